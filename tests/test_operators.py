"""Region, header, reference and sequence operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import bins as B
from strandframe.operators import header as H
from strandframe.operators import references as N
from strandframe.operators import regions as G
from strandframe.operators import sequences as S
from strandframe.sources.records import bin_of


def test_bins(spark):
    rng = random.Random(2)
    rows = [(b := rng.randrange(2**29 - 1), min(2**29, b + rng.choice([0, 1, 100, 20_000, 3_000_000]))) for _ in range(300)]
    got = spark.createDataFrame(rows, "b int, e int").select("b", "e", B.reg2bin(F.col("b"), F.col("e")).alias("bin"), B.reg2bins(F.col("b"), F.col("e")).alias("bins")).collect()
    for r in got:
        assert r.bin == bin_of(r.b, r.e) and r.bin in r.bins and len(set(r.bins)) == len(r.bins)
    v = spark.range(1).select(B.split_voffset(F.lit((123456789 << 16) | 65535)).alias("s"), B.make_voffset(F.lit(123456789), F.lit(65535)).alias("v")).first()
    assert tuple(v.s) == (123456789, 65535) and v.v == (123456789 << 16) | 65535


def test_overlap_join(spark):
    rng = random.Random(3)
    spans = lambda n: [(i, rng.randrange(3), b := rng.randrange(100_000), b + rng.choice([0, 1, 50, 20_000, 60_000])) for i in range(n)]
    a, b = spans(150), spans(120)
    left = spark.createDataFrame(a, "l int, ref_id int, beg int, end int")
    right = spark.createDataFrame(b, "r int, ref_id int, b2 int, e2 int")
    got = sorted((x.l, x.r) for x in G.overlap_join(left, right, right_range=("b2", "e2")).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < max(y[3], y[2] + 1) and y[2] < max(x[3], x[2] + 1))


def test_jump(spark):
    rng = random.Random(4)
    recs = sorted((rng.choice([0, 0, 2]), rng.randrange(50_000), rng.choice([1, 10, 9000])) for _ in range(300))
    rows = [(r, p, p + n, v) for v, (r, p, n) in enumerate(recs)] + [(-1, -1, 0, 999)]
    asked = [(i, rng.randrange(4), rng.randrange(60_000)) for i in range(100)]
    frame = spark.createDataFrame(rows, "ref_id int, pos int, end0 int, voffset long")
    got = {r.region_id: r.voffset for r in G.jump_first(frame, spark.createDataFrame(asked, "region_id int, ref_id int, start int")).collect()}
    want = {}
    for i, ref, s in asked:
        hit = [v for r, _, e, v in rows if r == ref and e > s or r > ref]
        if hit:
            want[i] = min(hit)
    assert got == want


def test_no_window_by_reference(spark):
    """A reference, however long, is sorted in no task: neither for jumps nor for chunks, orders, indexes."""
    recs = spark.createDataFrame([(0, 1, 5, 1)], "ref_id int, pos int, end0 int, voffset long")
    lines = spark.createDataFrame([("s", 0, "ACGT", 5)], "name string, line_no int, bases string, line_len int")
    regions = spark.createDataFrame([("s", 0, 1)], "name string, beg int, fin int")
    names = spark.createDataFrame([("s", 0)], "name string, fai_idx int")
    for df in (G.jump_first(recs, spark.createDataFrame([(0, 0, 0)], "region_id int, ref_id int, start int")), G.sort_regions(regions, names), S.build_fai(lines), S.chunks(lines)):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_long_sequence_in_chunks(spark):
    """Many lines of one sequence, with nothing broadcast: the join with its shape loads no single task."""
    lines = spark.range(20_000).select(F.when(F.col("id") < 19_000, "long").otherwise(F.concat(F.lit("s"), F.col("id") % 97)).alias("name"), F.col("id").cast("int").alias("line_no"), F.lit("ACGTACGTAC").alias("bases"))
    lines = lines.filter("name = 'long' or line_no >= 19000").repartition(8)
    got = S.chunks(lines, 1000)
    assert got.filter("name = 'long'").count() == 190 and got.agg(F.sum(F.length("bases"))).first()[0] == 200_000


def test_idxstats(spark):
    rows = spark.createDataFrame([(0, 0), (0, 4), (0, 16), (1, 5), (-1, 4), (-1, 77)], "ref_id int, flag int")
    assert sorted(map(tuple, N.idxstats(rows).collect())) == [(-1, 0, 2), (0, 2, 1), (1, 0, 1)]


def test_sort_and_fix_regions(spark):
    names = spark.createDataFrame([("b", 0), ("a", 1)], "name string, fai_idx int")
    rows = [("a", 5, 9), ("b", 7, 8), ("b", 2, 3), ("z", 0, 1), ("a", 5, 6)]
    frame = spark.createDataFrame(rows, "name string, beg int, end int")
    assert [tuple(r)[:3] for r in G.sort_regions(frame, names).orderBy("position").collect()] == [("b", 2, 3), ("b", 7, 8), ("a", 5, 6), ("a", 5, 9)]
    assert [tuple(r)[:3] for r in G.sort_regions(frame, names.limit(0)).orderBy("position").collect()] == sorted(rows)
    fixed = spark.createDataFrame([(None, 5), (9, 3), (1, 50), (1, 9)], "b int, e int").select(*G.fix_region(F.col("b"), F.col("e"), F.lit(20))).collect()
    assert [tuple(r) for r in fixed] == [(0, 5), (9, 20), (1, 20), (1, 9)]


HEADER = "@HD\tVN:1.6\r\n\n@SQ\tSN:b\tLN:7\tSN:bb\n@CO\tfree: text\tkept\n@RG\tID:x\tnocolon\tDS:a:b\n@SQ\tSN:c\tLN:1\n@PG"


def test_header(spark):
    records = H.header_records(H.header_lines(HEADER, spark))
    got = [(r.code, None if r.tags is None else [tuple(t) for t in r.tags], r.comment) for r in records.orderBy("rec_idx").collect()]
    assert got == [("@HD", [("VN", "1.6")], None), ("@SQ", [("SN", "bb"), ("LN", "7")], None), ("@CO", None, "free: text\tkept"), ("@RG", [("ID", "x"), ("DS", "a:b")], None), ("@SQ", [("SN", "c"), ("LN", "1")], None), ("@PG", [], None)]
    assert [r["id"] for r in H.read_groups(records).collect()] == ["x"]
    refs = spark.createDataFrame([(0, "c", 1), (1, "new", 5)], "ref_id int, name string, length int")
    assert H.header_text(records, refs).first()[0] == "@HD\tVN:1.6\n@SQ\tSN:bb\tLN:7\n@SQ\tSN:c\tLN:1\n@SQ\tSN:new\tLN:5\n@CO\tfree: text\tkept\n@RG\tID:x\tDS:a:b\n@PG"
    bare = H.header_records(H.header_lines("@HD\tVN:1.6\n@CO\tx", spark))
    assert H.header_text(bare, refs).first()[0] == "@SQ\tSN:c\tLN:1\n@SQ\tSN:new\tLN:5\n@HD\tVN:1.6\n@CO\tx"
    assert H.header_text(bare, refs, "spec").first()[0] == "@HD\tVN:1.6\n@SQ\tSN:c\tLN:1\n@SQ\tSN:new\tLN:5\n@CO\tx"


def test_reference_lookups(spark):
    refs = spark.createDataFrame([(0, "a", 10), (1, "b", 20), (2, "a", 30)], "ref_id int, name string, length int")
    recs = spark.createDataFrame([(0, 0), (1, 0), (-1, -1), (1, -1), (-1, 2)], "ref_id int, next_ref_id int")
    out = N.with_mate(N.with_reference(recs, refs), refs).collect()
    assert sorted((r.ref_id, r.ref_name, r.ref_length, r.rnext) for r in out) == sorted([(0, "a", 10, "="), (1, "b", 20, "a"), (-1, "*", None, "*"), (1, "b", 20, "*"), (-1, "*", None, "a")], key=str) or sorted(map(str, [(r.ref_id, r.ref_name, r.ref_length, r.rnext) for r in out])) == sorted(map(str, [(0, "a", 10, "="), (1, "b", 20, "a"), (-1, "*", None, "*"), (1, "b", 20, "*"), (-1, "*", None, "a")]))
    ids = N.reference_ids(spark.createDataFrame([("a",), ("b",), ("z",)], "name string"), refs).collect()
    assert {r.name: r.ref_id for r in ids} == {"a": 0, "b": 1, "z": None}


def test_sequences(spark):
    seqs = {"s1": "ACGTACGTACGTACG", "s2": "TTTT", "s3": "A"}
    lines = [(n, 10 * k + j, s[i : i + 5], 6) for k, (n, s) in enumerate(seqs.items()) for j, i in enumerate(range(0, len(s), 5))]
    body = spark.createDataFrame(lines, "name string, line_no int, bases string, line_len int")
    fai = S.build_fai(body)
    assert {r.name: r.len for r in fai.collect()} == {n: len(s) for n, s in seqs.items()}
    rng = random.Random(5)
    sites = [(i, rng.choice(["s1", "s2", "s3", "none"]), rng.randrange(20), rng.randint(1, 18)) for i in range(200)]
    frame = spark.createDataFrame(sites, "site_id int, name string, position int, length int")
    for size in (5, 10, 100):
        got = {r.site_id: r.bases for r in S.sequence_at(frame, S.chunks(body, size), fai, strict=False, sequence_filter=F.lower).collect()}
        for i, n, p, length in sites:
            if n not in seqs:
                assert got[i] == "N" * length
            else:
                p = len(seqs[n]) - 1 if p > len(seqs[n]) else p
                assert got[i] == seqs[n][p : p + length].ljust(length, "N").lower()
    for bad in [(1, "s2", 5, 1), (1, "s2", 3, 2), (1, "s2", 4, 1), (1, "s2", -1, 1), (1, "s2", 0, 0)]:
        with pytest.raises(Exception, match="no such slice"):
            S.sequence_at(spark.createDataFrame([bad], "site_id int, name string, position int, length int"), S.chunks(body), fai).collect()
    sizes = S.sizes(spark.createDataFrame([("s1",), ("none",)], "name string"), fai).collect()
    assert {r.name: r["size"] for r in sizes} == {"s1": 15, "none": 255_000_000}


def test_body_lines(spark):
    text = [(0, ">a x", 5), (1, "ACGT", 5), (2, "AC", 3), (3, "", 1), (4, ">b", 3), (5, "TT", 3)]
    got = S.body_lines(spark.createDataFrame(text, "line_no int, line string, line_len int")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "ACGT", 5), ("a", 2, "AC", 3), ("b", 5, "TT", 3)]
    many = [(k, f">s{k // 3000}" if k % 3000 == 0 else "ACGT", 5) for k in range(12_000)]  # sequences longer than a run
    long = S.body_lines(spark.createDataFrame(many, "line_no int, line string, line_len int")).groupBy("name").count().collect()
    assert {r.name: r["count"] for r in long} == {f"s{k}": 2999 for k in range(4)}
    with pytest.raises(Exception, match="outside a sequence"):
        S.body_lines(spark.createDataFrame([*text[:4], (4, "AA", 3)], "line_no int, line string, line_len int")).collect()


def test_overlap_sums(spark):
    """Numbers and sums of what overlaps, without a pair: half a million reads under as many regions."""
    rng = random.Random(6)
    spans = lambda n: [(i, rng.randrange(3), b := rng.randrange(60_000), b + rng.choice([0, 1, 50, 20_000, 60_000])) for i in range(n)]
    a, b = spans(150), [*spans(120), (120, 9, 0, 10)]
    left = spark.createDataFrame(a, "l int, ref_id int, beg int, end int")
    right = spark.createDataFrame(b, "r int, ref_id int, b2 int, e2 int")
    got = {x.r: (x.n, x.total) for x in G.overlap_sums(left, right, "beg", right_range=("b2", "e2")).collect()}
    pairs = [(y[0], x[2]) for x in a for y in b if x[1] == y[1] and x[2] < max(y[3], y[2] + 1) and y[2] < max(x[3], x[2] + 1)]
    assert got == {r: (len(own := [v for k, v in pairs if k == r]), sum(own)) for r in {k for k, _ in pairs}}
    n = 500_000
    reads = spark.range(n).select(F.lit(0).alias("ref_id"), F.col("id").alias("beg"), (F.col("id") + 1).alias("end"))
    regions = spark.range(n).select("id", F.lit(0).alias("ref_id"), F.lit(0).alias("b2"), F.lit(n).alias("e2"))
    assert G.overlap_sums(reads, regions, "beg", right_range=("b2", "e2")).agg(F.count("*"), F.min("n"), F.max("total")).first()[:] == (n, n, n * (n - 1) // 2)


def test_overlap_join_by_lengths(spark):
    """Short ranges are not compared with all of a bin of fixed width, whatever long ones there are."""
    rng = random.Random(7)
    spans = lambda n: [(i, rng.randrange(2), b := rng.randrange(5_000_000), b + rng.choice([0, 1, 15, 16, 17, 64, 65, 5_000, 4_000_000])) for i in range(n)]
    a, b = spans(200), spans(200)
    left = spark.createDataFrame(a, "l int, ref_id int, beg int, end int")
    right = spark.createDataFrame(b, "r int, ref_id int, b2 int, e2 int")
    got = sorted((x.l, x.r) for x in G.overlap_join(left, right, right_range=("b2", "e2")).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < max(y[3], y[2] + 1) and y[2] < max(x[3], x[2] + 1))
    # a row per range and base would be 16,384 times as many candidates with bins of 2^14
    assert G.overlap_join(left.limit(0), right, right_range=("b2", "e2")).count() == 0
    text = G.overlap_join(left, right, right_range=("b2", "e2"))._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in text and ", 14)" not in text


def test_jump_compares_numbers(spark, monkeypatch):
    """Over all records positions are compared, not their order, which may be a text or a struct."""
    kinds, real = [], G.least_beyond
    monkeypatch.setattr(G, "least_beyond", lambda points, asked: kinds.append(dict(points.dtypes)["value"]) or real(points, asked))
    rows = [(0, 5, 5 + k % 7, f"n{k:03d}") for k in range(300)] + [(2, 1, 0, "z1"), (2, 1, 9, "z0")]
    recs = spark.createDataFrame(rows, "ref_id int, pos int, end0 int, voffset string")
    asked = [(1, 0, 5), (2, 0, 10), (3, 0, 11), (4, 1, 0), (5, 2, 8), (6, 2, 9), (7, 3, 0)]
    got = {r.region_id: r.voffset for r in G.jump_first(recs, spark.createDataFrame(asked, "region_id int, ref_id int, start int")).collect()}
    assert got == {1: "n001", 2: "n006", 3: "z0", 4: "z0", 5: "z0"} and set(kinds) == {"int"}
