"""CIGAR functions against a plain-Python reading of their definition, and known cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import cigar as C

OPS = "MIDNSHP=X"
#: (1-based position, CIGAR, insertions, deletions) of 26 reads. Fixed values.
KNOWN = [
    (1, "251M", [], []),
    (1, "3S248M", [], []),
    (1, "199M1D2M2I8M2D2M38S", [(202, 2)], [(199, 1), (210, 2)]),
    (1, "52S199M", [], []),
    (1, "10S156M85S", [], []),
    (2, "4M2I245M", [(5, 2)], []),
    (31, "251M", [], []),
    (111, "205M46S", [], []),
    (199, "112M1I138M", [(310, 1)], []),
    (554, "38S3M3I207M", [(556, 3)], []),
    (1785, "116M1D135M", [], [(1900, 1)]),
    (2526, "11S3M1D237M", [], [(2528, 1)]),
    (2883, "224M1D26M1S", [], [(3106, 1)]),
    (2941, "166M1D85M", [], [(3106, 1)]),
    (4099, "171M1I11M68S", [(4269, 1)], []),
    (5975, "10S5M1I1M1I233M", [(5979, 1), (5980, 1)], []),
    (6109, "66S2M1D9M1I173M", [(6120, 1)], [(6110, 1)]),
    (6800, "3S7M1D1M1D240M", [], [(6806, 1), (6808, 1)]),
    (7603, "12S2M1I1M2D235M", [(7604, 1)], [(7605, 2)]),
    (9931, "242M1I3M2D2M3S", [(10172, 1)], [(10175, 2)]),
    (10517, "32S6M1D4M1D2M1D207M", [], [(10522, 1), (10527, 1), (10530, 1)]),
    (11127, "222M3I6M2I5M13S", [(11348, 3), (11354, 2)], []),
    (13388, "218M2I9M1I1M2D11M9S", [(13605, 2), (13614, 1)], [(13615, 2)]),
    (14640, "241M2I3M2D5M", [(14880, 2)], [(14883, 2)]),
    (16365, "205M39I4M2I1M", [(16569, 39), (16573, 2)], []),
    (16390, "179M62I2M2D2M6S", [(16568, 62)], [(16570, 2)]),
]
#: Query positions (1-based, what to look for). Fixed values.
ASKED = [(200, "D"), (202, "I"), (211, "ID"), (212, "D"), (1901, "D"), (6111, "D"), (6809, "D"), (7606, "D"), (13605, "I"), (14885, "D")]
#: (number of the read above, query position): the pairs that are true. Fixed values.
FOUND = {(2, 200), (2, 202), (2, 211), (2, 212), (10, 1901), (16, 6111), (17, 6809), (18, 7606), (22, 13605), (23, 14885)}
#: How many query positions each read covers, by its ends. Fixed values.
COVERED = [4, 4, 4, 1, 0, 4, 4, 4, 4, 0, 1, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 1, 1, 0, 0]


def parse(text):
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), OPS.index(c)))
            n = ""
    return out


def plain(pos, ops, semantics):
    at, ins, dels = pos, [], []
    for n, op in ops:
        if op == 1:
            ins.append((at - 1, n))
        if op == 2:
            dels.append((at - 1, n))
        if op in (0, 2, 3, 7, 8) or op == 5 and semantics == "compat":
            at += n
    return ins, dels, at


def test_known_indels(spark):
    df = spark.createDataFrame([(p - 1, c) for p, c, *_ in KNOWN], "pos int, cigar string").withColumn("e", C.indels(F.col("pos"), C.parse_cigar(F.col("cigar"))))
    assert [([tuple(x) for x in r.e.insertions], [tuple(x) for x in r.e.deletions]) for r in df.collect()] == [(i, d) for *_, i, d in KNOWN]


def test_known_positions(spark):
    """Each read against the positions that it covers, both ends included."""
    reads = spark.createDataFrame([(i, p - 1, c) for i, (p, c, *_) in enumerate(KNOWN)], "i int, pos int, cigar string").withColumn("ops", C.parse_cigar(F.col("cigar")))
    asked = spark.createDataFrame(ASKED, "p int, kind string")
    both = reads.crossJoin(asked).filter((F.col("pos") + 1 <= F.col("p")) & (F.col("p") <= C.end_position(F.col("pos"), F.col("ops"))))
    got = both.select("i", "p", C.indel_at(C.indels(F.col("pos"), F.col("ops")), F.col("p"), F.contains("kind", F.lit("I")), F.contains("kind", F.lit("D"))).alias("hit")).collect()
    assert {(r.i, r.p) for r in got if r.hit} == FOUND
    assert [sum(r.i == i for r in got) for i in range(len(KNOWN))] == COVERED


@pytest.mark.parametrize("semantics", ["compat", "spec"])
def test_random_cigars(spark, semantics):
    import random

    rng = random.Random(4)
    rows = [(i, rng.randrange(10**6), "".join(f"{rng.randint(1, 300)}{rng.choice(OPS)}" for _ in range(rng.randrange(12)))) for i in range(400)]
    ops = C.parse_cigar(F.col("cigar"))
    df = spark.createDataFrame(rows, "i int, pos int, cigar string").select("i", C.indels(F.col("pos"), ops, True, semantics).alias("e"), C.end_position(F.col("pos"), ops, True, semantics).alias("end1"), C.end_position(F.col("pos"), ops, False, semantics).alias("end0"), C.render_cigar(ops, semantics).alias("text"))
    for r in df.collect():
        _, pos, text = rows[r.i]
        ins, dels, end = plain(pos + 1, parse(text), semantics)
        assert ([tuple(x) for x in r.e.insertions], [tuple(x) for x in r.e.deletions], r.end1, r.end0) == (ins, dels, end, end - 1)
        assert r.text == (text.replace("X", "M") if semantics == "compat" else text or "*")


def test_end_is_one_past_the_last_base(spark):
    """A read at 1 of 199 aligned bases ends at 200: one past its last base; inclusive is 199."""
    ops = C.parse_cigar(F.lit("52S199M"))
    row = spark.range(1).select(C.end_position(F.lit(0), ops).alias("a"), C.end_position(F.lit(0), ops, inclusive=True).alias("b")).first()
    assert tuple(row) == (200, 199)


def test_indel_at(spark):
    found = C.indels(F.lit(0), C.parse_cigar(F.lit("199M1D2M2I8M2D2M38S")))
    want = {(200, "D"): True, (202, "I"): True, (211, "ID"): True, (212, "D"): True, (213, "D"): False, (199, "D"): False, (202, "D"): False, (200, "I"): False}
    df = spark.createDataFrame([(p, k) for p, k in want], "p int, k string")
    got = df.select("p", "k", C.indel_at(found, F.col("p"), F.contains("k", F.lit("I")), F.contains("k", F.lit("D"))).alias("x")).collect()
    assert {(r.p, r.k): r.x for r in got} == want


def test_empty_and_unknown(spark):
    row = spark.range(1).select(C.parse_cigar(F.lit("*")).alias("a"), C.parse_cigar(F.lit(None).cast("string")).alias("b"), C.reference_span(C.parse_cigar(F.lit(""))).alias("c")).first()
    assert tuple(row) == ([], [], 0)
    bad = spark.range(1).select(C.render_cigar(F.array(F.struct(F.lit(1).alias("len"), F.lit(9).cast("byte").alias("op")))).alias("x"))
    with pytest.raises(Exception, match="unknown CIGAR op"):
        bad.collect()


def test_long_cigar_placeholder(spark):
    def ops(*pairs):
        return F.array(*[F.struct(F.lit(n).alias("len"), F.lit(o).cast("byte").alias("op")) for n, o in pairs])

    cg = F.array(F.struct(F.lit("CG").alias("tag"), F.array(F.lit(10 << 4).cast("long"), F.lit(3 << 4 | 1).cast("long")).alias("i")))
    df = spark.range(1).select(*[C.render_cigar(C.real_cigar(c, F.lit(13), cg), "spec").alias(f"c{i}") for i, c in enumerate([ops((13, 4), (500, 3)), ops((12, 4), (500, 3)), ops((13, 4), (500, 0))])])
    assert tuple(df.first()) == ("10M3I", "12S500N", "13S500M")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.sampled_from(OPS)), max_size=8))
def test_plain_parse_round_trip(pairs):
    text = "".join(f"{n}{o}" for n, o in pairs)
    assert "".join(f"{n}{OPS[o]}" for n, o in parse(text)) == text
