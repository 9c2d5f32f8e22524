import random

import numpy as np
import pytest

from strandframe.llm import minhash


def brute(docs, percent):
    """(n_shingles, component) by id, from all pairs."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, top = sorted(sets), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def docs():
    rng, out = random.Random(11), []
    word = lambda: "w" + str(rng.randrange(3000))
    for g in range(12):
        base = [word() for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 9)):  # chains and stars of near copies
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                base = text
            out.append(" ".join(text) if rng.random() < 0.5 else "\t".join(text).upper())
    hot = [word() for _ in range(120)]  # one large group: many pairs just below and above the threshold
    for _ in range(150):
        text = list(hot)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text))
    out += ["one two", "ONE two", "one two three four five", "one", "", None, "   \n", out[0], out[0]]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_brute_force(spark, docs, percent):
    rows = [*docs, docs[3], docs[3], (None, "no id"), (None, None)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int")
    got = minhash.near_duplicates(frame, threshold=percent / 100).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_one_id_with_different_texts(spark):
    """Each set is a document of that id; no link of either is lost."""
    rng = random.Random(1)
    v, w = ([f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(2))
    near = lambda x: " ".join([*x, "end"])
    rows = [(5, " ".join(v)), (5, " ".join(w)), (1, near(w)), (2, near(v)), (5, " ".join(v)), (7, "alone"), (7, "apart")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "`a.b` long, `text.x` string"), id_col="a.b", text_col="text.x").collect()
    assert sorted((r[0], r.n_shingles, r.component_id) for r in got) == sorted([(5, 96, 2), (5, 96, 2), (5, 96, 1), (1, 97, 1), (2, 97, 2), (7, 1, 7), (7, 1, 7)])


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prune_keeps_links():
    rng = np.random.default_rng(4)
    for j in (0.85, 0.9):
        a = rng.integers(0, 256, (2000, minhash.HASHES), dtype=np.uint8)
        b = np.where(rng.random(a.shape) < j, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
        assert len(minhash.may_link(a, b, 0.85, 1e-6)) == 2000
    c = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    assert len(minhash.may_link(a, c, 0.85, 1e-6)) == 0


def test_band_shape_misses_little():
    for t in (0.8, 0.85, 0.95):
        bands, rows = minhash.band_shape(t)
        assert (1 - t**rows) ** bands < 1e-6


def test_low_thresholds():
    bands, rows = minhash.band_shape(0.2)
    assert rows == 1 and (1 - 0.2) ** bands < 1e-6 and bands <= 64
    with pytest.raises(ValueError):
        minhash.band_shape(0.1)


def test_star_weighs_on_no_task(spark, monkeypatch):
    """One centre with most links, and one with many smaller neighbours: with nothing broadcast by Spark
    itself, no task of the joins gets far more rows than others."""
    from pyspark.sql import functions as F

    seen, meet = [], minhash.meet

    def watched(*args, **kw):
        out = meet(*args, **kw)
        seen.append([r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()])
        return out

    monkeypatch.setattr(minhash, "FEW_EDGES", 0)
    monkeypatch.setattr(minhash, "meet", watched)
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "8", "false")):
            spark.conf.set(c, v)
        star = spark.range(20_000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, 50_000).otherwise(F.col("id") + 100_000 - F.col("id") % 20).cast("long").alias("b")).repartition(8, "a")
        got = {r["id"]: r.comp for r in minhash.components(star).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert all(got[i] == (0 if i % 2 == 0 else i - i % 20 + 1) for i in range(20_000)) and got[50_000] == 0
    assert len(seen) >= 4 and all(max(x) <= 3 * sorted(x)[len(x) // 2] for x in seen if sum(x) > 1000)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r["id"]: r.comp for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
