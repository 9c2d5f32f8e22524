import random

import pytest

import corpus_pipeline
from strandframe.llm import byte_bpe, mixing

NAMES = ["toxicity", "language", "near_duplicates", "mixture", "tokens"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_small_tables(spark):
    """Each stage keeps the columns of documents and only drops what it is meant to."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n, held = docs.count(), docs
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, held, d).cache()
        assert after.columns == docs.columns
        assert after.select("doc_id").subtract(held.select("doc_id")).count() == 0
        sizes[name], held = after.count(), after
    assert n * 0.85 < sizes["toxicity"] < n and sizes["language"] >= 0.99 * sizes["toxicity"] and sizes["near_duplicates"] < sizes["language"]
    assert held.select("doc_id").distinct().count() == held.count()


def plain_components(docs, percent):
    """The smallest id of each text's group, from all pairs of texts."""
    words = [(i, (t or "").encode().lower().split()) for i, t in docs]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()) for i, w in words]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, least[find(k)]) for k, (i, _) in enumerate(sets)]


def test_stages_equal_slow_versions(spark):
    """Every stage over a whole table against what its rule says, document by document."""
    import math
    import hashlib

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from strandframe.llm import language_id, toxicity

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    lexicon = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    clean = corpus_pipeline.keep_clean(spark, docs, d)
    assert ids(clean) == sorted(i for i, r in rows.items() if lexicon.judge(r.text or "")[0] < 0.5)

    model = language_id.train(docs)
    told = {}
    for i, r in rows.items():
        lang, score, _ = model.predict([(r.text or "").encode()], np.array([any(c.isalpha() for c in r.text or "")]))
        if lang[0] != "und" and score[0] >= 0.5:
            told[i] = r.lang or lang[0]
    known = corpus_pipeline.keep_known_language(spark, docs, d)
    assert {r.doc_id: r.lang for r in known.collect()} == told

    one = corpus_pipeline.keep_one_of_near_copies(spark, docs, d)
    assert ids(one) == sorted(i for i, least in plain_components([(i, r.text) for i, r in rows.items()], 80) if i == least)

    sizes = {}
    for r in rows.values():
        sizes[r.source] = sizes.get(r.source, 0) + 1
    total, want = sum(math.sqrt(n) for n in sizes.values()), []
    for i, r in rows.items():
        rate = math.sqrt(sizes[r.source]) / total * len(rows) / sizes[r.source]
        u = int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n, p = n + 1, p * rate / (n + 1)
            c += p
        want += [i] * n
    assert ids(corpus_pipeline.mix_sources(spark, docs, d)) == sorted(want)

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.bpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).ranks, special_tokens={})
    for r in corpus_pipeline.tokenize(spark, docs, d).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(rows[r.doc_id].text or "") and r.n_tokens == len(r.ids) // 4 and r.round_trip


def test_near_copies_of_one_id(spark, tmp_path):
    """Different texts of an id are judged by themselves; of equal ones one row stays."""
    rng = random.Random(3)
    v, w = (" ".join(f"w{rng.randrange(4000)}" for _ in range(80)) for _ in range(2))
    rows = [(5, v, 1), (5, w, 2), (5, v, 3), (1, w + " end", 4), (7, "alone and short", 5), (7, "ALONE and short", 6), (None, v, 7), (8, "", 8), (8, "", 9), (9, None, 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, `a.b` int, text_hash string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    left = sorted(((r.doc_id if r.doc_id is not None else -1), (r.text or "").lower()) for r in got.collect())
    assert left == sorted([(5, v), (1, w + " end"), (7, "alone and short"), (-1, v), (8, ""), (9, "")])


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns that operators would add or replace come through every stage as they are."""
    names = "score, predicted, passages, lang_pred, bits_per_byte, copy, __cdf, set_digest, kept, component_id".split(", ")
    rows = [(i, f"some words of document number {i} and others {i * 7}", "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)).withColumnRenamed("copy", "a.b")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns[: len(docs.columns)] == docs.columns and (name != "tokens" or got.columns[len(docs.columns) :] == ["n_tokens", "ids", "round_trip"])
        kept = got.collect()
        assert kept and all(r[n] == f"{n if n != 'a.b' else 'copy'}{r.doc_id}" for r in kept for n in ["a.b", *(n for n in names if n != "copy")])


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip for r in rows) and all(len(r.ids) == 4 * r.n_tokens for r in rows)


@pytest.fixture()
def odd(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["haus", "baum", "strasse", "wald"]) + str(rng.randrange(50)) for _ in range(30)), "de" if i % 2 else None, "hot" if i % 3 else None, 1) for i in range(60)]
    rows += [(1, rows[1][1], "de", "hot", 1), (70, None, None, None, None), (71, "", "de", "s", 0), (None, rows[3][1], "de", "s", 1), (72, "123 456", "de", "s", 1), (73, rows[2][1] + " neu", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs, str(tmp_path)


def test_stages_on_odd_rows(spark, odd):
    docs, d = odd
    clean = corpus_pipeline.keep_clean(spark, docs, d)
    assert clean.count() == docs.count()
    known = corpus_pipeline.keep_known_language(spark, clean, d).collect()
    assert {70, 71, 72}.isdisjoint({r.doc_id for r in known}) and len(known) == docs.count() - 3 and {r.lang for r in known} == {"de"}
    one = corpus_pipeline.keep_one_of_near_copies(spark, docs, d).collect()
    ids = [r.doc_id for r in one]
    assert ids.count(1) == 1 and 73 not in ids and ids.count(None) == 1 and {70, 71, 72} <= set(ids)
    mixed = corpus_pipeline.mix_sources(spark, docs, d)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(docs).count()
    done = corpus_pipeline.tokenize(spark, docs, d).collect()
    assert len(done) == docs.count() and all(r.round_trip for r in done)


def test_stages_on_nothing(spark, odd):
    docs, d = odd
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
    assert byte_bpe.MEMO > 0
