import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.llm import toxicity


def brute_segments(values):
    """All maximal segments by their definition: a segment scores more than each of its proper
    parts, and no longer segment with that property holds it."""
    n = len(values)
    total = [0, *itertools.accumulate(values)]
    sums = {(i, j): total[j] - total[i] for i in range(n) for j in range(i + 1, n + 1)}
    good = [(i, j) for (i, j), s in sums.items() if s > 0 and all(sums[a, b] < s for a in range(i, j) for b in range(a + 1, j + 1) if (a, b) != (i, j))]
    return sorted(x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([None, None, 2, 3, 5]), max_size=14))
def test_segments_are_maximal(marks):
    lexicon = toxicity.Lexicon({}, drift=1, rate=1)
    got = [(p.first, p.last + 1) for p in lexicon.segments([(i, m) for i, m in enumerate(marks) if m])]
    assert got == brute_segments([-1 if m is None else m for m in marks])


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    words = ["tree", "river", "stone", "cloud", "house", "green", "walk", "read", "song", "light"]
    bad = ["vileword", "foulword", "badword", "rudeword"]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text), 9.9, "p"))
        labels.append((i, int(toxic)))
    odd = [(1000, None, 0.0, ""), (1001, "", 0.0, ""), (None, "vileword badword foulword", 0.0, ""), (1002, "tree1 " * 400_000 + "badword vileword foulword rudeword", 0.0, ""), (5, docs[5][1], 0.0, "")]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, score double, passages string").withColumnRenamed("passages", "source")
    return frame, spark.createDataFrame([*labels, (None, 1), (7, None), (8, 0), (8, 0)], "doc_id long, toxic int")


def test_learns_and_judges(spark, made):
    docs, labels = made
    lexicon = toxicity.train(docs, labels.filter("doc_id % 5 <> 0"))
    assert {"vileword", "foulword", "badword", "rudeword"} <= set(lexicon.scores)
    rows = toxicity.score_toxicity(docs, lexicon).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    held = [i for i in range(0, 600, 5)]
    assert sum(by[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert by[1000].predicted == by[1001].predicted == 0 and by[1000].passages == [] and by[None].predicted == 1 and by[1002].predicted == 1
    p = by[1002].passages[-1]
    assert by[1002].text[p.start : p.end] == "badword vileword foulword rudeword"
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


def test_passages_are_places_of_the_text():
    """Also where a letter is two in lower case."""
    lexicon = toxicity.Lexicon({"bad": 9.0, "wörse": 9.0, "ll": 9.0}, drift=0.5, rate=1.0, k=0.1)
    for text, want in (("İİİ good bad", ["bad"]), ("İ BAD wörse x " + "good " * 60 + "İLL İ", ["BAD wörse", "LL"]), ("bad", ["bad"]), ("ΣΑΣ İbad bad", ["bad bad"])):
        assert [text[a:b] for a, b, *_ in lexicon.judge(text)[1]] == want


def test_all_segments_count(monkeypatch):
    """Evidence goes on growing beyond any number of segments, as the sum statistic says."""
    monkeypatch.setattr(toxicity, "EVIDENCE", 1e9)
    lexicon = toxicity.Lexicon({}, drift=1, rate=1, k=1.0)

    def slow(scores, words):
        base, best = math.log(words), None
        for r in range(1, len(scores) + 1):
            x = [s - base for s in sorted(scores, reverse=True)[:r]]
            if x[-1] <= 0 and r > 1:
                break
            t = sum(x)
            value = t if r == 1 else t - (r - 1) * math.log(max(t, 1.0)) + math.lgamma(r + 1) + math.lgamma(r)
            best = value if best is None else max(best, value)
        return max(-toxicity.EVIDENCE, min(toxicity.EVIDENCE, best))

    rng = random.Random(3)
    for n in (1, 5, 63, 64, 65, 90, 300):
        scores = [math.log(1000) + rng.random() * 0.2 for _ in range(n)]
        assert math.isclose(lexicon.evidence(scores, 1000), slow(scores, 1000))
    assert lexicon.evidence([math.log(1000) + 0.3] * 300, 1000) != lexicon.evidence([math.log(1000) + 0.3] * 64, 1000)


def test_candidates_in_slices(spark, made, monkeypatch):
    """However many words are counted at a time, the lexicon is the same."""
    docs, labels = made
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 40)
    part = toxicity.train(docs, labels)
    assert part.scores == whole.scores and math.isclose(part.rate, whole.rate) and math.isclose(part.slope, whole.slope, rel_tol=1e-6)


def test_odd_names(spark, made):
    docs, labels = made
    lexicon = toxicity.train(docs.select(docs.doc_id.alias("a.b"), docs.text.alias("t.x")), labels.withColumnRenamed("doc_id", "a.b"), id_col="a.b", text_col="t.x")
    got = toxicity.score_toxicity(docs.select("doc_id", docs.text.alias("t.x"), docs.source.alias("SCORE")).limit(5), lexicon, text_col="t.x")
    assert got.columns == ["doc_id", "t.x", "score", "predicted", "passages"] and got.count() == 5


def test_without_labels(spark, made):
    docs, labels = made
    for own in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.train(docs, own)).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_held_out_labels(spark):
    rows = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").collect()
    want = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = [r for r in rows if r.held_out and r.doc_id in want]
    assert len(rows) == 10_000 and sum(r.predicted == want[r.doc_id] for r in out) >= 0.97 * len(out)
    assert sum(r.predicted for r in out if want[r.doc_id]) >= 0.85 * sum(want[r.doc_id] for r in out)


def test_rare_forms_count_by_their_beginnings(spark):
    """Toxic words that never come twice in the same form, in held-out texts in forms never seen."""
    rng = random.Random(11)
    words = ["tree", "river", "stone", "cloud", "house", "green", "walk", "read", "song", "light"]
    docs, labels = [], []
    for i in range(300):
        text = [rng.choice(words) + str(rng.randrange(30)) for _ in range(60)]
        for k in range(4 if i % 5 == 0 else 0):
            text.insert(rng.randrange(len(text)), f"{rng.choice(['vilem', 'fouln', 'réeux'])}{i}x{k}")
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id < 150"))
    assert {"vilem*", "fouln*", "réeux*"} <= set(lexicon.scores)
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(frame, lexicon).collect()}
    assert sum(got[i] for i in range(150, 300) if i % 5 == 0) >= 28 and sum(got[i] for i in range(150, 300) if i % 5) <= 1
