"""Toxicity by maximum-scoring segment search.

Learning. Of labelled near copies (equal least hash of eight-word shingles, equal label) one is
taken, so that a much copied document counts once. A word's evidence is its log-odds of occurring in toxic against clean labelled
documents, each count smoothed by an informative Dirichlet prior: the word's share of all
documents of the corpus, times ``prior`` of the labelled ones. Words are
also counted by their first five and four characters, since a rare inflected form says little by
itself. Tokens (words or beginnings) whose log-odds stand ``min_z`` standard deviations above zero
make the lexicon. A word scores the log-odds of its most specific token there; every other word
scores a small negative drift, so that the mean score over the corpus is negative.

Search. One linear scan (Ruzzo and Tompa) finds all disjoint maximal-scoring segments of a text.
Under the corpus' word frequencies the scores of random segments follow an extreme-value
distribution: a segment of score S in a text of m words has E = K m exp(-lambda S) equals by
chance. lambda solves sum p exp(lambda s) = 1 over the corpus; K is its maximum-likelihood
estimate on clean labelled documents. Segments with E below ``max_e`` are passages.

Aggregation. The r best segments of a text have the sum statistic T = sum(lambda S - ln K m) with
tail probability exp(-T) T^(r-1) / (r! (r-1)!). The least of these over r is the text's evidence,
and a logistic curve, fitted on labelled documents, turns it into a score. A word's evidence is
that of occurring in a text, so here its later occurrences score as other words do.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import col, crc_mod, ddl, numbered, slices, stash, table, tidy

WORD = re.compile(r"\w+")
BREAK = re.compile(r"\W")
BLOCK = 1 << 20
EVIDENCE = 60.0

#: Bounds of the classifier's labelled samples, in rows. Samples are drawn by a hash of the id; where
#: there are fewer labelled rows, all of them are taken.
MAX_LABELS, MAX_CALIBRATION = 200_000, 20_000
#: Candidate words are counted over the corpus about so many at a time, all of them in the end.
WORDS_AT_ONCE = 200_000
SEEN = 100_000


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a lower-cased text, cut between words, so that a very long text never
    becomes one list of words."""
    start, n = 0, len(text)
    while n - start > BLOCK:
        m = BREAK.search(text, start + BLOCK)
        end = m.start() if m else n
        yield start, text[start:end]
        start = end
    yield start, text[start:]


def tokens(word: str) -> tuple[str, ...]:
    """A word and its beginnings, the most specific first."""
    return (word, f"{word[:5]}*", f"{word[:4]}*") if len(word) > 5 else (word, f"{word[:4]}*") if len(word) == 5 else (word,)


class Memo(dict):
    """What ``of`` makes of a word, remembered for up to MEMO words."""

    MEMO = 100_000

    def __init__(self, of):
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= self.MEMO:
            self.clear()
        self[word] = out = self.of(word)
        return out


@dataclass
class Passage:
    first: int  # words
    last: int
    score: float


@dataclass
class Lexicon:
    scores: dict[str, float]
    drift: float
    rate: float  # lambda
    k: float = 1.0
    slope: float = 1.0
    offset: float = 0.0
    max_e: float = 0.05

    def __post_init__(self):
        self.seen: set[str] = set()  # words looked up so far
        self.known: dict[str, float] = {}  # those of them that score

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def of(self, word: str) -> float | None:
        return next((s for t in tokens(word) if (s := self.scores.get(t)) is not None), None)

    def there(self, words: set[str]) -> set[str]:
        """Those of the words that score. Each is looked up once, as long as SEEN words are held."""
        if new := words - self.seen:
            if len(self.seen) > SEEN:
                self.seen, self.known, new = set(), {}, words
            self.seen |= new
            self.known.update((w, s) for w in new if (s := self.of(w)) is not None)
        return self.known.keys() & words

    def hits(self, text: str) -> tuple[int, list[tuple[int, float]], list[tuple[int, float]]]:
        """(words of the text, (number of the word, score) of those in the lexicon, the same
        without a word's later occurrences)."""
        n, found, once, seen = 0, [], [], set()
        for _, part in blocks(text.lower()):
            words = WORD.findall(part)
            if there := self.there(set(words)):
                for i, w in enumerate(words):
                    if w in there:
                        found.append((n + i, self.known[w]))
                        if w not in seen:
                            seen.add(w)
                            once.append(found[-1])
            n += len(words)
        return n, found, once

    def segments(self, hits: list[tuple[int, float]]) -> list[Passage]:
        """All maximal-scoring segments. A segment is (first, last, sum before, sum after, the
        nearest earlier one whose sum before is smaller)."""
        stack: list[tuple[int, int, float, float, int]] = []
        total, at = 0.0, 0
        for i, s in hits:
            total -= self.drift * (i - at)
            first, left = i, total
            total += s
            at = i + 1
            j = len(stack) - 1
            while True:
                while j >= 0 and stack[j][2] >= left:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= total:
                    break
                first, left = stack[j][0], stack[j][2]
                del stack[j:]
                j -= 1
            stack.append((first, i, left, total, j))
        return [Passage(a, b, right - left) for a, b, left, right, _ in stack]

    def expect(self, score: float, words: int) -> float:
        return self.k * max(words, 1) * math.exp(-self.rate * score)

    def evidence(self, scores: list[float], words: int) -> float:
        """-ln of the least tail probability over the r best of all segments; EVIDENCE at most either
        way. Segments that chance explains better than not add nothing, nor do those after them."""
        base = math.log(self.k * max(words, 1))
        best, t = min(-base, 0.0), 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            x = self.rate * s - base
            if x <= 0 and r > 1:
                break
            t += x
            best = max(best if r > 1 else x, t - (r - 1) * math.log(max(t, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
        return max(-EVIDENCE, min(EVIDENCE, best))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
        """(score, passages as first character, end, score, E)."""
        n, hits, once = self.hits(text)
        segments = self.segments(hits)
        score = self.probability(self.evidence([s.score for s in self.segments(once)], n))
        kept = [(s, e) for s in segments if (e := self.expect(s.score, n)) <= self.max_e]
        if not kept:
            return score, []
        wanted = sorted({i for s, _ in kept for i in (s.first, s.last)})
        spans, k, n = {}, 0, 0
        low = text.lower()
        for start, part in blocks(low):
            for m in WORD.finditer(part):
                if k < len(wanted) and n == wanted[k]:
                    spans[n] = (start + m.start(), start + m.end())
                    k += 1
                n += 1
        if len(low) != len(text):  # some letters are two in lower case: back to places of the text
            ends = np.cumsum([len(c.lower()) for c in text])
            spans = {n: (int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1) for n, (a, b) in spans.items()}
        return score, [(spans[s.first][0], spans[s.last][1], s.score, e) for s, e in kept]


def bounded(labels: DataFrame, id_col: str, bound: int, salt: int) -> DataFrame:
    """All rows, or where there are more than ``bound``, about ``bound`` of them by a hash of the id."""
    n = labels.count()
    if n <= bound:
        return labels
    return labels.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30)) < int(0.98 * bound / n * (1 << 30)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sketch, label): the least hash of a text's eight-word shingles."""
    memo = Memo(lambda w: zlib.crc32(w.encode("utf-8", "replace"))).__getitem__
    factors = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(8)], dtype=np.uint64)
    for batch in (part for whole in batches for part in slices(whole, 1)):
        out = []
        for text in batch.column(1).to_pylist():
            least = 1 << 64
            for _, part in blocks(text.lower()):
                words = np.fromiter(map(memo, WORD.findall(part)), np.uint64)
                if not len(words):
                    continue
                n = max(1, len(words) - 7)
                total = np.zeros(n, np.uint64)
                for k, f in enumerate(factors[: len(words)]):
                    total += words[k : k + n] * f
                total ^= total >> np.uint64(29)
                total *= np.uint64(0xBF58476D1CE4E5B9)
                least = min(least, int((total ^ total >> np.uint64(32)).min()))
            out.append(least - (1 << 63) if least < 1 << 64 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), batch.column(2)], names=["__id", "sketch", "label"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): in how many texts of the task each token occurs."""
    held: Counter[str] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(items := list(held.items())), 50_000):
            w, n = zip(*items[a : a + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
        held.clear()

    for batch in (part for whole in batches for part in slices(whole, 0)):
        for text in batch.column(0).to_pylist():
            held.update({t for w in {w for _, part in blocks(text.lower()) for w in WORD.findall(part)} for t in tokens(w)})
            if len(held) > 250_000:
                yield from flush()
    yield from flush()


def _counts(candidates) -> object:
    """(word, n, toxic, clean): in how many texts a candidate token occurs; under a null word the
    numbers of texts, and under an empty one n is the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = frozenset(t for t in candidates.value if t[-1] != "*")
        five, four = (frozenset(t[:-1] for t in candidates.value if t[-1] == "*" and len(t) == n + 1) for n in (5, 4))
        total, size = np.zeros(3, np.int64), 0
        texts, by = Counter(), (Counter(), Counter())
        for batch in (part for all_ in batches for part in slices(all_, 0)):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: set[str] = set()
                for _, part in blocks((text or "").lower()):
                    words = WORD.findall(part)
                    size += len(words)
                    held.update(words)
                own = [*(whole & held), *(f"{t}*" for n, known in ((5, five), (4, four)) for t in known & {w[:n] for w in held if len(w) > max(n, 4)})]
                texts.update(own)
                total[0] += 1
                if label is not None:
                    total[2 - label] += 1
                    by[label].update(own)
        words = list(texts)
        cols = [[None, "", *words], [total[0], size, *(texts[w] for w in words)], [total[1], 0, *(by[1][w] for w in words)], [total[2], 0, *(by[0][w] for w in words)]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["word", "n", "toxic", "clean"])

    return run


def _outstanding(counts: list, whole, prior: float, min_odds: float, min_z: float) -> Iterator[tuple[str, float, int]]:
    """(token, log-odds, texts) of the tokens that stand out in toxic documents."""
    a0 = prior * (whole["toxic"] + whole["clean"])
    for r in counts:
        if not r["word"]:
            continue
        a = a0 * r["n"] / whole["n"]
        t, c = r["toxic"] + a, r["clean"] + a
        odds = math.log(t / (whole["toxic"] + a0 - t + 1e-9)) - math.log(c / (whole["clean"] + a0 - c + 1e-9))
        if odds >= min_odds and odds >= min_z * math.sqrt(1 / t + 1 / c):
            yield r["word"], odds, r["n"]


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float = 0.1,
    min_texts: int = 3,
    min_z: float = 2.5,
    min_odds: float = 2.0,
    density: float = 0.1,
    max_e: float = 0.05,
) -> Lexicon:
    """Learns from the labelled documents; word frequencies come from all documents.

    labels: (id, 0 or 1); rows with a null in either are left out, of several labels of one id the
    greatest counts. density: share of lexicon words expected in a toxic passage; it sets the
    drift. Without labelled documents, or without a word that stands out, every text gets the
    share of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    texts = docs.select(col(id_col).alias("__id"), col(text_col).alias("text"))
    marks = labels.select(col(id_col).alias("__id"), col(label_col).cast("int").alias("label")).filter("__id is not null and label in (0, 1)").groupBy("__id").agg(F.max("label").alias("label"))
    # at most MAX_LABELS rows of a long and an int: this side may be sent to every task
    labelled = texts.filter("text is not null").join(F.broadcast(bounded(marks, "__id", MAX_LABELS, 1)), "__id")
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = labelled.select("__id", "text", "label").mapInArrow(tidy(_sketches), f"__id {kind}, sketch long, label int")
    marks = stash(sketched.groupBy("sketch", "label").agg(F.min("__id").alias("__id")).select("__id", "label"), "labelled")
    sample = F.broadcast(marks)
    toxic = texts.filter("text is not null").join(sample.filter("label = 1"), "__id", "left_semi")
    found = toxic.select("text").mapInArrow(tidy(_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_texts)
    found = stash(found, "tokens")
    lexicon = Lexicon({}, 1.0, 1.0, max_e=max_e)
    slices = max(1, -(-found.count() // WORDS_AT_ONCE))
    marked = texts.join(sample, "__id", "left").select("text", "label")
    kept: list[tuple[str, float, int]] = []  # (token, log-odds, texts) of those that stand out
    for nth in range(slices):
        candidates = frozenset(r["word"] for r in found.filter(F.pmod(F.xxhash64("word"), F.lit(slices)) == nth).collect())
        sent = spark.sparkContext.broadcast(candidates)
        counts = marked.mapInArrow(tidy(_counts(sent)), "word string, n long, toxic long, clean long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "clean")]).collect()
        sent.destroy()
        words = next((r["n"] for r in counts if r["word"] == ""), 0)
        whole = next((r for r in counts if r["word"] is None), None)
        if whole is None or not whole["toxic"] or not whole["clean"]:
            only = whole is not None and whole["toxic"] and not whole["clean"]
            lexicon.slope, lexicon.offset = 0.0, 30.0 if only else -30.0
            return lexicon
        kept += _outstanding(counts, whole, prior, min_odds, min_z)
    kept.sort()
    lexicon.scores = {w: odds for w, odds, _ in kept}
    p = np.array([n / max(1, words) for *_, n in kept])
    s = np.array(list(lexicon.scores.values()))
    if len(s):
        lexicon.drift = max(-math.log1p(-density), 2 * float(p @ s))
        low, high = 1e-6, 50.0
        for _ in range(200):  # the moment generating function is convex, below 1 and then above
            mid = (low + high) / 2
            value = float(p @ np.exp(np.minimum(mid * s, 700))) + (1 - p.sum()) * math.exp(-mid * lexicon.drift)
            low, high = (mid, high) if value < 1 else (low, mid)
        lexicon.rate = low
    _calibrate(lexicon, texts, marks)
    return lexicon


def _calibrate(lexicon: Lexicon, texts: DataFrame, marks: DataFrame) -> None:
    """K and the logistic curve, from at most about MAX_CALIBRATION labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            out = []
            for text in batch.column(0).to_pylist():
                n, _, once = lexicon.hits(text or "")
                out.append((n, sorted((x.score for x in lexicon.segments(once)), reverse=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64())), batch.column(1)], names=["words", "scores", "label"])

    some = F.broadcast(bounded(marks, "__id", MAX_CALIBRATION, 2))
    rows = texts.join(some, "__id").select("text", "label").mapInArrow(tidy(run), "words long, scores array<double>, label int").collect()
    clean = [r for r in rows if r["label"] == 0]
    tail = sum(max(r["words"], 1) * math.exp(-lexicon.rate * (r["scores"][0] if r["scores"] else 0.0)) for r in clean)
    lexicon.k = max(1, sum(1 for r in clean if r["scores"])) / max(tail, 1.0)
    x = np.array([lexicon.evidence(list(r["scores"]), r["words"]) for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    if not len(x):
        lexicon.slope, lexicon.offset = 0.0, -30.0
        return
    # Newton's method with a weak pull of the slope to 0, so that separable classes have an end
    w = np.array([0.0, math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])
    z = np.stack([x, np.ones(len(x))], 1)
    pull = np.diag([1.0, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    lexicon.slope, lexicon.offset = float(max(w[0], 0.0)), float(w[1])


PASSAGES = "array<struct<start:int,end:int,score:double,expect:double>>"


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", threshold: float = 0.5, batch_bytes: int = 2 << 20) -> DataFrame:
    """The documents with score (0 to 1), predicted (1 if score >= threshold) and passages
    (characters of the text, start to end, segment score, E; in order, disjoint); columns of these names are
    replaced, all others stay.

    Null and empty texts have no passage and the score of no evidence in no words. Whole texts are
    read, very long ones block by block. Repeated rows get equal results; an empty table stays
    empty. Each task holds about ``batch_bytes`` of text, or one text where that is longer.
    """
    added = ["score", "predicted", "passages"]
    kept = [c for c in docs.columns if c.lower() not in added]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names, at = [*kept, *added], kept.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expect", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value.judge
        for whole in batches:
            for part in slices(whole, at, batch_bytes):
                out = [judge(t or "") for t in part.column(at).to_pylist()]
                score = np.array([x[0] for x in out], dtype=np.float64)
                spans = pa.array([[dict(zip(("start", "end", "score", "expect"), p)) for p in x[1]] for x in out], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), spans], names=names)

    schema = ", ".join([ddl(docs.schema[c] for c in kept), "score double", "predicted int", f"passages {PASSAGES}"])
    return numbered(docs, kept).mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score_toxicity(docs.select("doc_id", "text", held_out().alias("held_out")), lexicon)
    return scored.select("doc_id", "held_out", "score", "predicted", "passages")
