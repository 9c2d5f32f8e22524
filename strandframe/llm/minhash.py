"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of k-word shingles (64-bit hashes of them). Equal sets fall into one class, a node
of the graph of links, so copies by the thousand cost one row each and meet in no pair. Nodes
get min-hash bands; where two share a band they are candidates.

Candidates are not all pairs of a band's bucket. First each member is paired with the bucket's
hub (its smallest node), and components are formed over the links that hold. Only buckets that
still hold several components go on: their members outside the largest component are compared
with all others, in blocks of signatures inside Python. Of the pairs that a comparison cannot
rule out, first the likeliest of each member are confirmed and components formed anew, then
more, until every pair left lies inside a component: all links of a group of near copies are
never listed, and no cap is set on a bucket or a member.

A pair's signatures are compared in batches. After m matches of n hashes the similarity has a
Beta(m + 1, n - m + 1) posterior under a uniform prior; the pair is pruned as soon as the
posterior's mass at or above the threshold falls below ``miss``. Pairs that survive all batches
are verified on their full shingle sets, so every link is exact; what can be lost is a pair that
shares no band (below 1e-6 at the threshold, by the choice of bands) or is pruned (``miss``).

Where rows meet what an aggregate says of their key (a digest, a bucket, a star's centre, a
component), keys with many rows are spread (``common.meet``): none of them weighs on one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import by_bytes, col, drop, meet, resident, stash, table, tidy

SHINGLE = 5
#: Hashes of a signature for verification, one byte each, and how many are compared at a time.
HASHES, BATCH = 512, 64
#: Rows that meet at once when a bucket's blocks are compared.
MEMBERS, OTHERS = 1024, 8192
#: Pairs of a document and a block that are confirmed first, the likeliest ones.
PARTNERS = 8


class _Words(dict):
    """64-bit hashes of words, for up to SIZE words."""

    SIZE = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.SIZE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def _factors(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The text's set of k-word shingles as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(resident("shingles", _Words).__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for i, f in enumerate(_factors(k)[:width]):
        total += h[i : i + n] * f
    return np.unique(_mix(total))


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """n min-hashes (32 bits each) of a set that isn't empty."""
    a, b = _permutations(n)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    low = hashes.astype(np.uint32)
    for s in range(0, len(low), 4096):
        part = low[s : s + 4096]
        x = part[None, :] * a[:, None]
        x += b[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band; its lowest six bits are the band's number."""
    parts = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i, f in enumerate(_factors(rows)):
        total = total + parts[:, i] * f
    return (_mix(total) & ~np.uint64(63) | np.arange(bands, dtype=np.uint64)).view(np.int64)


def band_shape(threshold: float, miss: float = 1e-6, most: int = 40) -> tuple[int, int]:
    """(bands, rows): the most rows for which at most ``most`` bands miss a pair at the threshold
    with a probability below ``miss``; for low thresholds, one row and up to 64 bands."""
    for rows in range(12, 0, -1):
        for bands in range(1, (64 if rows == 1 else most) + 1):
            if (1 - threshold**rows) ** bands < miss:
                return bands, rows
    raise ValueError(f"64 bands miss pairs at a threshold of {threshold} with a probability above {miss}")


@lru_cache(maxsize=16)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch: the fewest matches so far with which a pair goes on.

    P(S >= t | m of n) of a Beta(m + 1, n - m + 1) posterior is P(Binomial(n + 1, t) <= m). Bytes
    also match by chance, once in 256, which moves t up.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def may_link(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """For signatures row by row, bytes: the pairs that no batch rules out."""
    return surviving(a, b, threshold, miss)[0]


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that no batch rules out, their matches)."""
    todo, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[todo, part] == b[todo, part]).sum(1)
        todo, matches = todo[matches >= least], matches[matches >= least]
    return todo, matches


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sketch(bands: int, rows: int, k: int):
    """(id, text_hash, n, digest, bands) of each text; digest and bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), k)
                sizes.append(len(s))
                digests.append(_digest(s))
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_hash", "n", "digest", "bands"])

    return run


#: Bits of the largest filter by which documents that are no candidates are left out early.
FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter (two bits an id) of the distinct ids as 64-bit words, FILTER_BITS bits at most
    whatever their number; where there are very many, it just lets more rows pass."""
    n = ids.count()
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * max(n, 1) - 1).bit_length()))
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in (1, 2)])).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    words = spots.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _profile(found, bands: int, rows: int, k: int):
    """(id, digest, n, sig, keys, text) of the documents that the filter lets pass: what verification compares.
    Texts are compressed, as they travel several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = found.value
        for batch in batches:
            here = np.ones(batch.num_rows, bool)
            for c in ("h1", "h2"):
                spot = batch.column(c).to_numpy() % (64 * len(words))
                here &= words[spot >> 6] >> (spot & 63) & 1 == 1
            kept = batch.take(pa.array(np.flatnonzero(here)))
            for a, b in by_bytes([x or 0 for x in pa.compute.binary_length(kept.column("text")).to_pylist()], 4 << 20):
                part = kept.slice(a, b - a)
                digests, sizes, sigs, keys, packed = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    packed.append(zstandard.compress((text or "").encode()))
                    s = shingles(text, k)
                    sig = signature(s, max(HASHES, bands * rows)) if len(s) else np.zeros(HASHES, np.uint32)
                    digests.append(_digest(s))
                    sizes.append(len(s))
                    keys.append(band_keys(signature(s, bands * rows), bands, rows).tobytes() if len(s) else b"")
                    sigs.append(sig[:HASHES].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["id", "digest", "n", "sig", "keys", "text"])

    return run


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, 0), dtype)


def _prune(percent: int, miss: float):
    """The pairs (a, b) that signatures do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(may_link(_matrix(batch.column("a_sig"), np.uint8), _matrix(batch.column("b_sig"), np.uint8), percent / 100, miss))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


def _confirm(percent: int, k: int):
    """The pairs (a, b) that are links. Rows of one b come one after another, its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for i, b in enumerate(batch.column("b").to_pylist()):
                if held is None or b != last:
                    last, held = b, shingles(zstandard.decompress(batch.column("b_text")[i].as_py()).decode(), k)
                if linked(shingles(zstandard.decompress(batch.column("a_text")[i].as_py()).decode(), k), held, percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


def _with(pairs: DataFrame, profiles: DataFrame, column: str) -> DataFrame:
    """The pairs with a column of both sides' profiles."""
    a, b = (profiles.select(F.col("id").alias(x), F.col(column).alias(f"{x}_{column}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def prune(pairs: DataFrame, profiles: DataFrame, percent: int, miss: float) -> DataFrame:
    kind = pairs.schema["a"].dataType.simpleString()
    return _with(pairs, profiles, "sig").mapInArrow(tidy(_prune(percent, miss)), f"a {kind}, b {kind}")


#: Ids up to which profiles are looked through for them where they lie, before any is shuffled.
FEW_IDS = 1_000_000


def only(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    """The profiles of these ids, or all where there are many ids."""
    some = stash(ids.distinct(), "ids")
    return profiles.join(F.broadcast(some), "id", "left_semi") if some.count() <= FEW_IDS else profiles


def confirm(pairs: DataFrame, profiles: DataFrame, percent: int, k: int) -> DataFrame:
    """pairs: stashed, as they are read twice."""
    kind = pairs.schema["a"].dataType.simpleString()
    known = only(profiles, pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()))
    return _with(pairs, known, "text").mapInArrow(tidy(_confirm(percent, k)), f"a {kind}, b {kind}")


#: Edges up to which a node's edges may all meet in one task, as they fit there.
FEW_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): each id of an edge (a, b) with the least id that it is connected with.

    Alternating large and small stars: every node hands its neighbours to the least of them, until
    all edges lead to a component's least node. Each round is written to the shared folder, and
    the one before is deleted.
    """

    def told(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
        """The edges (a, b) with the m of their a."""
        if few:
            return rows.join(least.drop("n"), "a")
        return meet(rows, stash(least, "least"), ["a"], "n", spread=F.col("b"))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        return tuple(r)

    edges = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        few = before[0] <= FEW_EDGES
        back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = edges.union(back).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).filter("n > 0")
        large = told(back, least, few).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = large if few else stash(large, "edges")
        small = told(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), few)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last, edges = edges, stash(small.filter("a <> b").distinct(), "edges")
        drop(last, *([] if few else [large]))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct())


def _compare(percent: int, miss: float, bands: int, skip: int, most: int):
    """Block comparison inside buckets: (a, b, more, bucket, x, y), pairs and whether this block has
    others of a that were not named. Rows of one (bucket, blocks) come together, outsiders first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outer = None, []
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "x", "y", "role"))))
            ids, comp, n, outside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "n", "outside"))
            sig, keys = _matrix(batch.column("sig"), np.uint8), _matrix(batch.column("keys"), np.int64)
            out: list[tuple] = []
            start = 0
            while start < len(where):
                end = start + 1
                while end < len(where) and where[end] == where[start]:
                    end += 1
                rows = slice(start, end)
                block = (ids[rows], comp[rows], n[rows], outside[rows], sig[rows], keys[rows])
                if where[start][:3] != key:
                    key, outer = where[start][:3], []
                if where[start][3] == 0:
                    outer.append(block)
                else:
                    for o in outer:
                        out += [(*pair, *key) for pair in _block_pairs(o, block, key[0], percent, miss, skip, most)]
                start = end
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], t) for k, t in enumerate(kinds)], names=["a", "b", "more", "bucket", "x", "y"])

    return run


def _block_pairs(o: tuple, m: tuple, bucket: int, percent: int, miss: float, skip: int, most: int) -> list[tuple]:
    """Pairs of an outsider and a member that can be links, of each outsider the likeliest from number
    ``skip`` to ``most``; each comes up in its first common bucket only, and two outsiders once."""
    out = []
    ids, comp, n, outside, sig, keys = m
    for i in range(len(o[0])):
        near = (np.minimum(n, o[2][i]) * 100 >= percent * np.maximum(n, o[2][i])) & (comp != o[1][i]) & ~(outside & (ids < o[0][i]))
        at = np.flatnonzero(near)
        if not len(at):
            continue
        left, matches = surviving(np.broadcast_to(o[4][i], (len(at), o[4].shape[1])), sig[at], percent / 100, miss)
        at = at[left]
        same = keys[at] == o[5][i]
        first = o[5][i][same.argmax(1)] == bucket
        at, matches = at[first], matches[first]
        best = at[np.lexsort((ids[at], -matches))[skip:most]]
        out += [(int(o[0][i]), int(j), len(at) > most) for j in ids[best]]
    return out


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    k: int = SHINGLE,
    miss: float = 1e-6,
) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id, kept (the id is its component's),
    set_digest (of the shingle set, null without words) and text_hash (xxhash64 of the text).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct
    k-word shingles, or all words as one shingle where there are fewer than k. Two documents are
    linked if 100 * intersection >= 100 * threshold * union of their sets; component_id is the
    smallest id reachable over links. Null and empty texts and those without words have no
    shingle and stay alone. Rows of one id with equal sets are one document, with different sets
    each set is a document of that id; all come out as often as they went in. Rows with a null id
    link with nothing, have a null component_id and are kept. Whole texts are used, other columns
    are not read, an empty table gives an empty table.

    threshold: of a whole per cent, at least 0.2 (else ValueError: bands cannot serve it).
    """
    percent = round(100 * threshold)
    bands, rows = band_shape(percent / 100)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    sketch = texts.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(_sketch(bands, rows, k)), f"id {kind}, text_hash long, n long, digest binary, bands array<long>")
    sketches = stash(sketch, "sketches")
    # copies combine in their tasks: a class's bands travel once a task. Nodes are numbered when written
    own = sketches.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = stash(own.withColumn("node", F.monotonically_increasing_id()), "classes")

    # candidates: nodes that share a band
    banded = classes.select(F.col("node").alias("id"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("rows")).filter("rows > 1")
    members = stash(meet(banded, stash(shared, "shared"), ["bucket"], "rows", spread=F.col("id")).filter("hub is not null"), "buckets")
    # their texts: most others fall to a filter of bounded size before any is shuffled
    nodes = classes.select("node", F.col("rep").alias("id"), "digest")
    wanted = stash(nodes.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "wanted")
    found = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("id")))
    hashed = texts.filter("id is not null").select("id", "text", *[F.xxhash64("id", F.lit(i)).alias(f"h{i}") for i in (1, 2)])
    passed = hashed.mapInArrow(tidy(_profile(found, bands, rows, k)), f"id {kind}, digest binary, n long, sig binary, keys binary, text binary")
    exact = passed.join(wanted, ["id", "digest"]).groupBy("id", "digest", "node").agg(F.first(F.struct("n", "sig", "keys", "text")).alias("p"))
    profiles = stash(exact.select(F.col("node").alias("id"), "p.n", "p.sig", "p.keys", "p.text"), "profiles")
    found.destroy()

    stars = members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    # signatures travel first; texts only for pairs that they do not rule out
    links = stash(confirm(stash(prune(stars, profiles, percent, miss), "pairs"), profiles, percent, k), "links")
    joined = _closed(links, members, profiles, percent, miss, bands, k)
    drop(members, wanted, profiles)

    linked = stash(joined.join(classes.select(F.col("node").alias("id"), "rep"), "id"), "linked")
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("parts"))
    named = meet(linked, stash(least, "least"), ["comp"], "parts", spread=F.col("id")).select(F.col("id").alias("node"), "component_id")
    verdicts = classes.join(named, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"), "copies")
    out = meet(sketches.drop("bands"), stash(verdicts, "verdicts"), ["digest"], "copies", spread=F.col("id"))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"), F.col("digest").alias("set_digest"), "text_hash")


def _closed(links: DataFrame, members: DataFrame, profiles: DataFrame, percent: int, miss: float, bands: int, k: int) -> DataFrame:
    """(id, comp): the components over all links, those that ``links`` lacks included.

    A link inside a component adds nothing, so not all pairs that can be links are confirmed at
    once: in each round the PARTNERS likeliest ones of each outsider in each block, then components
    are formed anew, and the outsiders that had more go on with 16 times as many, until none has.
    """
    comps = components(links)
    blocks = stash(_blocks(members, comps), "blocks")
    rows, tried, skip, most = blocks, None, 0, PARTNERS
    while True:
        found = stash(_compared(rows, comps, profiles, percent, miss, bands, skip, most), "pairs")
        fresh = found.select("a", "b")
        if tried is not None and not skip:
            fresh = stash(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = stash(confirm(fresh, profiles, percent, k), "links")
        left = found.filter("more").select("bucket", "x", "y", F.col("a").alias("id")).distinct()
        some = not new.isEmpty()
        if left.isEmpty():
            return components(links.union(new)) if some else comps
        tried = fresh if tried is None else stash(tried.union(fresh), "pairs")
        if not some:  # the same order again: go on behind what was named
            skip = most
        else:
            links, skip = stash(links.union(new), "links"), 0
            comps = components(links)
        most *= 16
        outer = blocks.filter("role = 0").join(left, ["bucket", "x", "y", "id"], "left_semi")
        inner = blocks.filter("role = 1").join(left.select("bucket", "x", "y").distinct(), ["bucket", "x", "y"], "left_semi")
        rows = stash(outer.unionByName(inner), "blocks")


def _blocks(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, x, y, role, id, outside): members of buckets with several components, dealt so that each
    one outside the largest component (role 0) meets each member (role 1) in one block."""
    placed = members.select("bucket", "id").join(comps, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    mark = [F.bit_xor(F.xxhash64("id", F.lit(k))) for k in (3, 4)]
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"), *[m.alias(f"m{k}") for k, m in enumerate(mark)])
    apart = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("parts"), *[F.bit_xor(f"m{k}").alias(f"m{k}") for k in (0, 1)]).filter("parts > 1")
    # near copies share many bands: of buckets with the same members the one of the first band is
    # enough, and it is the first that any two of its members share
    once = apart.groupBy("m0", "m1", "all").agg(F.min_by(F.struct("bucket", "top"), F.col("bucket").bitwiseAND(F.lit(63))).alias("b")).select("b.bucket", "b.top", "all")
    split = once.select("bucket", F.col("top.comp").alias("main"), F.ceil(F.col("all") / MEMBERS).cast("int").alias("xs"), F.ceil((F.col("all") - F.col("top.c")) / OTHERS).cast("int").alias("ys"))
    seen = placed.join(split, "bucket").withColumn("outside", F.col("comp") != F.col("main"))
    spot = F.xxhash64("id")
    inner = seen.select("bucket", F.pmod(spot, "xs").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.lit(1).alias("role"), "id", "outside")
    outer = seen.filter("outside").select("bucket", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), F.pmod(spot, "ys").cast("int").alias("y"), F.lit(0).alias("role"), "id", "outside")
    return outer.union(inner)


def _compared(blocks: DataFrame, comps: DataFrame, profiles: DataFrame, percent: int, miss: float, bands: int, skip: int, most: int) -> DataFrame:
    """Pairs of different components that meet in a block and that signatures do not rule out."""
    known = only(profiles.select("id", "n", "sig", "keys"), blocks.select("id"))
    placed = known.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    dealt = blocks.join(placed, "id").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "role")
    return dealt.mapInArrow(tidy(_compare(percent, miss, bands, skip, most)), "a long, b long, more boolean, bucket long, x int, y int")


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_TEMPLATE = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from {docs}),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) end s from words),
grams as (select doc_id, unnest(s) g from sets),
common as (select a.doc_id x, b.doc_id y, count(*) c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from common join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * c >= {percent} * (len(p.s) + len(q.s) - c)),
pairs as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id r from sets union select reach.doc_id, pairs.y from reach join pairs on reach.r = pairs.x),
least as (select doc_id, min(r) component_id from reach group by doc_id)
select doc_id, len(s)::bigint n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)
"""
ORACLE = ORACLE_TEMPLATE.format(docs="documents", percent=85)
