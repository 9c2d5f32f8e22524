"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ``order``: how often each byte followed each
context in the learned documents. The statistics are frozen, so a text's code length is exact:
each byte is coded in the longest context that the tree has; there a byte that was seen costs
-log2(c / (n + d)) bits (c: its count, n: all counts, d: distinct bytes), and one that was not
costs the escape -log2(d / (n + d)) and goes on in the next shorter context, at last with 8 bits.
The language of the shortest code wins.

A tree is kept as the sorted windows of its longest order (context and byte in one integer); the
shorter orders are sums over it. All windows of a block of texts are coded at once: every
distinct window is coded once per language, and its code length is added up by text.

Models have no bound: all windows of all learned documents count. What grows with them, the orders
from SHARED on, is dealt to shards by a hash of the SHARED bytes before the coded one (all that a
window's contexts of these orders say is in its shard) of about SHARD windows each. Tasks write
the shards to the shared folder, and workers hold one of them at a time; where one is enough, it
stays. The short orders, 2^16 windows a language at most, go with the model.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import by_bytes, col, crc_mod, ddl, numbered, place, scratch_path, stash, table, tidy

ORDER = 3
BLOCK = 1 << 19
#: Orders below SHARED are part of every model; windows that a worker holds of the others at a time.
SHARED, SHARD = 2, 1_000_000
DENSE = 1 << 22
UND = "und"


def windows(parts: list[tuple[bytes, bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For (what comes before, bytes) pairs: one integer per byte, holding it and the ``order``
    bytes before it; and the border of each part in that array."""
    whole = b"".join(x for before, text in parts for x in (before[-order:].rjust(order, b"\0"), text)) if order else b"".join(t for _, t in parts)
    sizes = np.fromiter((len(t) for _, t in parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    n = len(whole) - order
    if not len(sizes) or n <= 0 or not ends[-1]:
        return np.zeros(0, np.uint32), np.concatenate([[0], ends])
    wide = np.ndarray((n,), dtype=">u4", buffer=whole + b"\0\0\0", strides=(1,)) >> (8 * (3 - order)) if order < 3 else np.ndarray((n,), dtype=">u4", buffer=whole, strides=(1,))
    keep = np.ones(n, bool)
    at = ends[:-1] + order * np.arange(len(sizes) - 1)
    for k in range(order):  # windows that end in the next part's lead
        keep[at[at + k < n] + k] = False
    return wide.astype(np.uint32)[keep], np.concatenate([[0], ends])


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct values, for each element an index into a table, size of the table); the values
    that belong to the table's entries come first. Halves are renumbered, so that a table of
    all pairs of halves that occur replaces sorting; where that is too large, it sorts."""
    low, high = (grams & 0xFFFF).astype(np.uint16), (grams >> 16).astype(np.uint16)
    maps = []
    for half in (low, high):
        there = np.zeros(65536, bool)
        there[half] = True
        maps.append((np.flatnonzero(there).astype(np.uint32), np.cumsum(there, dtype=np.int32) - 1))
    (lows, low_at), (highs, high_at) = maps
    if len(lows) * len(highs) > DENSE:
        values, at = np.unique(grams, return_inverse=True)
        return values, at, len(values)
    cell = high_at[high] * np.int32(len(lows)) + low_at[low]
    there = np.zeros(len(lows) * len(highs), bool)
    there[cell] = True
    used = np.flatnonzero(there)
    number = np.cumsum(there, dtype=np.int32) - 1
    return highs[used // len(lows)] << np.uint32(16) | lows[used % len(lows)], number[cell], len(used)


class Tree:
    """The context tree of one language, or its orders from ``order`` down to ``low``: (order, keys,
    bits of each, contexts, bits of escaping from each)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: int = 0):
        """keys: sorted distinct windows of the longest order."""
        self.levels = []
        keys, counts = keys.astype(np.uint32), counts.astype(np.float64)
        for k in range(order, low - 1, -1):
            contexts, first, d = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True) if k else (np.zeros(1, np.uint32), np.zeros(1, np.int64), np.array([len(keys)]))
            n = np.add.reduceat(counts, first) if len(keys) else np.zeros(0)
            seen = np.log2(np.repeat(n + d, d)) - np.log2(counts) if len(keys) else np.zeros(0)
            self.levels.append((k, keys, seen, contexts, np.log2(n + d) - np.log2(d) if len(keys) else np.zeros(0)))
            if k:
                short = keys & np.uint32((1 << (8 * k)) - 1)
                keys, at = np.unique(short, return_inverse=True)
                counts = np.bincount(at, counts, len(keys)) if len(keys) else counts

    def walk(self, grams: np.ndarray, out: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Adds to ``out`` what the windows at ``todo`` cost in these orders; returns those not yet coded."""
        for k, keys, seen, contexts, escape in self.levels:
            if not len(keys) or not len(todo):
                continue
            g = grams[todo] & np.uint32((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[at] == g
            out[todo[hit]] += seen[at[hit]]
            todo, g = todo[~hit], g[~hit]
            c = g >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            known = contexts[at] == c
            out[todo[known]] += escape[at[known]]
        return todo


def shard_of(grams, order: int, shards: int):
    """Number of a window's shard, for arrays and for SQL columns."""
    low = min(SHARED, order)
    if isinstance(grams, np.ndarray):
        context = (grams.astype(np.int64) >> 8) & ((1 << (8 * low)) - 1)
        return (context * 40503 & 65535) * shards >> 16
    context = F.shiftright(grams, 8).bitwiseAND(F.lit((1 << (8 * low)) - 1).cast("long"))
    return F.shiftright((context * 40503).bitwiseAND(F.lit(65535).cast("long")) * F.lit(shards), 16)


class Model:
    """trees: by language; with ``shards`` (paths of the shards' files) only the orders below
    SHARED, which are what is coded last."""

    def __init__(self, trees: dict[str, Tree], order: int, shards: list[str | None] | None = None):
        self.order, self.trees, self.shards = order, trees, shards or []
        self.held: tuple[int, dict[str, Tree]] = (-1, {})

    def __getstate__(self):
        return self.__dict__ | {"held": (-1, {})}

    def shard(self, nth: int) -> dict[str, Tree]:
        if self.held[0] != nth:
            self.held = (-1, {})
            trees: dict[str, Tree] = {}
            if self.shards[nth] is not None:
                fs, path = place(self.shards[nth])
                with fs.open_input_stream(path) as f:
                    file = np.load(io.BytesIO(f.read()))
                names = list(self.trees)
                for i in file["langs"].tolist():
                    tree = Tree(np.zeros(0, np.uint32), np.zeros(0), 0)
                    tree.levels = [(k, *(file[f"{i}-{k}-{j}"] for j in range(4))) for k in range(self.order, min(SHARED, self.order) - 1, -1)]
                    trees[names[i]] = tree
            self.held = (nth, trees)
        return self.held[1]

    def costs(self, blocks: list[np.ndarray]) -> list[np.ndarray]:
        """Bits of sorted distinct windows (rows) under each language (columns), block by block. Every
        shard is read once."""
        out = [np.zeros((len(self.trees), len(values))) for values in blocks]
        todo = [[np.arange(len(values))] * len(self.trees) for values in blocks]
        for nth in range(len(self.shards)):
            own = self.shard(nth)
            for b, values in enumerate(blocks):
                mine = np.flatnonzero(shard_of(values, self.order, len(self.shards)) == nth)
                for k, name in enumerate(self.trees):
                    if nth == 0:
                        todo[b][k] = []
                    todo[b][k].append(own[name].walk(values, out[b][k], mine) if name in own else mine)
        for b, values in enumerate(blocks):
            for k, tree in enumerate(self.trees.values()):
                rest = np.concatenate(todo[b][k]) if self.shards else todo[b][k]
                out[b][k][tree.walk(values, out[b][k], rest)] += 8
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        out = np.zeros((len(texts), len(self.trees)))
        parts, owner = [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), BLOCK):
                parts.append((t[max(0, a - self.order) : a], t[a : a + BLOCK]))
                owner.append(i)
        cuts = list(by_bytes([len(t) for _, t in parts], BLOCK))
        # block by block; with several shards all blocks at once, so that each shard is read once
        for some in [cuts] if len(self.shards) > 1 else [[c] for c in cuts]:
            coded = []
            for a, b in some:
                grams, ends = windows(parts[a:b], self.order)
                coded.append((a, b, ends, *distinct(grams)[:2]))
            for (a, b, ends, _, at), cost in zip(coded, self.costs([c[3] for c in coded])):
                for k in range(len(self.trees)):
                    total = np.concatenate([[0.0], np.cumsum(cost[k][at])])
                    np.add.at(out[:, k], owner[a:b], total[ends[1:]] - total[ends[:-1]])
        return out

    def predict(self, texts: list[bytes], letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its posterior under equal priors, bits per byte in it) of each text."""
        names, n = list(self.trees), len(texts)
        if not names:
            return [UND] * n, np.zeros(n), np.full(n, 8.0)
        bits = self.code_lengths(texts)
        best = bits.argmin(1)
        least = bits.min(1)
        score = 1 / np.exp2(least[:, None] - bits).sum(1)
        rate = least / np.maximum([len(t) for t in texts], 1)
        return [names[k] if ok else UND for k, ok in zip(best.tolist(), letters.tolist())], np.where(letters, score, 0.0), rate


def count_windows(docs: DataFrame, lang_col: str, text_col: str, order: int) -> DataFrame:
    """(lang, gram, n) over whole texts. Each task adds up its own windows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(pairs: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([p[1] for p in pairs]), len(keys)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, pairs in held.items():
                keys, n = merged(pairs)
                for a in range(0, len(keys), 100_000):
                    k = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n[a : a + 100_000])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = batch.column(1).filter(pa.array(langs == lang)).cast(pa.binary())
                for x, y in by_bytes(pc.binary_length(own).to_pylist(), BLOCK):
                    parts = [(t[max(0, a - order) : a], t[a : a + BLOCK]) for t in own.slice(x, y - x).to_pylist() for a in range(0, len(t), BLOCK)]
                    for a, b in by_bytes([len(t) for _, t in parts], BLOCK):
                        values, at, n = distinct(windows(parts[a:b], order)[0])
                        held.setdefault(lang, []).append((values, np.bincount(at, minlength=n)))
                        size += len(values)
            if size > 500_000:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
            if size > 1_000_000:
                yield from flush()
                size = 0
        yield from flush()

    known = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text")).filter("lang is not null and text is not null")
    return known.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _write_shards(folder: str, names: list[str], order: int):
    """(shard, path) of the files written from rows (shard, lang, gram, n), in this order. What a lost
    or repeated attempt wrote has another name and is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def written(nth: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            lang = pc.index_in(rows.column("lang"), value_set=pa.array(names, pa.string())).to_numpy()
            gram, n, arrays = rows.column("gram").to_numpy(), rows.column("n").to_numpy(), {"langs": np.unique(lang)}
            for i in arrays["langs"].tolist():
                own = lang == i
                for k, *parts in Tree(gram[own], n[own], order, min(SHARED, order)).levels:
                    arrays.update((f"{i}-{k}-{j}", part) for j, part in enumerate(parts))
            out = io.BytesIO()
            np.savez(out, **arrays)
            path = f"{folder}/shard-{nth:05d}-{uuid.uuid4().hex}.npz"
            fs, where = place(folder)
            fs.create_dir(where, recursive=True)
            with fs.open_output_stream(place(path)[1]) as f:
                f.write(out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([nth], pa.int64()), pa.array([path])], names=["shard", "path"])

        last = -1
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if held and shards[a] != last:
                        yield written(last)
                    last = int(shards[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield written(last)

    return run


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> Model:
    """Context trees of all languages of the documents, from all windows of all their texts.

    Rows with a null language or text are left out; without others no language is learned. Of the
    statistics only the orders below SHARED come to the driver, 2^16 windows a language at most.
    """
    spark = docs.sparkSession
    counts = stash(count_windows(docs, lang_col, text_col, order), "windows")
    low = min(SHARED, order)
    short = counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (8 * max(low, 1))) - 1).cast("long")).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = np.array(short.column("lang").to_pylist(), dtype=object), short.column("gram").to_numpy(), short.column("n").to_numpy()
    trees = {}
    for name in sorted(set(lang)):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(gram[own])]
        trees[name] = Tree(gram[own], n[own], max(low - 1, 0))
    if not order:
        return Model(trees, order)
    shards = max(1, -(-counts.count() // SHARD))
    dealt = counts.select(shard_of(F.col("gram"), order, shards).alias("shard"), "lang", "gram", "n").repartition(shards, "shard").sortWithinPartitions("shard", "lang", "gram")
    files = stash(dealt.mapInArrow(tidy(_write_shards(scratch_path(spark, "shards"), list(trees), order)), "shard long, path string"), "shards")
    paths = {r["shard"]: r["path"] for r in files.collect()}
    return Model(trees, order, [paths.get(i) for i in range(shards)])


def predict_language(docs: DataFrame, model: Model, *, text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """The documents with lang_pred, score (posterior of lang_pred under equal priors) and
    bits_per_byte (its code length); columns of these names are replaced, all others stay.

    A text that is null, empty or without letters gets ``und`` and score 0, and so does every
    text where no language was learned. Of equal code lengths the first name wins. Whole texts
    are coded, in blocks of a few MB; about ``batch_bytes`` of text, or one longer text, meet each
    shard of the model together. Repeated rows get the same result; an empty table stays empty.
    """
    added = ["lang_pred", "score", "bits_per_byte"]
    kept = [c for c in docs.columns if c.lower() not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = [*kept, *added], kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(at), "")
            letters = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
            for a, b in by_bytes(pc.binary_length(text).to_pylist(), batch_bytes):
                lang, score, rate = shared.value.predict(text.slice(a, b - a).cast(pa.binary()).to_pylist(), letters[a:b])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=names)

    schema = ", ".join([ddl(docs.schema[c] for c in kept), "lang_pred string", "score double", "bits_per_byte double"])
    return numbered(docs, kept).mapInArrow(tidy(run), schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out))
    scored = predict_language(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")
