"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into blocks (buckets) of similar lengths. A block of queries
first meets the ``seed`` longest vectors, which gives each query a threshold: its k-th best score
there. In a bucket whose longest vector is l, a query q needs a cosine of threshold / (|q| l); by
that local threshold the bucket is skipped (above 1), pruned by coordinates (high) or by length
(low):

- coordinates: from a cosine of t at least and a query coordinate x, a candidate's normed
  coordinate must lie in x t -/+ sqrt((1 - t^2)(1 - x^2)); the query's largest coordinates are
  looked up in the bucket's sorted columns, and what lies in all ranges is kept;
- length: vectors shorter than threshold / |q| cannot reach it, and they are the bucket's end.

What is left is verified by its integer inner product. Blocks of queries are dealt to all lanes,
blocks of vectors to one lane each, and they meet in an equi-join by lane: each pair of blocks
that a bound does not rule out meets once. A task holds two blocks, the thresholds it has seen and
HELD candidates, of which each query's k best leave it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import col, shuffle_partitions, stash, table, tidy

VECTORS, QUERIES, SEED = 4096, 512, 2048
#: Local cosine from which coordinates prune better than length; coordinates looked up.
COORDINATE_COSINE, FOCUS = 0.8, 4
SLACK = 1e-9
LONG = 1 << 63
#: Candidates that a task gathers before it keeps each query's k best.
HELD = 1 << 19


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vec, norm): floor(scale * x) of each component; rows with a null or a component that
    is null or not finite are left out, repeated rows count once."""
    x = F.col("raw")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("raw")).filter(F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    ints = rows.select("id", F.transform("raw", lambda c: F.floor(c * F.lit(float(scale)))).alias("vec")).distinct()
    return ints.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _narrow(m: np.ndarray) -> np.ndarray:
    top = max(int(m.max(initial=0)), -int(m.min(initial=0)))
    return m.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _pack(size: int):
    """Blocks of at most ``size`` sorted rows; shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vecs, norms, nth, part = [], [], [], 0, TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            nonlocal nth
            take_i, take_v, take_n = ids[:size], vecs[:size], norms[:size]
            del ids[:size], vecs[:size], norms[:size]
            dim = max(map(len, take_v))
            m = np.zeros((len(take_v), dim), np.int64)
            for k, v in enumerate(take_v):
                m[k, : len(v)] = v
            m = _narrow(m)
            nth += 1
            cols = [pa.array([part << 32 | nth]), pa.array([len(take_i)]), pa.array([dim]), pa.array([m.itemsize]), pa.array([max(take_n)]), pa.array([np.array(take_i, "<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([np.array(take_n, "<f8").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "n", "dim", "width", "longest", "ids", "data", "norms"])

        for batch in batches:
            ids += batch.column("id").to_pylist()
            norms += batch.column("norm").to_pylist()
            vecs += batch.column("vec").to_pylist()
            while len(ids) >= size:
                yield block()
        if ids:
            yield block()

    return run


BLOCK = "block long, n long, dim long, width long, longest double, ids binary, data binary, norms binary"


def _open(row: dict, p: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.frombuffer(row[p + "data"], f"<i{row[p + 'width']}").reshape(row[p + "n"], row[p + "dim"])
    return np.frombuffer(row[p + "ids"], "<i8"), m, np.frombuffer(row[p + "norms"], "<f8")


def products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; bound: of their size. Beyond the range of a long they saturate."""
    d = min(q.shape[1], c.shape[1])
    if bound < 1 << 52:  # every partial sum is a whole number that doubles hold
        return (q[:, :d].astype(np.float64) @ c[:, :d].T.astype(np.float64)).astype(np.int64)
    exact = q[:, :d].astype(object) @ c[:, :d].T.astype(object)
    return np.array([[min(LONG - 1, max(-LONG, int(x))) for x in r] for r in exact], dtype=np.int64).reshape(len(q), len(c))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.lexsort((ids[at], -scores[at].astype(np.float64) if abs(least) < 1 << 52 else [-int(s) for s in scores[at]]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-int(scores[i]), int(ids[i])))[:k], dtype=np.int64)


class Bucket:
    """A block of candidates, longest first."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, norms: np.ndarray):
        self.ids, self.data, self.norms = ids, data, norms
        self.unit = None
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, sorted values) of a normed coordinate."""
        if f not in self.columns:
            order = np.argsort(self.unit[:, f])
            self.columns[f] = order, self.unit[order, f]
        return self.columns[f]

    def by_coordinates(self, q: np.ndarray, t: float) -> np.ndarray:
        """Rows whose cosine with the normed query can be t or more."""
        if self.unit is None:
            self.unit = self.data / np.maximum(self.norms, 1e-300)[:, None]
        d = min(len(q), self.unit.shape[1])
        if d < len(q):
            q = q[:d]
        if not d:
            return np.arange(len(self.ids))
        focus = np.argsort(-np.abs(q))[:FOCUS]
        half = np.sqrt(max(0.0, 1 - t * t) * np.maximum(0.0, 1 - q[focus] ** 2)) + SLACK
        low, high = q[focus] * t - half, q[focus] * t + half
        # of a coordinate beyond the one of the best cosine the range is open on that side
        high, low = np.where(q[focus] >= t, 1 + SLACK, high), np.where(-q[focus] >= t, -1 - SLACK, low)
        ranges = []
        for f, a, b in zip(focus.tolist(), low, high):
            order, values = self.column(f)
            ranges.append((np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right"), f, a, b, order))
        first = min(ranges, key=lambda r: r[1] - r[0])
        at = first[5][first[0] : first[1]]
        for _, _, f, a, b, _ in ranges:
            if f != first[2]:
                x = self.unit[at, f]
                at = at[(x >= a) & (x <= b)]
        return np.sort(at)

    def search(self, ids: np.ndarray, data: np.ndarray, norms: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, ids, scores) of up to k candidates each, none below ``least``."""
        longest = self.norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(least <= 0, -1.0, least / (norms * longest))
        todo = np.flatnonzero(~(local > 1 + SLACK))
        out = []
        near = todo[local[todo] >= COORDINATE_COSINE]
        for i in near.tolist():
            at = self.by_coordinates(data[i] / norms[i], float(min(local[i], 1.0)))
            if len(at):
                out.append(self._kept(i, at, products(data[i : i + 1], self.data[at], norms[i] * longest)[0], ids, least, k))
        far = todo[local[todo] < COORDINATE_COSINE]
        if len(far):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where(least[far] > 0, least[far] / norms[far] * (1 - SLACK), -1.0)
            ends = np.searchsorted(-self.norms, -shortest, "right")
            end = int(ends.max())
            if end:
                scores = products(data[far], self.data[:end], float(norms[far].max()) * longest)
                for i, e, s in zip(far.tolist(), ends.tolist(), scores):
                    out.append(self._kept(i, np.arange(e), s[:e], ids, least, k))
        return out

    def _kept(self, i: int, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        good = (scores >= least[i]) & (self.ids[at] != ids[i])
        at, scores = at[good], scores[good]
        top = best(scores, self.ids[at], k)
        return i, self.ids[at[top]], scores[top]


def _thresholds(seed: Bucket | None, k: int):
    """Adds ``least`` (the threshold of each query) and ``reach``, the length below which no query
    of the block can use a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_least, reach = [], []
            for row in batch.to_pylist():
                ids, data, norms = _open(row)
                least = np.full(len(ids), -np.inf)
                if seed is not None:
                    for i, got, scores in seed.search(ids, data, norms, least, k):
                        if len(got) == k:
                            least[i] = float(scores[-1]) if abs(int(scores[-1])) < 1 << 52 else -np.inf
                all_least.append(least.astype("<f8").tobytes())
                reach.append(float(min(l / n if l > 0 and n > 0 else 0.0 for l, n in zip(least, norms))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(all_least, pa.binary()), pa.array(reach, pa.float64())], names=[*batch.schema.names, "least", "reach"])

    return run


def kept(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, by query; ~score falls as the score rises, without leaving a long."""
    order = np.lexsort((ids, ~scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else np.zeros(0, np.int64)
    nth = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
    return query[nth < k], ids[nth < k], scores[nth < k]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, np.ndarray] = OrderedDict()  # what this task has learned of thresholds
        last, bucket = None, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def best_held() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return kept(*(np.concatenate(x) for x in zip(*held)), k)

        def told(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["block"] != last:
                    last, bucket = row["block"], Bucket(*_open(row))
                ids, data, norms = _open(row, "q_")
                least = seen.get(row["q_block"])
                if least is None:
                    least = seen[row["q_block"]] = np.frombuffer(row["q_least"], "<f8").copy()
                    if len(seen) > 256:
                        seen.popitem(last=False)
                for i, got, scores in bucket.search(ids, data, norms, least, k):
                    if len(got) == k and abs(int(scores[-1])) < 1 << 52:
                        least[i] = max(least[i], float(scores[-1]))
                    held.append((np.full(len(got), ids[i], np.int64), got.astype(np.int64), scores.astype(np.int64)))
                    size += len(got)
                if size > HELD:
                    held = [best_held()]
                    size = len(held[0][0])
                    if size > HELD // 2:  # too many queries: what there is goes on
                        yield told(held[0])
                        held, size = [], 0
        if held:
            yield told(best_held())

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: int = 64,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k highest inner products over all other
    rows (all, if there are fewer), ties to the smaller id.

    Components are floor(scale * x), x as double. is_query: of the ids, over the column ``id``.
    Rows that are null or hold a null or non-finite component take no part, nor do rows with a null
    id. A row with the query's own id is no candidate of it; repeated rows count once. A vector
    shorter than others counts zeros for what it lacks. Components and scores beyond the range of
    a long saturate. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    lanes = shuffle_partitions(spark)
    rows = stash(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    order = [F.desc("norm"), F.col("id")]
    blocks = stash(rows.repartitionByRange(lanes, *order).sortWithinPartitions(*order).mapInArrow(_pack(VECTORS), BLOCK), "blocks")
    # SEED rows at most come to the driver
    top = rows.orderBy(*order).limit(SEED).collect()
    seed = None
    if top:
        m = np.zeros((len(top), max(len(r["vec"]) for r in top)), np.int64)
        for i, r in enumerate(top):
            m[i, : len(r["vec"])] = r["vec"]
        seed = Bucket(np.array([r["id"] for r in top]), _narrow(m), np.array([r["norm"] for r in top]))
    asked = rows.filter(is_query).repartitionByRange(lanes, *order).sortWithinPartitions(*order).mapInArrow(_pack(QUERIES), BLOCK)
    queries = stash(asked.mapInArrow(_thresholds(seed, k), BLOCK + ", least binary, reach double"), "queries")

    right = blocks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes))).repartition(lanes, "lane")
    left = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
    met = right.join(left.repartition(lanes, "lane"), "lane").filter(F.col("longest") * (1 + SLACK) >= F.col("q_reach")).drop("lane")
    found = met.mapInArrow(tidy(_search(k)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
