"""Helpers of all parts: names, the folder that tasks share, joins that no key can overload, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and all runs on one machine (``local[...]``, as in tests) a temporary folder
    takes its place; on a cluster it must be set.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandframe-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under this application's own directory."""
    return f"{shared_dir(spark)}/strandframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, and
    a lost executor costs no recomputation. ``drop_scratch`` removes what an application wrote."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*stashed: DataFrame) -> None:
    """Deletes tables that ``stash`` wrote, once nothing will read them again."""
    for df in stashed:
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, place)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes the application's scratch tables; call it once their results have been written."""
    _delete(spark, f"{shared_dir(spark)}/strandframe/{spark.sparkContext.applicationId}")


#: A table of fewer bytes than this for each core, in fewer partitions than cores, is dealt out.
LITTLE = 4 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A table as read, over all cores: a small file of one row group would keep one of them busy. Tables
    that are large for the cluster stay as they are."""
    run, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    size = int(str(run.optimizedPlan().stats().sizeInBytes()))
    if not LITTLE // 8 < size < LITTLE * cores or run.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: A key with more than one in so many of all rows is met by a copy of its row in every task.
HOT = 1000


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, *, spread: Column, slim: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Left join of ``left`` with the columns that ``right``, one row per key, adds to it.

    weight: the column of ``right`` (not returned) that says how many rows of ``left`` have the key.
    Keys with more than one in HOT of these rows, so HOT keys at most, are sent to every task; the
    others meet by a shuffle, in which rows of hot and of null keys are spread by ``spread``. So no
    key weighs on a single task, whatever its share. slim: values that columns take in rows that a
    hot key has met, made from the struct of what it adds, before anything is shuffled. ``right``
    is read three times: give a stashed table.
    """
    added = [c for c in right.columns if c not in keys and c != weight]
    size = right.agg(F.sum(col(weight)).alias("rows"), F.count("*").alias("keys")).first()
    heavy = col(weight) * F.lit(HOT) > F.lit(size["rows"] or 0)
    some = right.filter(heavy).select(*cols(keys), *cols(added))
    hot = some.collect()
    met, salt = unused(left, "__met", "__salt")
    packed = left.sparkSession.createDataFrame(hot, some.schema).select(*cols(keys), F.struct(*cols(added)).alias(met))
    out = left.join(F.broadcast(packed), list(keys), "left")
    if slim:
        out = out.withColumns({c: F.when(col(met).isNotNull(), f(col(met))).otherwise(col(c)) for c, f in slim.items()})
    if len(hot) == size["keys"]:
        return out.select(*cols(left.columns), *[col(met).getField(c).alias(c) for c in added])
    alone = col(met).isNotNull()
    for k in keys:
        alone = alone | col(k).isNull()
    out = out.withColumn(salt, F.when(alone, F.pmod(F.xxhash64(spread), F.lit(1 << 30)) + 1).otherwise(F.lit(0).cast("long")))
    # always 0, but not in a way that the optimizer sees: else it would leave the salt out of the keys
    rest = right.filter(~heavy).select(*cols(keys), F.pmod(col(weight), F.lit(1)).cast("long").alias(salt), F.struct(*cols(added)).alias(met + "2"))
    both = F.coalesce(col(met), col(met + "2"))
    return out.join(rest, [*keys, salt], "left").select(*cols(left.columns), *[both.getField(c).alias(c) for c in added])


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``, the row's number from 0 in this order; ties get numbers in any order.

    The rows are dealt to ranges of the order and written, so that each task sorts its range; their
    counts, one a task, give each range its first number. A run of equal rows stays in one task.
    """
    near, range_no, first = unused(df, "__near", "__range", "__first")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(near, F.monotonically_increasing_id())
    dealt = stash(dealt.withColumns({range_no: F.shiftright(near, 33), near: F.col(near).bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    starts, total = [], 0
    for r in dealt.groupBy(range_no).count().orderBy(range_no).collect():
        starts.append((r[0], total))
        total += r["count"]
    firsts = F.broadcast(df.sparkSession.createDataFrame(starts, f"{range_no} long, {first} long"))
    return dealt.join(firsts, range_no).select(*cols(df.columns), (F.col(first) + F.col(near)).alias(name))
