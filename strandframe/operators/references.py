"""Look-ups between records and the reference list (ref_id, name, length)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.record import mate_name, reference_name

#: Bytes that a reference list may have to be sent to every task: the sum of its texts and 16 a cell.
SMALL = 64 << 20


def small(references: DataFrame) -> DataFrame:
    """With a broadcast hint if the list's measured size is at most SMALL; else the join shuffles."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in references.schema if f.dataType.typeName() in ("string", "binary")]
    size = references.agg(F.sum(sum(texts, F.lit(16 * len(references.columns)).cast("long")))).first()[0]
    return F.broadcast(references) if (size or 0) <= SMALL else references


def with_reference(records: DataFrame, references: DataFrame) -> DataFrame:
    """Adds ref_name (``*`` without a reference), ref_length and reference, struct(name, length),
    whose fields are null without one."""
    refs = small(references.select(F.col("ref_id").alias("__id"), F.col("name").alias("__name"), F.col("length").alias("__length")))
    out = records.join(refs, records["ref_id"] == F.col("__id"), "left")
    return out.select(records["*"], reference_name(records["ref_id"], F.col("__name")).alias("ref_name"), F.col("__length").alias("ref_length"), F.struct(F.col("__name").alias("name"), F.col("__length").alias("length")).alias("reference"))


def with_mate(records: DataFrame, references: DataFrame) -> DataFrame:
    """Adds rnext (``*``, ``=`` or the name) and rnext_length."""
    refs = small(references.select(F.col("ref_id").alias("__id"), F.col("name").alias("__name"), F.col("length").alias("__length")))
    out = records.join(refs, records["next_ref_id"] == F.col("__id"), "left")
    return out.select(records["*"], mate_name(records["next_ref_id"], records["ref_id"], F.col("__name")).alias("rnext"), F.col("__length").alias("rnext_length"))


def reference_ids(names: DataFrame, references: DataFrame, name_col: str = "name") -> DataFrame:
    """Adds ref_id: the first reference of that name, null if there is none."""
    first = small(references.groupBy(F.col("name").alias("__name")).agg(F.min("ref_id").alias("ref_id")))
    return names.join(first, names[name_col] == F.col("__name"), "left").drop("__name")


def idxstats(records: DataFrame) -> DataFrame:
    """(ref_id, n_mapped, n_unmapped) by the flag's unmapped bit; ref_id -1 counts the unplaced."""
    unmapped = F.col("flag").bitwiseAND(F.lit(4)) != 0
    return records.groupBy("ref_id").agg(F.count_if(~unmapped).alias("n_mapped"), F.count_if(unmapped).alias("n_unmapped"))
