"""Streams of newly arriving alignment files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar as C
from strandframe.sources.bam import register


def stream_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of .bam files as they arrive in a folder, in the order of their names."""
    register(spark)
    return spark.readStream.format("bam").load(path)


def indel_counts(records: DataFrame) -> DataFrame:
    """Running (ref_name, n_insertions, n_deletions); the state has one row per reference."""
    e = C.indels(F.col("pos"), F.col("cigar"))
    return records.groupBy("ref_name").agg(F.sum(F.size(e["insertions"])).alias("n_insertions"), F.sum(F.size(e["deletions"])).alias("n_deletions"))
