"""SAM header text as rows, and back. A header line is (grp, k) ordered text, or one text with newlines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Record codes whose value is free text.
FREE_TEXT = ("@CO",)


def header_lines(text: str | Column, spark=None) -> DataFrame:
    """(rec_idx, line) of one header text."""
    one = spark.createDataFrame([(text,)], "text string")
    return one.select(F.posexplode(F.split("text", "\n", -1)).alias("rec_idx", "line"))


def header_records(lines: DataFrame) -> DataFrame:
    """(rec_idx, code, tags, comment) of (rec_idx, line): tags is an array of (tag, value) in order, a
    later value of a tag replacing the earlier one in its place. Empty lines vanish, and so do
    fields without a colon. Free-text codes have only a comment. A line without a tab has no tags."""
    line = F.rtrim(F.col("line"), F.lit("\r"))
    parts = F.split(line, "\t", 2)
    fields = F.filter(F.split(F.coalesce(F.get(F.col("parts"), F.lit(1)), F.lit("")), "\t", -1), lambda f: F.contains(f, F.lit(":")))
    pairs = F.transform(fields, lambda f: F.struct(F.substring_index(f, ":", 1).alias("tag"), F.get(F.split(f, ":", 2), F.lit(1)).alias("value")))
    free = F.col("code").isin(*FREE_TEXT)
    last = lambda t: F.element_at(F.filter(F.col("pairs"), lambda p: p["tag"] == t), -1)
    names = F.array_distinct(F.transform(F.col("pairs"), lambda p: p["tag"]))
    return (
        lines.filter(line != "")
        .select("rec_idx", parts.alias("parts"))
        .select("rec_idx", F.get("parts", F.lit(0)).alias("code"), F.get("parts", F.lit(1)).alias("value"), pairs.alias("pairs"))
        .select("rec_idx", "code", F.when(~free, F.transform(names, last)).alias("tags"), F.when(free, F.col("value")).alias("comment"))
    )


def tag_value(tags: Column, tag: str) -> Column:
    return F.get(F.filter(tags, lambda t: t["tag"] == tag), F.lit(0))["value"]


def read_groups(records: DataFrame) -> DataFrame:
    """(rec_idx, id) of the @RG records, in order."""
    return records.filter("code = '@RG'").select("rec_idx", tag_value(F.col("tags"), "ID").alias("id"))


def complete_records(records: DataFrame, references: DataFrame, semantics: str = "compat") -> DataFrame:
    """(code, code_order, rec_idx, line): the records rendered and grouped by the first appearance of
    their code, with an @SQ record appended for each reference (ref_id, name, length) that has none.
    An @SQ group that has to be made comes first (in spec: after @HD)."""
    known = records.filter("code = '@SQ'").select(tag_value(F.col("tags"), "SN").alias("SN"))
    missing = references.join(known, references["name"] == known["SN"], "left_anti")
    text = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("\t"), t["tag"], F.lit(":"), t["value"])), "")
    old = records.select("code", F.col("rec_idx").cast("long").alias("rec_idx"), F.concat("code", F.coalesce(F.concat(F.lit("\t"), F.col("comment")), text, F.lit(""))).alias("line"))
    new = missing.select(F.lit("@SQ").alias("code"), (F.col("ref_id").cast("long") + (1 << 40)).alias("rec_idx"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("line"))
    made = F.when(F.col("code") == "@SQ", F.lit(-1 if semantics == "compat" else 0))
    first = old.groupBy("code").agg(F.min("rec_idx").alias("own"))
    both = old.unionByName(new).join(first, "code", "left")
    if semantics != "compat":
        both = both.withColumn("own", F.when(F.col("code") == "@HD", F.lit(-1)).otherwise(F.col("own")))
    return both.select("code", F.coalesce("own", made).alias("code_order"), "rec_idx", "line")


def header_text(records: DataFrame, references: DataFrame, semantics: str = "compat") -> DataFrame:
    """One row: the header's text. A header is small by nature; it is gathered into one string."""
    lines = complete_records(records, references, semantics)
    rows = lines.agg(F.sort_array(F.collect_list(F.struct("code_order", "rec_idx", "line"))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def numbered(lines: DataFrame, *order: str) -> DataFrame:
    """Adds rec_idx from 0 by the given order. Headers are small."""
    return lines.withColumn("rec_idx", F.row_number().over(W.orderBy(*order)) - 1)
