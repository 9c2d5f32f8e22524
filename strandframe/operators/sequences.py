"""Indexed reference sequences as DataFrames: building the index, sizes, slices."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.schema import DEFAULT_SEQUENCE_LENGTH
from strandframe.shared import meet, stash


def build_fai(lines: DataFrame) -> DataFrame:
    """(name, len, line_blen, line_len) of body lines (name, line_no, bases, line_len): one entry per
    sequence; all lines but the last must have the first one's length, else an error is raised.

    Lines are counted by their lengths, which combines in the tasks that read them; a sequence is
    good if all are of one length, or the last one alone is of another.
    """
    kinds = lines.groupBy("name", F.length("bases").alias("b"), F.col("line_len").alias("l")).agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    one = kinds.groupBy("name").agg(F.sum(F.col("b").cast("long") * F.col("n")).alias("len"), F.min_by(F.struct("b", "l"), "lo").alias("first"), F.max_by("n", "hi").alias("last"), F.count("*").alias("kinds"))
    good = (F.col("kinds") == 1) | (F.col("kinds") == 2) & (F.col("last") == 1)
    ok = F.when(~good, F.raise_error(F.concat(F.lit("lines of unequal length in "), "name")).cast("long")).otherwise(F.col("len"))
    return one.select("name", ok.alias("len"), F.col("first.b").alias("line_blen"), F.col("first.l").alias("line_len"))


#: Lines of a FASTA file that are looked through together for their header.
LINES = 1 << 12


def body_lines(text: DataFrame) -> DataFrame:
    """(name, line_no, bases, line_len) of FASTA lines (line_no, line, line_len) of one file. The name
    is the header's first word; a blank line ends a sequence. Text outside a sequence raises.

    The running header is found within runs of LINES lines, and goes from run to run by a window
    over one row a run.
    """
    head = F.startswith("line", F.lit(">"))
    blank = F.trim("line") == ""
    state = F.when(head, F.regexp_extract("line", r"^>(\S*)", 1)).when(blank, F.lit("\0"))
    stated = text.withColumn("state", state).withColumn("run", F.floor(F.col("line_no") / LINES))
    last = stated.groupBy("run").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("line_no"))).alias("last"))
    before = last.select("run", F.last("last", ignorenulls=True).over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    own = F.last("state", ignorenulls=True).over(W.partitionBy("run").orderBy("line_no"))
    named = stated.withColumn("own", own).filter(~head & ~blank).join(before, "run").withColumn("name", F.coalesce("own", "before"))
    stray = F.when(F.coalesce(F.col("name"), F.lit("\0")) == "\0", F.raise_error(F.concat(F.lit("text outside a sequence at line "), F.col("line_no").cast("string"))).cast("string")).otherwise(F.col("name"))
    return named.select(stray.alias("name"), "line_no", F.trim("line").alias("bases"), "line_len")


def fai_offset(position: Column, offset: Column, line_blen: Column, line_len: Column) -> Column:
    """Byte offset of a base in its file."""
    return offset + F.floor(position / line_blen) * line_len + position % line_blen


def sizes(names: DataFrame, fai: DataFrame, default: int = DEFAULT_SEQUENCE_LENGTH) -> DataFrame:
    """Adds size: the sequence's length, or the default if it is unknown."""
    return names.join(fai.select("name", "len"), "name", "left").withColumn("size", F.coalesce("len", F.lit(default))).drop("len")


def chunks(lines: DataFrame, size: int = 1 << 14) -> DataFrame:
    """(name, chunk, bases): a sequence's lines (name, line_no, bases) regrouped into chunks of
    ``size`` bases. Lines must be of one length but for the last. Sites of any sequence, however
    long, then meet one or two chunks of it."""
    shape = lines.groupBy("name").agg(F.max(F.length("bases")).alias("w"), F.min("line_no").alias("first"), F.count("*").alias("n"))
    spread = meet(lines.select("name", "line_no", "bases"), stash(shape, "shape"), ["name"], "n", spread=F.col("line_no"))
    per = F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("w")))
    put = spread.withColumn("k", F.col("line_no") - F.col("first")).withColumn("chunk", F.floor(F.col("k") / per))
    rows = put.groupBy("name", "chunk").agg(F.first(per * F.col("w")).alias("chunk_size"), F.sort_array(F.collect_list(F.struct("k", "bases"))).alias("rows"))
    return rows.select("name", "chunk", "chunk_size", F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["bases"]), ""), r"\s", "").alias("bases"))


def sequence_at(sites: DataFrame, chunked: DataFrame, fai: DataFrame, *, unknown: str = "N", strict: bool = True, sequence_filter: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Adds bases to sites (site_id, name, position 0-based, length > 0).

    An unknown name gives ``unknown`` repeated, without the filter. Beyond the end, strict raises;
    otherwise a position past the length moves to the last base, and what is missing is filled with
    ``unknown``. A negative position raises. site_id must be unique.
    """
    at = sites.join(fai.select("name", F.col("len").alias("__len")), "name", "left")
    past = F.col("position") > F.col("__len")
    over = F.col("position") + F.col("length") > F.col("__len")
    bad = (F.col("length") <= 0) | (F.col("position") < 0) | (F.coalesce(past | over, F.lit(False)) if strict else F.lit(False))
    start = F.when(past, F.greatest(F.col("__len") - 1, F.lit(0))).otherwise(F.col("position"))
    at = at.withColumn("__from", F.when(bad, F.raise_error(F.concat(F.lit("no such slice of "), "name", F.lit(": "), F.col("position").cast("string"), F.lit("+"), F.col("length").cast("string"))).cast("long")).otherwise(start.cast("long")))
    at = at.withColumn("__to", F.greatest(F.least(F.col("__from") + F.col("length"), F.col("__len")), F.col("__from")))
    size = chunked.groupBy(F.col("name").alias("__n")).agg(F.max("chunk_size").alias("__size"))
    wide = at.join(size, at["name"] == F.col("__n"), "left").drop("__n")
    wanted = wide.filter("__size is not null and __to > __from").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__from") / F.col("__size")), F.floor((F.col("__to") - 1) / F.col("__size")))))
    part = F.substring("bases", (F.greatest(F.col("__from") - F.col("chunk") * F.col("__size"), F.lit(0)) + 1).cast("int"), (F.least(F.col("__to") - F.col("chunk") * F.col("__size"), F.col("__size")) - F.greatest(F.col("__from") - F.col("chunk") * F.col("__size"), F.lit(0))).cast("int"))
    found = wanted.join(chunked.select("name", "chunk", "bases"), ["name", "chunk"]).groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("chunk", part.alias("p")))).alias("parts"))
    text = F.rpad(F.coalesce(F.array_join(F.transform("parts", lambda r: r["p"]), ""), F.lit("")), F.col("length").cast("int"), F.lit(unknown))
    done = wide.join(found, "site_id", "left")
    # the start is part of the result, so that a bad slice raises even where its bases are not used
    bases = F.when(F.col("__from").isNotNull() & F.col("__len").isNull(), F.repeat(F.lit(unknown), F.col("length").cast("int"))).otherwise(sequence_filter(text))
    return done.select(*sites.columns, bases.alias("bases"))
