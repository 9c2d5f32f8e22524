"""Mixing sources to target weights by Poisson replication.

Each source s gets a mean repetition rate: target share x rows wanted / rows there. A document's
copy count is the inverse of the Poisson distribution with that mean at a uniform number hashed
from (seed, id): the same document gets the same count on every run, on any partitioning and
after any lost executor, and no state is kept. Documents are exploded by their counts, and the
copies are dealt to partitions and ordered by a second hash, which is the global shuffle. A mean
above LARGE is a whole number of copies of each document plus a Poisson number of mean LARGE or a
little more, since the inverse of a larger one leaves the range of doubles.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import col, cols, meet, stash, table, unused

#: Largest mean of an inverted Poisson distribution; exp(-LARGE) is a normal double.
LARGE = 600.0


def hash_unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, alpha: float, scale: float, max_rate: float | None) -> DataFrame:
    """(source, n, rate): one row per source that occurs, null included; n: its rows."""
    sizes = docs.groupBy(col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)) if alpha != 0.5 else F.sqrt(F.col("n").cast("double")))
    else:
        named = {k: v for k, v in weights.items() if k is not None}
        known = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.lit(float(v)))]) if named else F.lit(None).cast("map<string,double>")
        w = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.try_element_at(known, F.coalesce("source", F.lit(""))))
        sizes = sizes.withColumn("w", F.coalesce(w, F.lit(0.0)))
    total = sizes.agg(F.sum("w").alias("sw"), F.sum("n").alias("sn"))
    rate = F.when(F.col("sw") > 0, F.col("w") / F.col("sw") * F.col("sn") * F.lit(float(scale)) / F.col("n")).otherwise(F.lit(0.0))
    # total has one row
    rates = sizes.join(F.broadcast(total)).withColumn("rate", rate)
    return rates.select("source", "n", "rate") if max_rate is None else held_rates(stash(rates, "rates"), float(max_rate))


def held_rates(rates: DataFrame, most: float) -> DataFrame:
    """(source, n, rate) with no rate above ``most``: what a held source lacks goes to the others by
    their weights, which may bring more of them to ``most``. A warning tells how many sources are
    held, and the rows that no source can take."""
    held, unit = 0, 1.0
    while True:
        over = F.col("rate") * F.lit(unit) > F.lit(most)
        # rows of the held sources, rows wanted of the others, rows wanted in all
        one = rates.agg(F.count(F.when(over, 1)).alias("held"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(over, 0.0).otherwise(F.col("rate") * F.col("n"))).alias("free"), F.sum(F.col("rate") * F.col("n")).alias("all")).first()
        if one["held"] == held:
            break
        held = one["held"]
        left = one["all"] - most * one["rows"]
        if not one["free"] or left <= 0:
            break
        unit = max(unit, left / one["free"])
    if held:
        lost = one["all"] - most * one["rows"] if not one["free"] else 0.0
        warnings.warn(f"{held} sources are held at a mean repetition of {most}; other rates are multiplied by {unit}, {max(0.0, lost):.0f} rows go to no source", stacklevel=3)
    return rates.select("source", "n", F.least(F.col("rate") * F.lit(unit), F.lit(most)).alias("rate"))


def whole_part(rate: Column) -> Column:
    """Copies that each document gets for certain: none up to a rate of LARGE."""
    return F.greatest(F.floor(rate - F.lit(LARGE)), F.lit(0).cast("long"))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ..., as far as doubles tell it from 1."""
    last = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    scale: float = 1.0,
    max_rate: float | None = None,
    seed: int = 42,
    copy_col: str = "copy",
) -> DataFrame:
    """The documents, each as often as its Poisson count says, in a globally shuffled order.

    weights: target weight by source (a source not named gets 0 and vanishes; the null source is
    named by None); without it a source's weight is its row count to the power ``alpha``. scale:
    rows wanted, as a multiple of the input's. max_rate: if given, the largest mean repetition of a
    document; the rows that a source so held lacks go to the others by their weights, and a warning
    tells of it. All columns stay, whatever their names; ``copy_col`` (from 1) is added, and takes
    the place of a column of that name. Null sources are one source; a null id hashes as the text
    "null", and repeated rows of one id get the same count. Texts may be null or empty, they are
    not looked at. An empty table gives an empty table.

    Cost: one partially aggregated count by source, then one shuffle of the copies by hash. Rates of
    sources with more than a thousandth of the rows are sent to every task; where there are others,
    their rows meet their rates by source, and rows of larger sources are spread over those tasks.
    """
    # the cumulative tables are made once per source, not once per row
    rates = source_rates(docs, source_col, weights, alpha, scale, max_rate).withColumn("__whole", whole_part(F.col("rate")))
    # entries of 1 are above every uniform number, and most of a table
    rates = rates.withColumn("cdf", F.filter(poisson_cdf(F.col("rate") - F.col("__whole")), lambda c: c < 1.0))
    key = F.coalesce("source", F.lit("")).alias("source")
    rates = stash(rates.select(F.col("source").isNull().alias("none"), key, "n", F.struct(F.col("__whole").alias("whole"), "cdf").alias("rate")), "rates")
    none, source, rate, u, n, order, lone = own = unused(docs, "__none", "__source", "__rate", "__u", "__n", "__order", "__lone")
    rates = rates.toDF(none, source, n, rate)
    name = col(source_col).cast("string")
    # rows without an id are told apart by what they hold, so that they do not meet in one task
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    apart = F.when(col(id_col).isNull(), F.xxhash64(*cols(plain)))
    joined = meet(docs.withColumns({none: name.isNull(), source: F.coalesce(name, F.lit(""))}), rates, [none, source], n, spread=F.coalesce(apart, F.xxhash64(col(id_col))))
    count = (F.col(rate)["whole"] + F.size(F.filter(F.col(rate)["cdf"], lambda c: c <= F.col(u)))).cast("int")
    kept = [c for c in docs.columns if c.lower() != copy_col.lower()]
    copies = joined.withColumn(u, hash_unit(F.lit(seed), col(id_col))).withColumn(n, count).withColumn(lone, apart).filter(F.col(n) > 0)
    copies = copies.select(*cols(kept), lone, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_col))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(col(id_col).cast("string"), F.lit("null")), col(copy_col), col(lone)).cast("binary"))
    return copies.withColumn(order, mixed).repartition(order).sortWithinPartitions(order).drop(*own)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_TEMPLATE = """
with recursive sizes as (select source, count(*) n, sqrt(count(*)::double) w from {docs} group by source),
totals as (select sum(w) sw, sum(n) sn from sizes),
rates as (select source, least(case when sw > 0 then w / sw * sn * 1.0 / n else 0.0 end, 64.0) rate from sizes, totals),
cdf as (
  select source, rate, 0 k, exp(-rate) p, exp(-rate) c from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < 190),
units as (select *, ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double u from {docs}),
tables as (select source, list(c order by k) cs from cdf group by source),
counts as (select d.*, len(list_filter(t.cs, lambda c: c <= d.u)) n from units d join tables t on d.source is not distinct from t.source)
select {columns}, unnest(generate_series(1, n))::int as "copy" from counts where n > 0
"""
ORACLE = ORACLE_TEMPLATE.format(docs="documents", columns="doc_id, text, lang, source, n_chars")
