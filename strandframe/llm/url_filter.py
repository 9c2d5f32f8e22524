"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule (host, path) becomes the canonical key ``reversed host // path``. At a given number of
host labels, a URL is one point (its last labels, reversed, and its path), and a rule is the
interval of all keys that start with its own. Such intervals are nested or disjoint, so a sweep
over the sorted union of rules and points needs only a stack: each rule row brings the stack
that is open right after it (itself and the rules around it, innermost first), a running
``last`` carries it along the sweep, and a point takes the innermost entry that still holds it.
The URL's verdict is that of its longest rule over its label counts.

Scale: the key space is cut into ranges of ``rules_per_range`` rules at most; each range starts
with one of its rules, so no state crosses a border. Ranges get as many salts as their measured
number of points asks for, and their rules are repeated for each salt. A host with a third of
all URLs is thus dealt over many tasks, and no side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import col, shuffle_partitions, stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def canonical(labels: Column, path: Column) -> Column:
    """labels: reversed. Hosts hold no slash, so the double slash marks their end."""
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, depth, stack): stack holds the rule and those around it, innermost first."""
    base = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").filter("host is not null")
    labels = F.reverse(F.split("host", r"\."))
    # of equal rules one stays: block wins over allow
    keyed = base.withColumn("key", canonical(labels, F.col("path"))).withColumn("depth", F.size(labels)).groupBy("key", "depth").agg(F.max(F.struct("action", F.concat("host", "path").alias("rule"))).alias("r")).select("key", "depth", "r.action", "r.rule")
    # candidates for the rules around a rule: its own key's prefixes from the end of the host on
    first = F.instr("key", "/")
    around = keyed.select("key", F.explode(F.sequence(first, F.length("key"))).alias("n")).select("key", F.expr("substring(key, 1, n)").alias("outer"))
    entry = F.struct(F.length("o.key").alias("n"), F.col("o.key").alias("key"), F.col("o.rule").alias("rule"), F.col("o.action").alias("action"))
    stacks = around.alias("a").join(keyed.alias("o"), F.col("a.outer") == F.col("o.key")).groupBy(F.col("a.key").alias("key")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))
    return keyed.select("key", "depth").join(stacks, "key")


def _ranges(rules: DataFrame, rules_per_range: int) -> list[str]:
    """First keys of the ranges but the first; their number follows that of the rules alone."""
    n = rules.count()
    parts = -(-n // rules_per_range)
    if parts <= 1:
        return []
    cut = rules.repartitionByRange(parts, "key").select(F.spark_partition_id().alias("p"), "key").groupBy("p").agg(F.min("key").alias("low")).orderBy("low").collect()
    return [r["low"] for r in cut[1:]]


def _range_of(key: Column, lows: list[str]) -> Column:
    """Number of borders at or below the key, by bisection over the sorted borders."""
    if not lows:
        return F.lit(0)
    arr = F.array(*[F.lit(x) for x in lows])
    steps = F.sequence(F.lit(1), F.lit(len(lows).bit_length()))
    span = F.struct(F.lit(0).alias("lo"), F.lit(len(lows)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.element_at(arr, F.least(mid + 1, F.lit(len(lows)))) <= key)
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(acc["hi"]).alias("hi"))

    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(steps, span, halve, lambda acc: acc["lo"]))


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    rules_per_range: int = 20_000,
    points_per_task: int = 500_000,
) -> DataFrame:
    """One row per input row: the id, host, path, rule (``host`` + ``path`` of the longest rule
    that fits, else null), verdict (that rule's action, else ``default``).

    rules: columns action (allow or block), host, path. A rule fits its host and all subdomains
    if the URL's path starts with the rule's. Longest counts host and path together; of two
    equally long rules of one URL the one with more host labels wins. A URL that is null or has no
    ``://`` has an empty host and path, and only ``default`` applies. Repeated rows stay repeated;
    null ids are kept. Other columns are not read, so their names may clash with the result's.
    Empty pages give an empty table, empty rules give ``default`` everywhere.
    """
    spark = pages.sparkSession
    stacks = stash(rule_stacks(rules), "rules")
    depths = sorted(r["depth"] for r in stacks.select("depth").distinct().collect())
    lows = _ranges(stacks.select("key"), rules_per_range)

    parts = pages.select(col(id_col).alias("__id"), url_host(col(url_col)).alias("host"), url_path(col(url_col)).alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    fitting = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= F.size(labels))
    points = parts.select("*", F.posexplode_outer(F.transform(fitting, lambda d: canonical(F.slice(labels, F.lit(1), d), F.col("path")))).alias("nth", "key")).withColumn("range", _range_of(F.col("key"), lows))

    # salts by the measured load of each range; there are as many ranges as borders, plus one
    load = {r["range"]: r["count"] for r in points.groupBy("range").count().collect()}
    total = sum(load.values()) or 1
    wanted = max(4 * shuffle_partitions(spark), -(-total // points_per_task))
    salts = [max(1, -(-load.get(i, 0) * wanted // total)) for i in range(len(lows) + 1)]
    n_salts = F.element_at(F.array(*[F.lit(n) for n in salts]), F.col("range") + 1)

    dealt = points.withColumn("salt", F.pmod(F.xxhash64("__id", "path"), n_salts).cast("int")).select("range", "salt", "key", F.lit(1).alias("kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), "__id", "host", "path", "nth")
    opened = stacks.withColumn("range", _range_of(F.col("key"), lows)).withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1))).select("range", "salt", "key", F.lit(0).alias("kind"), "stack", F.lit(None).cast(dealt.schema["__id"].dataType).alias("__id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("nth"))
    sweep = W.partitionBy("range", "salt").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = opened.unionByName(dealt).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    hit = F.get(F.filter("open", lambda r: F.startswith(F.col("key"), r["key"])), F.lit(0))
    best = F.max(F.when(hit.isNotNull(), F.struct(F.length(hit["rule"]).alias("n"), F.size(F.split(F.substring_index(hit["key"], "/", 1), r"\.")).alias("depth"), hit["rule"].alias("rule"), hit["action"].alias("action"))))
    judged = swept.groupBy("__id", "host", "path").agg(best.alias("best"), F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("times"))
    out = judged.select(F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__k"))
    return out.drop("__k")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


ORACLE = """
with rules as (select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(action, rhost, rpath)),
rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r from pages),
parts as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path, row_number() over () rn from rest),
hits as (select p.rn, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(action, length(rhost || rpath)) as action
  from parts p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by p.rn)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from parts left join hits using (rn)
"""
