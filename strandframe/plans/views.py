"""Input views over the star schema, in SQL that Spark and DuckDB both run."""

from pyspark.sql import DataFrame, SparkSession

from strandframe.shared import dealt

ALIGNMENTS = """
select concat('ln',l_orderkey,':',l_linenumber,':',l_partkey,':',l_suppkey,':',cast(floor(l_extendedprice) as bigint)) read_name,
 cast(l_suppkey % 25 as int) ref_id, cast((l_orderkey*131 + l_partkey*17 + l_linenumber) % 1000000 as int) pos,
 cast(case l_returnflag when 'R' then 16 else 0 end + case l_linestatus when 'F' then 1 else 0 end + case l_partkey % 13 when 0 then 4 else 0 end as int) flag,
 cast((l_linenumber*7+l_partkey) % 61 as int) mapq, l_returnflag read_group,
 case l_partkey % 8 when 0 then concat(q,'M') when 1 then concat('5S',q,'M') when 2 then concat(q,'M2I10M') when 3 then concat(q,'M3D10M')
  when 4 then concat(q,'M1I4M2D6M3S') when 5 then concat('4H',q,'M100N',q,'M') when 6 then concat(q,'=1X',q,'=') else concat('3S',q,'M2P1I',q,'M') end cigar,
 cast(l_linenumber as int) nm, cast(case l_partkey % 5 when 0 then -1 when 1 then case when l_suppkey % 10 = 9 then -1 else l_suppkey % 25 end else (l_suppkey + 1) % 25 end as int) next_ref_id,
 cast(case when l_suppkey % 10 = 9 then -1 else l_suppkey % 25 end as int) placed_ref_id,
 cast((l_orderkey*131 + l_partkey*17 + l_linenumber + 300) % 1000000 as int) next_pos, cast(l_linenumber * 37 - 100 as int) t_len, cast(20 + l_linenumber as int) l_seq,
 cast(l_quantity as int) first_qual, l_partkey % 11 = 0 no_qual, l_orderkey, l_linenumber, l_partkey, l_suppkey
from (select *, cast(cast(l_quantity as int) as {STR}) q from {lineitem})
"""
REFERENCES = "select n_nationkey as ref_id, n_name as name, cast(1048576 + n_nationkey * 4096 as int) as length from {nation}"
REGIONS = """
select p_partkey as region_id, case when p_partkey % 50 = 49 then 'UNKNOWN' else concat('NATION_', p_partkey % 25) end as name,
 cast((p_partkey * 499) % 1000000 as int) as beg, cast((p_partkey * 499) % 1000000 + p_size * 20 as int) as fin from {part}
"""
HEADER = """
select 0 as grp, 0 as k, concat('@HD', chr(9), 'VN:1.6', chr(9), 'SO:coordinate') as line
 union all select 1, n_nationkey, concat('@SQ', chr(9), 'SN:', n_name, chr(9), 'LN:', 1048576 + n_nationkey * 4096) from {nation} where n_nationkey % 2 = 0
 union all select 2, ascii(f), concat('@RG', chr(9), 'ID:', f, chr(9), 'SM:sample', chr(9), 'badfield') from (select distinct l_returnflag as f from {lineitem}) t
 union all select 3, 0, concat('@CO', chr(9), 'free: text', chr(9), 'kept')
"""
FASTA = """
select concat('doc', doc_id) as name, k as line_no, case when k = n_chars % 5 then substr(b, 1, 20) else b end as bases
 from (select doc_id, n_chars, k, translate(md5(concat(doc_id, ':', k)), '0123456789abcdef', 'ACGTACGTACGTACGT') as b
  from {documents} cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4) t where k <= n_chars % 5) u
"""
CORE = """
select concat('ln', l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey) as read_name,
 cast((l_partkey % 37450) * 65536 + ((l_linenumber * 7 + l_partkey) % 61) * 256 + l_linenumber as bigint) as bin_mq_nl,
 cast((case l_returnflag when 'R' then 16 else 0 end + case l_linestatus when 'F' then 1 else 0 end) * 65536 + l_linenumber as bigint) as flag_nc from {lineitem}
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql.replace("{STR}", "string"), **{t: dealt(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in used})


def duck(sql: str) -> str:
    """The view's SQL for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{STR}", "varchar")
