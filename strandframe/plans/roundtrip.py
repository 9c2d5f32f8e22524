"""Queries that write alignment files to the session's scratch folder and read them back."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.functions import cigar as C
from strandframe.functions import record as R
from strandframe.operators import header as H
from strandframe.plans import views as V
from strandframe.shared import scratch_path


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared one, which must be mounted: Python sources open paths."""
    from strandframe.sources.bam import local

    path = local(scratch_path(spark, name))
    if "://" in path:
        raise RuntimeError(f"alignment files need a mounted folder, {path} is none")
    return path


def sam_lines(rows: DataFrame) -> DataFrame:
    """read_name and the text line of rows with ops, seq, an array of qualities, aux, ref_name, rnext."""
    line = R.to_sam(read_name=F.col("read_name"), flag=F.col("flag"), ref_name=F.col("ref_name"), pos=F.col("pos"), mapq=F.col("mapq"), cigar=F.col("ops"), rnext=F.col("rnext"), next_pos=F.col("next_pos"), t_len=F.col("t_len"), seq=F.col("seq"), qual=F.col("qual"), aux_text=F.col("aux_text"))
    return rows.withColumn("aux_text", R.sam_aux(F.col("aux"))).select("read_name", line.alias("line"))


def _rows(view: DataFrame) -> DataFrame:
    """The records of rows of the view, in their order."""
    from strandframe.plans.queries import with_aux, with_qual

    own = with_aux(with_qual(view.withColumn("ref_id", F.col("placed_ref_id"))))
    return own.select("read_name", "flag", "ref_id", "pos", "mapq", C.parse_cigar(F.col("cigar")).alias("cigar"), "next_ref_id", "next_pos", "t_len", "l_seq", R.decode_seq(F.unhex(F.md5(F.col("read_name").cast("binary"))), F.col("l_seq")).alias("seq"), R.qual_bytes(F.col("qual")).alias("qual"), "aux")


def _written(spark: SparkSession, d: str) -> str:
    """Coordinate-sorted BAM files with their indexes, one reference in one file."""
    from strandframe.sources.bam import write_bam

    path = folder(spark, "bam")
    references = [(r["name"], r["length"]) for r in V.view(spark, d, V.REFERENCES).orderBy("ref_id").collect()]
    key = F.when(F.col("placed_ref_id") < 0, F.lit(1 << 30)).otherwise(F.col("placed_ref_id"))
    header = "\n".join(r["line"] for r in V.view(spark, d, V.HEADER).orderBy("grp", "k").collect())
    # the ranges are the session's shuffle partitions, so their number follows the cluster; records are made
    # where they are written, neither for the sample that finds the ranges nor before the shuffle
    dealt = V.view(spark, d, V.ALIGNMENTS).repartitionByRange(key, "pos", "read_name").sortWithinPartitions(key, "pos", "read_name")
    write_bam(_rows(dealt), path, header=header, references=references)
    return path


def bam_roundtrip(spark, d):
    from strandframe.sources.bam import read_bam

    back = read_bam(spark, _written(spark, d))
    quals = F.array_join(R.qual_array(F.col("qual"), F.col("l_seq")).cast("array<string>"), ",")
    return back.select("read_name", "flag", "ref_id", "ref_name", "pos", "mapq", "bin", C.render_cigar(F.col("cigar"), "spec").alias("cigar"), "next_ref_id", "next_pos", "t_len", "l_seq", "seq", quals.alias("quals"), R.sam_aux(F.col("aux")).alias("aux"))


def bam_region_scan(spark, d):
    """Pruned by the index: columns and region reach the source."""
    from strandframe.sources.bam import read_bam

    back = read_bam(spark, _written(spark, d), columns=["read_name", "ref_id", "ref_name", "pos", "cigar"], region=("NATION_3", 100_000, 300_000))
    return back.filter((F.col("ref_id") == 3) & (F.col("pos") < 300_000)).select("read_name", "ref_name", "pos")


def linear_index(spark, d):
    """The first record of each window, by the written index: its position."""
    from strandframe.sources.bam import read_bam, register

    path = _written(spark, d)
    register(spark)
    linear = spark.read.format("bai").option("table", "linear").load(path)
    back = read_bam(spark, path, columns=["ref_id", "pos", "voffset", "file"])
    first = linear.withColumn("file", F.expr("substring(file, 1, length(file) - 4)")).join(back, ["file", "ref_id", "voffset"])
    return first.groupBy("ref_id", "window").agg(F.min("pos").alias("first_pos"))


def bai_stats(spark, d):
    from strandframe.sources.bam import register

    path = _written(spark, d)
    register(spark)
    stats = spark.read.format("bai").option("table", "stats").load(path)
    held = stats.groupBy("ref_id").agg(F.sum(F.coalesce("n_mapped", F.lit(0))).alias("n_mapped"), F.sum(F.coalesce("n_unmapped", F.lit(0))).alias("n_unmapped"))
    # reference -1: records without one, once a file
    unplaced = stats.groupBy("file").agg(F.max("n_no_coor").alias("n")).agg(F.lit(-1).alias("ref_id"), F.lit(0).cast("long").alias("n_mapped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_unmapped"))
    return held.unionByName(unplaced)


def file_references(spark, d):
    """The references of every file's header: each file has all of them."""
    from strandframe.sources.bam import references_table

    refs = references_table(spark, _written(spark, d))
    return refs.select("ref_id", "name", "length").distinct()


def file_header(spark, d):
    """Records of the files' header text, as the parser sees them."""
    from strandframe.sources.bam import header_lines_table

    lines = header_lines_table(spark, _written(spark, d)).select("rec_idx", "line").distinct()
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["tag"], F.lit("="), t["value"])), ";")
    return H.header_records(lines).select("rec_idx", "code", tags.alias("tags"), "comment")


def file_order(spark, d):
    """Records in file order: the place of each one on its reference, by file and virtual offset."""
    from strandframe.sources.bam import read_bam

    back = read_bam(spark, _written(spark, d), columns=["read_name", "ref_id", "file", "voffset"]).filter("ref_id >= 0")
    place = F.row_number().over(W.partitionBy("ref_id").orderBy("file", "voffset"))
    return back.select("read_name", "ref_id", place.alias("place"))


def bgzf_roundtrip(spark, d):
    """Read names through files of blocked gzip: written by tasks, read back block by block."""
    from strandframe.sources.bam import register

    path = folder(spark, "bgzf")
    register(spark)
    V.view(spark, d, V.ALIGNMENTS).select(F.concat("read_name", F.lit("\n")).cast("binary").alias("data")).write.format("bgzf").mode("append").save(path)
    blocks = spark.read.format("bgzf").option("split_bytes", str(1 << 16)).option("eofmarker", "fail").load(path)
    return blocks.select(F.explode(F.split(F.col("data").cast("string"), "\n")).alias("read_name")).filter("read_name <> ''")


def _fasta(spark: SparkSession, d: str) -> str:
    """The view's sequences as one FASTA file, in the order of their names."""
    body = V.view(spark, d, V.FASTA).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("line_no", "bases"))).alias("rows"))
    text = body.select(F.concat(F.lit(">"), "name", F.lit(" made\n"), F.array_join(F.transform("rows", lambda r: r["bases"]), "\n")).alias("value"), "name")
    path = folder(spark, "fasta")
    # tasks sort and write ranges of the names, in the order of the parts' numbers
    text.orderBy("name").select("value").write.text(path)
    parts = [os.path.join(path, x) for x in sorted(os.listdir(path)) if x.startswith("part-")]
    with open(os.path.join(path, "all.fa"), "wb") as out:
        for part in parts:
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
            os.remove(part)
    return os.path.join(path, "all.fa")


def fasta_source(spark, d):
    """Sequences written as one FASTA file, read by the source, indexed."""
    from strandframe.sources.fasta import build_index, read_fasta

    return build_index(read_fasta(spark, _fasta(spark, d)))


def fai_source(spark, d):
    """The index as a file, read back; and by it the sequences, in pieces: what each one's lines hold."""
    from strandframe.sources.fasta import build_index, read_fai, read_fasta, write_fai

    path = _fasta(spark, d)
    write_fai(build_index(read_fasta(spark, path)), path + ".fai")
    index = read_fai(spark, path + ".fai")
    lines = read_fasta(spark, path, index=path + ".fai", split_bytes="20000")
    whole = lines.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("line_no", "bases"))).alias("rows"))
    text = whole.select("name", F.md5(F.array_join(F.transform("rows", lambda r: r["bases"]), "").cast("binary")).alias("digest"))
    return index.join(text, "name").select("fai_idx", "name", "len", "offset", "digest")
