"""The ``fasta`` format (lines with their places) and .fai tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandframe.schema import FAI
from strandframe.shared import ranked
from strandframe.sources.bam import Split


class FastaDataSource(DataSource):
    """Body lines: file, name, line_no, offset (of its first base), bases, line_len (with its end).
    The name is the header's first word; a blank line ends a sequence; text outside one raises. A
    file is one partition, as its headers govern what follows; with the option ``index``, the path
    of its .fai, it is cut into pieces of ``split_bytes``, and line_no counts a header and the
    index' lines for each sequence."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, name string, line_no long, offset long, bases string, line_len int"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(dict(self.options))


Entry = tuple[str, int, int, int, int]


def fai_entry(line: str, path: str) -> Entry | None:
    """(name, len, offset, line_blen, line_len) of a line of a .fai file; None if it is blank."""
    if not line.strip():
        return None
    cells = line.rstrip("\r\n").split("\t")
    if len(cells) != 5:
        raise ValueError(f"{path}: bad number of index fields: {cells}")
    return (cells[0].split()[0], *map(int, cells[1:]))


def line_count(entry: Entry) -> int:
    return -(-entry[1] // entry[3]) if entry[3] else 0


def load_fai(path: str) -> list[Entry]:
    """The entries of a .fai file, in the order of the offsets."""
    with open(path, encoding="latin-1") as f:
        return sorted((e for line in f if (e := fai_entry(line, path))), key=lambda e: e[2])


#: Partitions at most that the pieces of an indexed file are dealt to.
PARTITIONS = 2000


@dataclass
class Marked(Split):
    """marks: for each piece (byte of the .fai, lines before) of the first sequence that may reach into it."""

    marks: list


def mark(pieces: list, path: str) -> list[tuple[int, int] | None]:
    """A mark for each piece, by one pass over the .fai, of which nothing is held. None for all where its
    lines are not in the order of the offsets: then tasks load and sort it."""
    out: list[tuple[int, int] | None] = []
    at = number = 0
    last = -1
    with open(path, "rb") as f:
        for raw in f:
            if entry := fai_entry(raw.decode("latin-1"), path):
                if entry[2] < last:
                    return [None] * len(pieces)
                last, lines = entry[2], line_count(entry)
                while len(out) < len(pieces) and pieces[len(out)][1] < entry[2] + lines * entry[4]:
                    out.append((at, number))
                number += 1 + lines  # with the header
            at += len(raw)
    return out + [(at, number)] * (len(pieces) - len(out))


def entries_from(path: str, at: int) -> Iterator[Entry]:
    with open(path, "rb") as f:
        f.seek(at)
        for raw in f:
            if entry := fai_entry(raw.decode("latin-1"), path):
                yield entry


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("line_no", pa.int64()), ("offset", pa.int64()), ("bases", pa.string()), ("line_len", pa.int32())])
    while held := list(islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        from strandframe.sources.bam import SPLIT, local, plan

        path = local(self.options.get("path", ""))
        if self.options.get("index"):
            pieces = [x for p in plan([path], int(self.options.get("split_bytes", SPLIT))) for x in p.pieces]
            marks, per = mark(pieces, local(self.options["index"])), -(-len(pieces) // PARTITIONS)
            return [Marked(pieces[k : k + per], marks[k : k + per]) for k in range(0, len(pieces), per)]
        files = [os.path.join(path, x) for x in sorted(os.listdir(path)) if x.endswith((".fa", ".fasta", ".fna"))] if os.path.isdir(path) else [path]
        return [Split([(x, 0, os.path.getsize(x), os.path.getsize(x))]) for x in files]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        if self.options.get("index"):
            for (path, a, b, _), place in zip(partition.pieces, partition.marks):
                yield from batches(self._indexed(path, a, b, place))
        else:
            for path, *_ in partition.pieces:
                yield from batches(self._whole(path))

    def _indexed(self, path: str, a: int, b: int, place: tuple[int, int] | None) -> Iterator[tuple]:
        """The lines that start in [a, b)."""
        from strandframe.sources.bam import local

        index = local(self.options["index"])
        at, number = place or (0, 0)
        with open(path, "rb") as f:
            for entry in entries_from(index, at) if place else load_fai(index):
                name, size, offset, bases, width = entry
                if offset >= b:
                    return
                number += 1  # the header
                lines = line_count(entry)
                first, last = max(0, -(-(a - offset) // width)) if width else 0, min(lines, max(0, -(-(b - offset) // width))) if width else 0
                for k in range(first, last, 4096):
                    n = min(4096, last - k)
                    f.seek(offset + k * width)
                    block = f.read(n * width)
                    for i in range(n):
                        line = block[i * width : i * width + min(bases, size - (k + i) * bases)]
                        whole = block[i * width : (i + 1) * width] if k + i < lines - 1 else block[i * width : i * width + len(line) + width - bases]
                        yield (path, name, number + k + i, offset + (k + i) * width, line.decode("latin-1"), len(whole))
                number += lines

    def _whole(self, path: str) -> Iterator[tuple]:
        name, at = None, 0
        with open(path, "rb") as f:
            for k, line in enumerate(f):
                if line.startswith(b">"):
                    words = line[1:].split()
                    name = words[0].decode("latin-1") if words else ""
                elif not line.strip():
                    name = None
                elif name is None:
                    raise ValueError(f"{path}: text outside a sequence at byte {at}")
                else:
                    yield (path, name, k, at, line.strip().decode("latin-1"), len(line))
                at += len(line)


def read_fasta(spark: SparkSession, path: str, **options: str) -> DataFrame:
    from strandframe.sources.bam import register

    register(spark)
    return spark.read.format("fasta").options(**options).load(path)


def build_index(lines: DataFrame) -> DataFrame:
    """The .fai table of ``read_fasta`` rows, with fai_idx, the order of first appearance."""
    from strandframe.operators.sequences import build_fai

    firsts = lines.groupBy("name").agg(F.min("offset").alias("offset"), F.min(F.struct("file", "line_no")).alias("place"))
    fai = build_fai(lines.select("name", "line_no", "bases", "line_len")).join(firsts, "name")
    return ranked(fai, [F.col("place")], "fai_idx").select(F.col("fai_idx").cast("int").alias("fai_idx"), "name", "len", "offset", "line_blen", "line_len")


def write_fai(index: DataFrame, path: str) -> None:
    """Writes a .fai table as one file of its lines, in order, on the driver: a line per sequence."""
    rows = index.orderBy("fai_idx").select("name", "len", "offset", "line_blen", "line_len").toLocalIterator()
    with open(path, "w", encoding="latin-1") as f:
        f.writelines("\t".join(map(str, r)) + "\n" for r in rows)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(fai_idx, name, len, offset, line_blen, line_len). Exactly five fields are needed; the name is
    cut at white space. A repeated name keeps its first place and takes the later values. Lines are
    numbered by the pieces of the file that tasks read: a line's place in its piece, behind the lines
    of the pieces before."""
    near = F.monotonically_increasing_id()
    read = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), near.alias("near"))
    firsts, before, last = [], 0, None
    for r in read.groupBy("file", "start").agg(F.min("near").alias("near"), F.count("*").alias("n")).orderBy("file", "start").collect():
        before = before if r.file == last else 0
        firsts.append((r.file, r.start, before - r.near))
        before, last = before + r.n, r.file
    starts = F.broadcast(spark.createDataFrame(firsts, "file string, start long, shift long"))
    raw = read.join(starts, ["file", "start"]).select((F.col("near") + F.col("shift")).cast("int").alias("fai_idx"), "line").filter("line <> ''")
    cells = F.split("line", "\t", -1)
    checked = raw.withColumn("c", F.when(F.size(cells) == 5, cells).otherwise(F.raise_error(F.concat(F.lit("bad number of index fields: "), "line")).cast("array<string>")))
    kinds = [f.dataType for f in FAI]
    rows = checked.select("fai_idx", F.get(F.split(F.get("c", F.lit(0)), r"\s+"), F.lit(0)).alias("name"), *[F.get("c", F.lit(i)).cast(kinds[i]).alias(FAI[i].name) for i in range(1, 5)])
    return rows.groupBy("name").agg(F.min("fai_idx").alias("fai_idx"), *[F.max_by(c, "fai_idx").alias(c) for c in ("len", "offset", "line_blen", "line_len")]).select("fai_idx", "name", "len", "offset", "line_blen", "line_len")
