"""The ``bam`` format: ``spark.read.format("bam")`` and ``df.write.format("bam")``.

Reading. Partitions are planned from the files' sizes alone: pieces of about ``split_bytes`` (default
SPLIT, less where there would be fewer than ``min_partitions``), small files several to a
partition. The task reads the header and the index (option
``index``, default the file's name and .bai) and starts at the first record behind its piece's
border: the index knows starts of records, elsewhere blocks are found by their magic bytes and
records by a chain of plausible ones, and both neighbours of a border find the same start. With
``region`` (``name:beg-end``, 0-based, half open) only the index' chunks that may overlap it are
read; with ``pushdown`` this also goes for comparisons of ref_name, ref_id and pos. Columns that
the user's schema leaves out are not decoded: ``read_bam(columns=...)``.

Writing. A task writes one file, with its own header blocks, and its index if its rows come sorted.
Files get their final names on commit; an aborted or repeated task leaves none.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from strandframe.schema import ALIGNMENT, BAM_MAGIC
from strandframe.sources.bai import BaiDataSource, Index, IndexBuilder
from strandframe.sources.bgzf import PAYLOAD, BgzfError, BgzfReader, BgzfWriter, first_block, read_block
from strandframe.sources.columnar import CORE, Records, encode

#: Bytes of a file for a partition, at most and where more partitions are asked for; of records
#: decoded at a time.
SPLIT, LEAST, RUN = 64 << 20, 1 << 20, 1 << 20
#: Beyond every virtual offset.
END = 1 << 63
#: Plausible records in a row that make a start.
CHAIN = 5


def local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def list_files(path: str, suffix: str) -> list[str]:
    """A file, or a folder's files of that suffix, sorted. Python sources read mounted paths."""
    path = local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(suffix))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def read_header(f: BgzfReader) -> tuple[str, list[tuple[str, int]]]:
    """(text, references); the cursor is at the first record afterwards."""
    if f.read(4) != BAM_MAGIC:
        raise ValueError(f"{f.path}: not a BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode("latin-1")
    references = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        name = f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode("latin-1")
        references.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, references


def header_bytes(text: str, references: list[tuple[str, int]]) -> bytes:
    raw = text.encode("latin-1")
    out = [BAM_MAGIC, struct.pack("<i", len(raw)), raw, struct.pack("<i", len(references))]
    for name, length in references:
        n = name.encode("latin-1") + b"\0"
        out += [struct.pack("<i", len(n)), n, struct.pack("<i", length)]
    return b"".join(out)


@dataclass
class Split(InputPartition):
    pieces: list  # of (path, first byte, byte behind the last, size of the file)


def plan(paths: list[str], most: int, parts: int = 1) -> list[Split]:
    """Partitions of about ``most`` bytes, from the files' sizes alone; smaller ones, down to LEAST, where
    there would be fewer than ``parts``."""
    sizes = [os.path.getsize(path) for path in paths]
    most = min(most, max(LEAST, -(-sum(sizes) // max(1, parts))))
    out, held, room = [], [], max(1, most)
    for path, size in zip(paths, sizes):
        step = -(-size // max(1, -(-size // max(1, most)))) or 1
        for a in range(0, max(size, 1), step):
            n = min(size - a, step)
            if held and n > room:
                out.append(Split(held))
                held, room = [], max(1, most)
            held.append((path, a, a + n, size))
            room -= n
    return out + [Split(held)] * bool(held)


def first_record(path: str, start: int, references: list[tuple[str, int]]) -> int:
    """Virtual offset of the first record in the blocks from byte ``start`` on, END if there is none:
    where CHAIN plausible records, or all up to the end of the file, follow one another."""
    limits = np.array([n for _, n in references] + [1 << 31], dtype=np.int64)
    with open(path, "rb") as f:
        at = first_block(f, start)
        f.seek(at)
        marks, places, data, wanted, end = [], [], b"", 1 << 18, False
        while True:
            parts, n = [data], len(data)
            while n < wanted and not end:
                try:
                    block = read_block(f)
                except (BgzfError, zlib.error):
                    block = None
                if block is None:
                    end = True
                else:
                    marks.append(n)
                    places.append(at)
                    parts.append(block[0])
                    n, at = n + len(block[0]), at + block[1]
            data = b"".join(parts)
            m = n - 4 - CORE.size
            if m < 0:
                return END
            word = lambda k, kind="<i4": np.ndarray((m + 1,), kind, data, k, (1,)).astype(np.int64)
            size, ref, pos, names, ops, bases, mate, mate_pos = word(0), word(4), word(8), word(12, "<u4") & 255, word(16, "<u4") & 65535, word(20), word(24), word(28)
            good = (ref >= -1) & (ref < len(references)) & (mate >= -1) & (mate < len(references)) & (pos >= -1) & (mate_pos >= -1) & (names > 0) & (bases >= 0)
            good &= size >= CORE.size + names + 4 * ops + (bases + 1) // 2 + bases
            good &= pos <= limits[np.where(good, ref, -1)]
            chars, where = np.frombuffer(data, np.uint8), np.flatnonzero(good)
            nul = where + 4 + CORE.size + names[where] - 1
            inside = nul < n
            good[where[inside]] = chars[nul[inside]] == 0
            unsure = False
            for p in np.flatnonzero(good).tolist():
                x, k = p, 0
                while k < CHAIN and x <= m and good[x]:
                    x, k = x + 4 + int(size[x]), k + 1
                if k == CHAIN or end and x == n:
                    b = int(np.searchsorted(marks, p, "right")) - 1
                    return places[b] << 16 | p - marks[b]
                unsure = unsure or x > m
                if unsure and not end:
                    break  # more data will tell
            if end:
                return END
            wanted *= 2


def record_runs(f, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, first bytes, sizes, virtual offsets) of the whole records that start in [start, end),
    about RUN bytes at a time. Raises BgzfError with the place where a record is cut off."""
    f.seek(start >> 16)
    place, data, marks, places = start >> 16, b"", [], []
    x, skip, done, need = 0, start & 0xFFFF, False, 0
    while True:
        data, marks = data[x:], [k - x for k in marks]
        keep = max(0, int(np.searchsorted(marks, 0, "right")) - 1)
        marks, places = marks[keep:], places[keep:]
        parts, n, broken = [data], len(data), None
        while not done and (n < RUN and place <= end >> 16 or n < need):
            try:
                block = read_block(f)
            except (BgzfError, zlib.error) as e:
                block, broken = None, e
            if block is None:
                done = True
            else:
                marks.append(n - (skip if not marks else 0))
                places.append(place)
                parts.append(block[0][skip:] if skip else block[0])
                n, place, skip = n + len(parts[-1]), place + block[1], 0
        data = b"".join(parts)
        x, at, sizes = 0, [], []
        unpack = struct.Struct("<i").unpack_from
        while x + 4 <= n:
            (size,) = unpack(data, x)
            if size < CORE.size or x + 4 + size > n:
                break
            at.append(x)
            sizes.append(size)
            x += 4 + size
        if at:
            first = np.array(at, dtype=np.int64)
            b = np.searchsorted(marks, first, "right") - 1
            where = np.array(places, dtype=np.int64)[b] << 16 | (first - np.array(marks, dtype=np.int64)[b])
            mine = where < end if end < END else np.ones(len(first), bool)
            yield np.frombuffer(data, np.uint8), first[mine] + 4, np.array(sizes, dtype=np.int64)[mine], where[mine]
            if not mine.all():
                return
        if x < n:  # part of a record: does it start before the end?
            b = int(np.searchsorted(marks, x, "right")) - 1
            here = places[b] << 16 | x - marks[b]
            if here >= end:
                return
            size = unpack(data, x)[0] if x + 4 <= n else CORE.size
            if done or size < CORE.size:
                raise BgzfError(f"a record is cut off at {here}" + (f": {broken}" if broken else ""))
            need = max(4 + size, n - x + 1)
        elif done or place > end >> 16:
            if broken:
                raise BgzfError(f"a record is cut off at {place << 16}: {broken}")
            return


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> T.StructType:
        return ALIGNMENT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "false") == "true" else BamReader)(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return BamStreamReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool):
        return BamWriter(self.options, schema, overwrite)


class BamReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.schema = dict(options), schema
        self.name = self.ref_id = None
        self.beg, self.end = 0, 1 << 31
        self.bounded = False
        if region := self.options.get("region"):
            name, _, rest = region.rpartition(":")
            beg, _, end = rest.partition("-")
            self.name, self.beg, self.end, self.bounded = name, int(beg), int(end), True

    def files(self) -> list[str]:
        return list_files(self.options["path"], ".bam")

    def partitions(self) -> list[Split]:
        return self.plan(self.files())

    def plan(self, paths: list[str]) -> list[Split]:
        return plan(paths, int(self.options.get("split_bytes", SPLIT)), int(self.options.get("min_partitions", "1")))

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was no split
            return
        schema = to_arrow_schema(self.schema)
        for piece in partition.pieces:
            yield from self._piece(*piece, schema)

    def ranges(self, path: str, a: int, b: int, size: int, references: list, first: int) -> tuple[int | None, list[tuple[int, int]]]:
        """(reference asked for, ranges of virtual offsets that this piece of the file has to read)."""
        index, ref = Index.load(self.options.get("index") or path + ".bai"), self.ref_id
        if self.name is not None:
            ref = next((i for i, r in enumerate(references) if r[0] == self.name), -2)
            if ref == -2:
                return ref, []
        known = np.array(index.starts() if index else [], dtype=np.int64)

        def start(byte: int) -> int:
            if byte <= first >> 16:
                return first
            k = int(np.searchsorted(known, byte << 16))
            return int(known[k]) if k < len(known) else first_record(path, byte, references)

        low, high = start(a), END if b >= size else start(b)
        if index is not None and ref is not None and ref >= 0:
            found = index.chunks(ref, self.beg, self.end)
        else:
            found = [(first, END)]
        return ref, [(max(x, low), min(y, high)) for x, y in found if x < high and y > low and low < high]

    def _piece(self, path: str, a: int, b: int, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        f = BgzfReader(path, eof=self.options.get("eofmarker", "warn") if b >= size else "ignore")
        try:
            _, references = read_header(f)
            ref, ranges = self.ranges(path, a, b, size, references, f.tell())
            names = pa.array([r[0] for r in references] + [None], pa.string())
            for start, end in ranges:
                for buf, at, sizes, where in record_runs(f.f, start, end):
                    rows = Records(buf, at, sizes)
                    if self.bounded and ref is not None:
                        keep = np.flatnonzero((rows.core["ref_id"] == ref) & (rows.core["pos"] < self.end))
                        rows, where = rows.take(keep), where[keep]
                        keep = np.flatnonzero(rows.core["pos"] + np.maximum(1, rows.span()) > self.beg)
                        rows, where = rows.take(keep), where[keep]
                    if len(where):
                        ids = rows.core["ref_id"]
                        yield rows.columns(schema, {"ref_name": names.take(pa.array(np.where(ids < 0, len(references), ids))), "file": pa.repeat(pa.scalar(path), len(where)), "voffset": pa.array(where)})
        except BgzfError as e:
            if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST" or "cut off" not in str(e):
                raise
            print(f"{path}: {e}", file=sys.stderr)
        finally:
            f.close()


class PushingReader(BamReader):
    """Prunes by pushed comparisons. All of them go back to Spark, which tests every row again.

    Spark 4.1 keeps the pruned plan with the loaded relation, so a second query over the same
    DataFrame would see the first one's partitions only. Hence the option ``pushdown`` is off
    unless asked for, and then the DataFrame serves one query.
    """

    def pushFilters(self, filters):
        for x in filters:
            match x:
                case EqualTo(("ref_name",), v):
                    self.name = v
                case EqualTo(("ref_id",), v):
                    self.ref_id = v
                case LessThan(("pos",), v):
                    self.end = min(self.end, v)
                case LessThanOrEqual(("pos",), v):
                    self.end = min(self.end, v + 1)
                case EqualTo(("pos",), v):
                    self.beg, self.end = max(self.beg, v), min(self.end, v + 1)
                case GreaterThan(("pos",), v) | GreaterThanOrEqual(("pos",), v):
                    self.beg = max(self.beg, v)
            yield x


class BamStreamReader(DataSourceStreamReader):
    """New .bam files of a folder, by the time that they came there (the last change of the file's
    entry), whatever their names. The offset is that time of the newest file, with the names of all
    that have it. Move files in when they are complete."""

    def __init__(self, options, schema: T.StructType):
        self.inner = BamReader(options, schema)

    def seen(self) -> list[tuple[int, str]]:
        return sorted((os.stat(p).st_ctime_ns, p) for p in self.inner.files())

    def initialOffset(self) -> dict:
        return {"time": 0, "names": []}

    def latestOffset(self) -> dict:
        files = self.seen()
        last = files[-1][0] if files else 0
        return {"time": last, "names": [os.path.basename(p) for t, p in files if t == last]}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        def upto(offset: dict, t: int, p: str) -> bool:
            return t < offset["time"] or t == offset["time"] and os.path.basename(p) in offset["names"]

        return self.inner.plan([p for t, p in self.seen() if upto(end, t, p) and not upto(start, t, p)])

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.inner.read(partition)


@dataclass
class Written(WriterCommitMessage):
    files: list


class PartWriter(DataSourceArrowWriter):
    """One file a task, with its final name from the commit on."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.folder = local(self.options["path"])
        self.job = uuid.uuid4().hex[:8]  # its unfinished files are its own

    def part(self) -> str:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        return os.path.join(self.folder, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.suffixes[0]}")

    def own(self, name: str) -> str:
        return f"{name}.{self.job}.tmp"

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        keep = {x for m in messages if m for x in m.files}
        old = [x for x in os.listdir(self.folder) if x.endswith(self.suffixes)] if self.overwrite else []
        for x in sorted(keep):
            os.rename(self.own(x), x)
        for x in old:
            os.remove(os.path.join(self.folder, x))
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """What repeated or failed tasks of this job left."""
        for x in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if x.endswith(f".{self.job}.tmp"):
                os.remove(os.path.join(self.folder, x))


class BamWriter(PartWriter):
    """Options: header (text), references (``name length`` lines), level."""

    suffixes = (".bam", ".bai")

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        super().__init__(options, schema, overwrite)
        missing = {"read_name", "flag", "ref_id", "pos"} - set(schema.names)
        if missing:
            raise ValueError(f"bam rows need the columns {sorted(missing)}")
        self.references = [(a, int(b)) for a, b in (x.rsplit(" ", 1) for x in self.options.get("references", "").splitlines() if x)]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        name = self.part()
        index, n, at = IndexBuilder(len(self.references)), 0, 0
        out = BgzfWriter(open(self.own(name), "wb"), int(self.options.get("level", "6")))
        out.write(header_bytes(self.options.get("header", ""), self.references))
        out.flush()  # the header has blocks of its own
        marks, before = out.marks, 0  # places of the blocks from number ``before`` on
        for batch in batches:
            data, ends, rows = encode(batch)
            if len(rows["ref_id"]) and rows["ref_id"].max() >= len(self.references):
                k = int(rows["ref_id"].argmax())
                raise ValueError(f"{batch.column('read_name')[k]}: no reference {rows['ref_id'][k]}")
            out.write(data)
            if index.sorted:
                edges = np.concatenate([[at], at + ends])
                where = np.array(marks, dtype=np.int64)[edges // PAYLOAD - before] << 16 | edges % PAYLOAD
                index.add(rows["ref_id"], rows["pos"], rows["span"], rows["flag"], where[:-1], where[1:])
            at += len(data)
            before += len(marks) - 1
            del marks[:-1]
            n += batch.num_rows
        out.close()
        done = []
        if n:
            done.append(name)
            if index.sorted:
                with open(self.own(name + ".bai"), "wb") as f:
                    f.write(index.bytes())
                done.append(name + ".bai")
        else:
            os.remove(self.own(name))
        return Written(done)


def register(spark: SparkSession) -> None:
    """Makes the formats bam, bai, bgzf and fasta known to the session, and that one the active one: the
    name of a format is looked up there, and a query may have left another or none active."""
    from strandframe.sources.blocks import BgzfDataSource
    from strandframe.sources.fasta import FastaDataSource

    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BamDataSource, BaiDataSource, BgzfDataSource, FastaDataSource):
        spark.dataSource.register(source)


def read_bam(spark: SparkSession, path: str, *, columns: list[str] | None = None, region: tuple[str, int, int] | None = None, pushdown: bool = False, **options: str) -> DataFrame:
    """columns: those to decode. region: (name, beg, end), 0-based, half open: only what may overlap it
    is read, and only overlapping records come out. pushdown: see PushingReader."""
    register(spark)
    reader = spark.read.format("bam").option("pushdown", str(pushdown).lower()).option("min_partitions", str(spark.sparkContext.defaultParallelism)).options(**options)
    if columns:
        reader = reader.schema(T.StructType([ALIGNMENT[c] for c in columns]))
    if region:
        reader = reader.option("region", f"{region[0]}:{region[1]}-{region[2]}")
    return reader.load(path)


def write_bam(df: DataFrame, path: str, *, header: str = "", references: list[tuple[str, int]] = (), mode: str = "overwrite", **options: str) -> None:
    """references: (name, length) by ref_id. Sort the rows within partitions to get indexes."""
    register(df.sparkSession)
    df.write.format("bam").option("header", header).option("references", "\n".join(f"{a} {b}" for a, b in references)).options(**options).mode(mode).save(path)


def read_references(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and references of a file, or of a folder's first file."""
    f = BgzfReader(list_files(path, ".bam")[0])
    try:
        return read_header(f)
    finally:
        f.close()


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, references) of each file, read by tasks: references is an array of (ref_id, name,
    length). A folder is listed on the driver."""
    files = list_files(path, ".bam")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("ref_id", pa.int32()), ("name", pa.string()), ("length", pa.int32())]))
        for batch in batches:
            for file in batch.column(0).to_pylist():
                text, references = read_references(file)
                rows = [{"ref_id": i, "name": n, "length": x} for i, (n, x) in enumerate(references)]
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([text]), pa.array([rows], kind)], names=["file", "text", "references"])

    paths = spark.createDataFrame([(x,) for x in files], "file string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)), "file")
    return paths.mapInArrow(run, "file string, text string, references array<struct<ref_id:int,name:string,length:int>>")


def references_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, ref_id, name, length) of each file's references, in their order."""
    return headers(spark, path).select("file", F.inline("references"))


def header_lines_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec_idx, line) of each file's header text, for ``operators.header.header_records``."""
    return headers(spark, path).select("file", F.posexplode(F.split("text", "\n", -1)).alias("rec_idx", "line"))
