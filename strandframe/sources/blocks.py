"""The ``bgzf`` format: blocks of blocked gzip as rows, and rows as blocks.

Reading: (file, coffset, size, data), one row a block, empty ones included; ``size`` is the block's
in the file. Files are cut into pieces of ``split_bytes``, at the first block behind each border.
Options: eofmarker (warn, fail or ignore a missing end marker), verify (checksums, default true).

Writing: a column ``data`` of bytes or text. A task writes its rows one behind the other into one
file. A row is cut only if it is longer than a block: another one that does not fit begins a new
block, so that each block can be read by itself. Option: level.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandframe.sources.bam import SPLIT, PartWriter, Split, Written, list_files, plan
from strandframe.sources.bgzf import PAYLOAD, BgzfError, BgzfWriter, first_block, has_eof, read_block

SUFFIXES = (".bgzf", ".bgz", ".gz", ".bam")
SCHEMA = "file string, coffset long, size int, data binary"


class BgzfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BlockReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool):
        return BlockWriter(self.options, schema, overwrite)


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[Split]:
        return plan(list_files(self.options["path"], SUFFIXES), int(self.options.get("split_bytes", SPLIT)))

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        for path, a, b, size in partition.pieces if partition else ():
            with open(path, "rb") as f:
                if b >= size and self.options.get("eofmarker", "warn") != "ignore" and not has_eof(f):
                    if self.options.get("eofmarker") == "fail":
                        raise BgzfError(f"{path}: no end marker")
                    print(f"{path}: no end marker", file=sys.stderr)
                at, rows = first_block(f, a) if a else 0, []
                f.seek(at)
                while at < b and (block := read_block(f, self.options.get("verify", "true") == "true")) is not None:
                    rows.append((path, at, block[1], block[0]))
                    at += block[1]
                    if len(rows) == 64:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("file", pa.string()), ("coffset", pa.int64()), ("size", pa.int32()), ("data", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


class BlockWriter(PartWriter):
    suffixes = (".bgzf",)

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        super().__init__(options, schema, overwrite)
        if "data" not in schema.names:
            raise ValueError("bgzf rows need a column data")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        name = self.part()
        out = BgzfWriter(open(self.own(name), "wb"), int(self.options.get("level", "6")))
        for batch in batches:
            for data in batch.column("data").cast(pa.binary()).to_pylist():
                if data and len(out.held) + len(data) > PAYLOAD:
                    out.flush()
                out.write(data or b"")
        out.close()
        return Written([name])
