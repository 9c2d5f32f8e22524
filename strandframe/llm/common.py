"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.shared import col, cols, dealt, drop, drop_scratch, meet, scratch_path, shared_dir, stash, unused  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def numbered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """These columns of ``df`` as c0, c1, ...: Arrow functions of Spark do not take all names."""
    return df.select(*[col(n).alias(f"c{i}") for i, n in enumerate(names)])


def ddl(fields) -> str:
    """The schema of some fields as text."""
    return ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in fields)


def place(uri: str):
    """(file system, path) of a URI or a local path, for tasks that read and write files themselves."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) ranges whose sizes add up to about ``limit`` at most; a larger
    single item gets a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batch, column: int, limit: int = 1 << 20) -> Iterator:
    """The batch in parts of about ``limit`` bytes of a text column, so that not all of its texts are
    Python strings at a time."""
    import pyarrow.compute as pc

    for a, b in by_bytes([n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()], limit):
        yield batch.slice(a, b - a)


_resident: dict[Any, Any] = {}


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """A Python worker's one large object: it stays from task to task, until a task asks for another
    one. Workers outlive operators and several share an executor's memory."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def tidy(run: Callable) -> Callable:
    """An Arrow function that gives its freed memory back to the system when a task ends."""

    def tidied(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied
