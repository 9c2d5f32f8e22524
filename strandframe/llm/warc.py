"""WARC archives with dictionary compression (.warc.zst), written and read by Spark tasks.

Each task that writes holds back its first records up to ``sample_bytes``, builds a Zstandard
dictionary from them, and starts each of its archives with a skippable frame that embeds the
dictionary. Every record is a frame of its own after that, so a reader can start at any record
and needs nothing but the archive. Equal payloads are stored once: the record with the smallest
id is the response, the others are revisits that refer to it.

Archives go to a folder that all executors share (or an object store that pyarrow can open), under
names that no two attempts share; the manifest, written when a task commits, names the archives
that count. What a lost or repeated attempt wrote is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import col, meet, place, scratch_path, stash, table, tidy

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(ident) -> str:
    return "<urn:page:>" if ident is None else f"<urn:page:{quote(str(ident), safe='')}>"


def ident(value: str) -> str | None:
    return unquote(value[len("<urn:page:") : -1]) or None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page, url: str | None, payload: bytes | None, digest: str, size: int, refers_to, date: str) -> bytes:
    """payload: None in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", urn(page)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(quote(c) if c < " " or c == "\x7f" else c for c in url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is None:
        return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))], http)
    return record("response", headers, http + payload)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where there is too little to train on, the samples' own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


class Archives:
    """One task's archives: ``add`` records, ``close`` at the end; ``done`` lists what was written."""

    def __init__(self, folder: str, task: int, level: int, sample_bytes: int, dict_bytes: int, max_bytes: int):
        self.folder, self.level, self.limits = folder, level, (sample_bytes, dict_bytes, max_bytes)
        self.stem = f"{folder}/part-{task:05d}-{uuid.uuid4().hex}"
        self.held: list[bytes] | None = []
        self.size, self.out, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.held is not None:
            self.held.append(data)
            self.size += len(data)
            if self.size >= self.limits[0]:
                self._start()
        else:
            self._write(data)

    def _start(self) -> None:
        import zstandard

        held, self.held, self.size = self.held, None, 0
        self.dict = dictionary(held, self.limits[1])
        kind = zstandard.ZstdCompressionDict(self.dict) if self.dict else None
        self.press = zstandard.ZstdCompressor(level=self.level, dict_data=kind)
        for data in held:
            self._write(data)

    def _write(self, data: bytes) -> None:
        if self.out is not None and self.size >= self.limits[2]:
            self._finish()
        if self.out is None:
            fs, folder = place(self.folder)
            fs.create_dir(folder, recursive=True)
            self.name = f"{self.stem}-{len(self.done):04d}.warc.zst"
            self.out = fs.open_output_stream(place(self.name)[1], compression=None)
            self.records, self.size = 0, 0
            self._put(struct.pack("<II", SKIPPABLE, len(self.dict)) + self.dict)
            self._put(self.press.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
        self._put(self.press.compress(data))
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _finish(self) -> None:
        self.out.close()
        self.done.append((self.name, self.size, self.records))
        self.out = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.held:
            self._start()
        if self.out is not None:
            self._finish()
        return self.done


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    level: int = 3,
    sample_bytes: int = 4 << 20,
    dict_bytes: int = 64 << 10,
    max_bytes: int = 256 << 20,
) -> DataFrame:
    """Writes a record per page into ``folder`` (default: one in the session's shared folder) and
    returns the manifest: path, bytes, records of each archive.

    Rows keep the partitions they come in, so a task writes what it reads, in archives of about
    ``max_bytes``; a task holds ``sample_bytes`` of records and one record at a time.

    A null payload is empty. Of records with equal payloads of at least ``min_bytes`` bytes those
    with the smallest id are responses and all others revisits; smaller payloads are always
    responses. A null id refers to the smallest id of its payload; where all ids are null, all are
    responses. Repeated rows are repeated records. A null URL leaves out the target header;
    control characters in one are percent-encoded. Other columns are not read. Empty pages give
    an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    base = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), F.coalesce(col(payload_col), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # only payloads that occur again matter; their rows know from (digest, size) whether they are first
    copies = stash(base.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter((F.col("rows") > 1) & F.col("first").isNotNull() & (F.col("size") >= min_bytes)), "copies")
    differs = lambda first: first.isNotNull() & ~F.col("id").eqNullSafe(first)
    # a payload may be a third of all rows: its rows lose the payload before any shuffle
    both = meet(base, copies, ["digest", "size"], "rows", spread=F.xxhash64("id", "url"), slim={"payload": lambda met: F.when(~differs(met["first"]), F.col("payload"))})
    again = differs(F.col("first"))
    rows = both.select("id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", F.when(again, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Archives(folder, TaskContext.get().partitionId(), level, sample_bytes, dict_bytes, max_bytes)
        for batch in batches:
            for page, url, payload, digest, size, refers_to in zip(*(c for c in batch.columns)):
                own.add(page_record(page.as_py(), url.as_py(), payload.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), size.as_py(), refers_to.as_py(), date))
        done = own.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return stash(rows.mapInArrow(tidy(run), "path string, bytes long, records long"), "manifest")


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, as a stream."""
    import zstandard

    fs, local = place(path)
    with fs.open_input_stream(local, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame at its start")
        raw = f.read(size)
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        stream = io.BufferedReader(press.stream_reader(f, read_across_frames=True), 1 << 20)
        while line := stream.readline():
            if line.rstrip() != b"WARC/1.1":
                raise ValueError(f"{path}: a record starts with {line[:40]!r}")
            headers = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                k, _, v = line.decode().partition(": ")
                headers[k.lower()] = v
            n = int(headers["content-length"])
            block = stream.read(n)
            if len(block) != n or stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record is cut off")
            yield headers, block


def read_archives(spark: SparkSession, manifest: DataFrame, *, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """One row per page record of the manifest's archives: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest and, if asked for, payload (null in revisits).

    A response's size and digest are computed from its payload and must equal its headers (else
    ValueError); a revisit's are what its headers say of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * payloads

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for head, block in read_archive(path):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x[15:] for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")))
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{path}: {head['warc-record-id']} differs from its digest")
                    refers = head.get("warc-refers-to")
                    rows.append((ident(head["warc-record-id"]), head.get("warc-target-uri"), kind, ident(refers) if refers else None, size, digest, *[payload if kind == "response" else None] * payloads))
                    held += len(block) * payloads + 200
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    # a task per archive, whose size is bounded
    paths = manifest.select("path").repartitionByRange(max(1, manifest.count()), "path")
    return paths.mapInArrow(tidy(run), schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op8_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    back = read_archives(spark, manifest, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h from pages),
d as (select page_id, n::bigint n, h, min(page_id) over (partition by h, n) f, list_transform(generate_series(0, 7), lambda g: ('0x' || substr(h, (g * 5 + 1)::int, 5))::bigint) v from p),
b as (select *, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31)::int + 1, 1)), '') digest from d)
select page_id, n payload_bytes, digest payload_digest, case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to from b
"""
