"""Audio fingerprints of a media column, and the alignment of recordings by them.

A recording (WAV bytes) is brought to one channel and one rate, cut into overlapping windows, and
each window's spectrum is folded into twelve pitch classes. Over the resulting image (time by
pitch class) an integral image gives any rectangle's sum in four look-ups; sixteen filters
compare rectangles at every time step, each comparison becomes two bits in Gray code, and the
sixteen make one packed 32-bit integer.

Recordings with equal fingerprints fall into one class, represented by its smallest id. Each query
class is held against every other class at every shift, block by block, and the shift of the
fewest bit errors decides. At the errors allowed (a fifth of the bits) whole integers are rarely
equal, and parts so short that some are surely equal are shared by nearly all pairs, so no index
comes before the comparison.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import by_bytes, col, meet, shuffle_partitions, stash, table, tidy

RATE, WINDOW = 5512, 2048
HOP = WINDOW // 3
LOWEST, HIGHEST = 55.0, 2500.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
STEP = 0.12

#: (kind, lowest class, classes, frames) of the sixteen filters, by a rule that spreads kinds,
#: heights and widths. Kinds: 0 upper against lower half, 1 earlier against later half, 2 crossed
#: quarters, 3 middle against outer classes, 4 middle against outer frames.
FILTERS = [(i % 5, (5 * i) % (13 - (4 + 2 * (i % 4))), 4 + 2 * (i % 4), 4 + 4 * (i // 6)) for i in range(16)]
WIDEST = max(f[3] for f in FILTERS)


def read_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """(samples of the channels' mean between -1 and 1, rate) of PCM WAV bytes; None if they are none."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None or form[0] != 1 or form[5] not in (8, 16, 32) or not form[1] or not form[2]:
        return None
    width = form[5] // 8
    body = body[: len(body) // (width * form[1]) * width * form[1]]
    x = np.frombuffer(body, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / (1 << (form[5] - 1))
    return x.reshape(-1, form[1]).mean(1), form[2]


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def _fold() -> np.ndarray:
    f = np.fft.rfftfreq(WINDOW, 1 / RATE)
    out = np.zeros((len(f), 12), np.float32)
    use = (f >= LOWEST) & (f <= HIGHEST)
    out[np.flatnonzero(use), np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


FOLD, HANN = _fold(), np.hanning(WINDOW).astype(np.float32)


def pitch_classes(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12): smoothed, each of length one or zero. Long recordings go block by block."""
    if rate != RATE:
        n = int(len(samples) * RATE / rate)
        samples = np.interp(np.arange(n) * (rate / RATE), np.arange(len(samples)), samples).astype(np.float32) if n and len(samples) else samples[:0]
    n = 1 + (len(samples) - WINDOW) // HOP if len(samples) >= WINDOW else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    image = np.concatenate([(np.abs(np.fft.rfft(frames[a : a + 512] * HANN)) ** 2).astype(np.float32) @ FOLD for a in range(0, n, 512)]).astype(np.float64)
    if n >= len(SMOOTH):
        image = sum(w * image[k : n - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    size = np.sqrt((image**2).sum(1, keepdims=True))
    return np.where(size > 1e-6, image / np.maximum(size, 1e-12), 0.0)


def packed(image: np.ndarray) -> np.ndarray:
    """The fingerprint's integers; none where the image is narrower than the widest filter or silent."""
    n = len(image) - WIDEST + 1
    if n <= 0 or not image.any():
        return np.zeros(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return total[t + x1, y1] - total[t + x0, y1] - total[t + x1, y0] + total[t + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if kind == 0:
            part = area(0, w, y, y + h // 2)
        elif kind == 1:
            part = area(0, w // 2, y, y + h)
        elif kind == 2:
            part = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:
            part = area(0, w, y + h // 4, y + h - h // 4)
        else:
            part = area(w // 4, w - w // 4, y, y + h)
        value = (2 * part - whole) / (whole + 1e-9)
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return out.view(np.int32)


def fingerprints(media: DataFrame, *, id_col: str, audio_col: str) -> DataFrame:
    """One row per input row: id, seconds (null where the bytes are no PCM WAV), ints.

    Null, unreadable, silent and very short recordings have no integers. Repeated rows and null ids
    are rows like others. Other columns are not read, names may clash with the result's; an empty
    table gives an empty table. A task holds the batch that Spark sends, one recording's samples
    (four bytes each) and 512 of its spectra, however long it is.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seconds, ints = [], []
            for audio in batch.column(1):
                wav = read_wav(audio.as_py())
                seconds.append(None if wav is None else len(wav[0]) / wav[1])
                ints.append([] if wav is None else packed(pitch_classes(*wav)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seconds, pa.float64()), pa.array(ints, pa.list_(pa.int32()))], names=["id", "seconds", "ints"])

    return media.select(col(id_col).alias("id"), col(audio_col).alias("audio")).mapInArrow(tidy(run), f"id {kind}, seconds double, ints array<int>")


def _best_shifts(query: np.ndarray, others: list[np.ndarray], min_overlap: int, max_errors: float) -> Iterator[tuple[int, int, int, float]]:
    """(number of the other, shift, overlap, errors) of those that have a shift within the limits.

    The others lie in one stream, so far apart that no place of the query shares min_overlap
    integers with two of them; the query slides over all of it at once.
    """
    n = len(query)
    gap = max(n - min_overlap, 0)
    sizes = np.array([len(x) for x in others])
    starts = n + np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    length = int(starts[-1] + sizes[-1]) + n
    stream, there = np.zeros(length, np.uint32), np.zeros(length, np.uint8)
    for a, x in zip(starts.tolist(), others):
        stream[a : a + len(x)] = x
        there[a : a + len(x)] = 255
    places = length - n + 1
    wrong = np.zeros(places, np.int32)
    for i, item in enumerate(query):
        wrong += np.bitwise_count(stream[i : i + places] ^ item) & there[i : i + places]
    shifts = np.maximum(sizes + n - 2 * min_overlap + 1, 0) * ((sizes >= min_overlap) & (n >= min_overlap))
    owner = np.repeat(np.arange(len(others)), shifts)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(shifts) - shifts, shifts) + min_overlap - n
    first = np.maximum(0, -shift)
    overlap = np.minimum(n - first, sizes[owner] - first - shift)
    errors = wrong[starts[owner] + shift] / (overlap * 32.0)
    good = np.flatnonzero(errors <= max_errors)
    good = good[np.lexsort((-shift[good], np.abs(shift[good]), errors[good], owner[good]))]
    for k in good[np.unique(owner[good], return_index=True)[1]].tolist():
        yield int(owner[k]), int(shift[k]), int(overlap[k]), float(errors[k])


#: Integers of a block of classes, and of a stream of other classes with their gaps.
BLOCK, STREAM = 1 << 15, 1 << 17


def align(prints: DataFrame, is_query: Column, *, min_overlap: int = 8, max_errors: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(classes, matches) of fingerprints (id, ints).

    classes: (class_id, ints), one per distinct fingerprint that has integers. matches: (query,
    other, shift, overlap, errors): class pairs of a class that holds a query (``is_query`` over
    ``id``) and any other one that have a shift with at least min_overlap integers in common time
    and at most max_errors of their bits differing; of these the shift of the fewest errors, then
    the smallest, then the positive one. All pairs and shifts are compared, so none is missed; the
    work grows with queries times classes times the square of their lengths.

    Rows with a null id or without integers take no part: they are in no class. Repeated rows, and
    ids with several fingerprints, are members of each of their classes; a class asks if one of its
    ids does. Other columns are not read; empty tables give empty results. A task holds two blocks
    of about BLOCK integers, or one longer recording each.
    """
    spark = prints.sparkSession
    kind = prints.schema["id"].dataType.simpleString()
    known = prints.filter("size(ints) > 0 and id is not null")
    classes = known.groupBy("ints").agg(F.min("id").alias("class_id"), F.max(is_query).alias("asked"))
    classes = stash(classes.select("class_id", "ints", "asked"), "prints")
    size = classes.agg(F.sum(F.size("ints")).alias("all"), F.sum(F.when(F.col("asked"), F.size("ints"))).alias("asked")).first()

    def packs(rows: DataFrame, total: int | None, name: str, least: int) -> DataFrame:
        n = max(least, -(-(total or 0) // BLOCK))
        block = F.pmod(F.xxhash64("class_id"), F.lit(n))
        return rows.select(block.alias("block"), F.struct("class_id", "ints").alias("item")).repartition(n, "block").groupBy("block").agg(F.collect_list("item").alias(name)).select(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, all_ = ([(x["class_id"].as_py(), x["ints"].values.to_numpy().view(np.uint32)) for x in batch.column(c)[k]] for c in ("asked", "others"))
                for query, ints in asked:
                    out = []
                    for a, b in by_bytes([len(x) + len(ints) for _, x in all_], STREAM):
                        out += [(query, all_[a + o][0], *m) for o, *m in _best_shifts(ints, [x for _, x in all_[a:b]], min_overlap, max_errors) if all_[a + o][0] != query]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (ids, ids, pa.int32(), pa.int32(), pa.float64()))], names=["query", "other", "shift", "overlap", "errors"])

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(prints.schema["id"].dataType)
    pairs = packs(classes, size["all"], "others", shuffle_partitions(spark)).crossJoin(packs(classes.filter("asked"), size["asked"], "asked", 1))
    return classes.select("class_id", "ints"), pairs.mapInArrow(tidy(run), f"query {kind}, other {kind}, shift int, overlap int, errors double")


def melodies(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", seconds: float = 4.0) -> DataFrame:
    """(id, audio): a WAV recording of each vector, four components to a note (pitch, second
    voice, its loudness, loudness), so that close vectors sound alike. Null vectors, and those
    with null or non-finite components, have null audio."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def tune(v: list | None) -> bytes | None:
        if not v or any(x is None or not np.isfinite(x) for x in v):
            return None
        x = np.tanh(2 * np.resize(np.array(v, np.float64), -(-len(v) // 4) * 4).reshape(-1, 4))
        n = int(RATE * seconds / len(x))
        t = np.arange(n) / RATE
        fade = np.minimum(1, np.minimum(t, t[::-1]) * 100)
        notes = 0.3 * (0.6 + 0.4 * x[:, 3:]) * fade * (np.sin(2 * np.pi * 330 * 2 ** x[:, :1] * t) + (0.5 + 0.5 * x[:, 2:3]) * np.sin(2 * np.pi * 495 * 2 ** x[:, 1:2] * t))
        return write_wav(notes.reshape(-1), RATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes([1] * batch.num_rows, 128):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tune(v) for v in part.column(1).to_pylist()], pa.binary())], names=["id", "audio"])

    # narrow rows are dealt out before the work: a small file of vectors is long to play
    dealt = vectors.select(col(id_col).alias("id"), col(vector_col).alias("vector")).repartition(shuffle_partitions(vectors.sparkSession))
    return dealt.mapInArrow(tidy(run), f"id {kind}, audio binary")


def op9_audio_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Recordings made of ``embeddings``, fingerprinted; queries are ids divisible by 100. One row per
    recording: vec_id, seconds, n_items, digest of its integers, class_id (its own id without
    integers), n_links (query classes that its class aligns with), best_query, best_shift and
    best_errors (of the fewest errors; ties to the smaller query). Vectors that are null or hold a
    null or non-finite component have no sound: seconds is null, n_items 0. A row with a null id has
    a null class_id and no links; repeated rows come out as often as they went in."""
    media = melodies(table(spark, sf_dir, "embeddings"))
    prints = stash(fingerprints(media, id_col="id", audio_col="audio"), "fingerprints")
    classes, matches = align(prints, F.col("id") % 100 == 0)
    links = matches.groupBy(F.col("other").alias("class_id")).agg(F.count("*").alias("n_links"), F.min(F.struct("errors", "query", "shift")).alias("best"))
    named = classes.join(links, "class_id", "left")
    # a third of all recordings may sound alike: equal fingerprints meet their class by a digest
    digest = F.sha2(F.array_join("ints", ",").cast("binary"), 256)
    members = prints.withColumn("digest", digest)
    sizes = members.filter("size(ints) > 0 and id is not null").groupBy("digest").agg(F.count("*").alias("rows"))
    known = stash(named.withColumn("digest", digest).drop("ints").join(sizes, "digest"), "classes")
    out = meet(members, known, ["digest"], "rows", spread=F.col("id"))
    out = out.withColumns({c: F.when(F.col("id").isNotNull(), F.col(c)) for c in ("class_id", "n_links", "best")})
    return out.select(F.col("id").alias("vec_id"), "seconds", F.size("ints").cast("long").alias("n_items"), "digest", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("best.query").alias("best_query"), F.col("best.shift").alias("best_shift"), F.col("best.errors").alias("best_errors"))
