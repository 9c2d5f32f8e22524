"""The binning index: reading, writing, choosing what a region needs."""

from __future__ import annotations

import os
import struct
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandframe.schema import BAI_MAGIC, PSEUDO_BIN
from strandframe.sources.columnar import bins_of

SCHEMAS = {
    "chunks": "file string, ref_id int, bin int, chunk_beg long, chunk_end long",
    "linear": "file string, ref_id int, window int, voffset long",
    "stats": "file string, ref_id int, unmapped_beg long, unmapped_end long, n_mapped long, n_unmapped long, n_no_coor long",
}


class Index:
    """references: for each, bins {bin: [(beg, end)]} without the pseudo-bin, linear [voffset] with
    zeros in their places, stats or None."""

    def __init__(self, references: list[tuple[dict, list, tuple | None]], n_no_coor: int | None):
        self.references, self.n_no_coor = references, n_no_coor

    @classmethod
    def load(cls, path: str) -> Index | None:
        """None if there is no such file."""
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            data = f.read()
        if data[:4] != BAI_MAGIC:
            raise ValueError(f"{path}: not a binning index")
        at = 4

        def take(form: str):
            nonlocal at
            out = struct.unpack_from("<" + form, data, at)
            at += struct.calcsize("<" + form)
            return out

        references = []
        for _ in range(take("i")[0]):
            bins, stats = {}, None
            for _ in range(take("i")[0]):
                number, n = take("Ii")
                flat = take(f"{2 * n}Q")
                if number == PSEUDO_BIN:
                    stats = flat if n == 2 else None
                else:
                    bins[number] = list(zip(flat[::2], flat[1::2]))
            references.append((bins, list(take(f"{take('i')[0]}Q")), stats))
        n_no_coor = take("Q")[0] if at + 8 <= len(data) else None
        if at != len(data):
            print(f"{path}: {len(data) - at} bytes after its end", file=sys.stderr)
        return cls(references, n_no_coor)

    def chunks(self, ref_id: int, beg: int, end: int) -> list[tuple[int, int]]:
        """Merged (start, end) virtual offsets that hold all records overlapping [beg, end). A window
        without a linear entry gives no lower bound."""
        if not 0 <= ref_id < len(self.references):
            return []
        bins, linear, _ = self.references[ref_id]
        last = max(end, beg + 1) - 1
        wanted = {0} | {b for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for b in range(first + (beg >> shift), first + (last >> shift) + 1)} if (last - beg) >> 14 < 50_000 else None
        low = linear[beg >> 14] if beg >> 14 < len(linear) else 0
        found = sorted(c for b, own in bins.items() if wanted is None or b in wanted for c in own if c[1] > low)
        out: list[tuple[int, int]] = []
        for a, b in found:
            a = max(a, low)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def starts(self) -> list[int]:
        """Known starts of records, in order: where a file may be split."""
        known = {v for bins, linear, _ in self.references for v in [*linear, *(c[0] for own in bins.values() for c in own)]}
        return sorted(known - {0})


class IndexBuilder:
    """Of records added in file order, which must be sorted by (ref_id, pos), unplaced ones last."""

    def __init__(self, n_ref: int):
        self.bins = [defaultdict(list) for _ in range(n_ref)]
        self.linear = [{} for _ in range(n_ref)]
        self.stats = [[None, 0, 0, 0] for _ in range(n_ref)]
        self.unplaced, self.last, self.sorted = 0, -1, True

    def add(self, ref: np.ndarray, pos: np.ndarray, span: np.ndarray, flag: np.ndarray, beg: np.ndarray, end: np.ndarray) -> None:
        """The next records; beg and end: their virtual offsets."""
        if not len(ref):
            return
        key = np.where(ref >= 0, ref, 1 << 30) << 32 | (pos + 1)
        self.sorted = self.sorted and key[0] >= self.last and bool((np.diff(key) >= 0).all())
        self.last = int(key[-1])
        if not self.sorted:
            return
        there = ref >= 0
        self.unplaced += int((~there).sum())
        ref, pos, span, flag, beg, end = (x[there] for x in (ref, pos, span, flag, beg, end))
        if not len(ref):
            return
        after = np.maximum(pos + span, pos + 1)
        # records of one bin in a row are one chunk
        bins = bins_of(pos, after)
        new = np.flatnonzero(np.diff(ref << 16 | bins, prepend=-1))
        last = np.append(new[1:], len(ref)) - 1
        for r, b, x, y in zip(ref[new].tolist(), bins[new].tolist(), beg[new].tolist(), end[last].tolist()):
            own = self.bins[r][b]
            if own and own[-1][1] == x:
                own[-1] = (own[-1][0], y)
            else:
                own.append((x, y))
        low, high = pos >> 14, (after - 1) >> 14
        width = high - low + 1
        window = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        owner = np.repeat(np.arange(len(ref)), width)
        seen, first = np.unique(ref[owner] << 20 | window, return_index=True)
        for k, x in zip(seen.tolist(), beg[owner[first]].tolist()):
            self.linear[k >> 20].setdefault(k & 0xFFFFF, x)
        unmapped = flag & 4 != 0
        for r in np.unique(ref).tolist():
            s, own = self.stats[r], np.flatnonzero(ref == r)
            s[0], s[1] = int(beg[own[0]]) if s[0] is None else s[0], int(end[own[-1]])
            s[2] += int((~unmapped[own]).sum())
            s[3] += int(unmapped[own].sum())

    def bytes(self) -> bytes:
        out = [BAI_MAGIC, struct.pack("<i", len(self.bins))]
        for bins, linear, s in zip(self.bins, self.linear, self.stats):
            out.append(struct.pack("<i", len(bins) + (s[0] is not None)))
            for number in sorted(bins):
                out.append(struct.pack("<Ii", number, len(bins[number])))
                out += [struct.pack("<QQ", *c) for c in bins[number]]
            if s[0] is not None:
                out.append(struct.pack("<IiQQQQ", PSEUDO_BIN, 2, *s))
            n = max(linear, default=-1) + 1
            out.append(struct.pack(f"<i{n}Q", n, *(linear.get(w, 0) for w in range(n))))
        return b"".join([*out, struct.pack("<Q", self.unplaced)])


class BaiDataSource(DataSource):
    """``spark.read.format("bai").option("table", "chunks" | "linear" | "stats").load(path)``: a .bai
    file, or a folder of them. Zero entries of the linear index are left out, windows keep their
    numbers. n_no_coor is 0 where an index does not say how many records are unplaced."""

    @classmethod
    def name(cls) -> str:
        return "bai"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "chunks")]

    def reader(self, schema) -> DataSourceReader:
        return BaiReader(self.options.get("path", ""), self.options.get("table", "chunks"))


class BaiReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self):
        from strandframe.sources.bam import list_files

        return [InputPartition(p) for p in list_files(self.path, ".bai")]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:
            return
        index = Index.load(partition.value)
        rows = []
        for r, (bins, linear, stats) in enumerate(index.references if index else ()):
            if self.table == "chunks":
                rows += [(partition.value, r, b, *c) for b, own in bins.items() for c in own]
            elif self.table == "linear":
                rows += [(partition.value, r, w, v) for w, v in enumerate(linear) if v]
            else:
                rows.append((partition.value, r, *(stats or (None,) * 4), index.n_no_coor or 0))
        yield from rows
