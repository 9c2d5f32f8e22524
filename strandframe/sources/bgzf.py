"""Blocked gzip: reading and writing. A virtual offset is (block's file offset << 16) | offset inside."""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from strandframe.schema import BGZF_EOF

#: Payload of a written block: small enough that even incompressible data fits the 16-bit block size.
PAYLOAD = 65_280
#: First bytes of a block: gzip with extra fields.
MAGIC = b"\x1f\x8b\x08\x04"


class BgzfError(ValueError):
    pass


def read_block(f: BinaryIO, verify: bool = True) -> tuple[bytes, int] | None:
    """(data, size in the file) of the block at the current position, None at the end of the file.
    Other extra fields may come before the block size; the checksum is tested if asked for."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != MAGIC:
        raise BgzfError("not a block of blocked gzip")
    extra_len = struct.unpack_from("<H", head, 10)[0]
    extra, at, total = f.read(extra_len), 0, None
    while at + 4 <= len(extra):
        name, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if name == b"BC" and n == 2:
            total = struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    if total is None:
        raise BgzfError("a block has no size field")
    body = f.read(total - 12 - extra_len)
    if len(body) != total - 12 - extra_len:
        raise BgzfError("the last block is cut off")
    data = zlib.decompress(body[:-8], -15)
    crc, size = struct.unpack("<II", body[-8:])
    if len(data) != size or verify and zlib.crc32(data) != crc:
        raise BgzfError("a block's data differ from its checksum or size")
    return data, total


def has_eof(f: BinaryIO) -> bool:
    """Whether the file ends with the empty block that marks the end. The position is kept."""
    here = f.tell()
    size = f.seek(0, 2)
    f.seek(max(0, size - len(BGZF_EOF)))
    found = f.read() == BGZF_EOF
    f.seek(here)
    return found


class BgzfReader:
    """A byte cursor over blocks. eof: ``warn``, ``fail`` or ``ignore`` a missing end marker."""

    def __init__(self, path: str, voffset: int = 0, eof: str = "ignore", verify: bool = True):
        self.f, self.verify, self.path = open(path, "rb"), verify, path
        if eof != "ignore" and not has_eof(self.f):
            if eof == "fail":
                raise BgzfError(f"{path}: no end marker")
            print(f"{path}: no end marker", file=sys.stderr)
        self.seek(voffset)

    def seek(self, voffset: int) -> None:
        self.f.seek(voffset >> 16)
        self.start = voffset >> 16
        self.data, self.size, self.at = b"", 0, 0
        if voffset & 0xFFFF:
            self._next()
            self.at = voffset & 0xFFFF

    def _next(self) -> bool:
        self.start += self.size
        block = read_block(self.f, self.verify)
        self.data, self.size = block or (b"", 0)
        self.at = 0
        return block is not None

    def tell(self) -> int:
        """Of the next byte; at a block's end that is the start of the next one."""
        if self.at >= len(self.data):
            return (self.start + self.size) << 16
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        """n bytes, or fewer at the end."""
        parts = []
        while n:
            left = len(self.data) - self.at
            if not left:
                if not self._next():
                    break
                continue
            take = min(n, left)
            parts.append(self.data[self.at : self.at + take])
            self.at += take
            n -= take
        return b"".join(parts)

    def blocks(self) -> Iterator[bytes]:
        while self._next():
            yield self.data

    def close(self) -> None:
        self.f.close()


def first_block(f: BinaryIO, start: int) -> int:
    """File offset of the first block that starts at ``start`` or later; the file's size if there is
    none. What looks like a block must be whole, and followed by another one or the end."""
    size = f.seek(0, 2)
    while start < size:
        f.seek(start)
        window = f.read(1 << 17)
        at = window.find(MAGIC)
        while at >= 0:
            f.seek(start + at)
            try:
                read_block(f)
                if (f.tell() == size) or f.read(4) == MAGIC:
                    return start + at
            except (BgzfError, zlib.error, struct.error):
                pass
            at = window.find(MAGIC, at + 1)
        start += max(1, len(window) - len(MAGIC) + 1)
    return size


class BgzfWriter:
    """marks: file offsets of the blocks since the last ``flush``, the open one last."""

    def __init__(self, f: BinaryIO, level: int = 6):
        self.f, self.level, self.held, self.offset = f, level, bytearray(), 0
        self.marks = [0]

    def tell(self) -> int:
        return self.offset << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        view = memoryview(data).cast("B")
        at = min(len(view), PAYLOAD - len(self.held))
        self.held += view[:at]
        while len(self.held) >= PAYLOAD:
            self._block(bytes(self.held))
            self.held = bytearray(view[at : at + PAYLOAD])
            at += PAYLOAD

    def _block(self, data: bytes) -> None:
        press = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        body = press.compress(data) + press.flush()
        if len(body) > 65_500:
            press = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = press.compress(data) + press.flush()
        head = struct.pack("<4sIBBHBBHH", MAGIC, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        self.f.write(head + body + struct.pack("<II", zlib.crc32(data), len(data)))
        self.offset += len(body) + 26
        self.marks.append(self.offset)

    def flush(self) -> None:
        """Ends the current block."""
        if self.held:
            self._block(bytes(self.held))
            self.held = bytearray()
        self.marks = [self.offset]

    def close(self) -> None:
        self.flush()
        self.f.write(BGZF_EOF)
        self.f.close()
