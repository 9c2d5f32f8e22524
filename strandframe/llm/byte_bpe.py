"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of pre-tokens are kept as a doubly linked list of token starts. For each merge rank a
bucket holds the list positions where that merge is possible, and a two-level bitmap over the
ranks says which buckets are not empty: find-first-set in the top word, then in the word below,
gives the next rank, however many merges wait. Entries go stale when a neighbour is merged; they
are recognised (the position's current rank differs) and skipped. The cost is linear in the
bytes but for sorting inside a bucket, so a pre-token of a megabyte is no harder per byte than
a word, and many pre-tokens go through one queue together.

Pre-tokens repeat, so their packed ids are remembered: about MEMO bytes of those met lately, and as
many of those before; a pre-token of the older half that comes up again moves to the newer one.
Texts are split SLICE characters at a time, and unseen pre-tokens merged MERGE bytes at a time, so
what a worker holds does not depend on how rich in words a batch is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from contextlib import suppress
from itertools import islice
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import by_bytes, ddl, numbered, resident, table, tidy

#: Longer pre-tokens are not remembered; ENTRY is what one costs besides its bytes and ids.
MEMO, MEMO_CHARS, ENTRY = 16 << 20, 64, 180
SLICE, MERGE = 1 << 19, 1 << 18
#: Positions from which a bucket is merged with array operations.
AT_ONCE = 48


class RankQueue:
    """Buckets of positions by rank, for ranks below ``size``.

    words: one bit per rank, 256 ranks to a word; top: one bit per word.
    """

    def __init__(self, size: int):
        self.words = [0] * ((size >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held += positions
            return
        self.buckets[rank] = positions
        self.mark(rank)

    def mark(self, rank: int) -> None:
        w = rank >> 8
        self.top |= 1 << w
        self.words[w] |= 1 << (rank & 255)

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions, or (-1, [])."""
        top = self.top
        if not top:
            return -1, []
        w = (top & -top).bit_length() - 1
        word = self.words[w]
        rank = (w << 8) + (word & -word).bit_length() - 1
        word &= word - 1
        self.words[w] = word
        if not word:
            self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


def ascii_pattern(pattern: str) -> str:
    """The pattern for ASCII texts: letters and numbers there are ranges, which the standard library
    matches faster."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        part = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if part in ("\\p", "\\P") and pattern[i : i + 5] in ("\\p{L}", "\\p{N}"):
            part = pattern[i : i + 5]
            ranges = "A-Za-z" if part[3] == "L" else "0-9"
            out.append(ranges if inside else f"[{ranges}]")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
        i += len(part)
    return "".join(out)


class ByteBpe:
    """ranks: token bytes to rank, which is also the id. pattern: what splits a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.any = self.ascii = regex.compile(pattern)
        with suppress(re.error):  # the standard library may not have the pattern's syntax
            self.ascii = re.compile(ascii_pattern(pattern), re.ASCII)
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        # (left id, right id) of every pair of tokens that together are a token
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(sorted(pairs) or [(-1, -1)], dtype=np.int64)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(table[:, 0]), table[:, 1].astype(np.int32)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the newer half

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token; none is empty.

        All pre-tokens lie one after another in arrays over their bytes. A bucket with many
        positions is merged at once, the first position of each pre-token, and the others go
        back to the bucket, as a lower rank may have come up in theirs; one with few positions,
        or with many in the same pre-token, is merged position by position.
        """
        if not pieces:
            return []
        get, queue, data = self.ranks.get, self.queue, b"".join(pieces)
        n = len(data)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        token = self.bytes[np.frombuffer(data, np.uint8)]
        alive = np.ones(n, np.uint8)
        first = np.zeros(n + 1, np.uint8)  # 1 where a pre-token starts, and at the end
        first[ends - size] = first[n] = 1
        at = np.full(n, -1, np.int32)  # the rank of the merge that starts at a position
        at[:-1] = self.pair_rank(token[:-1], token[1:])
        at[ends - 1] = -1
        wholes = [get(piece, -1) for piece in pieces]  # a pre-token that is a token needs no merge
        at[np.repeat(np.array(wholes) >= 0, size)] = -1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        there = np.flatnonzero(at >= 0)
        self._push(at[there], there)
        views = tuple(map(memoryview, (at, after, before, token, alive, first, owner)))
        while True:
            rank, held = queue.pop()
            if rank < 0:
                break
            if len(held) < AT_ONCE:
                held.sort()
                self._one_by_one(rank, held, data, *views)
                continue
            every = np.array(held)
            every = every[at[every] == rank]
            every.sort()
            if not len(every):
                continue
            own = owner[every]
            lead = np.ones(len(every), bool)
            lead[1:] = own[1:] != own[:-1]
            i, rest = every[lead], every[~lead]
            if len(rest) > len(i):
                self._one_by_one(rank, every.tolist(), data, *views)
                continue
            if len(rest):
                queue.push(rank, rest.tolist())
            gone = after[i]
            k = after[gone]
            at[gone], alive[gone], token[i], after[i], before[k] = -1, 0, rank, k, i
            right = np.full(len(i), -1)
            inner = first[k] == 0
            right[inner] = self.pair_rank(token[i[inner]], token[k[inner]])
            at[i] = right
            p = before[i[first[i] == 0]]
            left = self.pair_rank(token[p], np.full(len(p), rank))
            at[p] = left
            ranks, spots = np.concatenate([right, left]), np.concatenate([i, p])
            new = ranks >= 0
            self._push(ranks[new], spots[new])
        live = alive.astype(bool)
        packed = token[live].astype("<u4").tobytes()
        to = (4 * np.cumsum(live))[ends - 1].tolist()
        pack = Struct("<I").pack
        return [pack(w) if w >= 0 else packed[a:b] for w, a, b in zip(wholes, [0, *to], to)]

    def _push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, spots = ranks[order], positions[order].tolist()
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        push = self.queue.push
        for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(spots)]):
            push(r, spots[a:b])

    def _one_by_one(self, rank: int, held: list[int], data: bytes, at, after, before, token, alive, first, owner) -> None:
        """Merges at the positions of one bucket, in order. Once a lower rank comes up in a
        pre-token, its later positions go back to the bucket."""
        get, buckets, mark = self.ranks.get, self.queue.buckets, self.queue.mark
        blocked, later = -1, []
        for i in held:
            if at[i] != rank:
                continue
            if owner[i] == blocked:
                later.append(i)
                continue
            gone = after[i]
            k = after[gone]
            after[i] = k
            at[gone] = -1
            alive[gone] = 0
            token[i] = rank
            if first[k]:
                at[i] = -1
            else:
                before[k] = i
                at[i] = r = get(data[i : after[k]], -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        buckets[r] = [i]
                        mark(r)
                    if r < rank:
                        blocked = owner[i]
            if not first[i]:
                p = before[i]
                at[p] = r = get(data[p:k], -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(p)
                    else:
                        buckets[r] = [p]
                        mark(r)
                    if r < rank:
                        blocked = owner[i]
        if later:
            self.queue.push(rank, later)

    def split_any(self, text: str) -> list[str]:
        return self.any.findall(text) if not self.any.groups else [m.group() for m in self.any.finditer(text)]

    def split_ascii(self, text: str) -> list[str]:
        return self.ascii.findall(text) if not self.ascii.groups else [m.group() for m in self.ascii.finditer(text)]

    def split(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens, as lists of those of about SLICE characters."""
        plain = text.isascii()
        if len(text) <= SLICE:
            yield self.split_ascii(text) if plain else self.split_any(text)
            return
        found = (m.group() for m in (self.ascii if plain else self.any).finditer(text))
        while words := list(islice(found, SLICE // 6)):
            yield words

    def learn(self, words: set[str]) -> list[str]:
        """Puts all the words into the memo; returns those that must leave it after use."""
        memo, older = self.memo, self.older
        unseen = words.difference(memo)
        again = unseen.intersection(older)
        for w in again:
            memo[w] = ids = older[w]
            self.held += len(w) + len(ids) + ENTRY
        new, long = [w.encode() for w in unseen.difference(again)], []
        for a, b in by_bytes(list(map(len, new)), MERGE):
            for word, ids in zip(new[a:b], self.merge(new[a:b])):
                text = word.decode()
                memo[text] = ids
                if len(text) > MEMO_CHARS:
                    long.append(text)
                else:
                    self.held += len(word) + len(ids) + ENTRY
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for a, b in by_bytes(list(map(len, texts)), SLICE):
            # several short texts at once, or one text part by part
            for parts in zip(*(self.split(t) for t in texts[a:b])):
                long = self.learn(set().union(*parts))
                get = self.memo.__getitem__
                for i, words in enumerate(parts, a):
                    out[i].append(b"".join(map(get, words)))
                for word in long:
                    del self.memo[word]
                if self.held > MEMO:
                    self.older, self.memo, self.held = self.memo, {}, 0
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe(path: str, pattern: str) -> ByteBpe:
    """Loaded once per worker, until the worker turns to another operator."""

    def load() -> ByteBpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return ByteBpe(ranks, pattern)

    return resident(("byte_bpe", path, pattern), load)


#: What ``encode`` can add to a row, with the types.
ADDED = {"ids": ("binary", pa.binary()), "n_tokens": ("bigint", pa.int64()), "decoded": ("binary", pa.binary()), "round_trip": ("boolean", pa.bool_())}


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decode: bool = False, count: bool = False, check: bool = False, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per input row: the id, the columns named in ``keep``, and ids (little-endian unsigned
    32-bit integers); with ``count`` also n_tokens, with ``decode`` decoded, the bytes that these ids
    stand for, with ``check`` round_trip, whether those are the text's.

    ranks: path of a rank file, the same on every executor. pattern: each match is encoded by
    itself. Null and empty texts have no ids, decode to empty bytes and round-trip. Repeated rows
    and null ids are rows like others. A column to be added takes the place of one of its name in
    ``keep`` (upper and lower case alike), whatever characters kept names hold; other columns are
    not read. An empty table gives an empty table. The text goes to Python once; each task holds
    about ``batch_bytes`` of text and its ids at a time besides the batch that Spark sends, or one
    text where that is longer, and 2 * MEMO bytes of remembered pre-tokens.
    """
    add = [c for c, wanted in zip(ADDED, (True, count, decode, check)) if wanted]
    kept = [id_col, *(c for c in keep if c != id_col and c.lower() not in add)]
    sent = [*kept, *[text_col] * (text_col not in kept)]
    at, names = sent.index(text_col), [*kept, *add]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(ranks, pattern)
        for batch in batches:
            size = [x or 0 for x in pc.binary_length(batch.column(at)).to_pylist()]
            for a, b in by_bytes(size, batch_bytes):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = enc.encode(texts)
                made = {"ids": ids, "n_tokens": [len(x) // 4 for x in ids]}
                if decode or check:
                    made["decoded"] = back = [enc.decode(x) for x in ids]
                    made["round_trip"] = [x == t.encode() for x, t in zip(back, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(made[c], ADDED[c][1]) for c in add)], names=names)

    schema = ", ".join([ddl(docs.schema[c] for c in kept), *(f"{c} {ADDED[c][0]}" for c in add)])
    return numbered(docs, sent).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, ranks: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and ``decoded``. Null ids decode to empty bytes; an id that
    the ranks don't have raises KeyError."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(ranks, r"\w+")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    return numbered(encoded, [id_col, ids_col]).mapInArrow(tidy(run), f"{ddl([encoded.schema[id_col]])}, decoded binary")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, count=True, decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
