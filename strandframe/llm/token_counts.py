"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are gathered into batches of about ``batch_bytes`` bytes, so that a batch of many short
texts and a batch of one long text cost about the same, and memory stays bounded by the batch.
A text longer than ``chunk_chars`` is split, but only where no merge can reach across: at a
single space whose left neighbour precedes a word mark in no piece of the vocabulary. The space
itself is dropped there, since the encoder puts the same mark before each chunk. The sum of the
chunks' lengths therefore equals the length of the whole text's encoding; a text without such a
place is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strandframe.llm.common import by_bytes, ddl, numbered, resident, table, tidy

MARK = "▁"
OUT = "n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Lengths by a sentencepiece model, without begin and end tokens."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=raw)
        norm, pieces = model.normalizer_spec, [p.piece for p in model.pieces]
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        defined = any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        self.can_split = plain and norm.add_dummy_prefix and not defined and not model.trainer_spec.treat_whitespace_as_suffix and model.trainer_spec.model_type == proto.TrainerSpec.BPE
        #: Characters that some piece has right before a word mark: no split after these.
        self.joined = {a for p in pieces for a, b in zip(p, p[1:]) if b == MARK} | {" ", MARK}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode(texts, num_threads=1)]

    def split(self, text: str, chunk_chars: int) -> list[str]:
        if not self.can_split or len(text) <= chunk_chars:
            return [text]
        out, start, n = [], 0, len(text)
        while n - start > chunk_chars:
            cut = self._cut(text, start, start + chunk_chars)
            if cut < 0:
                break
            out.append(text[start:cut])
            start = cut + 1
        return [*out, text[start:]]

    def _safe(self, text: str, i: int) -> bool:
        return i + 1 < len(text) and text[i - 1] not in self.joined and text[i + 1] not in (" ", MARK)

    def _cut(self, text: str, start: int, want: int) -> int:
        """The last safe space in (start, want], else the first one after it, else -1."""
        i = text.rfind(" ", start + 1, want + 1)
        while i > start:
            if self._safe(text, i):
                return i
            i = text.rfind(" ", start + 1, i)
        i = text.find(" ", want + 1)
        while i >= 0:
            if self._safe(text, i):
                return i
            i = text.find(" ", i + 1)
        return -1


class JsonCounter:
    """Lengths by a tokenizers file; texts stay whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def split(self, text: str, chunk_chars: int) -> list[str]:
        return [text]


def counter(path: str) -> PieceCounter | JsonCounter:
    """Loaded once per worker, until the worker turns to another operator."""
    return resident(("token_counts", path), lambda: PieceCounter(path) if path.endswith(".model") else JsonCounter(path))


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def count_texts(texts: list[str], path: str, batch_bytes: int, chunk_chars: int) -> np.ndarray:
    """Token counts of the texts, in their order."""
    enc = counter(path)
    pieces: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        for part in enc.split(text, chunk_chars) if text else ():
            pieces.append(part)
            owner.append(i)
    total = np.zeros(len(texts), dtype=np.int64)
    at = np.asarray(owner, dtype=np.int64)
    for a, b in by_bytes(list(map(n_bytes, pieces)), batch_bytes):
        np.add.at(total, at[a:b], np.asarray(enc.lengths(pieces[a:b]), dtype=np.int64))
    return total


def count_tokens(
    docs: DataFrame,
    model: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
    chunk_chars: int = 1 << 15,
) -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    model: path of a .model or .json vocabulary, the same on every executor. Null and empty texts
    count 0 bytes and 0 tokens. Ids may repeat or be null; each row is counted by itself. Other
    columns, whatever their names, are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), pc.fill_null(batch.column(1), "")
            n = count_texts(text.to_pylist(), model, batch_bytes, chunk_chars)
            size = pc.binary_length(text.cast(pa.binary() if pa.types.is_string(text.type) else pa.large_binary()))
            yield pa.RecordBatch.from_arrays([ids, size.cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return numbered(docs, [id_col, text_col]).mapInArrow(tidy(run), f"{ddl([docs.schema[id_col]])}, {OUT}")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
