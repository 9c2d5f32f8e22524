"""Token counts, byte-level BPE and language ID: against libraries, held-out rows and odd rows."""

import hashlib
import math
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.llm import byte_bpe, language_id, token_counts

MODEL = P.path("piece_bpe_32k.model")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, n_tokens int, ids string, score string, bands int"
ODD = [
    (1, "The quick brown fox", "en", 7, "x", "y", 1), (1, "The quick brown fox", "en", 7, "x", "y", 1), (2, None, None, 0, "", "", 2), (3, "", "de", 1, "", "", 3),
    (None, "ohne Nummer, aber mit Text", "de", 1, "", "", 4), (4, "12345 !!! \n\t  ", None, 1, "", "", 5), (5, "wort " * 30_000, "de", 1, "", "", 6), (6, "a" * 50_000, "en", 1, "", "", 7), (7, "日本語 ▁ <s> </s> \x00 é́", "ja", 1, "", "", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def tokens():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.bpe(RANKS, P.PATTERN).ranks, special_tokens={})


def whole(text):
    return len(token_counts.counter(MODEL).encoder.encode(text, num_threads=1))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e\n\t▁.é日 "), max_size=300), st.integers(1, 40))
def test_split_counts_equal_whole_counts(text, chunk):
    assert token_counts.count_texts([text], MODEL, 50, chunk).tolist() == [whole(text)]


def test_token_counts_of_odd_rows(spark, odd):
    rows = token_counts.count_tokens(odd, MODEL, limit=10).collect()
    assert sorted((r[0] or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((r[0] or -1, len((r[1] or "").encode()), n := whole(r[1] or ""), n > 10) for r in ODD)
    assert token_counts.count_tokens(odd.limit(0), MODEL).count() == 0


def test_json_vocabulary(spark, odd):
    rows = token_counts.count_tokens(odd, P.path("byte_bpe_50k.json")).collect()
    assert [r.n_tokens for r in rows if r.doc_id == 3] == [0] and sum(r.n_tokens for r in rows) > 60_000


def test_bpe_of_odd_rows(spark, odd, tokens):
    rows = byte_bpe.encode(odd, RANKS, P.PATTERN, keep=("lang", "n_tokens"), decode=True).collect()
    want = {r[0]: tokens.encode_ordinary(r[1] or "") for r in ODD}
    for r in rows:
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want[r.doc_id]
    assert sorted(bytes(r.decoded) for r in rows) == sorted((r[1] or "").encode() for r in ODD)
    assert byte_bpe.encode(odd.limit(0), RANKS, P.PATTERN).count() == 0
    done = byte_bpe.encode(odd, RANKS, P.PATTERN, keep=tuple(odd.columns), count=True, check=True)
    assert done.columns == ["doc_id", "text", "lang", "score", "bands", "ids", "n_tokens", "round_trip"] and all(r.round_trip and r.n_tokens == len(want[r.doc_id]) for r in done.collect())
    named = odd.select(odd.doc_id.alias("a.b"), odd.text.alias("te`xt"), odd.ids)
    assert {r["a.b"]: bytes(r.ids) for r in byte_bpe.encode(named, RANKS, P.PATTERN, id_col="a.b", text_col="te`xt", keep=("ids",)).collect()} == {r.doc_id: bytes(r.ids) for r in rows}
    back = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {r[0]: (r[1] or "").encode() for r in ODD}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_equals_library(texts):
    import tiktoken

    enc = byte_bpe.bpe(RANKS, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in enc.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_rank_queue_orders_by_rank_then_position():
    rng, q, want = random.Random(5), byte_bpe.RankQueue(60_000), {}
    for _ in range(5000):
        r, p = rng.choice([3, 255, 256, 511, 512, 59_999, rng.randrange(60_000)]), rng.randrange(10**6)
        q.push(r, [p])
        want.setdefault(r, []).append(p)
    got = []
    while (x := q.pop())[0] >= 0:
        got.append((x[0], sorted(x[1])))
    assert got == [(r, sorted(want[r])) for r in sorted(want)]


def test_merges_at_once_equal_library(tokens, monkeypatch):
    rng, enc = random.Random(9), byte_bpe.bpe(RANKS, P.PATTERN)
    texts = ["".join(rng.choice("etaoinshr üéñ日😀\n0'!st  ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = [tokens.encode_ordinary(t) for t in texts]
    for at_once in (1, 3, 48, 10**9):
        monkeypatch.setattr(byte_bpe, "AT_ONCE", at_once)
        enc.memo, enc.older = {}, {}
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in enc.encode(texts)] == want


def test_other_patterns():
    """Patterns whose syntax the standard library lacks, and those with groups, split as the regex module does."""
    import regex

    for pattern in (r"\p{Lu}?\p{Ll}+|\s+|[^\s\p{L}]+|\p{L}", r"(\w)(\w*)|\W", r" ?[\p{L}\p{M}]+| ?\p{N}{1,3}|\s+|."):
        enc = byte_bpe.bpe(RANKS, pattern)
        for text in ("Some Text 12345 WITH\ncaps", "Größe ÉTÉ 日本 42", ""):
            (words,) = enc.split(text)
            assert words == [m.group() for m in regex.finditer(pattern, text)]
            assert enc.decode(enc.encode([text])[0]) == "".join(words).encode()


def test_memory_does_not_grow_with_new_words(tokens, monkeypatch):
    """Word-rich texts: what is remembered is bounded by bytes, and slices change no ids."""
    import tracemalloc

    rng, enc = random.Random(4), byte_bpe.bpe(RANKS, P.PATTERN)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=7)) for _ in range(40_000)) for _ in range(16)]
    enc.memo, enc.older, enc.held = {}, {}, 0
    tracemalloc.start()
    got = [enc.encode([t])[0] for t in texts]
    peak = tracemalloc.get_traced_memory()[1] - sum(map(len, got))
    tracemalloc.stop()
    assert peak < 120 << 20 and enc.held <= byte_bpe.MEMO
    for t, ids in list(zip(texts, got))[::5]:
        assert list(np.frombuffer(ids, "<u4")) == tokens.encode_ordinary(t)
    monkeypatch.setattr(byte_bpe, "SLICE", 1000)
    monkeypatch.setattr(byte_bpe, "MERGE", 300)
    monkeypatch.setattr(byte_bpe, "MEMO", 50_000)
    some = [t[:20_000] for t in texts[:3]] + ["", "kurz"]
    assert [list(np.frombuffer(x, "<u4")) for x in enc.encode(some)] == [tokens.encode_ordinary(t) for t in some]


def test_ascii_pattern():
    assert byte_bpe.ascii_pattern(P.PATTERN) == r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
    enc = byte_bpe.bpe(RANKS, P.PATTERN)
    for a in range(128):
        for b in range(128):
            text = f"a{chr(a)}{chr(b)}1 {chr(b)}{chr(a)}"
            assert enc.split_ascii(text) == enc.split_any(text)


def test_long_pre_token_is_linear(tokens):
    text = "".join(random.Random(1).choice("etaoin") for _ in range(200_000))
    assert list(np.frombuffer(byte_bpe.bpe(RANKS, P.PATTERN).encode([text])[0], "<u4")) == tokens.encode_ordinary(text)


def slow_bits(train, text, order=3):
    """Code length by the definition, with dictionaries."""
    counts = {}
    for t in train:
        data = b"\0" * order + t
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                counts[data[i - k : i]][data[i]] += 1
    data, bits = b"\0" * order + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: b.replace(b"\0", b"x")), min_size=1, max_size=4), st.lists(st.binary(max_size=40), max_size=4))
def test_code_lengths_equal_definition(train, texts):
    grams, at, n = language_id.distinct(np.concatenate([language_id.windows([(b"", t)], 3)[0] for t in train]))
    order = np.argsort(grams)
    model = language_id.Model({"x": language_id.Tree(grams[order], np.bincount(at, minlength=n)[order], 3)}, 3)
    assert np.allclose(model.code_lengths(texts)[:, 0] if texts else [], [slow_bits(train, t) for t in texts])


def test_blocks_do_not_change_code_lengths(monkeypatch):
    grams, at, n = language_id.distinct(language_id.windows([(b"", b"banana bandana ban")], 3)[0])
    order = np.argsort(grams)
    model = language_id.Model({"x": language_id.Tree(grams[order], np.bincount(at, minlength=n)[order], 3)}, 3)
    whole_text = model.code_lengths([b"a band of bananas", b"", b"nab"])
    monkeypatch.setattr(language_id, "BLOCK", 5)
    assert np.allclose(model.code_lengths([b"a band of bananas", b"", b"nab"]), whole_text)


def test_language_of_odd_rows(spark, odd):
    rows = language_id.predict_language(odd, language_id.train(odd)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].score == 0
    assert by[1].lang_pred == "en" and by[None].lang_pred == "de" and by[7].lang_pred == "ja" and by[1].ids == "x"
    nothing = language_id.predict_language(odd, language_id.train(odd.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and language_id.predict_language(odd.limit(0), language_id.train(odd)).count() == 0


def test_shards_change_nothing(spark, monkeypatch):
    """A model in many shards, read one at a time, gives the code lengths of the whole statistics."""
    rng = random.Random(6)
    words = {x: ["".join(rng.choice(chars) for _ in range(rng.randint(2, 8))) for _ in range(300)] for x, chars in (("aa", "abcdefg hij"), ("bb", "fghijkélmn"), ("cc", "日本語漢字かな "))}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(1, 60))), x) for i, x in enumerate(rng.choices(list(words), k=120))]
    rows += [(900, "", "aa"), (901, None, "bb"), (902, "x" * 3, None), (903, "\0\0a", "bb")]
    docs = spark.createDataFrame(rows, "`a.b` long, text string, lang string")
    texts = [(t or "").encode() for _, t, _ in rows] + [bytes(rng.choices(range(256), k=300)), b"", b"q"]
    for order in (3, 2, 1, 0):
        want = None
        for size in (10**9, 900, 40):
            monkeypatch.setattr(language_id, "SHARD", size)
            model = language_id.train(docs, order=order)
            assert order == 0 or size > 10**6 or order == 1 or len(model.shards) > 2
            got = model.code_lengths(texts)
            assert want is None or np.allclose(got, want)
            want = got
        for k, x in enumerate(sorted(words)):
            train = [(t or "").encode() for _, t, lang in rows if lang == x]
            assert np.allclose(want[-4:, k], [slow_bits(train, t, order) for t in texts[-4:]])
    told = language_id.predict_language(docs, language_id.train(docs))
    assert told.columns == ["a.b", "text", "lang", "lang_pred", "score", "bits_per_byte"]
    right = [r for r in told.collect() if r["a.b"] < 900]
    assert sum(r.lang == r.lang_pred for r in right) >= 0.95 * len(right)


def test_many_stray_languages(spark):
    """Languages of a single document take nothing from the others."""
    rows = [(i, "the cat sat on the mat and the dog ran " * 3, "en") for i in range(30)] + [(100 + i, f"zq{i} xv{i * 7}", f"stray{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict_language(docs, language_id.train(docs)).collect()
    assert {r.lang_pred for r in got if r.lang == "en"} == {"en"}


def test_counts_balance_bytes(monkeypatch):
    """Batches hold so many bytes, not characters."""
    seen, enc = [], token_counts.counter(MODEL)
    monkeypatch.setattr(enc, "lengths", lambda texts: [seen.append(sum(len(t.encode()) for t in texts)) or 0] * len(texts), raising=False)
    token_counts.count_texts(["日本" * 50, "abc" * 100, "é" * 150] * 20, MODEL, 1000, 1 << 15)
    assert max(seen) <= 1000 and len(seen) >= 18


def test_token_counts_query(spark):
    """The query itself, over all documents, against the library's own counts."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in token_counts.op2_token_counts(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = len(own.encode(d.text or ""))
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 4096)


def test_held_out_languages(spark):
    rows = language_id.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in rows if r.held_out]
    assert len(out) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)


def test_op4_digests(spark, tokens):
    from strandframe.llm.common import table

    rows = {r.doc_id: r for r in byte_bpe.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in table(spark, "/root/testdata/sf0.001", "documents").collect():
        ids = tokens.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
