"""Byte-level BPE, the coder of token ids, and token files, by exact round trips and the libraries themselves."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corvana.llm import batch_pieces, byte_bpe, mixing_coder, token_files

P = pytest.importorskip("public_tokenizers")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
ROWS = [(0, "Hello there, it's 12 o'clock"), (1, None), (2, ""), (3, "  two  spaces\n\n\ttab "), (4, "naïve 漢字 🙂👍🏽 é"), (5, "<|endoftext|> x"), (5, "again"), (None, "no id"), (9, "word " * 40000), (8, "ab" * 30000)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_tiktoken(text):
    bpe = byte_bpe.codec(MULTI, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ids = bpe.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_bpe_rows(spark, reference):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    encoded = byte_bpe.encode(frame, MULTI, P.PATTERN)
    both = {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(encoded, MULTI, P.PATTERN).collect()}
    want = {(i, struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for i, t in ROWS for x in [reference.encode_ordinary(t or "")]}
    assert both == want
    assert {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.round_trip(frame, MULTI, P.PATTERN).collect()} == want
    assert byte_bpe.round_trip(frame.limit(0), MULTI, P.PATTERN).count() == 0


ODD = list("abcXsétrvmld1²½٣_.,'’-! \n\t  \x1c\x85漢🙂\r𝐀𝟏") + [" "] * 8 + ["'"] * 4


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ODD), max_size=16), min_size=1, max_size=6))
def test_cuts_equal_the_pattern(texts):
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts])
    want = [p for t in texts for p in regex.findall(batch_pieces.PATTERN, t)]
    if len(points):
        begin = batch_pieces.boundaries(points, (np.cumsum(sizes) - sizes)[sizes > 0], batch_pieces._classes()).tolist()
        assert ["".join(texts)[a:b] for a, b in zip(begin, [*begin[1:], len(points)])] == want


def test_pattern_is_the_libraries():
    assert batch_pieces.PATTERN == P.PATTERN
    kinds = batch_pieces._classes()
    for k in range(0, 0x110000, 7):
        if not 0xD800 <= k < 0xE000:
            c = chr(k)
            want = batch_pieces.LETTER if regex.match(r"\p{L}", c) else batch_pieces.NUMBER if regex.match(r"\p{N}", c) else batch_pieces.SPACE if regex.match(r"\s", c) else batch_pieces.OTHER
            assert kinds[k] == want


def test_tables_that_overflow(monkeypatch, reference):
    monkeypatch.setattr(batch_pieces, "MAX_ENTRIES", 3)
    monkeypatch.setattr(batch_pieces, "PASS_CHARS", 64)
    monkeypatch.setattr(batch_pieces, "_SLOTS", 64)
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(MULTI), P.PATTERN)
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "bb", "ccc", "dddd", "eeeee", "ff", "漢字x"], k=rng.randint(0, 9))) for _ in range(200)] + [None, "long " * 100]
    got = bpe.texts.encode_many(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference.encode_ordinary(t or "") for t in texts]


def test_another_pattern():
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(MULTI), r"\S+|\s+")
    ref = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=bpe.ranks, special_tokens={})
    assert np.frombuffer(bpe.encode("it's  a test"), "<u4").tolist() == ref.encode_ordinary("it's  a test") and bpe.encode("") == b""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=900), st.booleans())
def test_coder(ids, repeat):
    data = np.array(ids * (3 if repeat else 1), dtype=np.int64)
    assert mixing_coder.decode_block(mixing_coder.encode_block(data, 300)).tolist() == data.tolist()


def test_coder_learns_and_finds_damage():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50000, 50)
    data = np.tile(phrase, 1200)
    block = mixing_coder.encode_block(data, 50257)
    assert (mixing_coder.decode_block(block) == data).all() and len(block) * 8 / len(data) < 4
    noise = rng.integers(0, 50257, 60000)
    assert (mixing_coder.decode_block(mixing_coder.encode_block(noise, 50257)) == noise).all()
    for at in (5, 20, 40, len(block) - 3):
        bad = bytearray(block)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            mixing_coder.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        mixing_coder.encode_block(np.array([300]), 300)


def test_file_over_many_blocks(monkeypatch):
    monkeypatch.setattr(mixing_coder, "BLOCK_IDS", 100)
    out, docs = io.BytesIO(), [(None, [1, 2]), (3, []), (4, list(range(250))), (4, [7] * 99), (9, [5])]
    writer = token_files.Writer(out, 300)
    for doc, ids in docs:
        writer.add(doc, struct.pack(f"<{len(ids)}I", *ids))
    writer.close()
    read = [(d, i.tolist()) for d, i in token_files.read_file(out, out.tell())]
    assert read == docs


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.round_trip(frame, JSON, P.PATTERN).collect()]
    at, want = 0, []
    for doc, text in sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, at, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert token_files.round_trip(frame.limit(0), JSON, P.PATTERN).count() == 0


def test_added_tokens_of_the_file(spark, tmp_path):
    from tokenizers import Tokenizer

    from corvana.llm.queries import QUERIES

    tok, at = Tokenizer.from_file(JSON), 0
    rows = [*((k, t) for k, (_, t) in enumerate(ROWS)), (20, "end <|endoftext|> start"), (21, "<|endoftext|><|endoftext|>\n x<|endoftext|"), (22, "after it")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_files"](spark, str(tmp_path)).collect()}
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[doc] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert got[20][1] == 5


def test_queries(spark):
    """The contract's digests, from the libraries alone."""
    from corvana.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})
    for r in QUERIES["op3_byte_bpe"](spark, sf).collect():
        ids = ref.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(JSON), 0
    for r in sorted(QUERIES["op4_token_files"](spark, sf).collect(), key=lambda r: r.doc_id):
        ids = tok.encode(docs[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
