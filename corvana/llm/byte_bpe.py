"""Byte-level BPE through a sentencepiece model written straight from a vocabulary.

Bytes become characters (U+0100 plus the byte), so that every token of the
vocabulary is a piece; its score is its negative rank, and normalisation is the
identity. sentencepiece then merges, as rank-ordered byte pair encoding does, the
pair whose joined piece has the lowest rank, leftmost first. Each match of the
pre-token pattern is encoded by itself; one that is a token as a whole is that
token. Decoding joins the bytes of the ids.

Ids come as a binary column of little-endian unsigned 32-bit integers.

Defined cases: a null text is an empty one, with no ids and no bytes. Repeated
rows give repeated results; other columns are not carried.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from corvana.llm.common import keeps, lean, vocabulary_file
from corvana.llm.pretokens import TextEncoder

BYTE_BASE = 0x100
_BPE, _NORMAL, _UNKNOWN = 2, 1, 2
#: Rows of a batch on its way out of a worker.
ROWS_OUT = 500


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: bytes by length, an int as a varint."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def to_chars(data: bytes) -> str:
    return "".join([chr(BYTE_BASE + b) for b in data])


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised BPE model; piece ids are ranks, the unknown piece comes after them."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    pieces = [piece(to_chars(t), -float(r), _NORMAL) for r, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, _UNKNOWN))
    trainer = _field(3, _BPE) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of a vocabulary and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.texts = TextEncoder(pattern, self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens; one that is a token as a whole is that token."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = [self.ranks.get(d) for d in data]
        merged = iter(self.processor.encode([to_chars(d) for d, w in zip(data, whole, strict=True) if w is None], num_threads=1))
        return [[w] if w is not None else next(merged) for w in whole]

    def encode(self, text: str) -> bytes:
        return self.texts.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(vocabulary_file(vocabulary)), pattern)


keeps(__name__, codec.cache_clear)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens and ids of every row; the vocabulary file must be readable on the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            ids = bpe.texts.encode_many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The rows of encoded with a further column, decoded: the bytes that its ids stand for."""
    at, names = encoded.columns.index("ids"), [*encoded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            data = [bpe.decode(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names)

    return encoded.mapInArrow(lean(run), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids and decoded of every row: both directions in one pass of one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            for part in (batch.slice(k, ROWS_OUT) for k in range(0, batch.num_rows, ROWS_OUT)):
                ids = bpe.texts.encode_many(part.column(1).to_pylist())
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, n_tokens long, ids binary, decoded binary")
