"""Token-id files: documents encoded by a tokenizer, coded in blocks, read back by position.

A file holds the documents of one range of ids, in ascending order: blocks of
coded ids (see mixing_coder), then a directory and a fixed tail. The directory is
a zstandard frame of the documents' ids (signed 64-bit), their token counts
(unsigned 64-bit) and the blocks' lengths (unsigned 64-bit), little-endian; the tail
gives its length and crc32, the numbers of documents, ids and blocks, and a magic.
Tasks write files under names of their own, and only those of finished tasks
enter the manifest: a task that is run again leaves a file that nobody reads.

Defined cases: a null text is an empty one and has the end id alone; rows of one
id stay apart, in the order of their texts; a null id comes first and is read
back as null. An empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvana.llm import mixing_coder
from corvana.llm.common import file_system, keeps, lean, materialise, scratch_dir, vocabulary_file
from corvana.llm.pretokens import TextEncoder

TAIL = struct.Struct("<QIQQQ4s")
TAIL_MAGIC = b"CTF1"
NULL_ID = -(1 << 63)
#: Documents that a reader passes on at a time.
READ_DOCS = 2000


def _byte_chars() -> dict[int, str]:
    """The characters of byte-level pre-tokens: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(tokenizer: str, pattern: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_file(tokenizer))
    chars, model = _byte_chars(), tok.model

    def encode(pieces: list[str]) -> list[list[int]]:
        # A pre-token goes straight to the tokenizer's model, in the characters that stand for its bytes.
        return [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(chars))] for p in pieces]

    return TextEncoder(pattern, encode), tok


keeps(__name__, _encoder.cache_clear)


def _encode_many(encoder: TextEncoder, tok, texts: list[str | None], added: list[str]) -> list[bytes]:
    """Ids of texts; those that hold an added token go to the tokenizer as a whole."""
    whole = {k for k, t in enumerate(texts) if t and any(a in t for a in added)}
    if not whole:
        return encoder.encode_many(texts)
    out = list(encoder.encode_many([None if k in whole else t for k, t in enumerate(texts)]))
    for k in whole:
        out[k] = np.asarray(tok.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
    return out


class Writer:
    """Streams documents into one file; holds one block of ids and the directory."""

    def __init__(self, out, vocabulary: int) -> None:
        self.out, self.vocabulary = out, vocabulary
        self.docs, self.sizes, self.blocks, self.held, self.waiting = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids) // 4
        while self.waiting >= mixing_coder.BLOCK_IDS:
            self._flush(mixing_coder.BLOCK_IDS)

    def _flush(self, n: int) -> None:
        data = b"".join(self.held)
        block = mixing_coder.encode_block(np.frombuffer(data, dtype="<u4", count=n), self.vocabulary)
        self.out.write(block)
        self.blocks.append(len(block))
        self.held, self.waiting = [data[4 * n :]], self.waiting - n

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        table = np.asarray(self.docs, dtype="<i8").tobytes() + np.asarray(self.sizes, dtype="<u8").tobytes() + np.asarray(self.blocks, dtype="<u8").tobytes()
        packed = zstandard.compress(table, 3)
        self.out.write(packed)
        self.out.write(TAIL.pack(len(packed), zlib.crc32(packed), len(self.docs), sum(self.sizes), len(self.blocks), TAIL_MAGIC))


def read_file(source, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of an open file of `size` bytes, with one block in memory at a time."""
    source.seek(size - TAIL.size)
    length, crc, n_docs, _, n_blocks, magic = TAIL.unpack(source.read(TAIL.size))
    if magic != TAIL_MAGIC:
        raise ValueError("no token file")
    source.seek(size - TAIL.size - length)
    packed = source.read(length)
    if zlib.crc32(packed) != crc:
        raise ValueError("the directory of a token file is damaged")
    table = zstandard.decompress(packed)
    docs = np.frombuffer(table, dtype="<i8", count=n_docs)
    sizes = np.frombuffer(table, dtype="<u8", count=n_docs, offset=8 * n_docs)
    blocks = np.frombuffer(table, dtype="<u8", count=n_blocks, offset=16 * n_docs)
    source.seek(0)
    left, at = np.empty(0, dtype="<u4"), 0
    for doc, need in zip(docs.tolist(), sizes.tolist(), strict=True):
        parts = [left[: int(need)]]
        got, left = len(parts[0]), left[len(parts[0]) :]
        while got < need:
            left = mixing_coder.decode_block(source.read(int(blocks[at])))
            at += 1
            parts.append(left[: int(need) - got])
            got, left = got + len(parts[-1]), left[len(parts[-1]) :]
        yield (None if doc == NULL_ID else doc), np.concatenate(parts)


def write(docs: DataFrame, tokenizer: str, pattern: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", match_added: bool = False) -> DataFrame:
    """Write docs in ascending order of id_col below folder; the manifest: path, bytes, n_docs, n_tokens, start.

    match_added: strings of the tokenizer's added tokens in a text become their ids; otherwise they are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tok = _encoder(tokenizer, pattern)
        vocabulary, added = tok.get_vocab_size(), [t.content for t in tok.get_added_tokens_decoder().values()] if match_added else []
        end = struct.pack("<I", end_id)
        fs, root = file_system(folder)
        path, writer, out, first = f"{root}/{uuid.uuid4().hex}.ctf", None, None, None
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), _encode_many(encoder, tok, batch.column(1).to_pylist(), added), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path)
                    writer, first = Writer(out, vocabulary), NULL_ID if doc is None else doc
                writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            rows = [path], [size], [first], [len(writer.docs)], [sum(writer.sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(x, pa.int64()) for x in rows[1:])], ["path", "bytes", "first_id", "n_docs", "n_tokens"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialise(ordered.mapInArrow(lean(run), "path string, bytes long, first_id long, n_docs long, n_tokens long"))
    # One row for each file: the only thing that is put in one order as a whole.
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(path) as source:
                    for doc, ids in read_file(source, size):
                        rows.append((doc, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        if len(rows) >= READ_DOCS:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    files = manifest.select("path", "bytes", "start")
    return files.repartition(max(1, files.count())).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def round_trip(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, match_added: bool = False) -> DataFrame:
    """Write docs into token files in the shared folder, and read them back."""
    folder = scratch_dir(docs.sparkSession)
    return read(write(docs, tokenizer, pattern, folder, end_id, match_added=match_added), folder)
