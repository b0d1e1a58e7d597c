"""What the training-data operators share: scratch tables, held-out split, word codes."""

from __future__ import annotations

import atexit
import ctypes
import math
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries a per-worker cache keeps before it starts afresh.
CACHE_ENTRIES = 150_000
#: Longer words are hashed each time instead of being kept.
CACHED_WORD_CHARS = 64
#: Characters that one numpy pass over several documents holds at most, a single document apart.
SLICE_CHARS = 2_000_000


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir; from here on the session's Arrow batches are bounded in bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_ROOTS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared spark.checkpoint.dir, as a URI.

    Where that setting is missing on one machine (tests, a laptop), a temporary folder
    of it takes its place until the driver ends; on a cluster that is an error, as
    executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_ROOTS:
            _OWN_ROOTS[app] = tempfile.mkdtemp(prefix="corvana-")
            atexit.register(shutil.rmtree, _OWN_ROOTS[app], ignore_errors=True)
        root = f"file://{_OWN_ROOTS[app]}"
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/corvana-{uuid.uuid4().hex}"


#: Rows that a task writes at least, where their number is known and they are short.
TASK_ROWS = 100_000


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there.

    rows: how many short rows there are at most, where that is known; a small table is
    then written by fewer tasks, a large one by as many as it has partitions.
    """
    spark, uri = df.sparkSession, scratch_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    df.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


#: What a worker keeps between the tasks of a stage, by the module that keeps it: how to empty it.
_KEPT: dict[str, Callable[[], object]] = {}


def keeps(module: str, clear: Callable[[], object]) -> None:
    """Say how to empty what a module keeps, which is done when the worker serves another module."""
    _KEPT[module] = clear


def _serve(module: str) -> None:
    for other, clear in _KEPT.items():
        if other != module:
            clear()


def give_back() -> None:
    """Return unused memory to the system: a worker serves other stages next, a driver other steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches for workers that live on and serve other stages: what these kept
    is emptied when a task begins, and unused memory is given back when it begins and ends."""
    module = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _serve(module)
        give_back()
        yield from run(batches)
        give_back()

    return task


def vocabulary_file(path: str) -> str:
    """A vocabulary file as this machine has it: at the path, else where its own public_tokenizers keeps that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32(id as text) mod 4 is 2; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_limit(rows: int, n: int) -> int:
    """The greatest signed 64-bit hash that about `rows` of n values reach from below, or ten standard errors more."""
    want = min(n, rows + math.isqrt(100 * rows) + 20)
    return (want << 64) // max(n, 1) - (1 << 63) - 1


def bounded_sample(df: DataFrame, by: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """The `rows` distinct ids of each value of `by` (all, if there are no more) that come first by hash, then by id.

    Ids are thinned by a threshold on the whole range of the hash, worked out from the
    counts of the values, and cut exactly among the few that pass. Where repeated rows
    leave too few of a value, its threshold is raised. Columns: id_col, by.
    """
    spark, hashed = df.sparkSession, F.xxhash64(F.col(id_col))
    kind = df.schema[by].dataType.simpleString()
    limits = {r[by]: [r["count"], hash_limit(rows, r["count"])] for r in df.groupBy(by).count().collect()}
    while True:
        table = spark.createDataFrame([(v, x) for v, (_, x) in limits.items()], f"{by} {kind}, _limit long")
        # One row for each value.
        picked = materialise(df.select(id_col, by).join(F.broadcast(table), by).filter(hashed <= F.col("_limit")).select(id_col, by).distinct())
        have = {r[by]: r["count"] for r in picked.groupBy(by).count().collect()}
        lacking = [v for v, (_, x) in limits.items() if have.get(v, 0) < rows and x < (1 << 63) - 1]
        if not lacking:
            break
        for v in lacking:
            limits[v][0] = max(1, limits[v][0] // 16)
            limits[v][1] = hash_limit(rows, limits[v][0])
    first = Window.partitionBy(by).orderBy(hashed, id_col)
    return picked.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= rows).drop("_place")


def bounded_texts(docs: DataFrame, picked: DataFrame, by: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """(id, value of `by`, text) of sampled ids, by id: one text for each id, whole texts by hash until `size` bytes of a value are full.

    docs: id_col, text_col, and `by` if texts are to have that value themselves.
    """
    on = [c for c in picked.columns if c in docs.columns]
    # The sample's bound is its parameter, so its ids may go to every worker.
    found = docs.join(F.broadcast(picked), on).groupBy(id_col, by).agg(F.min(text_col).alias("_text"))
    before = Window.partitionBy(by).orderBy(F.xxhash64(F.col(id_col)), id_col).rowsBetween(Window.unboundedPreceding, -1)
    sized = materialise(found).withColumn("_before", F.coalesce(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(before), F.lit(0)))
    given = sized.filter(F.col("_before") < size).select(id_col, by, "_text").toArrow()
    return sorted(zip(*(given[c].to_pylist() for c in (id_col, by, "_text")), strict=True), key=lambda x: (x[0], x[1]))


_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)


class WordCodes(dict):
    """word -> 62-bit code of its lower-cased core, 0 where no letter or digit is left."""

    def __missing__(self, word: str) -> int:
        if word.isalpha():  # its own core
            code = xxhash.xxh3_64_intdigest(word.lower()) >> 2 | 1
        else:
            found = _CORE.search(word)
            code = (xxhash.xxh3_64_intdigest(found[0].lower()) >> 2 | 1) if found else 0
        if len(word) <= CACHED_WORD_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = code
        return code


def word_codes(text: str, cache: WordCodes) -> np.ndarray:
    """Codes of the words of a text, words of punctuation alone left out."""
    words = text.split()
    codes = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    return codes[codes != 0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` codes; none if there are fewer."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = codes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k : k + n]
    return mix64(out)


def slices(batch: pa.RecordBatch, text_col: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a batch of two columns in bounded pieces; the id column comes first."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or k == len(texts) - 1:
            yield ids[at : k + 1], texts[at : k + 1]
            at, size = k + 1, 0
