"""Readers and sinks of state: JSON lines, JSON documents, text lists, files with fingerprints.

Schemas are given, never inferred. Lines that are no JSON objects are dropped, as are
blank ones; a missing path is an empty table.
"""

from __future__ import annotations

import os
import tempfile
import time
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def _or_empty(spark: SparkSession, schema: StructType, read: Callable[[], DataFrame]) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def jsonl(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines with file and ord, which rises along a file; limit keeps the last ones, last first.

    (file, ord) is the order of the rows: files by their path, lines as they stand. The tail is a
    top-k and not a sort of everything. Lines that are no objects are no rows: a bare number, or bad JSON.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*kind.fields]).add("file", "string").add("ord", "long")

    def read() -> DataFrame:
        # The scan deals a file out in blocks, and numbers rise within a block.
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
        objects = lines.filter(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
        return objects.select(F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("r"), "file", "at")

    def shown(rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields), "file", "ord")

    try:
        rows = read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], full)
    # Rows of a block keep 33 bits of their number; its start keeps the rest in order.
    placed = rows.withColumn("ord", F.col("at.block") * (1 << 20) + F.col("at.row") % (1 << 33))
    if limit is not None:
        placed = placed.orderBy(F.desc("file"), F.desc("at.block"), F.desc("at.row")).limit(limit)
    return shown(placed)


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row for each JSON file that holds an object, with file, its name."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*kind.fields]).add("file", "string")

    def read() -> DataFrame:
        whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
        good = whole.filter(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
        return good.select(F.from_json("value", kind).alias("r"), "file").select(*(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields), "file")

    return _or_empty(spark, full, read)


def raw_json(spark: SparkSession, path: str) -> DataFrame:
    """file, json of every file, whatever its structure."""
    return _or_empty(spark, StructType.fromDDL("file string, json string"), lambda: spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")))


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list without blank ones and comments."""
    return _or_empty(spark, StructType.fromDDL("line string"), lambda: spark.read.text(path).select(F.trim("value").alias("line")).filter("line != '' AND NOT startswith(line, '#')"))


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, modified, sha256 of the files below a root; their bytes stay in the scan."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return _or_empty(spark, StructType.fromDDL("path string, size long, modified timestamp, sha256 string"), lambda: read.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256")))


def file_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, content of the files below a root that are probably text; Spark's scan leaves out files of no bytes."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    kept = lambda: read.load(root).filter(probably_text(F.col("content"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return _or_empty(spark, StructType.fromDDL("path string, content string"), kept)


SAMPLE_BYTES = 8192


def probably_text(content: Column) -> Column:
    """By the first 8192 bytes: no NUL, few replacement characters (5 %) and few control characters (10 %); empty is text."""
    head = F.substring(content, 1, SAMPLE_BYTES)
    text = F.make_valid_utf8(head.cast("string"))
    n = F.greatest(F.lit(1), F.length(text))
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x01-\x08\x0b\x0e-\x1f\x7f]", ""))
    return (F.length(head) == 0) | ((F.instr(text, "\x00") == 0) & (bad / n <= 0.05) & (control / n <= 0.10))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, root: str) -> str:
    """Write a new version below root and let the pointer CURRENT name it; readers see the old or the new one whole."""
    version = f"v{time.time_ns()}"
    rows.write.parquet(f"{root}/{version}")
    folder = Path(root.removeprefix("file://"))
    atomic_write(folder / "CURRENT", version)
    return version


def read_current(spark: SparkSession, root: str) -> DataFrame:
    folder = Path(root.removeprefix("file://"))
    return spark.read.parquet(f"{root}/{(folder / 'CURRENT').read_text()}")


def atomic_write(path: Path, text: str) -> None:
    """Replace a small driver-side file in one step."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(name, path)


class LockBusy(RuntimeError):
    """Another writer holds the lock."""


@contextmanager
def exclusive_lock(path: Path, blocking: bool = True):
    """Advisory lock of a driver-side artifact; LockBusy if it is taken and blocking is off."""
    import fcntl

    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as handle:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | (0 if blocking else fcntl.LOCK_NB))
        except BlockingIOError as error:
            raise LockBusy(str(path)) from error
        try:
            yield
        finally:
            fcntl.flock(handle, fcntl.LOCK_UN)


# The parts of an action that a ledger may keep.
LEDGER_COLUMNS = ("action_id", "kind", "skill", "tool", "effects", "approval", "created", "status", "duration_ms", "exit_code")


def ledger(rows: DataFrame, status: str, at: Column | None = None) -> DataFrame:
    """The columns of a ledger that say nothing of an action's content, with status and time."""
    kept = [c for c in rows.columns if c in LEDGER_COLUMNS and c != "status"]
    return rows.select(*kept, F.lit(status).alias("status"), (at if at is not None else F.current_timestamp()).alias("recorded"))


# Parts of column names whose values are private.
PRIVATE_HINTS = ("content", "text", "prompt", "query", "message", "body", "secret", "token", "password", "key")


def scrubbed(rows: DataFrame) -> DataFrame:
    """Columns whose names hint at private content hold '[redacted]'."""
    return rows.select(*(F.when(F.col(c).isNotNull(), "[redacted]").alias(c) if any(h in c.lower() for h in PRIVATE_HINTS) else F.col(c) for c in rows.columns))
