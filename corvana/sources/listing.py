"""Listing of source trees, folder by folder in tasks: ignored folders are never opened, links never followed.

Each round lists the folders of one depth, dealt out over tasks, and writes what it finds; the
folders among it that no rule ignores are the next round. The driver holds counts alone, whatever
the number of files. Reading a source again goes through open_contained, which takes regular files
below the roots and no link on the way.
"""

from __future__ import annotations

import os
import posixpath
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import references as R

#: Folders of a task, and examples of each rule in a report.
TASK_FOLDERS, EXAMPLES = 256, 8
#: Folders that hold no sources, whatever the rules say.
SKIPPED = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv")
ENTRY = "path string, folder boolean, link boolean, size long, modified double"


def entries(root: str, folder: str) -> Iterator[tuple]:
    """(path below root, whether a folder, whether a link, bytes, time) of what a folder holds, by name; nothing if it is gone."""
    if root.startswith("file:") or "://" not in root:
        top = "/" + root[5:].lstrip("/") if root.startswith("file:") else root
        try:
            found = sorted(os.scandir(os.path.join(top, folder)), key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return
        for e in found:
            info = e.stat(follow_symlinks=False)
            kind = info.st_mode
            if stat.S_ISREG(kind) or stat.S_ISDIR(kind) or stat.S_ISLNK(kind):
                yield posixpath.join(folder, e.name), stat.S_ISDIR(kind), stat.S_ISLNK(kind), info.st_size, info.st_mtime
        return
    system, top = pafs.FileSystem.from_uri(root)
    for info in sorted(system.get_file_info(pafs.FileSelector(posixpath.join(top, folder), allow_not_found=True)), key=lambda i: i.path):
        modified = info.mtime.timestamp() if info.mtime else None
        yield posixpath.join(folder, info.base_name), info.type == pafs.FileType.Directory, False, info.size or 0, modified


def _lister(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["path", "folder", "link", "size", "modified"]
    kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(entries(root, folder))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


@dataclass(frozen=True)
class Listing:
    """found: path, folder, link, size, modified, rule (of the ignore rules, by number), skipped; opened: the folders that were listed."""

    found: DataFrame
    opened: DataFrame

    def sources(self) -> DataFrame:
        """path, size, modified of the files to index."""
        return self.found.filter("NOT folder AND NOT link AND NOT skipped AND rule IS NULL").select("path", "size", "modified")

    def report(self) -> DataFrame:
        """state, rule, n, bytes, examples: what would be indexed, and what is left out and why, before anything is written.

        An ignored folder counts once: nobody has looked into it.
        """
        state = F.when(F.col("link"), "link").when(F.col("rule").isNotNull(), "ignored").when(F.col("skipped"), "skipped").when(F.col("folder"), "folder").otherwise("indexed")
        told = self.found.withColumn("state", state).filter("state <> 'folder'")
        first = told.withColumn("_r", F.row_number().over(_by_path())).filter(F.col("_r") <= EXAMPLES).groupBy("state", "rule").agg(F.array_sort(F.collect_list("path")).alias("examples"))
        counts = told.groupBy("state", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("folder"), F.col("size")).otherwise(0)).alias("bytes"))
        same = counts["state"].eqNullSafe(first["state"]) & counts["rule"].eqNullSafe(first["rule"])
        return counts.join(first, same).select(counts["state"], counts["rule"], "n", "bytes", "examples")


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("state", "rule").orderBy("path")  # its limit holds below the exchange


def listing(spark: SparkSession, root: str, scratch: str, rules: list[R.IgnoreRule] = (), skip: tuple[str, ...] = SKIPPED) -> Listing:
    """What is below a root, with ignore rules before descent; scratch: a folder that the tasks share, for the rounds."""
    frontier = spark.createDataFrame([("",)], "path string")
    depth = 0
    while True:
        frontier.write.parquet(f"{scratch}/opened/depth={depth}")
        given = spark.read.parquet(f"{scratch}/opened/depth={depth}")
        n = given.count()
        if not n:
            break
        raw = given.repartition(max(1, -(-n // TASK_FOLDERS))).mapInArrow(_lister(root), ENTRY)
        name = F.substring_index("path", "/", -1)
        rule = R.ignored_by(F.col("path"), list(rules)) if rules else F.lit(None).cast("int")
        inner = R.ignored_by(F.concat("path", F.lit("/_")), list(rules)) if rules else F.lit(None).cast("int")
        marked = raw.withColumn("rule", F.coalesce(rule, F.when(F.col("folder"), inner))).withColumn("skipped", name.isin(*skip) | name.startswith(".") | name.startswith("_"))
        marked.write.parquet(f"{scratch}/found/depth={depth}")
        frontier = spark.read.parquet(f"{scratch}/found/depth={depth}").filter("folder AND NOT link AND NOT skipped AND rule IS NULL").select("path")
        depth += 1
    opened = spark.read.parquet(f"{scratch}/opened").select("path")
    return Listing(spark.read.parquet(f"{scratch}/found").drop("depth"), opened)


class NotContained(PermissionError):
    """A source that is not a regular file below the roots, or is reached by a link."""


def open_contained(path: str, roots: list[str]) -> int:
    """A descriptor of a regular file below one of the roots, no part of whose path is a link; the caller closes it.

    Each part is opened from the one before, so that a link put in place meanwhile is not followed.
    """
    for root in map(os.path.abspath, roots):
        inside = os.path.relpath(os.path.abspath(path), root)
        if inside == ".." or inside.startswith("../") or inside == ".":
            continue
        handle = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
        try:
            *folders, name = inside.split("/")
            for part in folders:
                below = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=handle)
                os.close(handle)
                handle = below
            found = os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=handle)
        except OSError as error:
            raise NotContained(path) from error
        finally:
            os.close(handle)
        if not stat.S_ISREG(os.fstat(found).st_mode):
            os.close(found)
            raise NotContained(path)
        return found
    raise NotContained(path)
