"""Lines of growing files as a table and as a stream: a Python data source with offsets.

A file only grows at its end. A range of bytes holds the lines whose line feed lies in
it, wherever they begin, so that ranges that follow one another give each line once,
however they are cut; a last line without its line feed waits until it is complete. The
offset of a stream is the number of bytes that is given out of each file. Driver and
workers list and read by pyarrow's file systems; the driver holds names and sizes alone.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from threading import Event

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "file string, at long, value string"
#: Bytes of a task, bytes that are read at once, and lines of a batch towards Spark.
TASK_BYTES, READ_BYTES, BATCH_LINES = 8 << 20, 1 << 20, 10_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Range(InputPartition):
    """The lines of a file whose line feed lies in [start, end)."""

    def __init__(self, file: str, start: int, end: int) -> None:
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class _Lines:
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))

    def sizes(self) -> dict[str, int]:
        """Bytes of each file of the folder, hidden ones and those that begin with _ apart."""
        system, folder = _open(self.uri)
        found = system.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        names = {posixpath.relpath(f.path, folder): f.size for f in found if f.type == pafs.FileType.File}
        return {n: size for n, size in sorted(names.items()) if not any(part[0] in "._" for part in n.split("/"))}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for name, size in end.items():
            done = start.get(name, 0)
            out += [Range(name, a, min(size, a + self.task_bytes)) for a in range(done, size, self.task_bytes)]
        return out

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, folder = _open(self.uri)
        with system.open_input_file(posixpath.join(folder, part.file)) as source:
            begin = self._line_begin(source, part.start)
            rest, at, out = b"", begin, []
            place = begin
            while place < part.end:
                piece = source.read_at(min(READ_BYTES, part.end - place), place)
                if not piece:
                    break
                place += len(piece)
                *whole, rest = (rest + piece).split(b"\n")
                for line in whole:
                    out.append((at, line))
                    at += len(line) + 1
                    if len(out) >= BATCH_LINES:
                        yield self._batch(part.file, out)
                        out = []
            if out:
                yield self._batch(part.file, out)

    @staticmethod
    def _line_begin(source: pa.NativeFile, start: int) -> int:
        """Where the line begins that goes on at a place."""
        end = start
        while end > 0:
            low = max(0, end - READ_BYTES)
            feed = source.read_at(end - low, low).rfind(b"\n")
            if feed >= 0:
                return low + feed + 1
            end = low
        return 0

    @staticmethod
    def _batch(file: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for _, line in rows]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), pa.array(texts, pa.string())], ["file", "at", "value"])


class LineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.sizes())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.lines(partition)


class LineStream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.lines(partition)


class LineSource(DataSource):
    """Format stored_lines: option path is a folder, taskBytes the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "stored_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema: object) -> LineStream:  # noqa: N802
        return LineStream(self.options)


def lines(spark: SparkSession, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, at (byte of its beginning), value of every complete line below a folder."""
    spark.dataSource.register(LineSource)
    return spark.read.format("stored_lines").option("path", folder).option("taskBytes", task_bytes).load()


def line_stream(spark: SparkSession, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format("stored_lines").option("path", folder).option("taskBytes", task_bytes).load()


def follow(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cancel: Event, poll: float = 0.2, to_end: bool = False) -> bool:
    """Give a stream's batches to a sink until cancel is set (True), or all that is there is given (to_end; False).

    Stopping leaves the checkpoint behind the last finished batch: a later call goes on there, and a
    batch that was under way comes again with its number.
    """
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    query: StreamingQuery = (writer.trigger(availableNow=True) if to_end else writer).start()
    try:
        while not cancel.is_set():
            if query.awaitTermination(poll):
                return False
    finally:
        query.stop()
    return True
