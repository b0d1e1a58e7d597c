"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as a request, a response (or a revisit of the response with
the same payload) and a metadata record, each a gzip member; request and metadata
name the response in WARC-Concurrent-To. Reading parses every record of the
archives, checks lengths and payload digests, and gives rows. Assembly joins
request, response and metadata rows through concurrent-to identifiers, in either
direction and over one record between, into one nested row for each capture.

Tasks write archives under names of their own; only those of finished tasks enter
the manifest, so that a task may run again.

Defined cases: a null html is an empty payload, a null url an empty target. Of equal
payloads of at least MIN_REVISIT_BYTES bytes the one with the smallest id is the
response, the others (those without an id too) are revisits; a payload that only
rows without an id have is a response each time. Repeated rows are captures of
their own, responses if they have the smallest id. A record whose length, version
or digest is wrong raises ValueError with its offset. A request or metadata record
without a response gives a capture whose response is null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.llm.common import file_system, lean, materialise, scratch_dir

MIN_REVISIT_BYTES = 0
#: The capture date where the table has none.
CAPTURE_DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
#: Blocks up to this size are packed with a window of 1 KB.
SMALL_BYTES = 512
#: Compressed bytes that the reader takes at a time.
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "record_id string, concurrent_to array<string>, warc_type string, target_uri string, warc_date string, payload_bytes long, payload_digest string, refers_to long, page_id long, http_line string, path string, offset long"
_FIELDS = [x.split(" ", 1)[0] for x in _RECORD.split(", ")]
_KINDS = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; line breaks in header values become spaces."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>"]
    lines += [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    # A small record needs a small window: setting up a large one costs more than packing it.
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31) if len(block) > SMALL_BYTES else zlib.compressobj(LEVEL, zlib.DEFLATED, 26, 2)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def capture(base: int, page_id: int | None, url: str | None, html: str | None, refers_to: int | None, refers_uri: str | None) -> bytes:
    """The three records of a capture; base: the first of three record numbers."""
    url = url or ""
    request_id, response_id, metadata_id = (f"urn:uuid:{uuid.UUID(int=base + k)}" for k in range(3))
    payload = (html or "").encode("utf-8", "surrogatepass")
    common = [("WARC-Target-URI", url), ("WARC-Date", CAPTURE_DATE)]
    host, _, path = re.sub(r"^[a-z]+://", "", url).partition("/")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    answered = [*common, ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        answer = record("response", response_id, answered, http + payload)
    else:
        answered += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", refers_uri or ""), ("WARC-Refers-To-Date", CAPTURE_DATE), ("Corvana-Refers-To-Page", str(refers_to))]
        answer = record("revisit", response_id, answered, http)
    linked = [*common, ("WARC-Concurrent-To", f"<{response_id}>")]
    ask = record("request", request_id, [*linked, ("Content-Type", "application/http; msgtype=request")], re.sub(r"\s", "%20", f"/{path}").join(("GET ", f" HTTP/1.1\r\nHost: {host}\r\n\r\n")).encode("utf-8", "surrogatepass"))
    note = record("metadata", metadata_id, [*linked, ("Content-Type", "application/warc-fields")], f"page: {'' if page_id is None else page_id}\r\n".encode())
    return ask + answer + note


def members(source) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of an open file."""
    data, base, at = b"", 0, 0
    while True:
        if at >= len(data):
            base, data, at = base + len(data), source.read(READ_BYTES), 0
            if not data:
                return
        start, unpack, out = base + at, zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                base, data, at = base + len(data), source.read(READ_BYTES), 0
                if not data:
                    raise ValueError(f"the record at byte {start} is cut")
            part = data[at : at + 4096]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        yield start, b"".join(out)


def _angle(value: str) -> str:
    return value.strip().removeprefix("<").removesuffix(">")


def parse(data: bytes, offset: int) -> tuple[dict[str, list[str]], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not first.startswith("WARC/1."):
        raise ValueError(f"no record at byte {offset}")
    headers: dict[str, list[str]] = {}
    for line in lines:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    size = int(headers.get("content-length", ["-1"])[0])
    if size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {offset} is not as long as it says")
    return headers, rest[:size]


def record_row(path: str, offset: int, data: bytes) -> tuple:
    headers, block = parse(data, offset)
    one = lambda name: headers.get(name, [None])[0]
    kind, size, sha, page, line = one("warc-type"), None, None, None, None
    if kind in ("response", "revisit", "request"):
        head, _, payload = block.partition(b"\r\n\r\n")
        line = head.split(b"\r\n", 1)[0].decode("utf-8", "replace")
        if kind == "response":
            size, sha = len(payload), digest(payload)
            if one("warc-payload-digest") not in (None, f"sha1:{sha}"):
                raise ValueError(f"the payload digest of the record at byte {offset} is wrong")
        elif kind == "revisit":
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size, sha = int(length[1]) if length else None, (one("warc-payload-digest") or "").removeprefix("sha1:") or None
    elif kind == "metadata":
        found = re.search(rb"(?m)^page: *(-?\d+)", block)
        page = int(found[1]) if found else None
    refers = one("corvana-refers-to-page")
    return (_angle(one("warc-record-id") or ""), [_angle(x) for x in headers.get("warc-concurrent-to", [])], kind, one("warc-target-uri"), one("warc-date"), size, sha, int(refers) if refers else None, page, line, path, offset)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, refers_uri: which captures revisit which page."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("sha", F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b""))))
    big = F.coalesce(F.octet_length("html"), F.lit(0)) >= MIN_REVISIT_BYTES
    groups = given.filter(big).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.min_by("url", F.col("page_id")).alias("first_url"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    joined = given.join(materialise(groups.drop("n")), "sha", "left")
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    return joined.select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_uri"))


def write(captures: DataFrame, folder: str) -> DataFrame:
    """Archives below folder; the manifest: path, bytes, captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        path, out, n, base = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, uuid.uuid4().int >> 40 << 40
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path)
                out.write(capture(base + 3 * n, *row))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "captures"])

    return materialise(captures.select("page_id", "url", "html", "refers_to", "refers_uri").mapInArrow(lean(run), "path string, bytes long, captures long"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives, without its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(path) as source:
                    for offset, data in members(source):
                        rows.append(record_row(path, offset, data))
                        if len(rows) >= 4000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(lean(run), _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """capture_id, request, response, metadata, n_requests, n_metadata: one nested row for each capture.

    A record that is no response belongs to the response it names, to the one that
    names it, or to that of the record it names. Captures are grouped by hash
    aggregation; of several requests or metadata records the first id stands.
    """
    answers = F.col("warc_type").isin("response", "revisit")
    others = records.filter(F.col("warc_type").isin("request", "metadata"))
    named = records.filter(answers).select(F.explode("concurrent_to").alias("named_id"), F.col("record_id").alias("by_response"))
    named = named.groupBy("named_id").agg(F.min("by_response").alias("by_response"))
    keyed = others.join(named, F.col("record_id") == F.col("named_id"), "left")
    keyed = keyed.withColumn("capture_id", F.coalesce("by_response", F.get("concurrent_to", F.lit(0)), "record_id")).drop("named_id", "by_response")
    hops = keyed.filter("warc_type = 'request'").selectExpr("record_id AS hop", "capture_id AS beyond")
    keyed = keyed.join(hops, (F.col("capture_id") == F.col("hop")) & (F.col("record_id") != F.col("hop")), "left").withColumn("capture_id", F.coalesce("beyond", "capture_id")).drop("hop", "beyond")
    whole = keyed.union(records.filter(answers).withColumn("capture_id", F.col("record_id")))

    def part(condition: str) -> Column:
        fields = ", ".join(f"'{n}', {n}" for n in _FIELDS)
        return F.min(F.expr(f"CASE WHEN {condition} THEN named_struct({fields}) END"))

    return whole.groupBy("capture_id").agg(
        part("warc_type = 'request'").alias("request"),
        part("warc_type IN ('response', 'revisit')").alias("response"),
        part("warc_type = 'metadata'").alias("metadata"),
        F.count_if(F.col("warc_type") == "request").alias("n_requests"),
        F.count_if(F.col("warc_type") == "metadata").alias("n_metadata"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder, read the archives back, and assemble the captures.

    The records are written once, without payloads: assembly reads them several times.
    """
    folder = scratch_dir(pages.sparkSession)
    return assemble(materialise(read(write(with_revisits(pages), folder), folder)))
