"""Ogg files and WARC archives: round trips, damage, and edge cases."""

import base64
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvana.llm import ogg, warc
from corvana.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=200))
def test_page_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 600), st.sampled_from([254, 255, 256, 510, 65025, 65026, 70000])), min_size=1, max_size=8))
def test_packets_survive_paging(sizes):
    packets = [(bytes([k % 251]) * n, k) for k, n in enumerate(sizes)]
    pages = ogg.paginate(packets, 77)
    other = ogg.paginate([(b"note", 0), (b"", 0)], 78)
    mixed = [pages[0], other[0], *other[1:], *pages[1:]]
    streams = ogg.demultiplex(b"".join(mixed))
    assert streams[77].packets == [p for p, _ in packets] and streams[78].packets == [b"note", b""]
    assert all(done == g + 1 for done, g in streams[77].granules)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 18432, 65025, 300000])
def test_text_survives(n):
    text = "aé漢"[: n % 4] + "x" * max(0, n - n % 4)
    data, raw, padded = ogg.store(text)
    clip = ogg.load(data)
    assert (clip.text_bytes, len(clip.payload)) == (raw, padded) == (len(text.encode()), max(1, -(-len(text.encode()) // 576)) * 576)
    assert clip.payload == text.encode().ljust(padded, b"\xff") and clip.seconds == pytest.approx(padded / ogg.RATE)


def test_damage_is_found():
    data, _, _ = ogg.store("some text " * 30000)
    assert data.count(b"OggS") >= 6
    for at in range(0, len(data), 9973):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.load(bytes(bad))
    starts = [at for at, *_ in ogg.read_pages(data)]
    for bad in (data[:-1], data[: starts[-1]], data[: starts[3]] + data[starts[4] :], data + b"x", b""):
        with pytest.raises(ValueError):
            ogg.load(bad)


def test_ogg_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_ogg"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        media = ogg.store(docs[r.doc_id])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature


def test_ogg_edges(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "x"), (1, "x")], "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = ogg.probe(ogg.media_column(frame)).collect()
    assert sorted(r.n_bytes for r in rows) == [0, 0, 1, 1, 1] and len({r.media_sha256 for r in rows}) == 2
    assert ogg.probe(ogg.media_column(frame.limit(0))).count() == 0


PAGES = [(1, "http://a.org/x?q=1", "<p>é</p>"), (2, None, "<p>é</p>"), (None, "http://b.org", "<p>é</p>"), (4, "u", None), (5, "u\r\nWARC-Type: evil", ""), (6, "http://c", "one"), (6, "http://c", "one"), (None, "q", "alone"), (7, "http://d", "x" * 300000)]


def test_warc_rows(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).withColumn("refers_to", F.lit("clash"))
    rows = warc.round_trip(frame).collect()
    assert len(rows) == len(PAGES) and all(r.n_requests == r.n_metadata == 1 for r in rows)
    got = sorted(((r.metadata.page_id, r.response.warc_type, r.response.refers_to, r.response.payload_bytes, r.response.payload_digest) for r in rows), key=repr)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(((i, "response" if first.get(h or "") in (i, None) else "revisit", None if first.get(h or "") in (i, None) else first[h or ""], len((h or "").encode()), sha(h)) for i, _, h in PAGES), key=repr)
    assert got == want
    assert all(r.request.target_uri == r.response.target_uri for r in rows)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert QUERIES["op2_warc"](spark, SF).select("page_id").distinct().count() == pages.count()


def test_records_split_over_reads(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    data = b"".join(warc.capture(3 * k, k, "http://x/y", "t" * k, None, None) for k in range(4))
    rows = [warc.record_row("p", at, part) for at, part in warc.members(io.BytesIO(data))]
    assert [r[2] for r in rows] == ["request", "response", "metadata"] * 4 and [r[5] for r in rows if r[2] == "response"] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_damaged_records():
    good = zlib.decompress(warc.capture(0, 1, "u", "body", None, None), 31)
    assert good.startswith(b"WARC/1.1")
    _, answer, _ = [part for _, part in warc.members(io.BytesIO(warc.capture(0, 1, "u", "body", None, None)))]
    for bad in (answer.replace(b"body", b"bodx"), answer.replace(b"body", b"bod"), answer[2:], b""):
        with pytest.raises(ValueError):
            warc.record_row("p", 0, bad)


def test_assembly_in_either_direction(spark):
    row = lambda i, kind, to: (i, to, kind, "u", "d", 1, "s", None, 9 if kind == "metadata" else None, "l", "p", 0)
    rows = [row("r1", "response", ["q1"]), row("q1", "request", []), row("m1", "metadata", ["q1"]), row("r2", "response", []), row("q2", "request", ["r2"]), row("m2", "metadata", ["r2"]), row("m3", "metadata", ["r2"]), row("m9", "metadata", ["gone"])]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc._RECORD)).collect()}
    assert set(got) == {"r1", "r2", "gone"}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1"
    assert (got["r2"].n_metadata, got["r2"].metadata.record_id, got["gone"].response) == (2, "m2", None)
