"""Versioned tables, stored lines as streams, and refreshed vectors by keyed state."""

import hashlib
import json
import random
import threading

import pytest

from corvana.operators import cleanup, memory
from corvana.sources import lines, state, versioned
from corvana.streaming import refresh

SCHEMA = "conv_id long, turn long, text string"


def filled(spark, root, files=4):
    table = versioned.Table(spark, root, SCHEMA)
    for k in range(files):
        table.append(spark.createDataFrame([(10 * k + i, t, f"{i} {t}") for i in range(5) for t in range(3)], SCHEMA).coalesce(1))
    return table


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_delete_rewrites_touched_files_alone(spark, tmp_path):
    table = filled(spark, f"file://{tmp_path}/t")
    before, files = rows(table.read()), set(table.live())
    change = table.delete(spark.createDataFrame([(11,), (13,), (999,), (None,)], "conv_id long"))
    assert (change.removed, change.rewritten, change.kept) == (6, 1, 3)
    assert rows(table.read()) == [r for r in before if r[0] not in (11, 13)]
    assert len(files & set(table.live())) == 3
    assert rows(table.read(4)) == before  # older versions stay readable
    assert table.delete(spark.createDataFrame([(11,)], "conv_id long")).version == change.version  # nothing to do: no version


def test_merge_replaces_and_adds(spark, tmp_path):
    table = filled(spark, f"{tmp_path}/t")
    new = spark.createDataFrame([(10, 1, "new"), (77, 0, "more")], SCHEMA)
    want = [r for r in rows(table.read()) if r[:2] != (10, 1)] + [(10, 1, "new"), (77, 0, "more")]
    change = table.merge(new, ["conv_id", "turn"])
    assert rows(table.read()) == sorted(want) and (change.removed, change.added, change.rewritten) == (1, 2, 1)
    with pytest.raises(ValueError):
        table.merge(new.union(new), ["conv_id", "turn"])


def test_two_writers_lose_nothing(spark, tmp_path):
    """Appends, deletions and merges of several threads at once all take effect."""
    root = f"file://{tmp_path}/t"
    filled(spark, root, 3)
    failed = []

    def work(k):
        try:
            mine = versioned.Table(spark, root, SCHEMA)
            mine.append(spark.createDataFrame([(1000 + k, 0, "a")], SCHEMA))
            mine.delete(spark.createDataFrame([(k,)], "conv_id long"))
            mine.merge(spark.createDataFrame([(10 + k, 0, f"m{k}")], SCHEMA), ["conv_id", "turn"])
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    table = versioned.Table(spark, root, SCHEMA)
    got = {(r.conv_id, r.turn): r.text for r in table.read().collect()}
    assert table.version() == 3 + 12 and table.read().count() == len(got)
    assert all((1000 + k, 0) in got and (k, 0) not in got and got[10 + k, 0] == f"m{k}" for k in range(4))
    assert len(got) == 45 - 12 + 4


def test_snapshots_history_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "SNAPSHOT_EVERY", 3)
    table = filled(spark, f"{tmp_path}/t", 5)
    keys = spark.createDataFrame([(1,), (21,)], "conv_id long")
    table.delete(keys)
    assert "all" in table._entry(6) and [h["operation"] for h in table.history()] == ["append"] * 5 + ["delete"]
    want = rows(table.read())
    assert table.vacuum() == 2 and rows(table.read()) == want and table.vacuum() == 0
    assert versioned.Table(spark, f"{tmp_path}/none", SCHEMA).read().count() == 0


def test_create_is_exclusive_on_any_file_system(spark, tmp_path):
    for folder in (versioned.Folder(spark, f"file://{tmp_path}/a"), versioned.Folder(spark, f"file://{tmp_path}/b")):
        if folder.uri.endswith("b"):
            folder.local = None  # by Hadoop's file systems
            assert folder.names() == []
        assert folder.create("x", "one") and not folder.create("x", "two") and folder.text("x") == "one"
        assert [n for n in folder.names() if not n.startswith(".")] == ["x"]


def test_ranges_give_each_line_once(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab é漢\r", k=rng.randrange(30))).rstrip("\r") for _ in range(300)]
    (tmp_path / "a.txt").write_bytes("".join(t + "\n" for t in texts).encode())
    (tmp_path / "b.txt").write_bytes(b"one\r\n\n" + b"x" * 5000 + b"\nunfinished")
    (tmp_path / "_hidden").write_text("no\n")
    want = sorted([("a.txt", t) for t in texts] + [("b.txt", t) for t in ("one", "", "x" * 5000)])
    for size in (7, 100, 1 << 20):
        got = lines.lines(spark, f"file://{tmp_path}", size)
        assert sorted((r.file, r.value) for r in got.collect()) == want
    assert [r.value for r in got.filter("file = 'a.txt'").orderBy("at").collect()] == texts


def test_line_stream_goes_on_after_a_kill(spark, tmp_path):
    """Lines come once: over new files, lines completed later, a batch lost before its commit, and a stop."""
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        def sink(batch, number):
            batch.write.mode("overwrite").json(f"{tmp_path}/out/batch={number}")

        assert lines.follow(lines.line_stream(spark, f"file://{folder}", 50), sink, f"file://{tmp_path}/cp", threading.Event(), to_end=True) is False
        return sorted((r.file, r.value) for r in spark.read.json(f"{tmp_path}/out").select("file", "value").collect())

    (folder / "a").write_text("".join(f"line {k}\n" for k in range(40)) + "half")
    want = [("a", f"line {k}") for k in range(40)]
    assert run() == sorted(want)
    with (folder / "a").open("a") as f:
        f.write(" done\nlast\n")
    (folder / "b").write_text("data: [DONE]\n")
    want += [("a", "half done"), ("a", "last"), ("b", "data: [DONE]")]
    assert run() == sorted(want)
    commits = sorted((p for p in (tmp_path / "cp/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / f"cp/commits/.{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == sorted(want)  # the lost batch comes again with its number
    (folder / "c").write_text("c\n")
    assert run() == sorted([*want, ("c", "c")])


def test_a_stream_stops_when_asked(spark, tmp_path):
    folder, stop, seen = tmp_path / "in", threading.Event(), []
    folder.mkdir()
    (folder / "a").write_text("x\ny\n")

    def sink(batch, number):
        seen.append(batch.count())
        stop.set()

    assert lines.follow(lines.line_stream(spark, f"file://{folder}"), sink, f"file://{tmp_path}/cp", stop) is True
    assert seen == [2] and not spark.streams.active


def test_jsonl_in_the_order_of_files(spark, tmp_path):
    """Spark packs files by size; rows come by name and place all the same."""
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nbad {\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text("".join(f'{{"id": {k}}}\n' for k in range(3, 3000)))
    (tmp_path / "c.jsonl").write_text('{"id": 3000}')
    uri = f"file://{tmp_path}/*.jsonl"
    got = state.jsonl(spark, uri, "id long")
    assert [r.id for r in got.orderBy("file", "ord").collect()] == list(range(1, 3001))
    assert [r.id for r in state.jsonl(spark, uri, "id long", limit=3).collect()] == [3000, 2999, 2998]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [r.id for r in state.jsonl(spark, uri, "id long", limit=2900).collect()] == list(range(3000, 100, -1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_deletion_passes_over_bad_lines(tmp_path):
    named, other = json.dumps({"conversation_id": "a"}), json.dumps({"conversation_id": "b"})
    (tmp_path / "one.jsonl").write_text(f"{named}\nnot json {{\n\n[1]\n{other}\n{named}")
    (tmp_path / "two.jsonl").write_text(f"{{\n{named}\n")
    report = cleanup.delete_conversation("a", {"one": tmp_path / "one.jsonl", "two": tmp_path / "two.jsonl"}, {})
    assert report == {"one": 2, "two": 1, "conversation": 0}
    assert (tmp_path / "one.jsonl").read_text() == f"not json {{\n[1]\n{other}\n" and (tmp_path / "two.jsonl").read_text() == "{\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one.jsonl", "two.jsonl"]


def test_queue_after_crashes(tmp_path, monkeypatch):
    """A line cut off, or a crash between taking and compacting: order stays, nothing comes twice, bad lines are none."""
    path = tmp_path / "q.jsonl"
    q = refresh.PromptQueue(path)
    path.write_text('{"text": "old"}\nnoise\n3\n{"text": "  "}\n{"text": "cut')
    assert q.append("a\nb") and q.append("ü") and q.append("ü")
    assert q.texts() == ["old", "a\nb", "ü", "ü"]
    assert q.pop("ü") == "ü" and refresh.PromptQueue(path).texts() == ["old", "a\nb", "ü"] and q.pop("none") is None
    size = path.stat().st_size
    q.append("last")
    assert path.read_bytes()[:size].startswith(b'{"text": "old"}')  # appended, not rewritten
    monkeypatch.setattr(refresh.PromptQueue, "COMPACT_AT", 4)
    monkeypatch.setattr(refresh, "atomic_write", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        [q.pop() for _ in range(4)]
    left = refresh.PromptQueue(path).texts()
    monkeypatch.undo()
    assert left == ["old", "a\nb", "ü", "last"][-len(left) :] and q.clear() == len(left) and q.pop() is None


def test_refresh_knows_its_ids_by_state(spark, tmp_path):
    """Batches never read the store: what it held may be gone, and ids that did not change still make no vector."""
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("".join(json.dumps({"id": i, "text": t}) + "\n" for i, t in rows))
    made = []

    def embed(rows):
        made.extend(r.id for r in rows.select("id").collect())
        return refresh.hashed_embedding(rows)

    def run(route=None, checkpoint="cp"):
        made.clear()
        refresh.refresh(spark, f"file://{folder}", "id string, text string", f"file://{tmp_path}/store", f"file://{tmp_path}/{checkpoint}", embed, route=route).awaitTermination()
        return sorted(made)

    put("a.json", [("x", "one"), ("y", "two"), ("x", "one")])
    assert run() == ["x", "y"]
    for batch in (tmp_path / "store").glob("run=*/batch=0"):
        batch.rename(tmp_path / "away")
    put("b.json", [("x", "one"), ("y", "new"), ("z", "three")])
    assert run() == ["y", "z"]
    (tmp_path / "away").rename(next((tmp_path / "store").glob("run=*")) / "batch=0")
    assert {r.id: r.input_sha256[:8] for r in refresh.stored(spark, f"file://{tmp_path}/store").collect()} == {i: hashlib.sha256(t.encode()).hexdigest()[:8] for i, t in (("x", "one"), ("y", "new"), ("z", "three"))}
    put("c.json", [("x", "one"), ("y", "new")])
    assert run(refresh.Route(schema="text-v2")) == ["x", "y"]  # another schema: another vector
    # A lost checkpoint begins a run of its own; no folder of the one before is touched.
    assert run(checkpoint="other") == ["x", "y", "z"]
    assert len(list((tmp_path / "store").glob("run=*"))) == 2 and refresh.stored(spark, f"file://{tmp_path}/store").count() == 3


def test_memories_of_files_in_blocks(spark, tmp_path):
    """A place beyond a file's first block is no int: rows without an id are named all the same, each by its own place."""
    (tmp_path / "a.jsonl").write_text("".join(f'{{"text": "t{k}", "importance": "{k}"}}\n' for k in range(1, 3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = memory.load(spark, f"file://{tmp_path}/a.jsonl", None).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.text for r in rows] == [f"t{k}" for k in range(1, 3000)]
    assert [r.id for r in rows] == [f"legacy-{r.ord:04d}" for r in rows] and len({r.id for r in rows}) == 2999 and rows[-1].ord >= 1 << 31
