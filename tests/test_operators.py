"""Operators against plain Python, and the traps of order, rounding and Unicode."""

import json
import math
import threading
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.functions import text as T
from corvana.operators import audit, code, fusion, lexical, memory, similarity, spans, vectors
from corvana.plans import planner, retrieval
from corvana.sources import state
from corvana.streaming import refresh


def plain_score(query: str, text: str) -> int:
    terms, words = lexical.query_terms(query), list(lexical.query_terms(text).elements())
    import re

    words = re.findall(T.WORD, text.lower())
    if not words or not terms:
        return 0
    counts, total = Counter(words), 0.0
    for t, c in terms.items():
        n = counts.get(t, 0)
        if n:
            total += (1.15 if len(t) >= 7 else 1.0) * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / 400))) * min(c, 2)
    names, joined = list(terms), " ".join(words)
    total += sum(0.5 for a, b in zip(names, names[1:]) if f"{a} {b}" in joined)
    return int(round(total * 10))


TEXTS = ["the art show was smart showing arts", "", None, "naïve café café", "deadline deadline deadline report of the quarter's deadline", "it's a-b c_d e'f", "the the the", "a b"]


@pytest.mark.parametrize("query", ["art show", "deadline report", "the the quarter's", "zzz", "", "café c_d"])
def test_score(spark, query):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: r.score for r in lexical.with_score(rows, query, F.col("text")).collect()}
    assert got == {k: plain_score(query, t or "") for k, t in enumerate(TEXTS)}


def test_rounding_is_half_to_even(spark):
    assert [r.x for r in spark.sql("SELECT bround(v) AS x FROM VALUES (2.5D), (3.5D), (0.5D) AS t(v)").collect()] == [2.0, 4.0, 0.0]


def test_unicode_space_and_code_points(spark):
    row = spark.createDataFrame([("  a\xa0 b😀  ",)], "t string").select(T.collapse(F.col("t")).alias("c"), F.length("t").alias("n")).first()
    assert (row.c, row.n) == ("a b😀", 9)


def test_compact(spark):
    frame = spark.createDataFrame([("one two three four five six",)], "t string")
    row = frame.select(T.compact(F.col("t"), 10).alias("a"), T.compact_middle(F.col("t"), 15).alias("b"), T.compact_middle(F.col("t"), 9).alias("c")).first()
    assert (row.a, row.b, row.c) == ("one two t…", "one t ... e six", "one two t")


def test_path_boost(spark):
    row = spark.range(1).select(*(T.path_boost(F.lit("see a/b.py, B.PY and x.c"), F.lit(p)).alias(f"c{k}") for k, p in enumerate(("a/b.py", "z/a/b.py", "q/b.py", "q/x.cpp", ""))))
    assert list(row.first()) == [2500 + 2500, 2500 + 2500, 2000 + 2500, 1200, 0]


def brute_sections(content: str) -> list[tuple[int, int]]:
    import re

    heads, at = [], 0
    for line in content.splitlines(keepends=True):
        m = re.match(r"^(\*+)\s+(.*)$", line.rstrip())
        if m:
            heads.append((at, len(m[1])))
        at += len(line)
    return [(a, next((b for b, m in heads[k + 1 :] if m <= n), len(content))) for k, (a, n) in enumerate(heads)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["* a\n", "** b\n", "*** c\n", "text\n", "\x0b", "* d ", ""]), max_size=12))
def test_sections(parts):
    content = "".join(parts)
    assert [(a, b) for a, b, *_ in spans.sections(content, spans.ORG)] == brute_sections(content)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0x100, 0x4E00, 0x1F300]), max_size=200), st.integers(4, 80))
def test_byte_parts(bases, budget):
    text = "".join(chr(b + k) for k, b in enumerate(bases))  # every character once
    at = 0
    for p in vectors.byte_parts(text, budget):
        assert len(p.encode()) <= budget and text.index(p) <= at
        at = max(at, text.index(p) + len(p))
    assert at == len(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=4000), st.integers(240, 900))
def test_windows_cover(content, size):
    found = spans.windows(content, size)
    assert bool(found) == bool(content.strip())
    assert all(0 <= s["start"] < s["end"] <= len(content) for s in found)
    if found:
        assert found[-1]["end"] == len(content)


def test_select_non_overlapping(spark):
    rows = [(1, [(0, 10, "x" * 10), (5, 12, "y" * 7), (20, 30, "z" * 10), (40, 45, ""), (50, 100, "w" * 50)])]
    frame = spark.createDataFrame(rows, "id int, s array<struct<start:int,end:int,text:string>>")
    got = frame.select(spans.select_non_overlapping(F.col("s"), 30).alias("s")).first().s
    assert [(s.start, s.end) for s in got] == [(0, 10), (20, 30)]
    long = frame.select(spans.select_non_overlapping(F.slice(F.col("s"), 5, 1), 30).alias("s")).first().s
    assert len(long) == 1 and len(long[0].text) <= 30


def test_fusion_takes_the_best_of_lanes(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "path string, chunk int, score double")
    fused = fusion.fuse([fusion.lane(rows(("a", 1, 5.0), ("a", 1, 7.0)), "lexical", path_boost=F.lit(2500.0)), fusion.lane(rows(("a", 1, 9.0), ("b", 2, 4.0)), "temporal", date=F.lit("2024-01-01"))])
    got = {r.path: r for r in fused.collect()}
    assert (got["a"].methods, got["a"].base, got["a"].guard) == (["lexical", "temporal"], 9.0, 2000.0)
    assert {r.path for r in fusion.restrict(fused).collect()} == {"a", "b"}
    ranked = fusion.rerank(fused, None, 5)
    chosen = fusion.select_required(ranked, 1, ["2024-01-01", "1999-01-01"]).collect()
    assert [r.path for r in chosen] == ["a"]


def test_empty_lanes(spark):
    empty = spark.createDataFrame([], "path string, chunk string, summary string, content string")
    assert retrieval.retrieve(empty, "where is function parse in a.py last two days").count() == 0


def test_retrieve_finds_the_dated_section(spark):
    rows = [("n.org", "1", "notes", "* [2024-05-01] one\nalpha beta\n* [2024-05-02] two\ngamma"), ("m.org", "1", "other", "alpha alpha alpha")]
    frame = spark.createDataFrame(rows, "path string, chunk string, summary string, content string")
    got = retrieval.retrieve(frame, "alpha in n.org on 2024-05-02").collect()
    assert [(r.path, r.methods) for r in got] == [("n.org", ["lexical", "temporal"])]


def test_memory_backfill(spark):
    rows = [(k, f"m{k}", "", "s", "alpha" if k == 3 else f"word{k}", 3, False, [], 1) for k in range(9)]
    frame = spark.createDataFrame(rows, "ord long, id string, created string, source string, text string, importance int, pinned boolean, tags array<string>, seen_count int")
    got = [r.id for r in memory.rank(frame, "alpha", 8).orderBy("place").collect()]
    assert got == ["m3", "m8", "m7", "m6", "m5", "m4"]


def test_similar_memory_first_wins_ties(spark):
    texts = spark.createDataFrame([(1, "one two three")], "id int, text string")
    rows = spark.createDataFrame([(7, 0, "one two three"), (8, 1, "one two three"), (9, 2, "four")], "id int, ord int, text string")
    assert [tuple(r) for r in memory.most_similar(texts, rows).collect()] == [(1, 7, 1.0)]


def test_evict_keeps_the_protected(spark):
    rows = spark.createDataFrame([("c", k, 10, f"2024-01-0{k}") for k in range(1, 6)], "cache string, id int, bytes int, last_used string")
    kept = audit.evict(rows, 25, ["cache"], protected=F.col("id") == 1).filter("stays").collect()
    assert {r.id for r in kept} == {1, 5}


def test_jsonl_and_current(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnope\n[1]\n3\n{"id": 2, "x": 5}\n')
    rows = state.jsonl(spark, f"file://{tmp_path}/a.jsonl", "id long")
    assert [r.id for r in rows.orderBy("ord").collect()] == [1, 2]
    assert state.jsonl(spark, f"file://{tmp_path}/missing.jsonl", "id long").count() == 0
    for n in (1, 2):
        state.replace_table(spark.range(n), f"file://{tmp_path}/t")
        assert state.read_current(spark, f"file://{tmp_path}/t").count() == n
    with state.exclusive_lock(tmp_path / "lock"):
        with pytest.raises(state.LockBusy), state.exclusive_lock(tmp_path / "lock", blocking=False):
            pass


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("héllo\n")
    (tmp_path / "d/b.bin").write_bytes(b"\x00\x01\x02" * 50)
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\xfa" * 50)
    assert {r.path.rsplit("/", 1)[1] for r in state.file_texts(spark, f"file://{tmp_path}").collect()} == {"a.txt"}
    assert state.files(spark, f"file://{tmp_path}", "b.bin").first().size == 150


def test_ignore_rules():
    with pytest.raises(R.NegatedRule):
        R.parse_ignore("a\n!b")
    assert [r.line for r in R.parse_ignore("# x\n\n/a\nb/\n")] == [3, 4]


def test_json_strings_with_quotes(spark):
    tree = json.dumps({"a": [{"index_ids": ['i"1', "i2"]}, {"index": "i3", "note": "index_ids"}]})
    row = spark.createDataFrame([(tree,)], "j string").select(*(R.references(F.col("j"), R.INDEX, v).alias(f"x{k}") for k, v in enumerate(('i"1', "i2", "i3", "index_ids", "")))).first()
    assert tuple(row) == (True, True, True, False, False)


def test_json_references_of_every_form():
    assert R.named({"index": {"id": 7}, "source_conversations": [{"id": "c"}, "d"], "conversation_id": 5, "conversation": "no"}) == {("index", "7"), ("conversation", "c"), ("conversation", "5")}
    assert R.named([{"context_items": [{"kind": "index", "id": "i"}, {"kind": "file", "id": "j"}]}]) == {("index", "i"), ("link-index", "i")}
    assert R.named({"kind": "topic", "id": "t", "dossiers": ["d", {"id": "e"}, 3]}) == {("link-topic", "t"), ("link-dossier", "d"), ("link-dossier", "e")}
    deep = {"index_id": "x"}
    for _ in range(5000):
        deep = [deep]
    assert ("index", "x") in R.named(deep)


def test_planner():
    plan = planner.build_plan("last 9 days of a.org, priority b, tagged work, DEADLINE items")
    assert (plan.recent, plan.paths, plan.priorities, plan.tags) == (7, ["a.org"], ["B"], ["work"])
    assert plan.has("structural") and plan.has("temporal")


def test_dense_normalize(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(vectors.dense_normalize(F.col("a")).alias("a"), vectors.dense_normalize(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == ([0.6, 0.8], [])


def test_code_rows_of_bad_source(spark):
    rows = code.source_rows("x.py", "def (")
    assert rows[0][1] == "error" and code.source_rows("y.py", None)[0][1] == "module"


def test_supervisor(spark):
    supervisor, seen = refresh.Supervisor(spark), threading.Event()

    def wait(job):
        seen.set()
        while True:
            refresh.raise_if_cancelled(job)
            job.cancel.wait(0.05)

    job = supervisor.start("study", "bg", "a", wait)
    assert seen.wait(5) and supervisor.snapshots()[0]["status"] == "running"
    assert supervisor.request_stop_by_kind("study") == 1
    for _ in range(100):
        if job.status != "running":
            break
        threading.Event().wait(0.05)
    assert job.status == "cancelled" and not supervisor.request_stop(job.id)


def test_maintenance_and_queue(tmp_path):
    m = refresh.Maintenance(tmp_path / "m.json")
    m.begin("c1")
    assert m.resume("c1") and m.resume("c1") and not m.resume("c1") and m.read()["status"] == "abandoned"
    q = refresh.PromptQueue(tmp_path / "q.jsonl")
    assert q.append("a") and q.append("b") and not q.append(" ") and q.pop("b") == "b" and q.pop() == "a" and q.pop() is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "t", float(h)) for h in range(5)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = refresh.activity(stream).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(map(tuple, spark.table("act").collect())) == sorted(map(tuple, refresh.activity(rows).collect()))


def test_sse():
    assert refresh.sse_line('data: {"choices": [{"delta": {"content": "x"}}]}') == (False, "x", "")
    assert refresh.sse_line("data: [DONE]") == (True, "", "") and refresh.sse_line(": ping") == (False, "", "")
    assert not math.isnan(0.0)


def test_best_content(spark):
    text = "* [2024-05-01] one\nalpha\n* [2024-05-02] two\nbeta\n* [2024-05-03] three\ngamma" + "\nfiller words here" * 40
    frame = spark.createDataFrame([(text,), ("short",), ("",)], "t string")
    got = [[r.x for r in spans.with_best_content(frame, "t", q, 60, "x").collect()] for q in ("what on 2024-05-02", "last one day", "gamma", "none")]
    assert got[0][0] == "* [2024-05-02] two\nbeta" and got[1][0].startswith("* [2024-05-03]") and "gamma" in got[2][0]
    assert all(len(x) <= 60 for g in got for x in g) and [g[1:] for g in got] == [["short", ""]] * 4


def test_subspans(spark):
    frame = spark.createDataFrame([("a", 10, "0123456789" * 5), ("b", 3, "xyz")], "id string, start int, text string")
    got = sorted((r.id, r.part, r.parent_start, r.start, r.end, r.text) for r in spans.subspans(frame, 20, 3).collect())
    assert got[-1] == ("b", 0, 3, 3, 6, "xyz") and [g[1:5] for g in got[:3]] == [(0, 10, 10, 30), (1, 10, 25, 45), (2, 10, 40, 60)]
    assert got[2][5] == ("0123456789" * 5)[-20:]


def test_refresh_keeps_vectors_when_a_batch_runs_again(spark, tmp_path):
    """The driver died between a batch's write and its commit: every vector is there once, after that and a further run."""
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        refresh.refresh(spark, f"file://{folder}", "id string, text string", f"file://{tmp_path}/store", f"file://{tmp_path}/cp", refresh.hashed_embedding, files_per_batch=1).awaitTermination()
        return sorted((r.id, r.n) for r in spark.read.parquet(f"file://{tmp_path}/store").groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect())

    lines = lambda a, b: "".join(json.dumps({"id": f"d{k}", "text": f"some words of text {k}"}) + "\n" for k in range(a, b))
    (folder / "a.json").write_text(lines(0, 10))
    (folder / "b.json").write_text(lines(10, 20))
    every = [(f"d{k}", 1) for k in range(20)]
    assert run() == sorted(every)
    for _ in range(2):
        commits = sorted((p for p in (tmp_path / "cp/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        commits[-1].unlink()
        (tmp_path / f"cp/commits/.{commits[-1].name}.crc").unlink(missing_ok=True)
        assert run() == sorted(every)
    (folder / "c.json").write_text(lines(15, 22))
    assert run() == sorted([*every, ("d20", 1), ("d21", 1)])


def test_similarity_joins_equal_all_pairs(spark):
    """Prefix-filtered joins against every pair, with words that all rows have, empty rows and repeated texts."""
    import random

    rng = random.Random(3)
    pool = [f"w{k}" for k in range(25)]
    make = lambda n: [(k, ["common", *rng.choices(pool, k=rng.randint(0, 9), weights=[30 - j for j in range(25)])] if k % 11 else []) for k in range(n)]
    left, right = [(k, sorted(set(w))) for k, w in make(60)], [(k, sorted(set(w))) for k, w in make(50)]
    x, y = spark.createDataFrame(left, "id long, words array<string>"), spark.createDataFrame([(k, 50 - k, w) for k, w in right], "id long, ord long, words array<string>")
    for t in (0.5, 0.72, 1.0):
        got = {(r.a, r.b): r.overlap for r in similarity.overlapping(x, y.drop("ord"), t).collect()}
        want = {(a, b): len(set(u) & set(v)) / min(len(u), len(v)) for a, u in left for b, v in right if u and v and len(set(u) & set(v)) / min(len(u), len(v)) >= t}
        assert got == want
    for least in (1, 2, 4):
        got = {(r.a, r.b): r.shared for r in similarity.sharing(x, least).collect()}
        assert got == {(a, b): len(set(u) & set(v)) for a, u in left for b, v in left if a < b and len(set(u) & set(v)) >= least}
    got = {(r.a, r.b): r.shared for r in similarity.first_sharing(x, y, 3).collect()}
    want = {}
    for a, u in left:
        for b, v in sorted((r for r in right if set(u) & set(r[1])), key=lambda r: 50 - r[0])[:3]:
            want[a, b] = sorted(set(u) & set(v))
    assert got == want


def test_windows_beyond_the_cap():
    text = "word " * 20000
    few, every = spans.windows(text, 600), spans.windows(text, 600, None)
    assert len(few) == 33 and few[-1]["label"].startswith("tail") and len(every) > 200 and every[-1]["end"] >= len(text) - 1
    assert every[:32] == few[:32]
