"""Clean-up, stores, suggestions and code sets against plain Python; what has side effects on files."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import cleanup, code, grounding, skills, stores
from corvana.plans.report_queries import QUERIES
from corvana.streaming import refresh


def test_conversation_goes_with_its_artifacts(tmp_path):
    rows = [{"conversation_id": "a", "n": 1}, {"note": "a"}, {"source_conversations": [{"id": "a"}]}, {"conversation_id": "b"}]
    (tmp_path / "log.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "own.jsonl").write_text(json.dumps(rows[0]) + "\n")
    (tmp_path / "d").mkdir()
    for name, tree in {"x": rows[0], "y": rows[1], "z": [rows[2]]}.items():
        (tmp_path / f"d/{name}.json").write_text(json.dumps(tree))
    (tmp_path / "d/bad.json").write_text("{")
    (tmp_path / "a.json").write_text("{}")
    ledgers = {"log": tmp_path / "log.jsonl", "own": tmp_path / "own.jsonl", "none": tmp_path / "no.jsonl"}
    assert set(cleanup.delete_conversation("", ledgers, {"d": tmp_path / "d"}).values()) == {0}
    report = cleanup.delete_conversation("a", ledgers, {"d": tmp_path / "d"}, [tmp_path / "a.json"])
    assert report == {"log": 2, "own": 1, "none": 0, "d": 2, "conversation": 1}
    assert [json.loads(x) for x in (tmp_path / "log.jsonl").read_text().splitlines()] == [rows[1], rows[3]]
    assert not (tmp_path / "own.jsonl").exists() and sorted(p.name for p in (tmp_path / "d").iterdir()) == ["bad.json", "y.json"]
    assert set(cleanup.delete_conversation("a", ledgers, {"d": tmp_path / "d"}).values()) == {0}


def test_guarded_apply(spark):
    states = spark.createDataFrame([("i1", "p", "deleted"), ("i2", "q", "changed")], "index_id string, path string, status string")
    records = spark.createDataFrame([("i1", "delete-derived", 5), ("i1", None, 7)], "index_id string, cleanup_policy string, bytes_estimate long")
    ready = spark.createDataFrame([("i1", "n1", True)], "index_id string, replacement_id string, ready boolean")
    plans = {r.index_id: r for r in cleanup.cleanup_plans(states, records, ready).collect()}
    gone = []
    drop = lambda i: gone.append(i) or {"files": 1}
    assert cleanup.apply_plan(plans["i1"], drop)["applied"] is None and not gone
    with pytest.raises(cleanup.Refused):
        cleanup.apply_plan(plans["i1"], drop, apply=True)
    assert cleanup.apply_plan(plans["i2"], drop, apply=True, consent=True)["applied"]["status"] == "blocked" and not gone
    done = cleanup.apply_plan(plans["i1"], drop, apply=True, consent=True)["applied"]
    assert done == {"status": "deleted", "deleted": {"files": 1}, "manual_review_kept": 1} and gone == ["i1"]


def test_batch_plan():
    assert stores.batch_plan(1000, 64, 4) == (64, 4) and stores.batch_plan(100, 64, 4) == (25, 4)
    assert stores.batch_plan(100, 64, 4, failures=1) == (50, 2) and stores.batch_plan(100, 64, 4, failures=9) == (64, 1)
    assert stores.batch_plan(10_000, 64, 500) == (64, 32) and stores.batch_plan(0, 64, 4) == (64, 4)


def test_registry_and_time():
    assert skills.handler("temporal") == "temporal" and skills.handler("no such") == skills.handler(None) == "prompt-only"
    assert skills.effects("code-intelligence, x", "codebase") == ["code-intelligence"] and skills.effects(["x"], "structural") == list(skills.HANDLERS["structural"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d", T.now())


def test_lines_stop_when_a_job_is_asked_to():
    import io

    job = refresh.Job("j", "k", "l", "m")
    lines = refresh.cancellable_lines(io.BytesIO(b"a\nb\nc\n"), job)
    assert next(lines) == b"a\n"
    job.cancel.set()
    with pytest.raises(refresh.Cancelled):
        next(lines)
    assert list(refresh.cancellable_lines([b"x"], refresh.Job("j", "k", "l", "m"))) == [b"x"]


def test_suggestions_in_plain_python(spark, tmp_path):
    bodies = ["alpha beta gamma delta", "alpha beta other", "zeta " * 700, "unique words here", "alpha beta again", None]
    spark.createDataFrame(list(enumerate(bodies)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "something of alpha"), (2, 0, "user", "alpha"), (3, 0, "user", "unique here"), (5, 0, "user", "nothing")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.rule, r.slug, r.signal) for r in QUERIES["skill_suggestions"](spark, str(tmp_path)).orderBy("place").collect()]
    # Selected three times and never patched: 4 has four uses and no patch (3 is pinned); 2 is the long body; 4 was made on 2024-01-05, 2 on 2024-01-03.
    assert got[:2] == [("1-feedback", "skill-0000", "000001-000"), ("1-feedback", "skill-0003", "000003-000")]
    assert ("2-usage", "skill-0004", "4") in got and ("3-support-file", "skill-0002", "3500") in got
    assert [(r, s) for r, s, _ in got if r == "4-consolidation"] == [("4-consolidation", "skill-0000"), ("4-consolidation", "skill-0001")]
    assert all(s != "skill-0003" for r, s, _ in got if r in ("2-usage", "3-support-file", "5-archive"))


SOURCE = '''"""Clean up."""
DERIVED_JSONL_ARTIFACT_FAMILIES = [{"path_key": "topics", "artifact_kind": "topic", "cleanup_policy": "delete-derived"}, 3]
LIMIT = 3

def sweep(job):
    """Stop and clean."""
    raise_if_cancelled(job)
    delete_files({})

def test_sweep():
    assert sweep(None) == "expected_marker"

parser.add_parser("sweep")
'''


def test_code_sets(spark):
    files = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def (")], "path string, content string")
    rows = code.code_rows(files)
    family = json.loads(rows.filter("kind = 'family'").first().detail)
    assert family == {"family_kind": "derived-jsonl-ledger", "storage": "jsonl-ledger", "path_key": "topics", "artifact_kind": "topic", "cleanup_policy": "delete-derived", "report_label": ""}
    roles = {(r.role, r.caller, tuple(r.helpers)) for r in code.role_paths(rows).collect()}
    assert roles == {("cancellation", "sweep", ("raise_if_cancelled",)), ("artifact_lifecycle", "sweep", ("delete_files",))}
    (test,) = code.test_rows(rows, files).collect()
    assert test.name == "test_sweep" and "expected_marker" in test.tokens and "raise_if_cancelled" not in test.tokens
    found = {}
    for r in code.query(code.search_sets(rows), "where is sweep of topics", 5).orderBy("set", "place").collect():
        found.setdefault(r.set, []).append((r.name, r.score))
    assert found["symbols"][0] == ("sweep", 60) and found["commands"] == [("sweep", 60)] and found["artifact_families"] == [("topics", 60)]
    assert found["tests"] == [("test_sweep", 60)] and found["call_edges"] == [("sweep", 60)] and found["cancellation_paths"] == [("sweep", 60)]
    checks = {r.name: r.passed for r in grounding.code_checks(rows).collect()}
    assert checks == {"parses": False, "modules": True, "commands": True, "handlers": False}
    assert code.validation_gates(spark).orderBy("ord").first().name == "syntax"


def test_reduction_keeps_order(spark):
    rows = spark.createDataFrame([(k % 3, k, f"t{k}") for k in range(50)], "k long, n long, text string")
    got = {r.k: r.text for r in stores.reduced(rows, "k", "n", "text", 4, lambda a: F.array_join(a, " ")).collect()}
    assert got == {m: " ".join(f"t{k}" for k in range(50) if k % 3 == m) for m in range(3)}
    assert stores.reduced(rows.limit(0), "k", "n", "text", 4, lambda a: F.array_join(a, " ")).count() == 0
