"""Lifecycle, dossiers and services beyond what the catalogue covers."""

import pytest
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.operators import dossiers, lifecycle, services


def test_schema():
    schema = services.check_schema({"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"type": "string", "enum": ["x"]}}})
    services.check_arguments({"a": [1, 2], "b": "x"}, schema)
    for bad in ({}, {"a": [True]}, {"a": ["1"]}, {"a": [], "c": 1}, {"a": [], "b": "y"}, []):
        with pytest.raises(services.SchemaError):
            services.check_arguments(bad, schema)
    for bad in ({}, {"type": "date"}, {"type": "object", "$ref": "x"}, {"type": "array", "items": {}}):
        with pytest.raises(services.SchemaError):
            services.check_schema(bad)


def test_deleting(tmp_path, spark):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text("xyz")
    families = {"topics": [f"file://{tmp_path}/a", str(tmp_path / "gone")], "evals": []}
    report = lifecycle.delete_files(families)
    assert (report.deleted, report.bytes, (tmp_path / "a").exists()) == ({"topics": 1, "evals": 0}, 3, True)
    assert lifecycle.delete_files(families, dry_run=False).deleted["topics"] == 1 and not (tmp_path / "a").exists()
    rows = spark.createDataFrame([("b", "delete"), ("c", "delete"), ("d", "block"), ("e", "keep")], "id string, decision string")
    report = lifecycle.cleanup_superseded(rows, lambda i: {"x": [str(tmp_path / i)]}, limit=1, dry_run=False)
    assert (report.deleted, report.blocked, (tmp_path / "b").exists(), (tmp_path / "c").exists()) == ({"x": 1}, ["d"], False, True)


def test_index_candidates(spark):
    rows = [("/r/a.txt", b"text"), ("/r/b.log", b"text"), ("/r/build/c.txt", b"text"), ("/r/d.bin", b"\x00\x01"), ("/other/e.txt", b"text")]
    good, ignored = lifecycle.index_candidates(spark.createDataFrame(rows, "path string, content binary"), "/r", R.parse_ignore("*.log\nbuild/"))
    assert [r.path for r in good.collect()] == ["/r/a.txt"]
    assert {(r.rule, r.n, tuple(r.examples)) for r in ignored.collect()} == {(1, 1, ("/r/b.log",)), (2, 1, ("/r/build/c.txt",))}


def test_policy(spark):
    rules = R.parse_ignore("*.log")
    one = lifecycle.policy_fingerprint("/r", "*", rules)
    assert one != lifecycle.policy_fingerprint("/r", "*", []) and len(one) == 64
    rows = spark.createDataFrame([("", 0), (one, 0), (one, 1), ("x", 0)], "stored string, excluded int")
    got = [r.s for r in rows.select(lifecycle.policy_staleness(F.col("stored"), one, F.col("excluded")).alias("s")).collect()]
    assert got == ["unknown", "fresh", "stale", "stale"]


def test_progress(spark):
    key = {"schema": "v1", "dims": 4, "model": None}
    assert services.progress_id(key) == services.progress_id(dict(reversed(key.items())))
    rows = spark.createDataFrame([("v1", 4, None), ("v1", 5, None), ("v1", 4, "m")], "schema string, dims int, model string")
    assert [r.m for r in rows.select(services.progress_matches(rows, key).alias("m")).collect()] == [True, False, False]


def test_diagnosis_and_label(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0.0, 0), (2, 5, 0, 3.0, 1), (2, 5, 1, 3.0, 0)], "files int, chunks int, selected int, best_score double, warnings int")
    assert [len(r.notes) for r in dossiers.diagnosis(rows).collect()] == [1, 2, 0]
    label = spark.range(1).select(dossiers.source_label(F.lit("chunk"), F.lit("x"), F.lit(3), F.lit(9)).alias("l")).first().l
    assert label == "chunk x chars 3-9"
