"""What source changes and deleted conversations mean for derived artifacts: records of all families, plans, reports, guarded clean-up."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.operators import lifecycle

DERIVED = "delete-derived"


@dataclass(frozen=True)
class Family:
    """Artifacts of one kind: trees (file, json); a ledger's lines count as one record of its file."""

    kind: str
    policy: str
    trees: DataFrame
    ledger: bool = False


def collect(families: list[Family], index_id: str, source_paths: list[str]) -> DataFrame:
    """Records of all families that name an index or mention one of its sources."""
    one = lambda f: (lifecycle.ledger_record if f.ledger else lifecycle.artifact_records)(f.trees, f.kind, f.policy or "manual-review", index_id, source_paths)
    columns = ["cleanup_policy", "artifact_kind", "artifact_id", "by_index", "source_paths", "row_count", "bytes_estimate"]
    return reduce(DataFrame.unionByName, (one(f).select(F.col("artifact_id").cast("string").alias("artifact_id"), *(c for c in columns if c != "artifact_id")) for f in families)).select(columns)


def path_keys(files: DataFrame) -> DataFrame:
    """index_id, path: the distinct forms of the paths of each index's files (index_id, path, and resolved, if known)."""
    resolved = F.col("resolved") if "resolved" in files.columns else None
    return files.select("index_id", F.explode(lifecycle.path_variants(F.col("path"), resolved)).alias("path")).distinct()


def cleanup_plans(states: DataFrame, records: DataFrame, replacements: DataFrame) -> DataFrame:
    """A plan for each index: status, action, whether it may be applied and why not, counts and bytes by policy.

    states: index_id, path, status; records: index_id, cleanup_policy, bytes_estimate;
    replacements: index_id, replacement_id, ready.
    """
    counted = states.groupBy("index_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("changed", "deleted", "ignored")), F.count_if(F.coalesce("status", F.lit("unknown")) != "fresh").alias("source_count"))
    derived = F.coalesce(F.nullif("cleanup_policy", F.lit("")), F.lit("manual-review")) == DERIVED
    size = F.coalesce("bytes_estimate", F.lit(0))
    held = records.groupBy("index_id").agg(F.count_if(derived).alias("derived_artifacts"), F.count_if(~derived).alias("manual_artifacts"), F.sum(F.when(derived, size).otherwise(0)).alias("derived_bytes"), F.sum(F.when(derived, 0).otherwise(size)).alias("manual_bytes"))
    whole = counted.join(held, "index_id", "left").join(replacements, "index_id", "left").fillna(0, ["derived_artifacts", "manual_artifacts", "derived_bytes", "manual_bytes"])
    ready = F.coalesce("ready", F.lit(False))
    state = (
        F.when(F.col("source_count") == 0, _state("fresh", "keep-derived-artifacts", "no-op"))
        .when((F.col("changed") > 0) & ~ready, _state("needs-rebuild", "rebuild-index-and-refresh-derived-artifacts", "blocked"))
        .when(~ready, _state("detached-source-work", "rebuild-index-before-cleanup", "blocked"))
        .otherwise(_state("cleanup-ready", "clean-superseded-derived-artifacts", "ready"))
    )
    return whole.withColumn("_s", state).select("index_id", "_s.*", F.coalesce("replacement_id", F.lit("")).alias("replacement_id"), ready.alias("replacement_ready"), "changed", "deleted", "ignored", "source_count", "derived_artifacts", "manual_artifacts", "derived_bytes", "manual_bytes")


def _state(status: str, action: str, apply: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(action).alias("recommended_action"), F.lit(apply).alias("apply_status"))


def plan_summaries(plans: DataFrame, indexes: DataFrame) -> DataFrame:
    """Plans that need work, with name and root of the index: the rows of a storage audit."""
    kept = ["recommended_action", "apply_status", "replacement_id", "replacement_ready", "derived_artifacts", "manual_artifacts", "derived_bytes", "manual_bytes"]
    return plans.filter("status <> 'fresh'").join(indexes.select("index_id", "name", "root"), "index_id").select("index_id", "name", "root", *kept)


def storage_sections(superseded: DataFrame, partials: DataFrame, orphans: DataFrame, older: DataFrame, missing: DataFrame, plans: DataFrame) -> DataFrame:
    """kind, n, bytes, safety of what may be cleaned and what must not yet be; kinds without any have no row.

    superseded, partials, orphans: bytes; the others count as rows. Older indexes that are superseded are no block.
    """
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.coalesce(F.sum("bytes") if "bytes" in rows.columns else F.sum(F.lit(0)), F.lit(0)).cast("long").alias(f"b_{name}"))
    sides = {"superseded": superseded, "partials": partials, "orphans": orphans, "older": older, "missing": missing, "plans": plans}
    whole = reduce(lambda a, b: a.join(F.broadcast(b)), (one(rows, name) for name, rows in sides.items()))  # one row each
    row = lambda kind, n, size, safety: F.struct(F.lit(kind).alias("kind"), n.alias("n"), size.alias("bytes"), F.lit(safety).alias("safety"))
    none = F.lit(None).cast("long")
    sections = F.array(
        row("stale-superseded-indexes", F.col("n_superseded"), F.col("b_superseded"), "candidate"),
        row("superseded-partials", F.col("n_partials"), F.col("b_partials"), "candidate"),
        row("orphan-chunk-files", F.col("n_orphans"), F.col("b_orphans"), "candidate"),
        row("older-complete-indexes", F.greatest(F.lit(0), F.col("n_older") - F.col("n_superseded")), none, "blocked"),
        row("missing-duplicate-targets", F.col("n_missing"), none, "repair-first"),
        row("source-lifecycle-work", F.col("n_plans"), none, "rebuild-first"),
    )
    return whole.select(F.explode(F.filter(sections, lambda s: s["n"] > 0)).alias("s")).select("s.*")


class Refused(RuntimeError):
    """A clean-up was asked for without consent."""


def apply_plan(plan: Row, delete: Callable[[str], dict] | None, apply: bool = False, consent: bool = False) -> dict:
    """What became of a plan: a dry run, blocked, or the snapshot's deletion; artifacts for manual review stay."""
    report = {"index_id": plan["index_id"], "dry_run": not apply, "plan": plan.asDict(), "applied": None}
    if not apply:
        return report
    if not consent:
        raise Refused(f"clean-up of {plan['index_id']} needs consent")
    if plan["apply_status"] != "ready" or delete is None:
        return {**report, "applied": {"status": "blocked", "reason": plan["status"] if plan["apply_status"] != "ready" else "no way to delete"}}
    return {**report, "applied": {"status": "deleted", "deleted": delete(plan["index_id"]), "manual_review_kept": plan["manual_artifacts"]}}


# Conversations


def cascade(families: list[Family], conversation_id: str) -> DataFrame:
    """kind, n: rows of ledgers and files of trees that go with a conversation, 0 for a family without any."""
    if not conversation_id:
        return families[0].trees.sparkSession.createDataFrame([(f.kind, 0) for f in families], "kind string, n long")
    return reduce(DataFrame.unionByName, (lifecycle.referencing(f.trees, R.CONVERSATION, conversation_id).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f.kind).alias("kind"), "n") for f in families))


def rewrite_without(path: Path, conversation_id: str) -> int:
    """Rows of a JSON-lines file that named a conversation and are gone; a file without any other row goes too.

    The file is read and written line by line. Lines that are no JSON name nothing and stay as they are.
    """
    gone = kept = 0
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        with path.open("rb") as lines, part.open("wb") as out:
            for line in lines:
                if not line.strip():
                    continue
                try:
                    named = (R.CONVERSATION, conversation_id) in R.named(json.loads(line))
                except ValueError:
                    named = False
                if named:
                    gone += 1
                else:
                    kept += 1
                    out.write(line)
        if gone and kept:
            os.replace(part, path)
        elif gone:
            path.unlink(missing_ok=True)
    except FileNotFoundError:
        return 0
    finally:
        part.unlink(missing_ok=True)
    return gone


def delete_naming(folder: Path, role: str, value: str) -> int:
    """JSON files of a folder that named a conversation or an index and are gone; one that cannot be read stays."""
    gone = 0
    for path in sorted(folder.glob("*.json")):
        try:
            tree = json.loads(path.read_text())
        except (OSError, ValueError):
            continue
        if value and (role, value) in R.named(tree):
            path.unlink(missing_ok=True)
            gone += 1
    return gone


def delete_conversation(conversation_id: str, ledgers: dict[str, Path], folders: dict[str, Path], files: Iterable[Path] = ()) -> dict[str, int]:
    """What went with a conversation, by family; its own files last. Nothing goes with the empty id."""
    report = dict.fromkeys([*ledgers, *folders, "conversation"], 0)
    if not conversation_id:
        return report
    for kind, path in ledgers.items():
        report[kind] = rewrite_without(path, conversation_id)
    for kind, folder in folders.items():
        report[kind] = delete_naming(folder, R.CONVERSATION, conversation_id)
    for path in files:
        if path.exists():
            path.unlink()
            report["conversation"] += 1
    return report
