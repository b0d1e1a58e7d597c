"""References of derived artifacts to indexes, conversations and sources; what may be deleted, and deleting it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.functions import text as T


def referencing(trees: DataFrame, role: str, value: str) -> DataFrame:
    """Rows (file, json) whose tree names an index or a conversation (role)."""
    return trees.filter(R.references(F.col("json"), role, value))


def without(rows: DataFrame, role: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with the number removed) of rows with a column json."""
    marked = rows.withColumn("_named", R.references(F.col("json"), role, value))
    return marked.filter("NOT _named").drop("_named"), marked.agg(F.count_if("_named").alias("removed"))


def artifact_records(trees: DataFrame, kind: str, policy: str, index_id: str, source_paths: list[str]) -> DataFrame:
    """A record of each file that names an index or mentions a source: which sources, and its size."""
    paths = F.array(*map(F.lit, source_paths)).cast("array<string>")
    found = R.with_strings(trees, "json").withColumn("source_paths", R.paths_mentioned(paths)).withColumn("by_index", R.references(F.col("json"), R.INDEX, index_id)).drop("_strings")
    hit = found.filter(F.col("by_index") | (F.size("source_paths") > 0))
    return hit.select(F.col("file").alias("artifact_id"), F.lit(kind).alias("artifact_kind"), F.lit(policy).alias("cleanup_policy"), "by_index", "source_paths", F.lit(1).cast("long").alias("row_count"), F.octet_length("json").cast("long").alias("bytes_estimate"))


def ledger_record(lines: DataFrame, kind: str, policy: str, index_id: str, source_paths: list[str]) -> DataFrame:
    """One record for a ledger's lines (file, json) that name an index or mention a source; none if no line does."""
    each = artifact_records(lines, kind, policy, index_id, source_paths)
    whole = each.groupBy("artifact_id", "artifact_kind", "cleanup_policy").agg(F.bool_or("by_index").alias("by_index"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_paths")))).alias("source_paths"), F.sum("row_count").alias("row_count"), F.sum("bytes_estimate").alias("bytes_estimate"))
    return whole


def dependency_counts(trees: DataFrame, kinds: list[str], role: str, value: str) -> DataFrame:
    """kind, n: files of each kind (column kind) that name a value; kinds without any have 0."""
    have = referencing(trees, role, value).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    every = trees.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(have, "kind", "left").fillna(0, ["n"])


def path_variants(path: Column, resolved: Column | None = None) -> Column:
    """A path as given, without a leading ./, and as the file system resolves it, where the listing says so."""
    forms = [T.strip(path), F.regexp_replace(T.strip(path), r"^(?:\./)+", ""), *([] if resolved is None else [resolved])]
    return F.array_distinct(F.filter(F.array(*forms), lambda p: F.coalesce(p, F.lit("")) != ""))


def affected(lifecycle: DataFrame) -> DataFrame:
    """status, path of what is no longer fresh, in all forms of the path."""
    resolved = F.col("resolved") if "resolved" in lifecycle.columns else None
    return lifecycle.filter("coalesce(status, '') NOT IN ('', 'fresh')").select("status", F.explode(path_variants(F.col("path"), resolved)).alias("path")).distinct()


def affected_paths(lifecycle: DataFrame) -> DataFrame:
    """Paths that are no longer fresh, in all their forms."""
    return affected(lifecycle).select("path").distinct()


def paths_by_status(lifecycle: DataFrame) -> DataFrame:
    return affected(lifecycle).groupBy("status").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def readiness(lifecycle: DataFrame, replacement: DataFrame) -> DataFrame:
    """One row: ready, reason. A replacement index must hold all changed sources and none of the detached ones.

    lifecycle: path, status; replacement: path.
    """
    have = replacement.select("path", F.lit(True).alias("_in")).distinct()
    both = lifecycle.join(have, "path", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    counts = both.agg(F.count_if(F.col("status").isin("deleted", "ignored") & F.col("_in")).alias("kept"), F.count_if((F.col("status") == "changed") & ~F.col("_in")).alias("lost"))
    reason = F.when(F.col("kept") > 0, "detached sources remain").when(F.col("lost") > 0, "changed sources are missing").otherwise("")
    return counts.select(((F.col("kept") == 0) & (F.col("lost") == 0)).alias("ready"), reason.alias("reason"))


@dataclass
class Report:
    """What a clean-up did, or would do."""

    dry_run: bool
    deleted: dict[str, int] = field(default_factory=dict)
    bytes: int = 0
    blocked: list[str] = field(default_factory=list)


def delete_files(families: dict[str, Iterable[str]], dry_run: bool = True) -> Report:
    """Unlink the files of each family; a file that is gone already counts for nothing. Dry runs only count."""
    report = Report(dry_run)
    for family, paths in families.items():
        for name in paths:
            path = Path(name.removeprefix("file://").removeprefix("file:"))
            try:
                size = path.stat().st_size
                if not dry_run:
                    path.unlink()
            except FileNotFoundError:
                continue
            report.deleted[family] = report.deleted.get(family, 0) + 1
            report.bytes += size
        report.deleted.setdefault(family, 0)
    return report


def cleanup_superseded(candidates: DataFrame, files_of: Callable[[str], dict[str, list[str]]], limit: int = 0, dry_run: bool = True) -> Report:
    """Delete superseded snapshots (id, decision) one after another, at most `limit` (0: all); blocked ones are reported.

    Snapshots of one state folder are few; each deletion is the driver's, as files are.
    """
    report = Report(dry_run)
    rows = candidates.select("id", "decision").orderBy("id").toLocalIterator()
    done = 0
    for row in rows:
        if row["decision"] == "block":
            report.blocked.append(row["id"])
        elif row["decision"] == "delete" and (not limit or done < limit):
            one = delete_files(files_of(row["id"]), dry_run)
            report.bytes += one.bytes
            for family, n in one.deleted.items():
                report.deleted[family] = report.deleted.get(family, 0) + n
            done += 1
    return report


def policy_fingerprint(root: str, pattern: str, rules: list[R.IgnoreRule]) -> str:
    """Digest of what decides which files an index holds."""
    import hashlib

    policy = {"root": root, "pattern": pattern, "rules": [[r.pattern, r.anchored, r.directory_only] for r in rules]}
    return hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()


def policy_staleness(stored: Column, current: str, excluded: Column) -> Column:
    """unknown without a stored policy, stale if it changed or now excludes an indexed file, else fresh."""
    return F.when(F.coalesce(stored, F.lit("")) == "", "unknown").when((stored != current) | (excluded > 0), "stale").otherwise("fresh")


def index_candidates(files: DataFrame, root: str, rules: list[R.IgnoreRule], limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """(paths to index, ignored files by rule with the first examples) of a listing (path, content)."""
    from corvana.sources.state import probably_text

    relative = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    marked = files.filter(R.under(F.col("path"), root)).withColumn("rule", R.ignored_by(relative, rules))
    good = marked.filter(F.col("rule").isNull() & probably_text(F.col("content"))).select("path")
    ignored = marked.filter("rule IS NOT NULL").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("path")), 1, limit).alias("examples"))
    return good, ignored


def boundary_reason(files: DataFrame) -> DataFrame:
    """index_id, reason: why an index's provenance is not known (a file without a source root or boundary); empty if it is."""
    lacking = F.count_if((F.coalesce("source_root", F.lit("")) == "") | (F.coalesce("source_boundary", F.lit("")) == ""))
    return files.groupBy("index_id").agg(F.when(lacking > 0, F.concat(lacking.cast("string"), F.lit(" files without a source boundary"))).otherwise("").alias("reason"))
