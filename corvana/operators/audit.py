"""Audits of stored chunks, snapshots and derived artifacts; cleanup decisions; cache budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def storage_records(chunks: DataFrame) -> DataFrame:
    """Counts and bytes of each index (index_id, kind).

    chunks: index_id, kind, path, chunk, digest, bytes, stored_bytes, duplicate, missing.
    """
    dup, miss = F.coalesce("duplicate", F.lit(False)), F.coalesce("missing", F.lit(False))
    stored = ~dup & ~miss
    return chunks.groupBy("index_id", "kind").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(stored).alias("stored_chunks"),
        F.count_if(dup).alias("duplicate_chunks"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("logical_bytes"),
        F.coalesce(F.sum(F.when(stored, F.col("stored_bytes"))), F.lit(0)).alias("stored_bytes"),
        F.coalesce(F.sum(F.when(dup, F.col("bytes"))), F.lit(0)).alias("duplicate_bytes"),
        F.count_if(~dup & miss).alias("missing_chunks"),
        F.count_if(F.coalesce("digest", F.lit("")) == "").alias("without_digest"),
    )


def storage_totals(chunks: DataFrame) -> DataFrame:
    """One row over all indexes: chunks, bytes, unique bodies (the first of each digest) and duplicate bodies."""
    records = storage_records(chunks)
    done = F.col("kind") == "index"
    sums = records.agg(
        F.sum(F.when(done, F.col("chunks"))).alias("total_chunks"),
        F.sum(F.when(done, F.col("logical_bytes"))).alias("logical_bytes"),
        F.sum("stored_bytes").alias("physical_bytes"),
        F.sum("missing_chunks").alias("missing_chunks"),
    )
    bodies = chunks.filter(~F.coalesce("duplicate", F.lit(False)) & ~F.coalesce("missing", F.lit(False)) & (F.coalesce("digest", F.lit("")) != "")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min_by("stored_bytes", F.struct("index_id", "path", "chunk")).alias("size"))
    unique = bodies.agg(F.count(F.lit(1)).alias("unique_bodies"), F.sum("size").alias("unique_bytes"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("duplicate_bodies"))
    return sums.join(F.broadcast(unique))  # one row each


def duplicate_targets(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(with a target, without one): duplicate references whose body another complete index stores.

    The targets are reduced to one row for each digest with its least and greatest
    index id, which tells whether another index has it without a join per pair.
    """
    dup = F.coalesce("duplicate", F.lit(False))
    refs = chunks.filter(dup).select("index_id", "path", "chunk", "digest", "bytes")
    stored = chunks.filter(~dup & ~F.coalesce("missing", F.lit(False)) & (F.col("kind") == "index")).groupBy("digest").agg(F.min("index_id").alias("low"), F.max("index_id").alias("high"))
    at = (refs.digest == stored.digest) & ((stored.low != refs.index_id) | (stored.high != refs.index_id))
    return refs.join(stored, at, "left_semi"), refs.join(stored, at, "left_anti")


def orphans(files: DataFrame, referenced: DataFrame, key: str = "path") -> DataFrame:
    """Files that nothing refers to."""
    return files.join(referenced.select(key), key, "left_anti")


def lifecycle_status(exists: Column, ignored: Column, changed: Column) -> Column:
    """ignored, deleted, changed or fresh."""
    return F.when(ignored, "ignored").when(~exists, "deleted").when(changed, "changed").otherwise("fresh")


ACTIONS = {"ignored": "detach-derived-artifacts", "deleted": "mark-stale-and-clean-derived-artifacts", "changed": "reprocess-from-source", "fresh": "keep"}


def lifecycle_action(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair)), status)


def snapshot_diff(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path, status, action of the indexed files that are no longer fresh.

    indexed: path, sha256; current: path, sha256, ignored, and `there` where rows stand for
    files that are gone. Files that are not indexed yet do not appear.
    """
    there = F.col("there") if "there" in current.columns else F.lit(True)
    now = current.select("path", F.col("sha256").alias("_now"), F.col("ignored").alias("_ignored"), there.alias("_there"))
    both = indexed.join(now, "path", "left")
    there = F.coalesce("_there", F.lit(False))
    status = lifecycle_status(there, F.coalesce("_ignored", F.lit(False)), ~F.col("sha256").eqNullSafe(F.col("_now")))
    return both.withColumn("status", status).filter("status != 'fresh'").select("path", "status", lifecycle_action(F.col("status")).alias("action"))


def coverage(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """One row: known, covered and missing files."""
    known, there = indexed.select("path").distinct(), current.filter("NOT ignored").select("path", F.lit(1).alias("_there")).distinct()
    return known.join(there, "path", "left").agg(F.count(F.lit(1)).alias("known"), F.count("_there").alias("covered"), F.count_if(F.col("_there").isNull()).alias("missing"))


def artifact_plan(lifecycle: DataFrame) -> DataFrame:
    """index_id, counts by status, and what to do, for each index of a lifecycle table (index_id, status)."""
    n = lifecycle.groupBy("index_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("changed", "deleted", "ignored")))
    detached = (F.col("deleted") > 0) | (F.col("ignored") > 0)
    action = (
        F.when((F.col("changed") > 0) & detached, "rebuild-index-and-clean-detached-derived-artifacts")
        .when(F.col("changed") > 0, "rebuild-index-and-refresh-derived-artifacts")
        .when(detached, "refresh-index-and-clean-detached-derived-artifacts")
        .otherwise("keep-derived-artifacts")
    )
    return n.withColumn("recommended_action", action)


def cleanup_policies(artifacts: DataFrame) -> DataFrame:
    """kind, policy, n, bytes; with the totals of each policy where kind is null."""
    rows = artifacts.select(F.coalesce(F.nullif("artifact_kind", F.lit("")), F.lit("artifact")).alias("kind"), F.coalesce(F.nullif("cleanup_policy", F.lit("")), F.lit("manual-review")).alias("policy"), F.coalesce("bytes_estimate", F.lit(0)).alias("bytes"))
    return rows.groupingSets([["policy", "kind"], ["policy"]], "policy", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def apply_status(n_rows: Column, changed: Column, ready: Column) -> Column:
    return F.when(n_rows == 0, F.struct(F.lit("fresh").alias("status"), F.lit("no-op").alias("apply"))).when((changed > 0) & ~ready, F.struct(F.lit("needs-rebuild").alias("status"), F.lit("blocked").alias("apply"))).when(~ready, F.struct(F.lit("detached-source-work").alias("status"), F.lit("blocked").alias("apply"))).otherwise(F.struct(F.lit("cleanup-ready").alias("status"), F.lit("ready").alias("apply")))


def latest_per_family(snapshots: DataFrame, family: str, order: list[str]) -> DataFrame:
    """Every snapshot with the id of its family's latest and whether it is that one."""
    latest = snapshots.groupBy(family).agg(F.max_by("id", F.struct(*order, "id")).alias("latest_id"))
    return snapshots.join(latest, family).withColumn("is_latest", F.col("id") == F.col("latest_id"))


def superseded(snapshots: DataFrame, family: str, order: list[str]) -> DataFrame:
    """Stale snapshots that are not their family's latest, and what to do with them.

    snapshots: id, family, stale, missing_artifacts, bytes and the order columns.
    """
    marked = latest_per_family(snapshots, family, order)
    blocked = snapshots.select(F.col("id").alias("latest_id"), F.col("missing_artifacts").alias("_blocked"))
    out = marked.join(blocked, "latest_id", "left").filter(~F.col("is_latest"))
    decision = F.when(F.coalesce("id", F.lit("")) == "", "skip").when(~F.col("stale"), "keep").when(F.coalesce("_blocked", F.lit(False)), "block").otherwise("delete")
    return out.withColumn("decision", decision).drop("_blocked")


SEVERITY = ("fresh", "metadata-changed", "unknown", "stale")


def file_staleness(size: Column, mtime: Column, sha: Column, size_now: Column, mtime_now: Column, sha_now: Column) -> Column:
    """unknown without a fingerprint, stale without a file, fresh where size and time agree; else the digest tells.

    Without a digest of now (it was not taken) another size is stale, another time alone metadata-changed.
    """
    same_size, same_time = size.eqNullSafe(size_now), mtime.eqNullSafe(mtime_now)
    return (
        F.when(size.isNull() & mtime.isNull() & sha.isNull(), "unknown")
        .when(size_now.isNull(), "stale")
        .when(same_size & same_time, "fresh")
        .when(sha_now.isNull(), F.when(same_size, "metadata-changed").otherwise("stale"))
        .when(sha.eqNullSafe(sha_now), "mtime-only")
        .otherwise("stale")
    )


def index_staleness(files: DataFrame) -> DataFrame:
    """index_id, status: stale before unknown before metadata-changed before fresh; 'empty' has no files."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.when(F.col("status") == "mtime-only", "fresh").otherwise(F.col("status"))), F.lit(1))
    worst = files.groupBy("index_id").agg(F.max(rank).cast("int").alias("r"), F.count("path").alias("n"))
    return worst.select("index_id", F.when(F.col("n") == 0, "empty").otherwise(F.element_at(F.array(*map(F.lit, SEVERITY)), F.greatest(F.lit(1), F.col("r")))).alias("status"))


def cache_usage(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("bytes").isNull()).alias("unknown"))


def evict(records: DataFrame, budget: int, keys: list[str], used: str = "last_used", protected: Column | None = None) -> DataFrame:
    """Records of each cache with whether they stay: the least recently used go until the rest fits, protected ones last.

    records: the keys, id, bytes, last_used. The running sum orders one cache's records, so a
    cache bounds a task; keys must tell caches apart.
    """
    first = F.coalesce(protected, F.lit(False)) if protected is not None else F.lit(False)
    w = Window.partitionBy(*keys).orderBy(first.desc(), F.desc(used), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    out = records.withColumn("_kept", F.sum(F.coalesce("bytes", F.lit(0))).over(w)).withColumn("_all", F.sum(F.coalesce("bytes", F.lit(0))).over(total))
    return out.withColumn("stays", (F.col("_all") <= budget) | (F.col("_kept") <= budget)).drop("_kept", "_all")


SLOT_SCHEMA, SLOT_NAMESPACE, MOST_SLOTS = "slot-cache-v1", "default", 512


def read_slots(manifest: DataFrame) -> DataFrame:
    """Records of a manifest (schema, records: array of structs); none of a manifest of another schema."""
    return manifest.filter(F.col("schema") == SLOT_SCHEMA).select(F.posexplode("records").alias("ord", "r")).select("ord", "r.*")


def kept_slots(records: DataFrame, most: int = MOST_SLOTS) -> DataFrame:
    """What a manifest keeps: the `most` records that were updated last."""
    moment = F.coalesce(F.nullif("updated", F.lit("")), "created", F.lit(""))
    return records.orderBy(moment.desc(), F.desc("ord")).limit(most)


def observed_bytes(records: DataFrame, route: str) -> DataFrame:
    """One row: the largest size of a route's records, 0 without any."""
    return records.filter(F.col("catalog_route") == route).agg(F.coalesce(F.max(F.when(F.col("bytes") > 0, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"))


def latest_slot(records: DataFrame, schema: str = SLOT_SCHEMA, namespace: str = SLOT_NAMESPACE) -> DataFrame:
    """For each conversation and route fingerprint the record of this schema and namespace that was saved last."""
    saved = records.filter((F.col("schema") == schema) & (F.coalesce("client_namespace", F.lit(SLOT_NAMESPACE)) == namespace) & (F.col("status") == "saved"))
    return latest_record(saved, ["conversation_id", "route_fingerprint"])


SLOT_KEY = ["route_fingerprint", "conversation_id", "filename"]


def upsert_slots(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with new ones merged in by route, conversation and file."""
    return upsert(records, new, SLOT_KEY)


def latest_record(records: DataFrame, keys: list[str]) -> DataFrame:
    """The latest record of each key by updated, else created."""
    columns = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce("updated", "created"), "ord")).alias("r")).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old records with the new ones merged in: what a new record leaves null stays as it was."""
    values = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in values if c in new.columns))
    both = old.join(fresh, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in values))


def tail(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows of an order, newest first."""
    return rows.orderBy(*order).limit(n)


def context_plan(lanes: DataFrame, budget: int) -> DataFrame:
    """Characters and items of each context lane, its share of the budget, and whether all fits."""
    each = lanes.groupBy("lane").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("items"))
    whole = each.agg(F.sum("chars").alias("total_chars"))
    return each.join(F.broadcast(whole)).withColumn("status", F.when(F.col("total_chars") > budget, "over-budget").otherwise("within-budget"))


STRONG_METHODS = ("evidence", "structural", "temporal", "code", "vector")


def strong_evidence(kinds: list[str]) -> Column:
    """A source row with retrieved evidence: of a strong kind, and a chunk only with a method, an evidence id or a score."""
    chunk = F.arrays_overlap("methods", F.array(*map(F.lit, STRONG_METHODS))) | F.coalesce(F.nullif("evidence_id", F.lit("")).isNotNull(), F.lit(False)) | (F.coalesce("signal", F.lit(0.0)) > 0)
    return F.col("kind").isin(kinds) & ((F.col("kind") != "chunk") | F.coalesce(chunk, F.lit(False)))


def grounding_audit(sources: DataFrame, strong: list[str], context: list[str], needs_grounding: Column) -> DataFrame:
    """For each answer (answer_id): counts of strong, nominal, weak and context sources, warnings, and a status.

    sources: answer_id, kind, methods, evidence_id, signal, status, path, n_warnings.
    """
    rows = sources.filter("kind != 'answer-audit'")
    counted = rows.groupBy("answer_id").agg(
        F.count_if(strong_evidence(strong)).alias("strong"),
        F.count_if(F.col("kind").isin(strong)).alias("nominal"),
        F.count_if(F.col("kind").isin(context)).alias("context"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if(F.col("status") == "stale") + F.sum(F.coalesce("n_warnings", F.lit(0)))).alias("warnings"),
        F.count_distinct(F.nullif("path", F.lit(""))).alias("paths"),
    )
    status = F.when(F.col("strong") > 0, F.when(F.col("warnings") > 0, "warn").otherwise("pass")).when(F.col("context") > 0, "partial").when(needs_grounding, "fail").otherwise("thin")
    return counted.withColumn("weak", F.greatest(F.lit(0), F.col("nominal") - F.col("strong"))).withColumn("audit", status)


def expansion_decision(needed: Column, path_warning: Column, stale: Column, strong: Column, candidate_score: Column, least: float) -> Column:
    """not-needed, path-warning, stale-warning, sufficient, expand or no-candidate."""
    return F.when(~needed, "not-needed").when(path_warning, "path-warning").when(stale, "stale-warning").when(strong > 0, "sufficient").when(candidate_score >= least, "expand").otherwise("no-candidate")
