"""Queries of storage audits, lifecycle decisions, caches, sources, context plans, streams and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import audit
from corvana.plans.tables import shared_folder, table
from corvana.sources import state
from corvana.streaming import refresh


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of four indexes: copies of an earlier text are references in odd indexes."""
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("i"), n % 4).alias("index_id"),
        F.when(n % 4 == 3, "partial").otherwise("index").alias("kind"),
        F.col("source").alias("path"),
        n.alias("chunk"),
        T.sha256(F.col("text")).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.octet_length("text").cast("long").alias("stored_bytes"),
        (n % 10 == 7).alias("duplicate"),
        (n % 50 == 11).alias("missing"),
    )


def storage_records(spark: SparkSession, sf: str) -> DataFrame:
    return audit.storage_records(_chunks(spark, sf))


def storage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return audit.storage_totals(_chunks(spark, sf))


def duplicate_targets(spark: SparkSession, sf: str) -> DataFrame:
    have, _ = audit.duplicate_targets(_chunks(spark, sf))
    return have.select("index_id", "chunk", "bytes")


def missing_targets(spark: SparkSession, sf: str) -> DataFrame:
    _, lack = audit.duplicate_targets(_chunks(spark, sf))
    return lack.select("index_id", "chunk", "bytes")


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that occur more than once: how often, and the first document."""
    d = table(spark, sf, "documents").select(T.sha256(F.col("text")).alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label."""
    return audit.orphans(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select(F.format_string("f%d", "doc_id").alias("path"), T.sha256(F.col("text")).alias("sha256"), "doc_id")
    n = F.col("doc_id")
    # A listing has rows for what is there, and for what rules exclude, there or not.
    now = d.filter("doc_id % 9 <> 4 OR doc_id % 11 = 2").select("path", F.when(n % 7 == 1, "changed").otherwise(F.col("sha256")).alias("sha256"), (n % 11 == 2).alias("ignored"), (n % 9 != 4).alias("there"))
    return d.select("path", "sha256"), now


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return audit.snapshot_diff(*_snapshots(spark, sf))


def snapshot_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(*_snapshots(spark, sf))


def status_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Number of affected paths of each status, and the first."""
    return snapshot_diff(spark, sf).groupBy("status").agg(F.count_distinct("path").alias("n"), F.min("path").alias("first_path"))


def artifact_plans(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("fresh", "fresh", "changed", "deleted", "ignored"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = table(spark, sf, "orders").filter("o_custkey % 3 <> 0 OR o_orderkey % 5 < 3").select(F.col("o_custkey").alias("index_id"), status.alias("status"))
    return audit.artifact_plan(rows)


def policy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("source").alias("artifact_kind"), F.when(F.col("lang") == "en", "delete-derived").when(F.col("lang") == "de", "").otherwise("keep").alias("cleanup_policy"), F.col("n_chars").alias("bytes_estimate"))
    return audit.cleanup_policies(rows)


def latest_per_family(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family"), F.col("o_orderdate").alias("created"))
    return audit.latest_per_family(orders, "family", ["created"]).filter("is_latest").select("family", "id")


def superseded(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("family"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") == "F").alias("stale"), (F.col("o_orderkey") % 4 == 0).alias("missing_artifacts"))
    return audit.superseded(orders, "family", ["created"]).select("id", "latest_id", "decision")


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of indexes (one for each source): what was stored of each, and what is there now."""
    d, size, sha = F.col("doc_id"), F.octet_length("text").cast("long"), T.sha256(F.col("text"))
    return table(spark, sf, "documents").select(
        (d % 40).alias("index_id"),
        F.concat(F.lit("f"), d).alias("path"),
        *(F.when(d % 37 != 5, x).alias(n) for n, x in (("size", size), ("mtime", d), ("sha", sha))),
        F.when(d % 31 != 7, F.when(d % 13 == 3, size + 1).otherwise(size)).alias("size_now"),
        F.when(d % 17 == 2, d + 1).otherwise(d).alias("mtime_now"),
        F.when(d % 3 == 0, F.when(d % 13 == 3, "other").otherwise(sha)).alias("sha_now"),
    )


def _file_status() -> Column:
    return audit.file_staleness(*(F.col(c) for c in ("size", "mtime", "sha", "size_now", "mtime_now", "sha_now")))


def file_states(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprints(spark, sf).select("path", _file_status().alias("status"))


def staleness(spark: SparkSession, sf: str) -> DataFrame:
    return audit.index_staleness(_fingerprints(spark, sf).withColumn("status", _file_status()))


def lru_eviction(spark: SparkSession, sf: str) -> DataFrame:
    """Events as cache records of each user: which stay within a budget of bytes."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.floor(F.abs("value") * 100).cast("long").alias("bytes"), F.col("ts").alias("last_used"))
    return audit.evict(e, 60_000, ["user_id"]).filter("stays").select("user_id", "id")


def cache_usage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 != 0, F.floor(F.abs("value") * 100)).cast("long").alias("bytes"))
    return audit.cache_usage(e)


def latest_records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("updated"), F.col("ts").alias("created"))
    return audit.latest_record(e, ["user_id", "event_type"]).select("user_id", "event_type", "ord")


def upserts(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = old.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit("renamed").alias("s_name"), F.when(F.col("s_suppkey") % 2 == 0, 99).cast(old.schema["s_nationkey"].dataType).alias("s_nationkey"))
    extra = new.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)
    return audit.upsert(old, new.unionByName(extra), ["s_suppkey"])


def context_plan(spark: SparkSession, sf: str) -> DataFrame:
    lanes = table(spark, sf, "conversations").select(F.col("role").alias("lane"), "text")
    return audit.context_plan(lanes, 10_000)


def grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as an answer whose turns are its sources."""
    n = F.col("turn")
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("answer_id"),
        F.when(n % 3 == 0, "chunk").when(n % 3 == 1, "memory").otherwise("file").alias("kind"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("lexical"), F.lit("vector"))).otherwise(F.array(F.lit("lexical"))).alias("methods"),
        F.lit("").alias("evidence_id"),
        (F.col("conv_id") % 5 * 1.0).alias("signal"),
        F.when((F.col("conv_id") + n) % 7 == 0, "stale").otherwise("fresh").alias("status"),
        F.concat(F.lit("p"), n % 2).alias("path"),
        F.lit(0).alias("n_warnings"),
    )
    return audit.grounding_audit(rows.filter("answer_id % 6 <> 1 OR kind = 'memory'"), ["chunk", "file"], ["memory"], F.lit(True))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("action_id"), F.col("event_type").alias("kind"), F.col("props").alias("arguments"))
    return state.ledger(rows, "completed", F.lit("2024-01-01")).select("action_id", "kind", "status", "recorded")


def scrubbed(spark: SparkSession, sf: str) -> DataFrame:
    return state.scrubbed(table(spark, sf, "conversations"))


def hourly_activity(spark: SparkSession, sf: str) -> DataFrame:
    """An addition of this engine: windows over events, the same on a stream."""
    out = refresh.activity(table(spark, sf, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.bround("value", 4).alias("value"))


def incremental_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Questions embedded by a stream that runs twice over the same files: the second run embeds nothing."""
    root = shared_folder(spark)
    table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text").write.json(f"{root}/in")
    for _ in range(2):
        refresh.refresh(spark, f"{root}/in", "id string, text string", f"{root}/store", f"{root}/checkpoint", refresh.hashed_embedding).awaitTermination()
    stored = spark.read.parquet(f"{root}/store")
    return stored.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.max(F.size("vector") > 0).alias("embedded"))


_ALL = (storage_records, storage_totals, duplicate_targets, missing_targets, exact_duplicates, orphans, snapshot_diff, snapshot_coverage, status_paths, artifact_plans, policy_rollup, latest_per_family, superseded, file_states, staleness, lru_eviction, cache_usage, latest_records, upserts, context_plan, grounding, ledger, scrubbed, hourly_activity, incremental_refresh)
QUERIES = {f.__name__: f for f in _ALL}

#: The text rules in SQL: severity, rule, pattern.
_WORDS_SQL = r"('block', 'prompt_injection', 'ignore (all )?(previous|above) instructions|system prompt|developer message'), ('block', 'destructive_shell', '\brm\s+-rf\b|\bshutil\.rmtree\b|\.unlink\('), ('warn', 'network_reference', '\b(socket|urllib|httpx|requests|aiohttp|curl|wget)\b'), ('warn', 'subprocess_reference', '\b(subprocess|os\.system|Popen|pty\.spawn)\b'), ('warn', 'ambient_secret_reference', '\b(os\.environ|getenv|SSH_|TOKEN|API[_-]?KEY|PASSWORD|SECRET)\b'), ('warn', 'broad_path_reference', '(/home/|/etc/|/var/|~/|Path\.home\()'), ('info', 'shell_snippet', '```(?:bash|sh|shell)|\bpython\s+-c\b')"


_C = "c AS (SELECT 'i' || doc_id % 4 AS index_id, CASE WHEN doc_id % 4 = 3 THEN 'partial' ELSE 'index' END AS kind, source AS path, doc_id AS chunk, sha256(text) AS digest, octet_length(encode(text)) AS bytes, doc_id % 10 = 7 AS dup, doc_id % 50 = 11 AS miss FROM documents)"
_DIFF = "d AS (SELECT 'f' || doc_id AS path, doc_id % 9 = 4 AS gone, doc_id % 11 = 2 AS ign, doc_id % 7 = 1 AS chg FROM documents), s AS (SELECT path, CASE WHEN ign THEN 'ignored' WHEN gone THEN 'deleted' WHEN chg THEN 'changed' ELSE 'fresh' END AS status FROM d)"
_PRINTS = "f AS (SELECT doc_id % 40 AS index_id, 'f' || doc_id AS path, CASE WHEN doc_id % 37 = 5 THEN 'unknown' WHEN doc_id % 31 = 7 THEN 'stale' WHEN doc_id % 13 <> 3 AND doc_id % 17 <> 2 THEN 'fresh' WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 13 = 3 THEN 'stale' ELSE 'metadata-changed' END WHEN doc_id % 13 = 3 THEN 'stale' ELSE 'mtime-only' END AS status FROM documents)"
_TARGET = "EXISTS (SELECT 1 FROM c t WHERE NOT t.dup AND NOT t.miss AND t.kind = 'index' AND t.digest = c.digest AND t.index_id <> c.index_id)"
ORACLE = {
    "storage_records": f"WITH {_C} SELECT index_id, kind, count(*) AS chunks, count(*) FILTER (WHERE NOT dup AND NOT miss) AS stored_chunks, count(*) FILTER (WHERE dup) AS duplicate_chunks, CAST(sum(bytes) AS BIGINT) AS logical_bytes, CAST(coalesce(sum(bytes) FILTER (WHERE NOT dup AND NOT miss), 0) AS BIGINT) AS stored_bytes, CAST(coalesce(sum(bytes) FILTER (WHERE dup), 0) AS BIGINT) AS duplicate_bytes, count(*) FILTER (WHERE NOT dup AND miss) AS missing_chunks, 0 AS without_digest FROM c GROUP BY index_id, kind",
    "storage_totals": f"WITH {_C}, b AS (SELECT digest, count(*) AS n, min(bytes) AS size FROM c WHERE NOT dup AND NOT miss GROUP BY digest) SELECT count(*) FILTER (WHERE kind = 'index') AS total_chunks, CAST(sum(bytes) FILTER (WHERE kind = 'index') AS BIGINT) AS logical_bytes, CAST(sum(bytes) FILTER (WHERE NOT dup AND NOT miss) AS BIGINT) AS physical_bytes, count(*) FILTER (WHERE NOT dup AND miss) AS missing_chunks, (SELECT count(*) FROM b) AS unique_bodies, (SELECT CAST(sum(size) AS BIGINT) FROM b) AS unique_bytes, (SELECT CAST(sum(n - 1) AS BIGINT) FROM b) AS duplicate_bodies FROM c",
    "duplicate_targets": f"WITH {_C} SELECT index_id, chunk, bytes FROM c WHERE dup AND {_TARGET}",
    "missing_targets": f"WITH {_C} SELECT index_id, chunk, bytes FROM c WHERE dup AND NOT {_TARGET}",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING n > 1",
    "orphans": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "snapshot_diff": f"WITH {_DIFF} SELECT path, status, CASE status WHEN 'ignored' THEN 'detach-derived-artifacts' WHEN 'deleted' THEN 'mark-stale-and-clean-derived-artifacts' ELSE 'reprocess-from-source' END AS action FROM s WHERE status <> 'fresh'",
    "snapshot_coverage": f"WITH {_DIFF} SELECT count(*) AS known, count(*) FILTER (WHERE NOT gone AND NOT ign) AS covered, count(*) FILTER (WHERE gone OR ign) AS missing FROM d",
    "status_paths": f"WITH {_DIFF} SELECT status, count(*) AS n, min(path) AS first_path FROM s WHERE status <> 'fresh' GROUP BY status",
    "artifact_plans": "WITH n AS (SELECT o_custkey AS index_id, count(*) FILTER (WHERE o_orderkey % 5 = 2) AS changed, count(*) FILTER (WHERE o_orderkey % 5 = 3) AS deleted, count(*) FILTER (WHERE o_orderkey % 5 = 4) AS ignored FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 5 < 3 GROUP BY o_custkey) SELECT *, CASE WHEN changed > 0 AND deleted + ignored > 0 THEN 'rebuild-index-and-clean-detached-derived-artifacts' WHEN changed > 0 THEN 'rebuild-index-and-refresh-derived-artifacts' WHEN deleted + ignored > 0 THEN 'refresh-index-and-clean-detached-derived-artifacts' ELSE 'keep-derived-artifacts' END AS recommended_action FROM n",
    "policy_rollup": "WITH r AS (SELECT source AS kind, CASE lang WHEN 'en' THEN 'delete-derived' WHEN 'de' THEN 'manual-review' ELSE 'keep' END AS policy, n_chars FROM documents) SELECT policy, kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM r GROUP BY GROUPING SETS ((policy, kind), (policy))",
    "latest_per_family": "SELECT o_custkey AS family, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY o_custkey",
    "superseded": "WITH o AS (SELECT o_orderkey::VARCHAR AS id, o_custkey AS family, o_orderdate AS created, o_orderstatus = 'F' AS stale, o_orderkey % 4 = 0 AS lack FROM orders), l AS (SELECT family, arg_max(id, (created, id)) AS latest_id FROM o GROUP BY family) SELECT o.id, latest_id, CASE WHEN NOT o.stale THEN 'keep' WHEN t.lack THEN 'block' ELSE 'delete' END AS decision FROM o JOIN l USING (family) JOIN o t ON t.id = latest_id WHERE o.id <> latest_id",
    "file_states": f"WITH {_PRINTS} SELECT path, status FROM f",
    "staleness": f"WITH {_PRINTS} SELECT index_id, CASE WHEN bool_or(status = 'stale') THEN 'stale' WHEN bool_or(status = 'unknown') THEN 'unknown' WHEN bool_or(status = 'metadata-changed') THEN 'metadata-changed' ELSE 'fresh' END AS status FROM f GROUP BY index_id",
    "lru_eviction": "WITH e AS (SELECT user_id, event_id AS id, CAST(floor(abs(value) * 100) AS BIGINT) AS bytes, ts FROM events), w AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS run, sum(bytes) OVER (PARTITION BY user_id) AS total FROM e) SELECT user_id, id FROM w WHERE total <= 60000 OR run <= 60000",
    "cache_usage": "SELECT CAST(coalesce(sum(CASE WHEN event_id % 10 <> 0 THEN CAST(floor(abs(value) * 100) AS BIGINT) END), 0) AS BIGINT) AS bytes, count(*) AS records, count(*) FILTER (WHERE event_id % 10 = 0) AS unknown FROM events",
    "latest_records": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS ord FROM events GROUP BY user_id, event_type",
    "upserts": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 6 = 0 THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'renamed', CASE WHEN s_suppkey % 2 = 0 THEN 99 END FROM supplier WHERE s_suppkey % 3 = 0",
    "context_plan": "WITH l AS (SELECT role AS lane, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS items FROM conversations GROUP BY role) SELECT lane, chars, items, (SELECT CAST(sum(chars) AS BIGINT) FROM l) AS total_chars, CASE WHEN (SELECT sum(chars) FROM l) > 10000 THEN 'over-budget' ELSE 'within-budget' END AS status FROM l",
    "grounding": "WITH s AS (SELECT conv_id AS answer_id, CASE turn % 3 WHEN 0 THEN 'chunk' WHEN 1 THEN 'memory' ELSE 'file' END AS kind, conv_id % 2 = 0 OR conv_id % 5 > 0 AS strong_chunk, (conv_id + turn) % 7 = 0 AS stale, turn % 2 AS p FROM conversations), f AS (SELECT * FROM s WHERE answer_id % 6 <> 1 OR kind = 'memory'), n AS (SELECT answer_id, count(*) FILTER (WHERE kind = 'file' OR (kind = 'chunk' AND strong_chunk)) AS strong, count(*) FILTER (WHERE kind IN ('file', 'chunk')) AS nominal, count(*) FILTER (WHERE kind = 'memory') AS context, count(*) AS total, count(*) FILTER (WHERE stale) AS warnings, count(DISTINCT p) AS paths FROM f GROUP BY answer_id) SELECT *, greatest(0, nominal - strong) AS weak, CASE WHEN strong > 0 THEN CASE WHEN warnings > 0 THEN 'warn' ELSE 'pass' END WHEN context > 0 THEN 'partial' ELSE 'fail' END AS audit FROM n",
    "ledger": "SELECT event_id AS action_id, event_type AS kind, 'completed' AS status, '2024-01-01' AS recorded FROM events",
    "scrubbed": "SELECT conv_id, turn, role, CASE WHEN text IS NOT NULL THEN '[redacted]' END AS text FROM conversations",
    "hourly_activity": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    # The rules of a question as SQL over the questions, one expression for each.
    "incremental_refresh": "SELECT item_id::VARCHAR AS id, 1 AS times, true AS embedded FROM benchmark",
}
