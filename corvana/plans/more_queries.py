"""Queries of lifecycle references, dossiers, service answers and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.functions import text as T
from corvana.operators import audit, dossiers, lexical, lifecycle, services
from corvana.plans.tables import TERMS_SQL, first_question, score_sql, table


def dependency_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as artifacts of a kind that name indexes: how many of each kind name one of them."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit('{"source_index_ids": ["i'), F.col("o_custkey") % 7, F.lit('", {"id": "i'), F.col("o_orderkey") % 5, F.lit('"}]}')).alias("json"))
    return lifecycle.dependency_counts(orders, ["1-URGENT", "2-HIGH", "no such kind"], R.INDEX, "i1")


def rows_without(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as rows of a ledger: what stays without one conversation, and how many go."""
    turns = table(spark, sf, "conversations").select(F.concat(F.lit('{"conversation_id": '), "conv_id", F.lit(', "turn": '), "turn", F.lit("}")).alias("json"))
    kept, removed = lifecycle.without(turns, R.CONVERSATION, "3")
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(removed))  # one row each


def _lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sources of an index, each with a status."""
    d = F.col("doc_id")
    status = F.when(d % 11 == 2, "ignored").when(d % 9 == 4, "deleted").when(d % 7 == 1, "changed").otherwise("fresh")
    return table(spark, sf, "documents").select(F.concat(F.when(d % 2 == 0, "./").otherwise(""), F.lit("f"), d).alias("path"), status.alias("status"))


def readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Three replacements of an index: one that holds what it must, one that lost sources, one that keeps detached ones."""
    life = _lifecycle(spark, sf)
    good = lifecycle.readiness(life, life.filter("status IN ('fresh', 'changed')").select("path")).withColumn("case", F.lit("good"))
    lost = lifecycle.readiness(life, life.filter("status = 'fresh'").select("path")).withColumn("case", F.lit("lost"))
    kept = lifecycle.readiness(life, life.select("path")).withColumn("case", F.lit("kept"))
    return good.union(lost).union(kept)


def affected_paths(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.affected_paths(_lifecycle(spark, sf))


def paths_by_status(spark: SparkSession, sf: str) -> DataFrame:
    """Number of the paths of each status, with the first and the last; fresh ones are not affected."""
    return lifecycle.paths_by_status(_lifecycle(spark, sf)).select("status", F.size("paths").cast("long").alias("n"), F.element_at("paths", 1).alias("first_path"), F.element_at("paths", -1).alias("last_path"))


def lifecycle_states(spark: SparkSession, sf: str) -> DataFrame:
    """Status and action of sources that are gone, ignored or changed, in every combination."""
    d = F.col("doc_id")
    status = audit.lifecycle_status(d % 9 != 4, d % 4 == 1, d % 7 == 1)
    return table(spark, sf, "documents").select("doc_id", status.alias("status"), audit.lifecycle_action(status).alias("action"))


def material_until_full(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation until what stands before them fills a budget."""
    m = table(spark, sf, "conversations")
    return dossiers.until_full(m, ["conv_id"], [F.col("turn")], F.length("text"), 600).select("conv_id", "turn")


def dossier_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("dossier_id"), F.col("turn").alias("ord"), "text")
    return dossiers.from_dossier(m, first_question(spark, sf), 900).select("dossier_id", "ord", "score")


def dossier_material(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations")
    a = m.filter("role = 'user'").select(F.col("conv_id").alias("dossier_id"), F.format_string("m%04d", "turn").alias("id"), (F.col("turn") % 5).alias("importance"), "text")
    b = m.filter("role = 'assistant'").select(F.col("conv_id").alias("dossier_id"), F.format_string("c%04d", "turn").alias("id"), F.format_string("%04d", "turn").alias("updated"), "text")
    return dossiers.source_material(a, b, 60, 200).select("dossier_id", F.col("place").cast("long").alias("place"), "kind", "id")


def profile_material(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("profile_id"), F.format_string("%05d-%03d", "conv_id", "turn").alias("id"), "text", "role")
    out = dossiers.profile_material(m.filter("role = 'user'").drop("role"), m.filter("role = 'assistant'").drop("role"))
    return out.select("profile_id", F.length("text").cast("long").alias("chars"), F.size("memory_ids").cast("long").alias("memories"), F.get("conversation_ids", F.lit(0)).alias("first_conversation"))


def profile_scope(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("profile_id"), F.col("conv_id").alias("conversation_id")).distinct()
    roots = m.select("conversation_id", F.when(F.col("conversation_id") % 10 < 4, "/a").when(F.col("conversation_id") % 10 < 7, "/b").otherwise("/c").alias("root")).filter("conversation_id % 20 <> 5")
    return dossiers.in_scope(m, roots, ["/a", "/b"])


def best_per_date(spark: SparkSession, sf: str) -> DataFrame:
    """For every day the event with the highest value, within a budget that grows with the days."""
    e = _dated_events(spark, sf)
    days = [r["date"] for r in e.select("date").distinct().filter("date IS NOT NULL").collect()]
    return dossiers.best_per_date(e, days, 1000 * len(days))


def _dated_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("id"), F.col("value").alias("score"), F.col("event_type").alias("text"))


def distinct_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("id"), F.lit(0).alias("start"), (F.col("turn") % 3).alias("end"), F.col("turn").alias("ord"), "text")
    return dossiers.distinct_excerpts(m, ["conv_id"], 3, 700).select("conv_id", "id", "end", "ord")


def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("memory", "chunk", "other", "dossier", "file"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), kinds.alias("kind"))
    return dossiers.summary(e, 15)


def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of headers and contents under a limit."""
    text = services.embedding_text(F.concat(F.lit("path: "), "source"), F.col("text"), 300)
    return table(spark, sf, "documents").select("doc_id", (F.length(text) <= 300).alias("fits"), F.startswith(text, F.concat(F.lit("path: "), "source", F.lit("\ncontent: "))).alias("headed"))


def conversation_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap coefficient of each document's words with the first question's."""
    asked = F.array(*map(F.lit, lexical.query_terms(first_question(spark, sf)))).cast("array<string>")
    return table(spark, sf, "documents").select("doc_id", F.bround(lexical.overlap(F.array_distinct(T.tokens(F.col("text"))), asked), 6).alias("overlap"))


_ALL = (dependency_counts, rows_without, readiness, affected_paths, paths_by_status, lifecycle_states, material_until_full, dossier_excerpts, dossier_material, profile_material, profile_scope, best_per_date, distinct_excerpts, source_summary, embedding_texts, conversation_overlap)
QUERIES = {f.__name__: f for f in _ALL}

_LIFE = "l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN './' ELSE '' END || 'f' || doc_id AS path, CASE WHEN doc_id % 11 = 2 THEN 'ignored' WHEN doc_id % 9 = 4 THEN 'deleted' WHEN doc_id % 7 = 1 THEN 'changed' ELSE 'fresh' END AS status FROM documents)"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CUT = f"CASE WHEN length({_FLAT}) <= 60 THEN {_FLAT} ELSE rtrim(left({_FLAT}, 59)) || '…' END"
ORACLE = {
    "dependency_counts": "SELECT kind, (SELECT count(*) FROM orders WHERE o_orderpriority = kind AND (o_custkey % 7 = 1 OR o_orderkey % 5 = 1)) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('no such kind')) AS t(kind)",
    "rows_without": "SELECT count(*) FILTER (WHERE conv_id <> 3) AS kept, count(*) FILTER (WHERE conv_id = 3) AS removed FROM conversations",
    "readiness": f"WITH {_LIFE} SELECT count(*) FILTER (WHERE status = 'x') = 0 AS ready, '' AS reason, 'good' AS \"case\" FROM l UNION ALL SELECT count(*) FILTER (WHERE status = 'changed') = 0, CASE WHEN count(*) FILTER (WHERE status = 'changed') > 0 THEN 'changed sources are missing' ELSE '' END, 'lost' FROM l UNION ALL SELECT count(*) FILTER (WHERE status IN ('deleted', 'ignored')) = 0, CASE WHEN count(*) FILTER (WHERE status IN ('deleted', 'ignored')) > 0 THEN 'detached sources remain' ELSE '' END, 'kept' FROM l",
    "affected_paths": f"WITH {_LIFE} SELECT path FROM l WHERE status <> 'fresh' UNION SELECT replace(path, './', '') FROM l WHERE status <> 'fresh'",
    "paths_by_status": f"WITH {_LIFE}, v AS (SELECT status, path FROM l WHERE status <> 'fresh' UNION SELECT status, replace(path, './', '') FROM l WHERE status <> 'fresh') SELECT status, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM v GROUP BY status",
    "lifecycle_states": "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'ignored' WHEN doc_id % 9 = 4 THEN 'deleted' WHEN doc_id % 7 = 1 THEN 'changed' ELSE 'fresh' END AS status FROM documents) SELECT doc_id, status, CASE status WHEN 'ignored' THEN 'detach-derived-artifacts' WHEN 'deleted' THEN 'mark-stale-and-clean-derived-artifacts' WHEN 'changed' THEN 'reprocess-from-source' ELSE 'keep' END AS action FROM s",
    "material_until_full": "SELECT conv_id, turn FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 600",
    "dossier_excerpts": f"WITH {TERMS_SQL}, c AS (SELECT conv_id * 10000 + turn AS key, * FROM conversations),\n{score_sql('c', 'key', 'text')}, r AS (SELECT conv_id, turn, score, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY score DESC, turn ROWS UNBOUNDED PRECEDING) - 2 AS e FROM c JOIN scored ON k = key) SELECT conv_id AS dossier_id, turn AS ord, score FROM r WHERE e <= 900",
    "dossier_material": f"WITH a AS (SELECT conv_id, 0 AS lane, -(turn % 5) AS o1, '' AS o2, 'memory' AS kind, format('m{{:04d}}', turn) AS id, {_CUT} AS t FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 1, 0, format('{{:04d}}', turn), 'conversation', format('c{{:04d}}', turn), {_CUT} FROM conversations WHERE role = 'assistant'), s AS (SELECT *, CASE WHEN lane = 0 THEN o1::VARCHAR END AS k0 FROM a WHERE t <> ''), w AS (SELECT *, row_number() OVER x AS place, coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY lane, k0 NULLS FIRST, o2 DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s WINDOW x AS (PARTITION BY conv_id ORDER BY lane, k0 NULLS FIRST, o2 DESC, id)) SELECT conv_id AS dossier_id, place, kind, id FROM w WHERE b < 200",
    "profile_material": "WITH m AS (SELECT conv_id % 10 AS profile_id, format('{:05d}-{:03d}', conv_id, turn) AS id, text, role FROM conversations WHERE role IN ('user', 'assistant')) SELECT profile_id, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS chars, count(*) FILTER (WHERE role = 'user') AS memories, min(id) FILTER (WHERE role = 'assistant') AS first_conversation FROM m GROUP BY profile_id",
    "profile_scope": "SELECT conv_id % 10 AS profile_id, bool_and(conv_id % 10 < 7 AND conv_id % 20 <> 5) AS in_scope FROM conversations GROUP BY 1",
    "best_per_date": "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, value, event_type FROM events) SELECT date, arg_max(event_id, (value, length(event_type), event_id)) AS id, arg_max(event_type, (value, length(event_type), event_id)) AS text FROM e WHERE date IS NOT NULL GROUP BY date",
    "distinct_excerpts": "WITH o AS (SELECT conv_id, role AS id, turn % 3 AS e, min(turn) AS ord, arg_min(text, turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY ALL), w AS (SELECT *, sum(length(text) + 2) OVER x - 2 AS run, count(*) OVER x AS n FROM o WINDOW x AS (PARTITION BY conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT conv_id, id, e AS \"end\", ord FROM w WHERE run <= 700 AND n <= 3",
    "source_summary": "WITH e AS (SELECT event_id AS ord, (['memory', 'chunk', 'other', 'dossier', 'file'])[event_id % 5 + 1] AS kind FROM events) SELECT ord, kind FROM e WHERE kind <> 'other' ORDER BY list_position(['chunk', 'file', 'dossier', 'memory'], kind), ord LIMIT 15",
    "embedding_texts": "SELECT doc_id, true AS fits, trim(text) <> '' AS headed FROM documents",
    "conversation_overlap": "WITH q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_''-]{3,}')) AS q FROM benchmark ORDER BY item_id LIMIT 1), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_''-]{3,}')) AS w FROM documents) SELECT doc_id, CASE WHEN least(len(w), len(q)) > 0 THEN round_even(len(list_intersect(w, q)) / least(len(w), len(q)), 6) ELSE 0 END AS overlap FROM d, q",
}
