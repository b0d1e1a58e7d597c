"""Material under a budget: dossiers, profiles, excerpts; summaries of sources and what to debug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import lexical


def until_full(rows: DataFrame, keys: list[str], order: list[Column], length: Column, budget: int) -> DataFrame:
    """Rows of each key as long as the rows before them leave room: the budget is looked at before a row is added."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(length).over(w), F.lit(0))).filter(F.col("_before") < budget).drop("_before")


def source_material(memories: DataFrame, conversations: DataFrame, excerpt: int, budget: int) -> DataFrame:
    """dossier_id, place, kind, id, text: memories by importance, then conversations, cut to excerpts, until the budget is full.

    memories: dossier_id, id, importance, text; conversations: dossier_id, id, updated, text.
    """
    a = memories.select("dossier_id", F.lit(0).alias("lane"), (-F.col("importance")).cast("string").alias("o"), F.lit("memory").alias("kind"), "id", T.compact(F.col("text"), excerpt).alias("text"))
    b = conversations.select("dossier_id", F.lit(1).alias("lane"), F.col("updated").cast("string").alias("o"), F.lit("conversation").alias("kind"), "id", T.compact(F.col("text"), excerpt).alias("text"))
    order = [F.asc("lane"), F.when(F.col("lane") == 0, F.col("o")).asc(), F.when(F.col("lane") == 1, F.col("o")).desc(), F.asc("id")]
    kept = until_full(a.unionByName(b).filter("text <> ''"), ["dossier_id"], order, F.length("text"), budget)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("dossier_id").orderBy(*order))).select("dossier_id", "place", "kind", "id", "text")


def from_dossier(excerpts: DataFrame, query: str, budget: int) -> DataFrame:
    """Stored excerpts (dossier_id, ord, text) by their score against a query, as many as fit a running budget."""
    scored = lexical.with_score(excerpts, query, F.col("text"))
    w = Window.partitionBy("dossier_id").orderBy(F.desc("score"), "ord").rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("_end", F.sum(F.length("text") + 2).over(w) - 2).filter(F.col("_end") <= budget).drop("_end")


def profile_material(memories: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each profile: text of its memories and conversations, and their ids in order."""
    rows = memories.select("profile_id", F.lit(0).alias("lane"), "id", "text").unionByName(conversations.select("profile_id", F.lit(1).alias("lane"), "id", "text"))
    got = rows.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("lane", "id", "text"))).alias("r"))
    ids = lambda lane: F.transform(F.filter("r", lambda x: x["lane"] == lane), lambda x: x["id"])
    return got.select("profile_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"), ids(0).alias("memory_ids"), ids(1).alias("conversation_ids"))


def in_scope(profiles: DataFrame, roots: DataFrame, projects: list[str]) -> DataFrame:
    """profile_id, in_scope: whether every conversation of a profile belongs to one of the projects.

    profiles: profile_id, conversation_id; roots: conversation_id, root.
    """
    inside = F.coalesce(F.col("root").isin(projects), F.lit(False))
    return profiles.join(roots, "conversation_id", "left").groupBy("profile_id").agg(F.bool_and(inside).alias("in_scope"))


def best_per_date(evidence: DataFrame, dates: list[str], budget: int) -> DataFrame:
    """For each wanted date its best row (score, then length), within a budget shared equally."""
    best = evidence.filter(F.col("date").isin(dates)).groupBy("date").agg(F.max_by(F.struct("id", "text"), F.struct("score", F.length("text"), "id")).alias("b"))
    share = max(240, budget // max(1, len(dates)))
    return best.select("date", "b.id", T.compact_source_middle(F.col("b.text"), share).alias("text"))


def distinct_excerpts(evidence: DataFrame, keys: list[str], limit: int, budget: int) -> DataFrame:
    """The first distinct rows (id, start, end) of each key that fit the budget, `limit` at most."""
    once = evidence.filter(T.strip(F.col("text")) != "").groupBy(*keys, "id", "start", "end").agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"))
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return once.withColumn("_end", F.sum(F.length("text") + 2).over(w) - 2).withColumn("_n", F.count(F.lit(1)).over(w)).filter((F.col("_end") <= budget) & (F.col("_n") <= limit)).drop("_end", "_n")


# The kinds of sources that a summary names, in their order.
SUMMARY_KINDS = ("chunk", "file", "dossier", "memory")


def summary(sources: DataFrame, limit: int) -> DataFrame:
    """The first sources of the summarised kinds, by kind and then as they came."""
    rank = F.array_position(F.array(*map(F.lit, SUMMARY_KINDS)), F.col("kind"))
    return sources.withColumn("_k", rank).filter("_k > 0").orderBy("_k", "ord").limit(limit).drop("_k")


def signal(rows: DataFrame) -> Column:
    """The greatest of a source's scores."""
    names = [c for c in ("score", "hybrid_score", "lexical_score", "structured_score", "evidence_score", "vector_score", "rerank_score") if c in rows.columns]
    return F.greatest(F.lit(0.0), *(F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0)) for c in names)) if names else F.lit(0.0)


def diagnosis(report: DataFrame) -> DataFrame:
    """notes of each debug report (files, chunks, selected, best_score, warnings)."""
    notes = F.array(
        F.when(F.col("files") == 0, F.lit("the index has no files")),
        F.when((F.col("files") > 0) & (F.col("chunks") == 0), F.lit("no chunk was scored")),
        F.when((F.col("chunks") > 0) & (F.col("best_score") <= 0), F.lit("no chunk matched the query's terms")),
        F.when((F.col("best_score") > 0) & (F.col("selected") == 0), F.lit("matches were found, none was selected")),
        F.when(F.col("warnings") > 0, F.lit("the index has warnings")),
    )
    return report.withColumn("notes", F.filter(notes, lambda n: n.isNotNull()))


def source_label(kind: Column, label: Column, start: Column, end: Column) -> Column:
    """How a span is named in a list of sources."""
    return F.concat_ws(" ", kind, F.nullif(label, F.lit("")), F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("chars "), start.cast("string"), F.lit("-"), end.cast("string"))))
