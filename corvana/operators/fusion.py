"""Fusion of candidate lanes, rerank order, and rows that must be selected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANE = "path string, chunk string, method string, score double, path_boost double, task_boost double, structured double, vector_score double, date string, total double"
EVIDENCE_LIMIT, GUARD_PATH, GUARD_TASK = 8, 2000.0, 120.0


def lane(rows: DataFrame, method: str, **columns: Column) -> DataFrame:
    """Rows of a lane in the shape that fuse() takes; missing parts are 0 or null."""
    zero = F.lit(0.0)
    given = {"path": F.col("path"), "chunk": F.col("chunk").cast("string"), "method": F.lit(method), "score": F.col("score"), "path_boost": zero, "task_boost": zero, "structured": zero, "vector_score": F.lit(None), "date": F.lit(None), "total": F.col("score")} | columns
    kinds = dict(x.rsplit(" ", 1) for x in LANE.split(", "))
    return rows.select(*(given[name].cast(kind).alias(name) for name, kind in kinds.items()))


def fuse(lanes: list[DataFrame], evidence_limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """One row for each path and chunk: the best score of each lane, the methods, and the best evidence rows.

    One shuffle over all lanes; the evidence kept for a key is bounded while it is collected
    only by the number of its lane rows, which the lanes' own limits bound.
    """
    rows = reduce(DataFrame.unionByName, lanes)
    m = F.col("method")
    best = lambda when, value: F.coalesce(F.max(F.when(when, value)), F.lit(0.0))
    proof = m.isin("evidence", "temporal", "structural")
    fused = rows.groupBy("path", "chunk").agg(
        F.sort_array(F.collect_set("method")).alias("methods"),
        best(m == "lexical", F.col("score")).alias("lexical_score"),
        best(m == "vector", F.col("score")).alias("vector_rank_score"),
        F.max(F.when(m == "vector", F.col("vector_score"))).alias("vector_score"),
        F.greatest(best(m.isin("structured", "code"), F.col("score")), best(proof, F.col("structured"))).alias("structured_score"),
        best(proof, F.col("score")).alias("evidence_score"),
        best(m != "structured", F.col("path_boost")).alias("path_boost"),
        F.greatest(best(m == "lexical", F.col("task_boost")), best(m == "structured", F.col("score"))).alias("task_boost"),
        F.slice(F.sort_array(F.collect_list(F.when(proof | (m == "code"), F.struct("total", "date", "method"))), False), 1, evidence_limit).alias("evidence"),
    )
    return fused.withColumn("base", base_score()).withColumn("guard", guard_bonus())


def base_score() -> Column:
    return F.greatest("lexical_score", "vector_rank_score", "structured_score", "evidence_score")


def guard_bonus() -> Column:
    return F.least(F.col("path_boost"), F.lit(GUARD_PATH)) + F.least(F.col("task_boost"), F.lit(GUARD_TASK))


def restrict(candidates: DataFrame) -> DataFrame:
    """Only candidates of the temporal lane if there are any, else only those of the structural lane, else all."""
    flags = candidates.agg(F.coalesce(F.bool_or(F.array_contains("methods", "temporal")), F.lit(False)).alias("t"), F.coalesce(F.bool_or(F.array_contains("methods", "structural")), F.lit(False)).alias("s"))
    out = candidates.join(F.broadcast(flags))  # one row
    return out.filter(F.when(F.col("t"), F.array_contains("methods", "temporal")).when(F.col("s"), F.array_contains("methods", "structural")).otherwise(True)).drop("t", "s")


def rerank(candidates: DataFrame, rerank_scores: DataFrame | None, first: int) -> DataFrame:
    """Candidates with hybrid_score and place; the first ones by score are reordered by their rerank scores.

    rerank_scores: path, chunk, rerank. Ties go by path and chunk. Only keys and scores
    of the first rows are ranked; the others keep their order after them.
    """
    order = [F.desc("base"), F.desc("guard"), "path", "chunk"]
    if rerank_scores is None:
        return candidates.withColumn("hybrid_score", F.bround("base", 6)).withColumn("phase", F.lit(1))
    head = candidates.orderBy(*order).limit(first).select("path", "chunk").join(rerank_scores, ["path", "chunk"], "left").select("path", "chunk", F.coalesce("rerank", F.lit(0.0)).alias("rerank"))
    out = candidates.join(F.broadcast(head), ["path", "chunk"], "left")  # at most `first` rows
    mixed = F.bround(F.col("base") * 0.2 + F.col("rerank") * 1000 + F.col("guard"), 6)
    return out.withColumn("hybrid_score", F.coalesce(mixed, F.bround("base", 6))).withColumn("phase", F.when(F.col("rerank").isNotNull(), 0).otherwise(1)).drop("rerank")


def ordered(ranked: DataFrame) -> list[Column]:
    return [F.asc("phase"), F.desc("hybrid_score"), F.desc("base"), F.desc("guard"), F.asc("path"), F.asc("chunk")]


def select_required(ranked: DataFrame, limit: int, dates: list[str], method: str = "", least: int = 3) -> DataFrame:
    """The first `limit` rows; for each date that none of them has, the best row with it; then rows of a method.

    Of the method's rows that were left out, as many follow as make `least` of it, and one at least.
    """
    order = ordered(ranked)
    w = Window.orderBy(*order)
    top = ranked.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(w))
    if dates:
        have = top.select(F.explode("evidence.date").alias("date")).distinct()
        dated = ranked.withColumn("date", F.explode(F.array_distinct("evidence.date"))).filter(F.col("date").isin(dates)).join(F.broadcast(have), "date", "left_anti")
        best = dated.groupBy("date").agg(F.min_by(F.struct(*ranked.columns), F.struct("phase", -F.col("hybrid_score"), -F.col("base"), -F.col("guard"), "path", "chunk")).alias("r")).select("r.*")
        extra = best.dropDuplicates(["path", "chunk"]).withColumn("place", limit + F.row_number().over(w))
        top = top.unionByName(extra)
    if not method:
        return top
    mine = F.array_contains("methods", method)
    n = top.agg(F.count_if(mine).alias("_have"), F.coalesce(F.max("place"), F.lit(0)).alias("_last"))
    # At most limit rows and one a date are chosen by now, and `least` more are looked at.
    left = ranked.filter(mine).join(F.broadcast(top.select("path", "chunk")), ["path", "chunk"], "left_anti").orderBy(*order).limit(least)
    more = left.withColumn("_r", F.row_number().over(w)).join(F.broadcast(n)).filter(F.col("_r") <= F.greatest(F.lit(1), least - F.col("_have")))
    return top.unionByName(more.withColumn("place", (F.col("_last") + F.col("_r")).cast("int")).drop("_r", "_have", "_last"))
