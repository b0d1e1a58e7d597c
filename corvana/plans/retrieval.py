"""Hybrid retrieval of chunks: gate, lanes, fusion, selection and packing, as one lazy plan; attached context and a second pass.

Model calls (embedding, reranking) are pluggable; without them hashed vectors and
dot products stand in, so that everything runs without a network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import corpus, dossiers, fusion, lexical, spans, vectors
from corvana.plans.planner import Plan, build_plan

#: Chunks that stand in where no chunk scores, and evidence rows that a question asks for at least.
FALLBACK_CHUNKS, EVIDENCE_ROWS = 2, 24
SHOWN = ["place", "path", "chunk", "methods", "hybrid_score", "base", "guard", "text"]


@dataclass
class Environment:
    """What a caller may bring: embed (query -> vector), rerank (candidates, query -> path, chunk, rerank), stored
    vectors, evidence rows (path, chunk, kind, title, tags, todo, priority, date, start, text, base_score), tasks
    (path, chunk, score: structured tasks), and reasons why indexes are blocked (index_id, reason). With stores
    (store_id, created, fingerprint) and the fingerprint of the sources, vectors of the newest fresh store count alone."""

    embed: Callable[[str], list[float]] | None = None
    rerank: Callable[[DataFrame, str], DataFrame] | None = None
    vectors: DataFrame | None = None
    evidence: DataFrame | None = None
    tasks: DataFrame | None = None
    boundaries: DataFrame | None = None
    stores: DataFrame | None = None
    fingerprint: str = ""


def gate(chunks: DataFrame, boundaries: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks of indexes that may be read, one warning for each index that may not): a blocked index gives no text."""
    if boundaries is None:
        return chunks, None
    blocked = boundaries.filter(F.coalesce("reason", F.lit("")) != "")
    warned = blocked.groupBy("index_id").agg(F.min("reason").alias("warning")).select("index_id", F.lit("blocked").alias("status"), "warning")
    return chunks.join(blocked.select("index_id"), "index_id", "left_anti"), warned


def scored_chunks(chunks: DataFrame, plan: Plan) -> DataFrame:
    """Chunks with the parts of their lexical score."""
    return lexical.score_parts(chunks, plan.query, F.concat_ws("\n", "path", "summary", "content"), F.col("path"))


def lexical_lane(chunks: DataFrame, plan: Plan) -> DataFrame:
    """The best chunks, in one pass; where none scores, the first ones."""
    top = scored_chunks(chunks, plan).orderBy(F.desc("total"), "path", "chunk").limit(plan.limits.rerank)
    # At most limits.rerank rows are put in one order.
    placed = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("total"), "path", "chunk"))).withColumn("_best", F.max("total").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = placed.filter((F.col("total") > 0) | ((F.col("_best") <= 0) & (F.col("_r") <= FALLBACK_CHUNKS)))
    return fusion.lane(kept, "lexical", score=F.col("total"), path_boost=F.col("path_boost"), total=F.col("total"))


def two_level(chunks: DataFrame, plan: Plan, per_file: int) -> DataFrame:
    """path, chunk, total, file_score, summary, place: the best chunks of each of the best files.

    A file's score is that of its path and summary with the path's boost; chunks of a file share their
    summary, so that files and chunks are ranked from one scan. The limit of a file's chunks holds
    below the exchange by path: at most per_file rows of a file leave a task.
    """
    own = F.concat_ws("\n", "path", "summary")
    parts = lexical.with_score(scored_chunks(chunks, plan), plan.query, own, "_own").withColumn("file_score", F.col("_own") + F.col("path_boost"))
    w = Window.partitionBy("path").orderBy(F.desc("total"), "chunk")
    limited = parts.select("path", "chunk", "total", "file_score", "summary").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_file)
    # The rows of a path are together already; a file's list holds per_file of them.
    files = limited.groupBy("path").agg(F.max("file_score").alias("file_score"), F.min("summary").alias("summary"), F.collect_list(F.struct("chunk", "total", "place")).alias("best"))
    top = files.filter("file_score > 0").orderBy(F.desc("file_score"), "path").limit(plan.limits.files)
    return top.select("path", "file_score", "summary", F.explode("best").alias("b")).select("path", "b.chunk", "b.total", "file_score", "summary", "b.place")


def best_files(chunks: DataFrame, plan: Plan) -> DataFrame:
    """path, score, summary of the best files, best first."""
    return two_level(chunks, plan, 1).select("path", F.col("file_score").alias("score"), "summary").orderBy(F.desc("score"), "path")


def fresh_vectors(vectors_: DataFrame, stores: DataFrame, fingerprint: str) -> DataFrame:
    """Vectors (store_id) of the newest store (store_id, created, fingerprint) that was made from the sources as they are; none if all are stale."""
    newest = stores.filter(F.col("fingerprint") == fingerprint).orderBy(F.desc("created"), F.desc("store_id")).limit(1).select("store_id")
    return vectors_.join(F.broadcast(newest), "store_id", "left_semi")  # one row


def temporal_lane(chunks: DataFrame, plan: Plan) -> DataFrame:
    """Dated sections with the dates a query names, else those of the newest dates in files that answer to it.

    A file answers by its path, or by a score of path and summary. A chunk bounds the number of its sections.
    """
    exact = bool(plan.dates)
    rows = chunks.withColumn("boost", T.path_boost(F.lit(plan.query), F.col("path")))
    if plan.paths:
        rows = rows.filter("boost > 0")
    elif not exact:
        rows = rows.filter((F.col("boost") > 0) | (lexical.score(lexical.query_terms(plan.query), F.concat_ws("\n", "path", "summary")) > 0))
    dated = rows.filter(F.col("content").rlike(r"\d{4}-\d{2}-\d{2}")).select("path", "chunk", "boost", F.explode(spans.dated(F.col("content"))).alias("s"))
    found = dated.select("path", "chunk", "boost", F.col("s.label").alias("date"), "s.start", "s.text").filter("text != ''")
    found = found.filter(F.col("date").isin(plan.dates)) if exact else spans.newest_dates(found, "date", plan.recent)
    total = F.lit(9000 if exact else 8000) + F.col("boost")
    return fusion.lane(found, "temporal", score=total, path_boost=F.col("boost"), structured=F.lit(7000 if exact else 6000), date=F.col("date"), total=total)


def structural_rows(evidence: DataFrame, plan: Plan) -> DataFrame:
    """Evidence rows of outlines that satisfy all structural filters of a query, with structured, lexical and total."""
    rows = evidence.filter(F.col("kind").startswith("org_")).withColumn("boost", T.path_boost(F.lit(plan.query), F.col("path")))
    score = F.lit(6500) + F.col("boost")
    if plan.paths:
        rows = rows.filter("boost > 0")
    if plan.tags:
        rows, score = rows.filter(F.size(F.array_except(F.array(*map(F.lit, plan.tags)), "tags")) == 0), score + 1200 * len(plan.tags)
    if plan.todo:
        rows, score = rows.filter(F.upper("todo").isin(plan.todo)), score + 900
    if plan.priorities:
        rows, score = rows.filter(F.upper("priority").isin(plan.priorities)), score + 700
    for flag in ("deadline", "scheduled"):
        if plan.flags.get(flag):
            rows, score = rows.filter(F.col("text").contains(f"{flag.upper()}:")), score + 500
    if plan.flags.get("heading"):
        rows = rows.filter(F.col("kind").isin("org_heading", "org_day", "org_task"))
    haystack = F.concat_ws("\n", "path", "kind", "title", F.array_join("tags", " "), "text")
    return rows.withColumn("structured", score.cast("long")).withColumn("lexical", lexical.score(lexical.query_terms(plan.query), haystack)).withColumn("total", F.col("structured") + F.col("lexical"))


def structural_lane(evidence: DataFrame, plan: Plan) -> DataFrame:
    order = [F.desc("total"), F.desc("structured"), F.desc("path"), F.asc("start")]
    top = structural_rows(evidence, plan).orderBy(*order).limit(max(4 * plan.limits.chunks, 3 * plan.limits.evidence))
    return fusion.lane(top, "structural", score=F.col("total"), path_boost=F.col("boost"), structured=F.col("structured"), date=F.nullif("date", F.lit("")), total=F.col("total"))


def evidence_lane(evidence: DataFrame, plan: Plan) -> DataFrame:
    """The best evidence rows of a question, of whatever kind."""
    top = corpus.evidence_query(evidence, plan.query, F.col("path"), max(3 * plan.limits.chunks, EVIDENCE_ROWS)).orderBy(F.desc("total"), "path", "chunk", "start").limit(max(2 * plan.limits.chunks, plan.limits.evidence))
    boost = T.path_boost(F.lit(plan.query), F.col("path"))
    return fusion.lane(top, "evidence", score=F.col("total"), path_boost=boost, date=F.nullif("date", F.lit("")), total=F.col("total"))


def vector_lane(stored: DataFrame, plan: Plan, vector: list[float]) -> DataFrame:
    ranked = vectors.rank(stored, vector, plan.query)
    best = vectors.best_per_key(ranked.withColumn("ord", F.xxhash64("id")), ["path", "chunk"], "ord")
    top = best.orderBy(F.desc("score"), "path", "chunk").limit(max(plan.limits.chunks, plan.limits.rerank))
    return fusion.lane(top, "vector", path_boost=F.col("path_boost"), vector_score=F.col("vector_score"))


def task_lane(tasks: DataFrame, plan: Plan) -> DataFrame:
    """Chunks with open tasks, for questions that ask for tasks."""
    asks = bool(corpus.TASK_WORDS & set(lexical.query_terms(plan.query)))
    top = tasks.filter(F.lit(asks) & (F.col("score") > 0)).orderBy(F.desc("score"), "path", "chunk").limit(plan.limits.chunks)
    return fusion.lane(top, "structured", score=F.col("score"), total=F.col("score"))


def candidates(chunks: DataFrame, plan: Plan, env: Environment) -> DataFrame:
    lanes = [lexical_lane(chunks, plan)]
    if env.tasks is not None:
        lanes.append(task_lane(env.tasks, plan))
    if plan.has("code"):
        rows = lexical.code_rows(chunks, plan.query)
        lanes.append(fusion.lane(rows, "code", score=F.col("total"), path_boost=F.col("path_boost"), total=F.col("total")))
    if plan.dated:
        lanes.append(temporal_lane(chunks, plan))
    if env.evidence is not None:
        lanes += [structural_lane(env.evidence, plan)] * plan.has("structural") + [evidence_lane(env.evidence, plan)]
    if env.vectors is not None and env.embed is not None:
        stored = env.vectors if env.stores is None else fresh_vectors(env.vectors, env.stores, env.fingerprint)
        lanes.append(vector_lane(stored, plan, env.embed(plan.query)))
    return fusion.restrict(fusion.fuse(lanes, max(24, plan.limits.evidence) if plan.has("structural") else plan.limits.evidence))


def retrieve(chunks: DataFrame, query: str, env: Environment | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """place, path, chunk, methods, scores and text of the chunks that answer a query, within its character budget.

    chunks: path, chunk, summary, content, and index_id where indexes may be blocked.
    Candidates are few by the lanes' limits, so only they are ordered, and contents are
    joined back to the selected keys alone.
    """
    env, plan = env or Environment(), build_plan(query)
    if evidence is not None:
        env = replace(env, evidence=evidence)
    chunks, _ = gate(chunks, env.boundaries)
    found = candidates(chunks, plan, env)
    scores = env.rerank(found, query) if env.rerank else None
    ranked = fusion.rerank(found, scores, plan.limits.rerank)
    chosen = fusion.select_required(ranked, plan.limits.chunks, plan.dates, "code")
    texts = chunks.select("path", F.col("chunk").cast("string").alias("chunk"), "content")
    rows = texts.join(F.broadcast(chosen), ["path", "chunk"])  # limits.chunks rows, three of code and one for each date of the query
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # Of each chunk the sections of the dates asked for, else the best spans, within its share.
    told = spans.with_selection(rows, "content", query, max(240, plan.limits.chars // 4), "text")
    sized = told.withColumn("_end", F.sum(F.length("text") + 2).over(w))
    return sized.filter((F.col("_end") - F.length("text") - 2) < plan.limits.chars).select(SHOWN)


# Explaining


def explain_files(chunks: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """path, summary, lexical, path_boost, total, matched_terms of the files that come first for a question."""
    files = chunks.groupBy("path").agg(F.min("summary").alias("summary"))
    parts = lexical.score_parts(files, query, F.concat_ws("\n", "path", "summary"), F.col("path"))
    return parts.orderBy(F.desc("total"), "path").limit(limit).select("path", T.compact(F.col("summary"), 280).alias("summary"), "lexical", "path_boost", "total", "matched_terms")


def explain_chunks(chunks: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """path, chunk, lexical, path_boost, total and what of a question is in the summary and at the content's beginning, of the chunks that come first."""
    plan = build_plan(query)
    top = scored_chunks(chunks, plan).orderBy(F.desc("total"), "path", "chunk").limit(limit)
    terms = list(lexical.query_terms(query))
    shared = lambda text: F.slice(T.shared_terms(terms, text), 1, 12)
    return top.select("path", "chunk", "lexical", "path_boost", "total", shared(F.col("summary")).alias("summary_terms"), shared(F.substring("content", 1, 4000)).alias("content_terms"))


# Attached context


@dataclass
class Service:
    """Tables of a state folder behind one facade: chunks (index_id, path, chunk, summary, content), excerpts of
    dossiers and topics (kind, dossier_id, ord, text), files (path, content)."""

    spark: SparkSession
    chunks: DataFrame
    excerpts: DataFrame | None = None
    files: DataFrame | None = None
    env: Environment = field(default_factory=Environment)
    budget: int = 12_000
    summaries: bool = False  # with the summaries of the best files, at place 0

    COLUMNS = "item int, kind string, id string, status string, place int, path string, text string, warning string"

    def retrieve_index(self, index_id: str, query: str) -> DataFrame:
        """Rows of an index that answer a query, or its one warning if it is blocked."""
        mine = self.chunks.filter(F.col("index_id") == index_id)
        allowed, warned = gate(mine, self.env.boundaries)
        rows = retrieve(allowed, query, replace(self.env, boundaries=None)).select(F.lit("ok").alias("status"), "place", "path", "text", F.lit("").alias("warning"))
        if self.summaries:
            files = best_files(allowed, build_plan(query)).filter("summary <> ''")
            rows = rows.unionByName(files.select(F.lit("ok").alias("status"), F.lit(0).alias("place"), "path", F.col("summary").alias("text"), F.lit("").alias("warning")))
        if warned is None:
            return rows
        warnings = warned.filter(F.col("index_id") == index_id).select("status", F.lit(0).alias("place"), F.lit("").alias("path"), F.lit("").alias("text"), "warning")
        return rows.unionByName(warnings)

    def _rows(self, item: dict, query: str) -> DataFrame | None:
        kind, key = item.get("kind"), str(item.get("id", ""))
        if kind == "index":
            return self.retrieve_index(key, query)
        if kind in ("topic", "dossier") and self.excerpts is not None:
            own = self.excerpts.filter((F.col("kind") == kind) & (F.col("dossier_id") == key))
            found = dossiers.from_dossier(own, query, self.budget)
            return found.select(F.lit("ok").alias("status"), F.row_number().over(Window.partitionBy("dossier_id").orderBy(F.desc("score"), "ord")).alias("place"), F.lit("").alias("path"), "text", F.lit("").alias("warning"))
        if kind in ("file", "repo") and self.files is not None:
            one = self.files.filter((F.col("path") == key) if kind == "file" else F.col("path").startswith(key.rstrip("/") + "/"))
            return one.select(F.lit("ok").alias("status"), F.lit(1).alias("place"), "path", spans.term_window(F.col("content"), query, self.budget).alias("text"), F.lit("").alias("warning"))
        return None

    def _known(self) -> DataFrame:
        """kind, id of everything that may be attached."""
        known = [self.chunks.select(F.lit("index").alias("kind"), F.col("index_id").cast("string").alias("id")).distinct()]
        if self.excerpts is not None:
            known.append(self.excerpts.select("kind", F.col("dossier_id").cast("string").alias("id")).distinct())
        if self.files is not None:
            known.append(self.files.select(F.lit("file").alias("kind"), F.col("path").alias("id")).distinct())
        return reduce(DataFrame.unionByName, known)

    def attached(self, items: list[dict], query: str) -> DataFrame:
        """Rows of all attached items by kind; an item that is not there, or of an unknown kind, is a warning."""
        asked = self.spark.createDataFrame([(k, str(i.get("kind")), str(i.get("id", ""))) for k, i in enumerate(items)], "item int, kind string, id string")
        lost = asked.filter("kind <> 'repo'").join(self._known(), ["kind", "id"], "left_anti").select("item", "kind", "id", F.lit("unavailable").alias("status"), F.lit(0).alias("place"), F.lit("").alias("path"), F.lit("").alias("text"), F.concat(F.lit("no "), "kind", F.lit(" "), "id").alias("warning"))
        parts = [lost]
        for k, item in enumerate(items):
            rows = self._rows(item, query)
            if rows is not None:
                parts.append(rows.select(F.lit(k).alias("item"), F.lit(item["kind"]).alias("kind"), F.lit(str(item.get("id", ""))).alias("id"), "status", "place", "path", "text", "warning"))
        return reduce(DataFrame.unionByName, parts)

    def expand(self, decision: dict, query: str) -> DataFrame:
        """What a second pass adds (see grounding.expansions): the rows of the one chosen item, none without one."""
        chosen = [{"kind": decision["kind"], "id": decision["id"]}] if decision.get("decision") == "expand" else []
        return self.attached(chosen, query)

    def query_vector(self, query: str, limit: int) -> DataFrame:
        """The best stored vectors of a question, one for each chunk; none without a way to embed."""
        if self.env.vectors is None or self.env.embed is None:
            raise ValueError("no stored vectors, or no way to embed a question")
        ranked = vectors.rank(self.env.vectors, self.env.embed(query), query)
        best = vectors.best_per_key(ranked.withColumn("ord", F.xxhash64("id")), ["path", "chunk"], "ord")
        return best.orderBy(F.desc("score"), "path", "chunk").limit(limit)
