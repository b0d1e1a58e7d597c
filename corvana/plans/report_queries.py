"""Queries of embedding stores, clean-up plans, grounding, feedback, slots, span rows and explanations, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import audit, cleanup, grounding, lexical, skills, spans, stores
from corvana.plans import retrieval
from corvana.plans.tables import TERMS_SQL, first_question, score_sql, table

NOW = "2024-06-01T00:00:00"


def _at(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


# Embedding stores


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id"), F.concat(F.lit("i"), F.col("doc_id") % 4).alias("index_id"), F.col("source").alias("path"), F.col("doc_id").alias("chunk"), "text", T.sha256(F.col("text")).alias("content_sha256"), F.concat_ws(" ", "lang", "source").alias("summary"), "lang")
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("id"), "index_id", "path", "chunk", "text", "content_sha256", "summary")
    proof = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("e"), "doc_id").alias("id"), "index_id", "path", "chunk", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("x"), F.substring("text", 1, 40))).alias("text"), "content_sha256", "summary", F.col("lang").alias("evidence_title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("excerpt "), "lang")).otherwise("").alias("evidence_excerpt"))
    return stores.candidates(chunks, proof)


def store_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("id", "lane", F.length("text").alias("chars"))


def store_rows(spark: SparkSession, sf: str) -> DataFrame:
    found = _candidates(spark, sf)
    embedded = found.filter("chunk % 2 = 0").select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    return stores.vector_rows(found, embedded, "v3").select("id", "kind", "embedding_kind", F.col("embedding_input_chars").cast("long").alias("chars"), "embedding_input_sha256", "summary", "evidence_title")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as runs that embed an index by a route."""
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.cast("string").alias("store_id"), F.concat(F.lit("i"), s).alias("index_id"), F.col("s_name").alias("name"), F.lit("/r").alias("root"), F.lit("2024-01-01").alias("index_created"), F.when(s % 2 == 0, "*.md").otherwise("").alias("glob"), F.lit("fam").alias("family_key"), T.sha256(F.col("s_name")).alias("fingerprint"),
        F.concat(F.lit("r"), s % 3).alias("route_id"), F.lit("model-x").alias("route_model"), (s % 5 * 100).alias("route_dims"), F.lit(None).cast("string").alias("request_path"), F.lit(4).alias("max_parallel"),
        (s % 7 * 10).alias("expected_rows"), (s % 7 * 5).alias("completed_rows"), (s % 3).alias("checkpoint_rows"), (s % 2).alias("previous_rows"), F.lit("old").alias("previous_store"), F.lit(60.0).alias("elapsed"),
    )


def progress_ids(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf).select("store_id", F.col("route_dims").alias("embedding_dimensions"), F.lit(None).cast("long").alias("embedding_input_bytes"), F.lit(8000).alias("embedding_input_chars"), F.lit("in-v2").alias("embedding_input_schema"), F.lit(8).alias("embedding_max_parts_per_chunk"), F.lit("dense").alias("method"), F.col("route_model").alias("model"), F.col("route_id").alias("route"), F.lit("p1").alias("schema"), F.col("fingerprint").alias("source_fingerprint"), F.concat(F.lit('say "'), "name", F.lit('"')).alias("source_index"), F.lit("s1").alias("target_schema"), F.lit("rows-v1").alias("vector_row_id_schema"))
    return stores.progress_key(runs).select("store_id", "progress_id")


def progress_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = stores.progress_records(_runs(spark, sf).withColumn("progress_id", F.col("store_id")))
    return rows.select("progress_id", "source_index.glob", F.col("embedding_route.catalog_route").alias("route"), F.col("embedding_route.request_path").alias("request_path"), "expected_rows", "completed_rows", "eta_seconds")


def store_records(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("store_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("vector"))
    out = stores.store_records(runs, rows)
    return out.select("store_id", "row_count", F.col("dims").cast("long").alias("dims"), "reused_rows", "embedded_rows", "reuse_store_id", F.col("provenance.input_hash").alias("input_hash"))


def run_times(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runs: seconds since each began, and the age of their last sign of life."""
    e, now = F.col("event_id"), F.to_timestamp(F.lit(NOW))
    rows = table(spark, sf, "events").select("event_id", F.when(e % 3 > 0, _at("ts")).otherwise("no time").alias("created"), (F.col("value") * 0 + e % 100).alias("session"))
    return rows.select("event_id", stores.elapsed_seconds(F.col("created"), F.col("session"), now).alias("elapsed"), stores.age_seconds(F.col("created"), now).alias("age"), stores.vectors.progress_state(F.coalesce(stores.age_seconds(F.col("created"), now), F.lit(0)), e % 10 == 0, 5_000_000).alias("state"))


def vector_row_plans(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("raw_rows"), F.count_distinct("source").alias("files"))
    c = table(spark, sf, "conversations").agg(F.count_distinct("conv_id").alias("conversations"))
    return stores.row_plans(d.join(F.broadcast(c)), 64).drop("invalidates_on")  # one row each


def vector_gates(spark: SparkSession, sf: str) -> DataFrame:
    evaluation = table(spark, sf, "labels").agg(F.when(F.count_if(F.col("quality") == 0) == 0, "pass").otherwise("fail").alias("status"))
    lost = table(spark, sf, "documents").agg(F.count_if(F.col("doc_id") % 50 == 11).alias("missing_chunks"), F.lit(0).alias("missing_targets"))
    routes = table(spark, sf, "nation").select(F.col("n_name").alias("route"), F.when(F.col("n_nationkey") % 5 == 0, "embed").otherwise("chat").alias("task"))
    return stores.readiness_gates(evaluation, lost, routes)


def vector_inputs(spark: SparkSession, sf: str) -> DataFrame:
    asked = stores.query_input(F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("  --rerank "), "text")).otherwise(F.col("text")))
    return table(spark, sf, "benchmark").select("item_id", asked.alias("q")).select("item_id", "q.query", "q.rerank")


def route_identities(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return stores.route_identity(table(spark, sf, "nation").select(F.when(n % 2 == 0, F.col("n_name")).otherwise("").alias("catalog_route"), F.concat(F.lit("r"), n).alias("route"), F.when(n % 3 > 0, "m").alias("model"), F.when(n % 4 == 0, "x").otherwise(n.cast("string")).alias("embedding_dimensions")))


def reduced_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation reduced three by three to one text."""
    out = stores.reduced(table(spark, sf, "conversations"), "conv_id", "turn", "text", 3, lambda texts: F.array_join(texts, "|"))
    return out.select("conv_id", T.sha256(F.col("text")).alias("digest"))


# Clean-up


def _trees(spark: SparkSession, sf: str) -> list[cleanup.Family]:
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    topics = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("t"), n).alias("file"), F.concat(F.lit('{"source_index_id": "i'), n % 5, F.lit('", "conversation_id": '), n % 7, F.lit("}")).alias("json"))
    evals = d.filter("doc_id % 3 = 1").select(F.concat(F.lit("v"), n).alias("file"), F.concat(F.lit('{"note": "see /s/'), n % 11, F.lit('.md", "source_conversations": [{"id": "'), n % 7, F.lit('"}]}')).alias("json"))
    ledger = d.filter("doc_id % 3 = 2").select(F.lit("ledger").alias("file"), F.concat(F.lit('{"indexes": ["i'), n % 5, F.lit('"], "at": "/s/'), n % 11, F.lit('.md", "conversation_ids": ["'), n % 7, F.lit('"]}')).alias("json"))
    return [cleanup.Family("topic", "delete-derived", topics), cleanup.Family("eval", "", evals), cleanup.Family("actions", "rewrite", ledger, ledger=True)]


def lifecycle_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Records of three families that name one index or mention one source."""
    rows = cleanup.collect(_trees(spark, sf), "i1", ["/s/4.md", "/s/9.md"])
    return rows.select("cleanup_policy", "artifact_kind", "artifact_id", "by_index", F.array_join("source_paths", ",").alias("paths"), "row_count")


def index_path_keys(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    return cleanup.path_keys(table(spark, sf, "pages").select((n % 4).alias("index_id"), F.concat(F.lit(" ./p"), n % 100).alias("path"), F.concat(F.lit("/r/p"), n % 100).alias("resolved")))


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    o, n = table(spark, sf, "orders"), F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("fresh", "fresh", "changed", "deleted", "ignored"))), (n % 5 + 1).cast("int"))
    states = o.filter("o_custkey % 3 <> 0 OR o_orderkey % 5 < 2").select(F.col("o_custkey").alias("index_id"), n.alias("path"), status.alias("status"))
    records = o.filter("o_custkey % 4 > 0").select(F.col("o_custkey").alias("index_id"), F.when(n % 2 == 0, "delete-derived").otherwise("").alias("cleanup_policy"), (n % 100).alias("bytes_estimate"))
    ready = o.filter("o_custkey % 5 = 1").select(F.col("o_custkey").alias("index_id"), F.lit("new").alias("replacement_id"), F.lit(True).alias("ready")).distinct()
    return cleanup.cleanup_plans(states, records, ready)


def cleanup_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf)


def plan_summaries(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("index_id"), F.col("c_name").alias("name"), F.lit("/r").alias("root"))
    return cleanup.plan_summaries(_plans(spark, sf), names).select("index_id", "name", "recommended_action", "apply_status", "derived_bytes")


def storage_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    part = lambda k: d.filter(f"doc_id % 10 = {k}").select(F.col("n_chars").alias("bytes"))
    return cleanup.storage_sections(part(1), part(2), part(3), d.filter("doc_id % 10 IN (1, 4)").select("doc_id"), d.limit(0).select("doc_id"), d.filter("doc_id % 10 = 5").select("doc_id"))


def conversation_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What would go with one conversation, by family."""
    return cleanup.cascade(_trees(spark, sf), "3")


# Grounding and feedback


def grounding_needs(spark: SparkSession, sf: str) -> DataFrame:
    need = grounding.needs_sources(F.when(F.col("item_id") % 4 == 0, F.concat("text", F.lit(" in notes/a.md."))).otherwise(F.col("text")), ["the", "source"], ["task"])
    return table(spark, sf, "benchmark").select("item_id", need.alias("needed"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    n, v = F.col("turn"), F.col("conv_id")
    kinds = F.element_at(F.array(*map(F.lit, ("chunk", "memory", "file", "answer-audit", "recent-conversation"))), ((v + n) % 5 + 1).cast("int"))
    return table(spark, sf, "conversations").select(
        v.alias("answer_id"), v.alias("feedback_id"), n.alias("ord"), kinds.alias("kind"), F.array(F.when(v % 2 == 0, "vector").otherwise("lexical")).alias("methods"), F.when(n % 4 == 1, F.concat(F.lit("e"), n % 3)).otherwise("").alias("evidence_id"),
        (v % 3 * 1.0).alias("signal"), F.when((v + n) % 6 == 0, "stale").otherwise("fresh").alias("status"), F.concat(F.lit("dir/p"), n % 2, F.lit(".md")).alias("path"), F.lit("i1").alias("index"), (n % 3).alias("chunk"), F.when(n % 2 == 0, n * 1.0).alias("score"),
    )


def audited_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of each answer with one new audit in place of older ones."""
    audits = table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), F.lit("pass").alias("status")).distinct()
    out = grounding.with_audit(_sources(spark, sf).select("answer_id", "kind", "status"), audits)
    return out.groupBy("answer_id", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


def context_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sources(spark, sf).filter("answer_id % 4 > 0")
    heads = table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") % 8 == 0).alias("has_summary")).distinct()
    stored = table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), F.when(F.col("turn") % 2 == 0, "topic").otherwise("dossier").alias("kind"), F.concat(F.lit("x"), "turn").alias("id"), (F.col("turn") * 10).alias("score"), (F.col("conv_id") % 3 == 0).alias("attached"))
    return grounding.sufficiency(rows.filter("kind <> 'chunk' OR answer_id % 3 = 1"), heads, stored, 20)


def context_expansions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("conv_id")
    answers = table(spark, sf, "conversations").select(v.alias("answer_id"), (v % 7 > 0).alias("needed"), F.when(v % 3 == 0, F.array(F.lit("p9.md"))).when(v % 3 == 1, F.array(F.lit("p1.md"))).otherwise(F.array().cast("array<string>")).alias("paths")).dropDuplicates(["answer_id"])
    found = table(spark, sf, "conversations").filter("conv_id % 5 > 0").select(v.alias("answer_id"), F.lit("index").alias("kind"), F.concat(F.lit("i"), "turn").alias("id"), (F.col("turn") * 1.0).alias("score"))
    return grounding.expansions(answers, _sources(spark, sf), found, ["chunk", "file"], 1.0)


def compact_feedback_sources(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.compact_sources(_sources(spark, sf), 3).select("feedback_id", "ord", "kind", "path", "chunk", "score", "evidence_id")


def feedback_hints(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.source_hints(_sources(spark, sf)).select("feedback_id", "ord", "kind", "path")


def feedback_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("role = 'assistant'").groupBy(F.col("conv_id").alias("id")).agg(F.max("text").alias("reply"))
    rated = rows.withColumn("rating", F.when(F.col("id") % 3 == 0, "up").when(F.col("id") % 3 == 1, "ok").otherwise("down")).withColumn("note", F.lit("stale page")).withColumn("prompt", F.lit(""))
    out = grounding.fixtures(rated, _sources(spark, sf), "home")
    return out.select("id", "realm", "quality_status", F.array_join("focus", ",").alias("focus"), "reply_sha256", "source_paths", "source_evidence")


def memory_query_texts(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations")
    heads = m.select("conv_id", F.concat(F.lit("talk "), "conv_id").alias("title"), F.when(F.col("conv_id") % 2 == 0, "a summary").otherwise("").alias("summary")).distinct()
    return grounding.query_text(heads, m, "what now", 4)


def chat_content(spark: SparkSession, sf: str) -> DataFrame:
    v, m = F.col("conv_id"), table(spark, sf, "conversations")
    heads = m.select(v, F.when(v % 5 == 0, "s").otherwise(" ").alias("summary"), F.when(v % 7 == 0, F.array(F.lit(" "), F.lit("q"))).alias("queued")).distinct()
    return grounding.has_content(heads, m.filter("conv_id % 3 = 0"))


def goal_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as goals whose turns are their actions."""
    goals = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("goal_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda a: F.struct(a["role"].alias("kind"))).alias("actions"))
    return grounding.action_results(goals).withColumn("index", F.col("index").cast("long"))


def goals_completed(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.completed(table(spark, sf, "conversations").select(F.col("conv_id").alias("goal_id"), F.when(F.col("turn") % 3 == 0, "completed").otherwise("pending").alias("status")))


def readiness_checks(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.readiness(table(spark, sf, "labels").select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("passed")))


def _skills(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    return table(spark, sf, "benchmark").select(F.format_string("skill-%04d", n).alias("slug"), n.alias("ord"), F.lit("").alias("description"), F.col("text").alias("body"), (n % 3 == 0).alias("pinned"), F.lit(False).alias("builtin"), (n % 5).cast("int").alias("selected_count"), (n % 2).cast("int").alias("patch_count"), F.lit(0).alias("support_files"), F.format_string("2024-01-%02d", (n % 28 + 1).cast("int")).alias("created_at"), F.lit(False).alias("archived"), F.lit("2024").alias("updated_at"))


def skill_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """What a curator would look at first; tests hold it against plain Python."""
    feedback = table(spark, sf, "conversations").filter("role = 'user'").select(F.format_string("%06d-%03d", "conv_id", "turn").alias("id"), F.when(F.col("conv_id") % 2 == 0, "up").otherwise("down").alias("rating"), F.col("text").alias("note"), F.lit("").alias("prompt"))
    return grounding.suggestions(_skills(spark, sf), feedback, 40, F.lit("2024-03-01T00:00:00").cast("timestamp"), 40).withColumn("place", F.col("place").cast("long"))


def skill_support(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as support files of skills: the two of each that share most with the first question."""
    files = table(spark, sf, "pages").select(F.format_string("skill-%d", (F.col("page_id") % 20).cast("int")).alias("slug"), F.col("url").alias("file"), F.col("html").alias("content"), F.col("page_id").cast("string").alias("updated_at"))
    return skills.support_files(files, first_question(spark, sf)).select("slug", "file", F.col("score").cast("long").alias("score"))


def skills_rendered(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(F.format_string("skill-%04d", (F.col("page_id") % 20).cast("int")).alias("slug"), F.col("url").alias("file"), F.col("html").alias("content"), F.lit("").alias("updated_at"))
    return skills.rendered(_skills(spark, sf), files, first_question(spark, sf), 12, 4000).select("slug", F.col("place").cast("long").alias("place"))


# Slots


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf, "events").select(
        n.alias("ord"), F.when(n % 11 == 0, "old").otherwise(audit.SLOT_SCHEMA).alias("schema"), F.col("user_id").cast("string").alias("conversation_id"), F.when(n % 13 == 0, "other").when(n % 2 == 0, "default").alias("client_namespace"), F.concat(F.lit("f"), n % 3).alias("route_fingerprint"), F.concat(F.lit("r"), n % 3).alias("catalog_route"),
        F.when(n % 5 == 0, "failed").otherwise("saved").alias("status"), F.when(n % 7 > 0, _at("ts")).alias("updated"), _at("ts").alias("created"), F.concat(F.lit("s"), n % 4).alias("filename"), F.when(n % 4 > 0, F.floor(F.abs("value") * 10)).cast("long").alias("bytes"),
    )


def slot_latest(spark: SparkSession, sf: str) -> DataFrame:
    return audit.latest_slot(_slots(spark, sf)).select("conversation_id", "route_fingerprint", "ord")


def slot_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return audit.observed_bytes(_slots(spark, sf), "r1")


def slots_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of all records, read back and cut to those that were updated last."""
    whole = _slots(spark, sf).withColumn("_m", F.floor(F.col("ord") / 500))
    manifest = whole.groupBy("_m").agg(F.lit(audit.SLOT_SCHEMA).alias("schema"), F.array_sort(F.collect_list(F.struct(F.col("ord").alias("id"), "updated", "created"))).alias("records"))
    return audit.kept_slots(audit.read_slots(manifest.filter("_m = 1")), 50).select("id")


def slot_upserts(spark: SparkSession, sf: str) -> DataFrame:
    old = audit.latest_record(_slots(spark, sf), audit.SLOT_KEY).select(*audit.SLOT_KEY, "status", "bytes")
    new = old.filter("conversation_id LIKE '%1'").select(*audit.SLOT_KEY, F.lit("deleted").alias("status"), F.lit(None).cast("long").alias("bytes"))
    return audit.upsert_slots(old, new).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


# Spans and explanations


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(n.alias("id"), F.lit("text-window").alias("kind"), F.when(n % 2 == 0, "a label").otherwise("").alias("label"), "text", F.lit(0).alias("start"), F.length("text").alias("end"), F.when(n % 3 == 0, F.substring("text", 5, 50)).alias("sub_text"), F.when(n % 6 == 0, F.lit(4)).alias("sub_start"), F.when(n % 6 == 0, F.lit(54)).alias("sub_end"))


def effective_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.effective(_spans(spark, sf)).select("id", T.sha256(F.col("text")).alias("digest"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def model_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select("id", spans.model_text(F.col("kind"), F.col("label"), F.col("text"), 300).alias("model_text"))


def model_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the spans of every document as a model reads them."""
    found = _spans(spark, sf).select("id", F.array(F.struct("kind", "label", "text", "start", "end")).alias("spans"))
    return spans.model_rows(found, 400, 3).select("id", F.col("part").cast("long").alias("part"), F.col("start").cast("long").alias("start"), F.length("model_text").cast("long").alias("chars"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id") % 7, F.lit(".md")).alias("path"), F.col("doc_id").alias("chunk"), F.col("source").alias("summary"), F.col("text").alias("content"), F.concat(F.lit("i"), F.col("doc_id") % 3).alias("index_id"))


def explain_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = retrieval.explain_chunks(_chunks(spark, sf), first_question(spark, sf))
    return out.select("path", "chunk", "lexical", "total")


def explain_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as files, ranked by path and summary for a question that names one of them."""
    out = retrieval.explain_files(_chunks(spark, sf), "what is in 3.md of the web", 10)
    return out.select("path", "path_boost")


def lexical_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The lexical lane of the first question over documents as chunks."""
    plan = retrieval.build_plan(first_question(spark, sf))
    return retrieval.lexical_lane(_chunks(spark, sf), plan).select("path", "chunk", "score")


def lexical_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Where no chunk scores, the first two stand in."""
    return retrieval.lexical_lane(_chunks(spark, sf), retrieval.build_plan("qqqqzzzz")).select("path", "chunk", "score")


def blocked_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of indexes that may be read, and a warning for each that may not."""
    reasons = spark.createDataFrame([("i1", "sources outside the boundary"), ("i2", "")], "index_id string, reason string")
    allowed, warned = retrieval.gate(_chunks(spark, sf), reasons)
    n = allowed.groupBy("index_id").agg(F.count(F.lit(1)).alias("chunks")).select("index_id", F.lit("ok").alias("status"), "chunks", F.lit("").alias("warning"))
    return n.unionByName(warned.select("index_id", "status", F.lit(0).cast("long").alias("chunks"), "warning"))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as evidence rows of outlines."""
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "source", F.concat("source", F.lit("/"), n % 7, F.lit(".md")).alias("path"), n.alias("chunk"), F.when(n % 4 == 0, "text-window").when(n % 4 == 1, "org_heading").otherwise("org_task").alias("kind"), F.lit("").alias("title"), F.when(n % 2 == 0, F.array(F.lit("work"))).otherwise(F.array(F.lit("home"), F.lit("work"))).alias("tags"),
        F.when(n % 3 == 0, "todo").otherwise("DONE").alias("todo"), F.when(n % 5 < 4, "A").otherwise("b").alias("priority"), F.lit("").alias("date"), F.lit(0).alias("start"), F.when(n % 10 == 3, F.concat(F.lit("DEADLINE: <2024-01-01> "), "text")).otherwise(F.col("text")).alias("text"), F.lit(5.0).alias("base_score"),
    )


def structural_candidates(spark: SparkSession, sf: str) -> DataFrame:
    plan = retrieval.build_plan("deadline of todo items tagged home priority A")
    return retrieval.structural_rows(_evidence(spark, sf), plan).select("path", "chunk", "structured")


def evidence_candidates(spark: SparkSession, sf: str) -> DataFrame:
    plan = retrieval.build_plan(first_question(spark, sf))
    return retrieval.evidence_lane(_evidence(spark, sf), plan).select("path", "chunk", "score")


def temporal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Events as days of outlines: those of the two newest days in files that a question names."""
    e = table(spark, sf, "events").select(F.concat(F.lit("notes/"), F.col("event_id") % 3, F.lit(".org")).alias("path"), F.col("event_id").alias("chunk"), F.lit("days").alias("summary"), F.concat(F.lit("* ["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] "), "event_type", F.lit("\nsome words")).alias("content"))
    plan = retrieval.build_plan("latest entries in notes/1.org")
    return retrieval.temporal_lane(e, plan).select("path", F.col("chunk").cast("long").alias("chunk"), "date", "structured")


def temporal_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Without a path only files count that share a word with the question."""
    e = table(spark, sf, "events").select(F.concat(F.lit("n"), F.col("event_id") % 3).alias("path"), F.col("event_id").alias("chunk"), F.when(F.col("event_id") % 3 == 2, "garden").otherwise("other").alias("summary"), F.concat(F.lit("* "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" x")).alias("content"))
    return retrieval.temporal_lane(e, retrieval.build_plan("latest garden news")).select("path", F.col("chunk").cast("long").alias("chunk"), "date")


def attached_items(spark: SparkSession, sf: str) -> DataFrame:
    """Context of an index, a dossier, a file and things that are not there: rows by item, and warnings."""
    excerpts = table(spark, sf, "conversations").select(F.lit("dossier").alias("kind"), F.col("conv_id").cast("string").alias("dossier_id"), F.col("turn").alias("ord"), "text")
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    service = retrieval.Service(spark, _chunks(spark, sf), excerpts, files, budget=1_000_000)
    first = files.orderBy("path").limit(1).collect()
    items = [{"kind": "dossier", "id": "1"}, {"kind": "file", "id": first[0]["path"] if first else ""}, {"kind": "topic", "id": "t9"}, {"kind": "index", "id": "i9"}, {"kind": "song", "id": "x"}]
    rows = service.attached(items, first_question(spark, sf))
    return rows.filter("status <> 'ok' OR kind IN ('dossier', 'file')").groupBy("item", "kind", "id", "status", "warning").agg(F.count(F.lit(1)).alias("n"))


_ALL = (
    store_candidates, store_rows, progress_ids, progress_records, store_records, run_times, vector_row_plans, vector_gates, vector_inputs, route_identities, reduced_turns, lifecycle_artifacts, index_path_keys, cleanup_plans, plan_summaries, storage_sections, conversation_cascade,
    grounding_needs, audited_sources, context_sufficiency, context_expansions, compact_feedback_sources, feedback_hints, feedback_fixtures, memory_query_texts, chat_content, goal_actions, goals_completed, readiness_checks, skill_suggestions, skill_support, skills_rendered,
    slot_latest, slot_bytes, slots_kept, slot_upserts, effective_spans, model_texts, model_parts, explain_chunks, explain_files, lexical_candidates, lexical_fallback, blocked_indexes, structural_candidates, evidence_candidates, temporal_candidates, temporal_of_files, attached_items,
)
QUERIES = {f.__name__: f for f in _ALL}

_FLAT = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_RUN = "r AS (SELECT s_suppkey AS s, s_suppkey::VARCHAR AS store_id, s_name, sha256(s_name) AS fp FROM supplier)"
_CAND = "c AS (SELECT 'c' || doc_id AS id, 0 AS lane, doc_id, text, lang || ' ' || source AS summary, NULL AS title, '' AS excerpt FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'e' || doc_id, 1, doc_id, 'x' || left(text, 40), lang || ' ' || source, lang, CASE WHEN doc_id % 2 = 0 THEN 'excerpt ' || lang ELSE '' END FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0)"
_PLAN = "st AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderkey % 5 = 2) AS changed, count(*) FILTER (WHERE o_orderkey % 5 = 3) AS deleted, count(*) FILTER (WHERE o_orderkey % 5 = 4) AS ignored FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 5 < 2 GROUP BY o_custkey), rc AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS da, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS ma, CAST(coalesce(sum(o_orderkey % 100) FILTER (WHERE o_orderkey % 2 = 0), 0) AS BIGINT) AS db, CAST(coalesce(sum(o_orderkey % 100) FILTER (WHERE o_orderkey % 2 <> 0), 0) AS BIGINT) AS mb FROM orders WHERE o_custkey % 4 > 0 GROUP BY o_custkey), p AS (SELECT k AS index_id, CASE WHEN changed + deleted + ignored = 0 THEN 'fresh' WHEN changed > 0 AND k % 5 <> 1 THEN 'needs-rebuild' WHEN k % 5 <> 1 THEN 'detached-source-work' ELSE 'cleanup-ready' END AS status, CASE WHEN changed + deleted + ignored = 0 THEN 'keep-derived-artifacts' WHEN changed > 0 AND k % 5 <> 1 THEN 'rebuild-index-and-refresh-derived-artifacts' WHEN k % 5 <> 1 THEN 'rebuild-index-before-cleanup' ELSE 'clean-superseded-derived-artifacts' END AS recommended_action, CASE WHEN changed + deleted + ignored = 0 THEN 'no-op' WHEN k % 5 <> 1 THEN 'blocked' ELSE 'ready' END AS apply_status, CASE WHEN k % 5 = 1 THEN 'new' ELSE '' END AS replacement_id, k % 5 = 1 AS replacement_ready, changed, deleted, ignored, changed + deleted + ignored AS source_count, coalesce(da, 0) AS derived_artifacts, coalesce(ma, 0) AS manual_artifacts, coalesce(db, 0) AS derived_bytes, coalesce(mb, 0) AS manual_bytes FROM st LEFT JOIN rc USING (k))"
_SRC = "s AS (SELECT conv_id AS a, turn AS o, (['chunk', 'memory', 'file', 'answer-audit', 'recent-conversation'])[(conv_id + turn) % 5 + 1] AS kind, conv_id % 2 = 0 AS vec, CASE WHEN turn % 4 = 1 THEN 'e' || turn % 3 END AS ev, conv_id % 3 AS sig, CASE WHEN (conv_id + turn) % 6 = 0 THEN 'stale' ELSE 'fresh' END AS status, 'dir/p' || turn % 2 || '.md' AS path, (turn % 3)::VARCHAR AS chunk, CASE WHEN turn % 2 = 0 THEN turn::DOUBLE END AS score FROM conversations)"
_NAME = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_.-]{{3,}}'))"
_SLOT = "sl AS (SELECT event_id AS ord, event_id % 11 <> 0 AS right_schema, user_id::VARCHAR AS conversation_id, coalesce(CASE WHEN event_id % 13 = 0 THEN 'other' WHEN event_id % 2 = 0 THEN 'default' END, 'default') AS ns, 'f' || event_id % 3 AS route_fingerprint, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'saved' END AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS moment, 's' || event_id % 4 AS filename, CASE WHEN event_id % 4 > 0 THEN floor(abs(value) * 10)::BIGINT END AS bytes FROM events)"
_DOCS = "dc AS (SELECT doc_id, source || '/' || doc_id % 7 || '.md' AS path, source || '/' || doc_id % 7 || '.md' || chr(10) || source || chr(10) || text AS hay FROM documents)"
ORACLE = {
    "store_candidates": f"WITH {_CAND} SELECT id, lane, length(text) AS chars FROM c",
    "store_rows": f"WITH {_CAND} SELECT id, CASE lane WHEN 1 THEN 'evidence_embedding' ELSE 'raw_chunk_embedding' END AS kind, CASE lane WHEN 1 THEN 'evidence' ELSE 'chunk_content' END AS embedding_kind, length(text) AS chars, sha256(text) AS embedding_input_sha256, CASE WHEN excerpt <> '' THEN excerpt ELSE summary END AS summary, title AS evidence_title FROM c WHERE doc_id % 2 = 0",
    "progress_ids": f"WITH {_RUN} SELECT store_id, 'embedding-' || left(sha256('{{\"embedding_dimensions\": ' || s % 5 * 100 || ', \"embedding_input_bytes\": 0, \"embedding_input_chars\": 8000, \"embedding_input_schema\": \"in-v2\", \"embedding_max_parts_per_chunk\": 8, \"method\": \"dense\", \"model\": \"model-x\", \"route\": \"r' || s % 3 || '\", \"schema\": \"p1\", \"source_fingerprint\": \"' || fp || '\", \"source_index\": \"say \\\"' || s_name || '\\\"\", \"target_schema\": \"s1\", \"vector_row_id_schema\": \"rows-v1\"}}'), 16) AS progress_id FROM r",
    "progress_records": f"WITH {_RUN} SELECT store_id AS progress_id, CASE WHEN s % 2 = 0 THEN '*.md' ELSE '**/*' END AS glob, 'r' || s % 3 AS route, '/v1/embeddings' AS request_path, s % 7 * 10 AS expected_rows, s % 7 * 5 AS completed_rows, CASE WHEN s % 7 * 5 - (s % 3 + s % 2) > 0 AND s % 7 > 0 THEN CAST(floor(60.0::DOUBLE / (s % 7 * 5 - (s % 3 + s % 2)) * (s % 7 * 5)) AS BIGINT) END AS eta_seconds FROM r",
    "store_records": f"WITH {_RUN}, n AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1) SELECT store_id, coalesce(n, 0) AS row_count, CASE WHEN n > 0 THEN 3 ELSE 0 END AS dims, s % 3 + s % 2 AS reused_rows, greatest(0, coalesce(n, 0) - (s % 3 + s % 2)) AS embedded_rows, CASE WHEN s % 2 > 0 THEN 'old' ELSE '' END AS reuse_store_id, fp AS input_hash FROM r LEFT JOIN n USING (s)",
    "run_times": f"WITH e AS (SELECT event_id, greatest(0, date_diff('second', date_trunc('second', ts), TIMESTAMP '{NOW}')) AS age FROM events) SELECT event_id, CASE WHEN event_id % 3 > 0 THEN age ELSE event_id % 100 END AS elapsed, CASE WHEN event_id % 3 > 0 THEN age END AS age, CASE WHEN event_id % 10 = 0 THEN 'finalizing' WHEN event_id % 3 > 0 AND age >= 5000000 THEN 'stale' ELSE 'running' END AS state FROM e",
    "vector_row_plans": "WITH n AS (SELECT * FROM (VALUES ('raw_chunk_embedding', (SELECT count(*) FROM documents)), ('evidence_embedding', 0), ('chunk_summary_embedding', 0), ('file_summary_embedding', 0), ('file_label_embedding', (SELECT count(DISTINCT source) FROM documents)), ('memory_embedding', 0), ('conversation_summary_embedding', (SELECT count(DISTINCT conv_id) FROM conversations)), ('topic_dossier_embedding', 0), ('memory_dossier_embedding', 0)) AS t(kind, rows)) SELECT kind, rows, 64 AS dims, rows * 256 AS vector_bytes, rows * 768 AS metadata_bytes, rows * 1024 AS estimated_bytes FROM n",
    "vector_gates": "SELECT 'retrieval_eval' AS name, CASE WHEN (SELECT count(*) FROM labels WHERE quality = 0) = 0 THEN 'pass' ELSE 'fail' END AS status UNION ALL SELECT 'index_storage_audit', CASE WHEN (SELECT count(*) FROM documents WHERE doc_id % 50 = 11) = 0 THEN 'pass' ELSE 'warn' END UNION ALL SELECT 'embedding_route', CASE WHEN (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) > 0 THEN 'available' ELSE 'not-configured' END UNION ALL SELECT 'reranker_route', 'not-configured' UNION ALL SELECT 'privacy_boundary', 'pass'",
    "vector_inputs": f"SELECT item_id, {_FLAT.format(x='text')} AS query, item_id % 2 = 0 AS rerank FROM benchmark",
    "route_identities": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'r' || n_nationkey END AS route_id, CASE WHEN n_nationkey % 3 > 0 THEN 'm' ELSE '' END AS route_model, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey END AS route_dims FROM nation",
    "reduced_turns": "SELECT conv_id, sha256(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "lifecycle_artifacts": "SELECT 'delete-derived' AS cleanup_policy, 'topic' AS artifact_kind, 't' || doc_id AS artifact_id, true AS by_index, '' AS paths, 1 AS row_count FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 = 1 UNION ALL SELECT 'manual-review', 'eval', 'v' || doc_id, false, '/s/' || doc_id % 11 || '.md', 1 FROM documents WHERE doc_id % 3 = 1 AND doc_id % 11 IN (4, 9) UNION ALL SELECT 'rewrite', 'actions', 'ledger', bool_or(doc_id % 5 = 1), string_agg(DISTINCT CASE WHEN doc_id % 11 IN (4, 9) THEN '/s/' || doc_id % 11 || '.md' END, ',' ORDER BY CASE WHEN doc_id % 11 IN (4, 9) THEN '/s/' || doc_id % 11 || '.md' END), count(*) FROM documents WHERE doc_id % 3 = 2 AND (doc_id % 5 = 1 OR doc_id % 11 IN (4, 9))",
    "index_path_keys": "SELECT DISTINCT page_id % 4 AS index_id, unnest(['./p' || page_id % 100, 'p' || page_id % 100, '/r/p' || page_id % 100]) AS path FROM pages",
    "cleanup_plans": f"WITH {_PLAN} SELECT * FROM p",
    "plan_summaries": f"WITH {_PLAN} SELECT index_id, c_name AS name, recommended_action, apply_status, derived_bytes FROM p JOIN customer ON c_custkey = index_id WHERE status <> 'fresh'",
    "storage_sections": "WITH d AS (SELECT doc_id % 10 AS m, n_chars FROM documents) SELECT 'stale-superseded-indexes' AS kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, 'candidate' AS safety FROM d WHERE m = 1 UNION ALL SELECT 'superseded-partials', count(*), CAST(sum(n_chars) AS BIGINT), 'candidate' FROM d WHERE m = 2 UNION ALL SELECT 'orphan-chunk-files', count(*), CAST(sum(n_chars) AS BIGINT), 'candidate' FROM d WHERE m = 3 UNION ALL SELECT 'older-complete-indexes', count(*), NULL, 'blocked' FROM d WHERE m = 4 UNION ALL SELECT 'source-lifecycle-work', count(*), NULL, 'rebuild-first' FROM d WHERE m = 5",
    "conversation_cascade": "SELECT 'topic' AS kind, count(*) AS n FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 = 3 UNION ALL SELECT 'eval', count(*) FROM documents WHERE doc_id % 3 = 1 AND doc_id % 7 = 3 UNION ALL SELECT 'actions', count(*) FROM documents WHERE doc_id % 3 = 2 AND doc_id % 7 = 3",
    "grounding_needs": "SELECT item_id, item_id % 4 = 0 OR regexp_matches(text, '[A-Za-z0-9_./~+-]*[A-Za-z0-9_~+-]\\.[A-Za-z0-9]') OR len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9_''-]{3,}'), ['the', 'source', 'task'])) > 0 AS needed FROM benchmark",
    "audited_sources": f"WITH {_SRC}, u AS (SELECT a, kind, status FROM s WHERE kind <> 'answer-audit' UNION ALL SELECT DISTINCT a, 'answer-audit', 'pass' FROM s) SELECT a AS answer_id, kind, status, count(*) AS n FROM u GROUP BY ALL",
    "context_sufficiency": f"WITH {_SRC}, k AS (SELECT a, bool_or(kind = 'chunk' AND a % 3 = 1) AS deep, bool_or(kind IN ('memory', 'recent-conversation')) AS few FROM s WHERE a % 4 > 0 GROUP BY a), r AS (SELECT conv_id AS a, CASE WHEN turn % 2 = 0 THEN 'topic' ELSE 'dossier' END AS kind, max(turn) AS t FROM conversations WHERE turn * 10 >= 20 AND conv_id % 3 <> 0 GROUP BY ALL), g AS (SELECT a, string_agg(kind || ' x' || t, ', ' ORDER BY kind) AS reusable FROM r GROUP BY a) SELECT a AS answer_id, CASE WHEN deep THEN 'enough' WHEN few OR a % 8 = 0 THEN 'partial' ELSE 'thin' END AS status, coalesce(reusable, '') AS reusable FROM (SELECT DISTINCT a FROM s) LEFT JOIN k USING (a) LEFT JOIN g USING (a)",
    "context_expansions": f"WITH {_SRC}, p AS (SELECT *, kind = 'file' OR (kind = 'chunk' AND (vec OR ev IS NOT NULL OR sig > 0)) AS strong FROM s), n AS (SELECT a, count(*) FILTER (WHERE strong) AS strong, count(*) FILTER (WHERE strong AND a % 3 = 1 AND path = 'dir/p1.md') AS on_path, count(*) FILTER (WHERE status = 'stale') AS stale FROM p GROUP BY a), b AS (SELECT conv_id AS a, max(turn) AS t FROM conversations WHERE conv_id % 5 > 0 GROUP BY 1), w AS (SELECT n.a, CASE WHEN n.a % 3 < 2 AND on_path = 0 THEN 'path' WHEN stale > 0 THEN 'stale' WHEN strong = 0 THEN 'thin' END AS reason, t, coalesce(t >= 1, false) AS found FROM n LEFT JOIN b USING (a)), x AS (SELECT *, CASE WHEN a % 7 = 0 THEN 'not-needed' WHEN reason IS NULL THEN 'sufficient' WHEN found THEN 'expand' ELSE 'no-candidate' END AS decision FROM w) SELECT a AS answer_id, decision, CASE WHEN decision IN ('expand', 'no-candidate') THEN reason END AS reason, CASE WHEN decision = 'expand' THEN 'index' END AS kind, CASE WHEN decision = 'expand' THEN 'i' || t END AS id FROM x",
    "compact_feedback_sources": f"WITH {_SRC} SELECT a AS feedback_id, o AS ord, kind, path, chunk, score::VARCHAR AS score, ev AS evidence_id FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY o) <= 3",
    "feedback_hints": f"WITH {_SRC} SELECT a AS feedback_id, min(o) AS ord, kind, path FROM s GROUP BY a, kind, path, chunk, coalesce(ev, '')",
    "feedback_fixtures": f"WITH {_SRC}, h AS (SELECT DISTINCT a, kind, path, chunk, ev FROM s), n AS (SELECT a, count(DISTINCT path) AS p, count(ev) AS e FROM h GROUP BY a), f AS (SELECT conv_id AS id, max(text) AS reply FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT id, 'home' AS realm, CASE id % 3 WHEN 0 THEN 'accepted-good' WHEN 1 THEN 'accepted-mixed' ELSE 'needs-review' END AS quality_status, 'staleness' AS focus, sha256(reply) AS reply_sha256, p AS source_paths, e AS source_evidence FROM f JOIN n ON n.a = id",
    "memory_query_texts": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, concat_ws(chr(10), 'what now', 'talk ' || conv_id, CASE WHEN conv_id % 2 = 0 THEN 'a summary' END, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE r <= 4 AND role = 'user' AND text <> '')) AS text FROM r GROUP BY conv_id",
    "chat_content": "SELECT conv_id, conv_id % 5 = 0 OR conv_id % 7 = 0 OR (conv_id % 3 = 0 AND bool_or(trim(text) <> '')) AS has_content FROM conversations GROUP BY conv_id",
    "goal_actions": "SELECT conv_id AS goal_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS \"index\", 'pending' AS status, role AS kind FROM conversations",
    "goals_completed": "SELECT conv_id AS goal_id, count(*) FILTER (WHERE turn % 3 = 0) AS completed FROM conversations GROUP BY 1",
    "readiness_checks": "SELECT CASE WHEN count(*) = 0 THEN 'not-run' WHEN count(*) = count(*) FILTER (WHERE quality = 1) THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER (WHERE quality = 1) AS passed, count(*) AS total FROM labels",
    "skill_support": f"WITH q AS (SELECT {_NAME.format(x='text')} AS q FROM benchmark ORDER BY item_id LIMIT 1), f AS (SELECT 'skill-' || page_id % 20 AS slug, url AS file, page_id::VARCHAR AS u, len(list_intersect({_NAME.format(x='url || chr(10) || translate(url, chr(47) || chr(46) || chr(45), chr(32) || chr(32) || chr(32)) || chr(10) || left(html, 8000)')}, q)) AS n, len(list_intersect({_NAME.format(x='url')}, q)) > 0 AS named FROM pages, q) SELECT slug, file, n * 10 + CASE WHEN named THEN 20 ELSE 0 END AS score FROM f WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n * 10 + CASE WHEN named THEN 20 ELSE 0 END DESC, u DESC, file) <= 2",
    "slot_latest": f"WITH {_SLOT} SELECT conversation_id, route_fingerprint, arg_max(ord, (moment, ord)) AS ord FROM sl WHERE right_schema AND ns = 'default' AND status = 'saved' GROUP BY ALL",
    "slot_bytes": f"WITH {_SLOT} SELECT coalesce(max(bytes) FILTER (WHERE bytes > 0), 0) AS bytes FROM sl WHERE ord % 3 = 1",
    "slots_kept": f"WITH {_SLOT} SELECT ord AS id FROM sl WHERE ord // 500 = 1 ORDER BY moment DESC, ord DESC LIMIT 50",
    "slot_upserts": f"WITH {_SLOT}, o AS (SELECT route_fingerprint, conversation_id, filename, arg_max(status, (moment, ord)) AS status, arg_max(ord, (moment, ord)) AS last FROM sl GROUP BY 1, 2, 3), u AS (SELECT CASE WHEN o.conversation_id LIKE '%1' THEN 'deleted' ELSE o.status END AS status, sl.bytes FROM o JOIN sl ON sl.ord = o.last) SELECT status, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM u GROUP BY status",
    "effective_spans": r"WITH d AS (SELECT *, regexp_replace(regexp_replace(substr(text, 5, 50), '^\s+', ''), '\s+$', '') AS part FROM documents) SELECT doc_id AS id, sha256(CASE WHEN doc_id % 3 = 0 AND part <> '' THEN part ELSE text END) AS digest, CASE WHEN doc_id % 6 = 0 AND part <> '' THEN 4 ELSE 0 END AS start, CASE WHEN doc_id % 6 = 0 AND part <> '' THEN 54 ELSE length(text) END AS " + '"end"' + r" FROM d",
    "model_texts": f"WITH d AS (SELECT doc_id, {_FLAT.format(x='text')} AS flat, CASE WHEN doc_id % 2 = 0 THEN 'text-window: a label' ELSE 'text-window' END AS pre FROM documents), r AS (SELECT *, 300 - length(pre) - 1 AS room FROM d), s AS (SELECT *, (room - 5) // 2 AS side FROM r) SELECT doc_id AS id, trim(left(pre || chr(10) || CASE WHEN length(flat) <= room THEN flat ELSE left(rtrim(left(flat, side)) || ' ... ' || ltrim(right(flat, room - 5 - side)), room) END, 300), ' ' || chr(10)) AS model_text FROM s",
    "model_parts": f"WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN doc_id % 2 = 0 THEN 'text-window: a label' ELSE 'text-window' END AS pre FROM documents), k AS (SELECT *, CASE WHEN n <= 400 THEN 1 ELSE least(3, (n - 400 + 299) // 300 + 1) END AS kept FROM d), p AS (SELECT *, unnest(range(0, kept)) AS part FROM k), o AS (SELECT *, CASE WHEN part = kept - 1 AND n > 400 THEN n - 400 ELSE part * 300 END AS off FROM p), x AS (SELECT *, {_FLAT.format(x='substr(text, off + 1, 400)')} AS flat, 400 - length(pre) - 1 AS room FROM o), s AS (SELECT *, (room - 5) // 2 AS side FROM x) SELECT doc_id AS id, part, off AS start, length(trim(left(pre || chr(10) || CASE WHEN length(flat) <= room THEN flat ELSE left(rtrim(left(flat, side)) || ' ... ' || ltrim(right(flat, room - 5 - side)), room) END, 400), ' ' || chr(10))) AS chars FROM s",
    "explain_chunks": f"WITH {TERMS_SQL}, {_DOCS},\n{score_sql('dc', 'doc_id', 'hay')} SELECT path, doc_id AS chunk, score AS lexical, score AS total FROM scored JOIN dc ON k = doc_id ORDER BY score DESC, path, doc_id LIMIT 12",
    "explain_files": "SELECT DISTINCT source || '/' || doc_id % 7 || '.md' AS path, CASE WHEN doc_id % 7 = 3 THEN 2500 ELSE 0 END AS path_boost FROM documents ORDER BY path_boost DESC, path LIMIT 10",
    "lexical_candidates": f"WITH {TERMS_SQL}, {_DOCS},\n{score_sql('dc', 'doc_id', 'hay')} SELECT path, doc_id::VARCHAR AS chunk, score::DOUBLE AS score FROM scored JOIN dc ON k = doc_id WHERE score > 0 ORDER BY score DESC, path, doc_id LIMIT 24",
    "lexical_fallback": f"WITH {_DOCS} SELECT path, doc_id::VARCHAR AS chunk, 0.0::DOUBLE AS score FROM dc ORDER BY path, doc_id LIMIT 2",
    "blocked_indexes": "SELECT 'i' || doc_id % 3 AS index_id, 'ok' AS status, count(*) AS chunks, '' AS warning FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1 UNION ALL SELECT 'i1', 'blocked', 0, 'sources outside the boundary'",
    "structural_candidates": "SELECT source || '/' || doc_id % 7 || '.md' AS path, doc_id AS chunk, 6500 + 1200 + 900 + 700 + 500 AS structured FROM documents WHERE doc_id % 4 > 0 AND doc_id % 2 <> 0 AND doc_id % 3 = 0 AND doc_id % 5 < 4 AND doc_id % 10 = 3",
    "evidence_candidates": f"WITH {TERMS_SQL}, ev AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 3 THEN 'DEADLINE: <2024-01-01> ' || text ELSE text END AS text FROM documents),\n{score_sql('ev', 'doc_id', 'text')}, t AS (SELECT source || '/' || doc_id % 7 || '.md' AS path, doc_id, score + 5 AS score FROM scored JOIN ev ON k = doc_id WHERE score > 0) SELECT path, doc_id::VARCHAR AS chunk, score::DOUBLE AS score FROM t ORDER BY score DESC, path, doc_id LIMIT 24",
    "temporal_candidates": "WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 3 = 1) SELECT 'notes/1.org' AS path, event_id AS chunk, day AS date, 6000.0::DOUBLE AS structured FROM e WHERE day IN (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 2)",
    "temporal_of_files": "WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 3 = 2) SELECT 'n2' AS path, event_id AS chunk, day AS date FROM e WHERE day IN (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 2)",
    "attached_items": "SELECT 0 AS item, 'dossier' AS kind, '1' AS id, 'ok' AS status, '' AS warning, count(*) AS n FROM conversations WHERE conv_id = 1 UNION ALL SELECT 1, 'file', min(url), 'ok', '', (SELECT count(*) FROM pages WHERE url = (SELECT min(url) FROM pages)) FROM pages UNION ALL SELECT 2, 'topic', 't9', 'unavailable', 'no topic t9', 1 UNION ALL SELECT 3, 'index', 'i9', 'unavailable', 'no index i9', 1 UNION ALL SELECT 4, 'song', 'x', 'unavailable', 'no song x', 1",
}
