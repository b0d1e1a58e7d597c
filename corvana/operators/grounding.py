"""What an answer rests on: need of sources, sufficiency of context, one more retrieval pass, feedback with its sources, goals and their actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import audit, memory, similarity, skills

# Kinds of sources that go deep, and those that tell something.
DEEP_KINDS = ("dossier", "dossier-memory", "dossier-conversation", "topic", "topic-evidence", "chunk", "index")
SOME_KINDS = ("memory", "recent-conversation")
# What feedback keeps of a source, and what a hint of its evaluation keeps.
SOURCE_KEYS = "kind id index path chunk retrieval retrieval_methods score hybrid_score rerank_score vector_score status vector_store vector_method vector_rerank_route hybrid_rerank_route evidence_rows evidence_id evidence_kind evidence_title evidence_date evidence_score".split()
HINT_KEYS = "kind index path chunk evidence_id evidence_kind evidence_title evidence_date score hybrid_score rerank_score vector_score evidence_score status".split()
HINT_KEY = ("kind", "index", "path", "chunk", "evidence_id")
SOURCE_LIMIT = 16


def needs_sources(query: Column, grounding_words: list[str], task_words: list[str]) -> Column:
    """Whether a question must rest on sources: it names a path, or has a word that asks for them."""
    from corvana.plans.planner import PATH, PATH_EDGES

    asked = F.array(*map(F.lit, sorted({*grounding_words, *task_words}))).cast("array<string>")
    paths = F.exists(F.regexp_extract_all(query, F.lit(PATH), F.lit(0)), lambda p: F.contains(F.substring_index(F.trim(p, F.lit(PATH_EDGES)), "/", -1), F.lit(".")))
    return paths | F.arrays_overlap(T.tokens(query), asked)


def with_audit(sources: DataFrame, audits: DataFrame) -> DataFrame:
    """Sources (answer_id, kind, ...) with the audit row of each answer in place of an older one."""
    return sources.filter("kind <> 'answer-audit'").unionByName(audits.withColumn("kind", F.lit("answer-audit")), allowMissingColumns=True)


def sufficiency(sources: DataFrame, conversations: DataFrame, stored: DataFrame, least: float) -> DataFrame:
    """answer_id, status (enough, partial, thin), reusable: stored context that matches and is not attached.

    sources: answer_id, kind; conversations: answer_id, has_summary; stored: answer_id,
    kind, id, score, attached. Of each kind only the best one counts, whatever is attached.
    """
    kinds = sources.groupBy("answer_id").agg(F.bool_or(F.col("kind").isin(*DEEP_KINDS)).alias("deep"), F.bool_or(F.col("kind").isin(*SOME_KINDS)).alias("some"))
    best = stored.filter(F.col("score") >= least).groupBy("answer_id", "kind").agg(F.max_by(F.struct("id", "attached"), F.struct("score", "id")).alias("b"))
    reuse = best.filter("NOT b.attached").groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "b.id"))), ", ").alias("reusable"))
    whole = conversations.join(kinds, "answer_id", "left").join(reuse, "answer_id", "left")
    deep, some = F.coalesce("deep", F.lit(False)), F.coalesce("some", F.lit(False)) | F.coalesce("has_summary", F.lit(False))
    return whole.select("answer_id", F.when(deep, "enough").when(some, "partial").otherwise("thin").alias("status"), F.coalesce("reusable", F.lit("")).alias("reusable"))


def expansions(answers: DataFrame, sources: DataFrame, candidates: DataFrame, strong: list[str], least: float) -> DataFrame:
    """answer_id, decision, kind, id of the one context item that a second retrieval pass would add.

    answers: answer_id, needed, paths (mentioned ones); sources as in the grounding audit;
    candidates: answer_id, kind, id, score.
    """
    path = F.lower(F.coalesce("path", F.lit("")))
    proof = audit.strong_evidence(strong)
    each = sources.join(answers.select("answer_id", "paths"), "answer_id")
    hit = F.exists("paths", lambda p: (path == p) | path.endswith(F.concat(F.lit("/"), p)))
    counted = each.groupBy("answer_id").agg(F.count_if(proof).alias("strong"), F.count_if(proof & hit).alias("on_path"), F.count_if(F.coalesce("status", F.lit("")).isin("stale", "unavailable")).alias("stale"))
    best = candidates.groupBy("answer_id").agg(F.max_by(F.struct("kind", "id", "score"), F.struct("score", "id")).alias("b"))
    whole = answers.join(counted, "answer_id", "left").fillna(0, ["strong", "on_path", "stale"]).join(best, "answer_id", "left")
    reason = F.when((F.size("paths") > 0) & (F.col("on_path") == 0), "path").when(F.col("stale") > 0, "stale").when(F.col("strong") == 0, "thin")
    found = F.coalesce(F.col("b.score") >= least, F.lit(False))
    decision = F.when(~F.col("needed"), "not-needed").when(reason.isNull(), "sufficient").when(found, "expand").otherwise("no-candidate")
    picked = lambda n: F.when(decision == "expand", F.col(f"b.{n}"))
    return whole.select("answer_id", decision.alias("decision"), F.when(decision.isin("expand", "no-candidate"), reason).alias("reason"), picked("kind").alias("kind"), picked("id").alias("id"))


# Feedback


def compact_sources(sources: DataFrame, limit: int = SOURCE_LIMIT) -> DataFrame:
    """The first sources (feedback_id, ord) of each piece of feedback with what feedback keeps of them; blank is null."""
    rows = sources.withColumn("_r", F.row_number().over(Window.partitionBy("feedback_id").orderBy("ord"))).filter(F.col("_r") <= limit)
    return rows.select("feedback_id", "ord", *(F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in SOURCE_KEYS if k in sources.columns))


def source_hints(sources: DataFrame) -> DataFrame:
    """The first of the sources of a piece of feedback that agree in kind, index, path, chunk and evidence."""
    key = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") if k in sources.columns else F.lit("").alias(f"_{k}") for k in HINT_KEY]
    kept = [k for k in HINT_KEYS if k in sources.columns]
    return sources.groupBy("feedback_id", *key).agg(F.min_by(F.struct("ord", *kept), "ord").alias("h")).select("feedback_id", "h.*")


def fixtures(feedback: DataFrame, sources: DataFrame, realm: str = "") -> DataFrame:
    """Feedback (id, rating, note, prompt, reply) as cases of an evaluation: status, focus, digest of the reply, counts of paths and evidence."""
    n = source_hints(sources).groupBy("feedback_id").agg(F.count_distinct(F.nullif("path", F.lit(""))).alias("source_paths"), F.count(F.nullif("evidence_id", F.lit(""))).alias("source_evidence"))
    rows = feedback.join(n, feedback["id"] == n["feedback_id"], "left").fillna(0, ["source_paths", "source_evidence"])
    return rows.select("id", F.lit(realm).alias("realm"), "rating", memory.quality_status(F.col("rating")).alias("quality_status"), memory.focus(F.col("rating"), F.col("note"), F.col("prompt")).alias("focus"), T.sha256(F.coalesce("reply", F.lit(""))).alias("reply_sha256"), "source_paths", "source_evidence")


def query_text(heads: DataFrame, messages: DataFrame, query: str, recent: int) -> DataFrame:
    """conv_id, text that memories are looked up by: the query, title, end of the summary, and the last messages of the user."""
    said = memory.last_messages(messages, recent).filter("role = 'user' AND coalesce(text, '') <> ''").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), "\n").alias("_said"))
    part = lambda c: F.nullif(c, F.lit(""))
    return heads.join(said, "conv_id", "left").select("conv_id", F.concat_ws("\n", part(F.lit(query)), part(F.col("title")), part(F.right(F.coalesce("summary", F.lit("")), F.lit(4000))), "_said").alias("text"))


def has_content(heads: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, has_content: a summary, a queued prompt or a message that is not blank."""
    said = messages.filter(T.strip(F.coalesce("text", F.lit(""))) != "").select("conv_id", F.lit(True).alias("_said")).distinct()
    own = F.greatest(T.strip(F.coalesce("summary", F.lit(""))) != "", F.exists(F.coalesce("queued", F.array().cast("array<string>")), lambda q: T.strip(F.coalesce(q, F.lit(""))) != ""))
    return heads.join(said, "conv_id", "left").select("conv_id", (own | F.coalesce("_said", F.lit(False))).alias("has_content"))


# Skills that feedback and use point to


def suggestions(rows: DataFrame, feedback: DataFrame, limit: int, now: Column, stale_days: int, least: int = 2, long_body: int = 2500) -> DataFrame:
    """place, rule, slug, signal: what a curator would look at, rule by rule, the first `limit` of all.

    rows: slug, ord, description, body, pinned, builtin, selected_count, patch_count,
    support_files, created_at; feedback: id, rating, note, prompt. Of a piece of feedback
    the first skill that shares a term counts.
    """
    text = F.concat_ws(" ", "slug", "description", F.substring("body", 1, 1000))
    pinned = F.coalesce("pinned", F.lit(False))
    counted = lambda c: F.coalesce(c, F.lit(0))
    shape = lambda rule, found, order, signal: found.select(F.lit(rule).alias("rule"), order.cast("double").alias("_o"), "slug", signal.cast("string").alias("signal")).orderBy("_o", "slug").limit(limit)
    ranked = skills.feedback_matches(feedback, rows.select("slug", "ord", text.alias("text")), 1).withColumn("_f", F.col("text_id"))
    used = rows.filter(~pinned & (counted("selected_count") >= 3) & (counted("patch_count") == 0))
    large = rows.filter(~pinned & (counted("support_files") == 0) & (F.length("body") > long_body))
    pairs = similarity.sharing(rows.select(F.col("slug").alias("id"), skills.terms(text).alias("words")), least)
    merged = pairs.groupBy(F.col("a").alias("slug")).agg(F.count(F.lit(1)).alias("n")).join(rows.select("slug", "ord"), "slug")
    idle = skills.stale_unused(rows, now, stale_days)
    every = shape("1-feedback", ranked, F.xxhash64("_f") * 0, F.col("_f"))
    for rule, found, order, signal in (("2-usage", used, F.col("ord"), F.col("selected_count")), ("3-support-file", large, F.col("ord"), F.length("body")), ("4-consolidation", merged, F.col("ord"), F.col("n")), ("5-archive", idle, -F.col("age_days"), F.col("age_days"))):
        every = every.unionByName(shape(rule, found, order, signal))
    # At most `limit` rows a rule are put in one order.
    w = Window.orderBy("rule", "_o", "slug", "signal")
    return every.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("place", "rule", "slug", "signal")


def readiness(checks: DataFrame) -> DataFrame:
    """One row: status, passed and total of checks (name, passed); without any it has not run."""
    n = checks.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
    return n.select(F.when(F.col("total") == 0, "not-run").when(F.col("passed") == F.col("total"), "pass").otherwise("fail").alias("status"), "passed", "total")


def code_checks(rows: DataFrame, least_commands: int = 1) -> DataFrame:
    """Checks of a code map (see code.code_rows): it parses, has commands, and functions stand for all of them."""
    own = rows.filter("kind = 'function'").select(F.col("name").alias("_h")).distinct()
    commands = rows.filter("kind = 'command'").select("name", F.concat(F.lit("command_"), F.replace("name", F.lit("-"), F.lit("_"))).alias("_h")).join(own.withColumn("_has", F.lit(True)), "_h", "left")
    linked = commands.agg(F.count(F.lit(1)).alias("commands"), F.count_if(F.col("_has").isNull()).alias("unlinked"))
    errors = rows.agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "module").alias("modules"))
    each = F.array(*(F.struct(F.lit(n).alias("name"), p.alias("passed")) for n, p in (("parses", F.col("errors") == 0), ("modules", F.col("modules") > 0), ("commands", F.col("commands") >= least_commands), ("handlers", F.col("unlinked") == 0))))
    return errors.join(F.broadcast(linked)).select(F.explode(each).alias("c")).select("c.*")  # one row each


# Goals


def action_results(goals: DataFrame) -> DataFrame:
    """goal_id, index (from 1), status and kind of each action of a goal (actions: array of structs with a kind) that begins."""
    return goals.select("goal_id", F.posexplode("actions").alias("p", "a")).select("goal_id", (F.col("p") + 1).alias("index"), F.lit("pending").alias("status"), F.coalesce("a.kind", F.lit("")).alias("kind"))


def completed(results: DataFrame) -> DataFrame:
    return results.groupBy("goal_id").agg(F.count_if(F.col("status") == "completed").alias("completed"))
