"""Memories, conversations and feedback: normalising, tags, relevance, selection, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import lexical, similarity
from corvana.sources.state import jsonl

IMPORTANCE, MOST_IMPORTANCE, DUPLICATE_AT = 3, 5, 0.72
# Words that are no tags.
TAG_STOP = ["about", "after", "also", "because", "before", "could", "from", "have", "into", "should", "that", "their", "there", "this", "with", "would"]


def normalize(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Memory rows with defaults for what is missing and importance within 1 to 5."""
    have = set(rows.columns)
    get = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    importance = F.expr("try_cast(importance AS int)") if "importance" in have else F.lit(None).cast("int")
    return rows.withColumns({
        "id": get("id", F.format_string("legacy-%04d", F.col(ord_col).cast("long"))),
        "created": get("created", F.lit("")),
        "source": get("source", F.lit("unknown")),
        "text": get("text", F.lit("")),
        "importance": F.coalesce(F.greatest(F.lit(1), F.least(F.lit(MOST_IMPORTANCE), importance)), F.lit(IMPORTANCE)),
        "pinned": get("pinned", F.lit(False)),
        "tags": get("tags", F.array().cast("array<string>")),
        "seen_count": get("seen_count", F.lit(1)),
    })


SCHEMA = "id string, created string, source string, text string, importance string, pinned boolean, tags array<string>, seen_count int, conversation_id string, source_conversations array<string>"


def load(spark: SparkSession, path: str, limit: int | None = 80) -> DataFrame:
    """The last `limit` memories of files of JSON lines, with defaults for what is missing, in their order (ord); all with None."""
    rows = jsonl(spark, path, SCHEMA, limit)
    # A row without an id is named by its place in its file.
    return normalize(rows)


def without_conversation(rows: DataFrame, conversation_id: str) -> tuple[DataFrame, DataFrame]:
    """(normalised rows that do not name a conversation, one row with the number removed)."""
    named = F.coalesce(F.col("conversation_id") == conversation_id, F.lit(False)) | F.coalesce(F.array_contains("source_conversations", conversation_id), F.lit(False))
    marked = normalize(rows).withColumn("_named", named)
    return marked.filter("NOT _named").drop("_named"), marked.agg(F.count_if("_named").alias("removed"))


def tags(rows: DataFrame, id_col: str, text: Column, top: int = 20, most: int = 8, stop: list[str] = TAG_STOP) -> DataFrame:
    """id, tag, place: the first `most` of the `top` commonest words that are no stop words; ties by first occurrence."""
    common = F.slice(T.word_counts(text), 1, top)
    kept = F.slice(F.filter(F.transform(common, lambda w: w["word"]), lambda w: ~w.isin(stop)), 1, most)
    return rows.select(id_col, F.posexplode(kept).alias("place", "tag")).select(id_col, "tag", (F.col("place") + 1).alias("place"))


def relevance(rows: DataFrame, query: str, thread: str = "", ord_col: str = "ord") -> DataFrame:
    """matched, thread_matched, recency and relevance of normalised memory rows in the order of ord_col (0, 1, ...).

    The number of rows comes from one aggregate row that is broadcast.
    """
    haystack = F.concat_ws("\n", "text", F.array_join("tags", " "), "source")
    q, t = lexical.query_terms("\n".join(filter(None, (query, thread)))), lexical.query_terms(thread)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    recency = F.when(F.col("total") > 1, 1 + F.least(F.lit(10), F.floor(F.col(ord_col) * 10 / F.greatest(F.lit(1), F.col("total") - 1)))).otherwise(10)
    out = rows.join(F.broadcast(total)).withColumn("recency", recency.cast("long"))
    out = out.withColumn("_text", T.tokens(F.col("text"))).withColumn("_hay", T.tokens(haystack))
    out = out.withColumn("matched", lexical.score_tokens(q, F.col("_text"))).withColumn("thread_matched", lexical.score_tokens(t, F.col("_text")))
    value = lexical.score_tokens(q, F.col("_hay")) * 8 + lexical.score_tokens(t, F.col("_hay")) * 3 + F.col("importance") * 4 + F.col("recency") + F.when(F.col("pinned"), 40).otherwise(0) + F.least(F.lit(8), F.col("seen_count"))
    return out.withColumn("relevance", value.cast("long")).drop("total", "_text", "_hay")


def rank(rows: DataFrame, query: str, limit: int, thread: str = "", ord_col: str = "ord") -> DataFrame:
    """The best memories, pinned first; where fewer than six qualify, the newest others follow until there are."""
    scored = relevance(rows, query, thread, ord_col)
    asked = bool(lexical.query_terms(query + "\n" + thread))
    keep = F.col("pinned") | (F.col("matched") > 0) | (F.col("thread_matched") > 0) if asked else F.lit(True)
    order = [F.desc("pinned"), F.desc("matched"), F.desc("relevance"), F.desc("importance"), F.desc("created"), F.asc(ord_col)]
    columns = scored.columns
    once = scored.filter(keep).groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("pinned", "matched", "relevance", "importance", "created", -F.col(ord_col))).alias("r")).select("r.*")
    best = once.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    # Only selected rows (limit at most) and as many newest rows are put in one order.
    newest = scored.join(F.broadcast(best.select("id")), "id", "left_anti").orderBy(F.desc(ord_col)).limit(min(limit, 6))
    newest = newest.withColumn("back", F.row_number().over(Window.orderBy(F.desc(ord_col))))
    size = best.agg(F.count(F.lit(1)).alias("chosen"))
    whole = scored.agg(F.least(F.lit(6), F.count(F.lit(1))).alias("wanted"))
    fill = newest.join(F.broadcast(size)).join(F.broadcast(whole)).filter((F.col("chosen") < F.col("wanted")) & (F.col("chosen") + F.col("back") <= F.least(F.lit(limit), F.lit(6))))
    return best.unionByName(fill.withColumn("place", (F.col("chosen") + F.col("back")).cast("int")).select(best.columns))


def most_similar(texts: DataFrame, rows: DataFrame, threshold: float = DUPLICATE_AT) -> DataFrame:
    """For each text (id, text) the row (id, text, ord) with the highest overlap coefficient, if it reaches the threshold; ties by ord."""
    words = lambda r: r.select("id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    near = similarity.overlapping(words(texts), words(rows), threshold).join(rows.select(F.col("id").alias("b"), "ord"), "b")
    best = F.max_by(F.struct(F.col("b").alias("row_id"), "overlap"), F.struct("overlap", -F.col("ord")))
    return near.groupBy(F.col("a").alias("text_id")).agg(best.alias("r")).select("text_id", "r.*")


ROLES = ("user", "assistant", "system", "summary", "error", "queued")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation (conv_id, turn, role, text)."""
    return messages.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("_r") <= n).drop("_r")


def recall_text(messages: DataFrame, n: int, heads: DataFrame | None = None) -> DataFrame:
    """conv_id, text: title and summary (heads) and what user and assistant said in the last n messages."""
    said = last_messages(messages, n).filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    joined = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m")).select("conv_id", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("said"))
    if heads is None:
        return joined.select("conv_id", F.col("said").alias("text"))
    return heads.join(joined, "conv_id", "left").select("conv_id", F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("summary", F.lit("")), F.nullif("said", F.lit(""))).alias("text"))


def transcript(messages: DataFrame, n: int, limit: int) -> DataFrame:
    """conv_id, transcript of the last n messages as 'role: text', cut at limit characters if it is positive."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("message")
    lines = last_messages(messages, n).withColumn("said", T.strip(F.coalesce("text", F.lit("")))).filter("said != ''").withColumn("line", F.concat(role, F.lit(": "), F.col("said")))
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("m")).withColumn("transcript", T.strip(F.array_join(F.transform("m", lambda x: x["line"]), "\n\n")))
    return whole.select("conv_id", (T.compact(F.col("transcript"), limit) if limit > 0 else F.col("transcript")).alias("transcript"))


def last_of_role(messages: DataFrame, role: str) -> DataFrame:
    """conv_id, turn, text of the last message of a role."""
    return messages.filter(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def nearest_previous(messages: DataFrame, role: str = "user") -> DataFrame:
    """Each message with the turn and text of the latest earlier message of a role (an as-of lookup)."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("role") == role, F.struct("turn", "text")), ignorenulls=True).over(w)
    return messages.withColumn("_p", seen).withColumn("previous_turn", F.col("_p.turn")).withColumn("previous_text", F.col("_p.text")).drop("_p")


def recent_and_relevant(recall: DataFrame, query: str, recency_lane: int, relevance_lane: int, limit: int) -> DataFrame:
    """Conversations (conv_id, ord from newest, updated, text) by two lanes: the newest, and the best matches.

    Each lane is a top-k of its own; only their union is put in order.
    """
    terms = lexical.query_terms(query)
    scored = recall.withColumn("matched", lexical.score(terms, F.col("text"))).withColumn("recall", F.col("matched") * 8 + F.greatest(F.lit(1), 10 - F.col("ord")))
    recent = scored.filter(F.col("ord") < recency_lane).withColumn("reason", F.lit("recent"))
    hits = scored.filter("matched > 0") if terms else scored
    relevant = hits.orderBy(F.desc("matched"), F.desc("recall"), F.desc("updated"), "ord").limit(relevance_lane).withColumn("reason", F.lit("relevant"))
    both = recent.unionByName(relevant).groupBy("conv_id", "ord", "updated", "matched", "recall").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return both.orderBy(F.desc(F.array_contains("reasons", "recent")), F.desc("matched"), F.desc("recall"), "ord").limit(limit)


# What in a note or a prompt points to which part of the system.
FOCUS = {
    "recall": ["missing", "didn't find", "did not find", "not found", "absent", "sources"],
    "ranking": ["wrong source", "wrong file", "irrelevant", "ranking", "top result"],
    "evidence": ["citation", "source", "excerpt", "ground", "quote"],
    "prompt_use": ["ignored", "didn't use", "did not use", "answer"],
    "staleness": ["stale", "old", "outdated", "changed"],
    "synthesis": ["summary", "prioritize", "todo", "plan"],
}


def focus(rating: Column, note: Column, prompt: Column) -> Column:
    """What a piece of feedback is about; 'answer_quality' if nothing else."""
    text = F.lower(F.concat_ws(" ", rating, note, prompt))
    found = F.filter(F.array(*(F.when(F.greatest(*(text.contains(w) for w in words)), F.lit(label)) for label, words in FOCUS.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("answer_quality")))


def quality_status(rating: Column) -> Column:
    return F.when(rating == "up", "accepted-good").when(rating == "ok", "accepted-mixed").otherwise("needs-review")


def feedback_counts(rows: DataFrame) -> DataFrame:
    """facet, value, n: feedback by rating and by focus."""
    by_rating = rows.groupBy(F.coalesce("rating", F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rating").alias("facet"), "value", "n")
    by_focus = rows.select(F.explode(focus(F.col("rating"), F.col("note"), F.col("prompt"))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit("focus").alias("facet"), "value", "n")
    return by_rating.unionByName(by_focus)


def facts_matched(output: Column, facts: Column) -> Column:
    """Of facts (name, any) those any of whose strings occur in the output, whatever the case."""
    low = F.lower(output)
    return F.filter(facts, lambda f: F.exists(f["any"], lambda o: (T.strip(o) != "") & F.contains(low, F.lower(T.strip(o)))))


def worker_score(rows: DataFrame) -> DataFrame:
    """score and status of outputs against golden facts.

    rows: required_keys, required_facts, forbidden_facts, output, max_output_chars, min_fact_ratio.
    """
    parsed = T.json_object(F.col("output"))
    keys = F.coalesce(F.json_object_keys(parsed), F.array().cast("array<string>"))
    out = rows.withColumn("json", parsed).withColumn("missing_keys", F.array_except("required_keys", keys))
    shown = F.coalesce("json", "output")
    out = out.withColumn("matched", F.size(facts_matched(shown, F.col("required_facts")))).withColumn("forbidden", F.size(facts_matched(shown, F.col("forbidden_facts"))))
    needed, n_keys = F.size("required_facts"), F.size("required_keys")
    ratio = F.when(needed > 0, F.col("matched") / needed).otherwise(1.0)
    length_ok, no_think = F.length("output") <= F.col("max_output_chars"), ~F.lower("output").contains("<think")
    lost = F.size("missing_keys")
    value = 55.0 * ratio + F.when(F.col("json").isNotNull(), 15.0).otherwise(0.0) + F.when(lost == 0, 10.0).otherwise(F.greatest(F.lit(0.0), 10.0 * (1.0 - lost / F.greatest(F.lit(1), n_keys))))
    value = value + F.when(F.col("forbidden") == 0, 10.0).otherwise(0.0) + F.when(length_ok, 5.0).otherwise(0.0) + F.when(no_think, 5.0).otherwise(0.0)
    good = F.col("json").isNotNull() & (lost == 0) & (ratio >= F.col("min_fact_ratio")) & (F.col("forbidden") == 0) & length_ok & no_think
    return out.withColumn("score", F.bround(value, 1)).withColumn("status", F.when(good, "pass").otherwise("fail"))
