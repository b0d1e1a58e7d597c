"""Building an index: chunks, reuse of equal bodies, outline signals, evidence rows, profile, quality gate, recall.

Sizes and weights here are this engine's own: no specification gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import lexical, spans

CHUNK_CHARS, OVERLAP_CHARS = 2000, 200
# States of outline tasks.
STATES = ("TODO", "NEXT", "WAITING", "DONE", "CANCELLED")
OPEN_STATES = ("TODO", "NEXT", "WAITING")


def chunks(documents: DataFrame, id_col: str, text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """id, chunk, start, content, digest: windows of `size` characters that share `overlap` with the one before."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int")), lambda k: k * step))
    rows = documents.select(id_col, text.alias("_t"), F.posexplode(starts).alias("chunk", "start"))
    out = rows.select(id_col, "chunk", "start", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size)).alias("content"))
    return out.withColumn("digest", T.sha256(F.col("content")))


def stored_bodies(rows: DataFrame, id_col: str) -> DataFrame:
    """Chunks with `duplicate`: whether an earlier chunk (by id and place) already stores that body.

    The first of each digest comes from an aggregation; the join brings one row for each digest.
    """
    first = rows.groupBy("digest").agg(F.min(F.struct(id_col, "chunk")).alias("_first"))
    both = rows.join(first, "digest")
    return both.withColumn("duplicate", F.struct(id_col, "chunk") != F.col("_first")).drop("_first")


_HEAD = r"(?m)^(\*+)[ \t]+(?:(TODO|NEXT|WAITING|DONE|CANCELLED)[ \t]+)?(?:\[#([A-Z])\][ \t]+)?(.*?)(?:[ \t]+:([\w@:]+):)?[ \t]*$"


def outline(documents: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, place, level, todo, priority, title, tags of every heading, by expressions alone."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^\*+[ \t]+.*$"), F.lit(0))
    rows = documents.select(id_col, F.posexplode(heads).alias("place", "line"))
    part = lambda k: F.regexp_extract("line", _HEAD, k)
    return rows.select(id_col, "place", F.length(part(1)).alias("level"), part(2).alias("todo"), part(3).alias("priority"), part(4).alias("title"), F.filter(F.split(part(5), ":"), lambda t: t != "").alias("tags"))


def planned(documents: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, kind, date of every DEADLINE and SCHEDULED."""
    found = F.regexp_extract_all(text, F.lit(r"\b(?:DEADLINE|SCHEDULED):\s*<\d{4}-\d{2}-\d{2}"), F.lit(0))
    rows = documents.select(id_col, F.explode(found).alias("m"))
    return rows.select(id_col, F.regexp_extract("m", r"^(\w+):", 1).alias("kind"), F.regexp_extract("m", r"(\d{4}-\d{2}-\d{2})$", 1).alias("date"))


def signals(documents: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, headings, open_tasks, done_tasks, priority_a, first_deadline of each document."""
    heads = outline(documents, id_col, text).groupBy(id_col).agg(F.count(F.lit(1)).alias("headings"), F.count_if(F.col("todo").isin(*OPEN_STATES)).alias("open_tasks"), F.count_if(F.col("todo").isin("DONE", "CANCELLED")).alias("done_tasks"), F.count_if(F.col("priority") == "A").alias("priority_a"))
    dates = planned(documents, id_col, text).groupBy(id_col).agg(F.min(F.when(F.col("kind") == "DEADLINE", F.col("date"))).alias("first_deadline"))
    return documents.select(id_col).join(heads, id_col, "left").join(dates, id_col, "left").fillna(0, ["headings", "open_tasks", "done_tasks", "priority_a"])


# Words that ask for tasks.
TASK_WORDS = frozenset(("task", "tasks", "todo", "todos", "deadline", "deadlines", "priority", "priorities", "plan", "agenda", "due", "next"))


def task_boost(query: str, found: DataFrame) -> DataFrame:
    """Signals with a boost for queries that ask for tasks: open tasks, priority A and a deadline."""
    asks = bool(TASK_WORDS & set(lexical.query_terms(query)))
    value = F.least(F.lit(60), F.col("open_tasks") * 10) + F.least(F.lit(40), F.col("priority_a") * 20) + F.when(F.col("first_deadline").isNotNull(), 20).otherwise(0)
    return found.withColumn("boost", value if asks else F.lit(0))


def evidence(documents: DataFrame, id_col: str, text: Column, window: int = 1200, most: int | None = spans.MOST_WINDOWS) -> DataFrame:
    """id, kind, label, start, end, text, base_score of dated sections, headings and windows; the same span counts once.

    One pass over each text, without a shuffle; `most` windows and the tail of a text, all of them with None.
    """
    return documents.select(id_col, F.explode(spans.evidence(text, window, most)).alias("s")).select(id_col, "s.kind", "s.label", "s.start", "s.end", "s.text", "s.base_score")


def evidence_query(rows: DataFrame, query: str, path: Column, limit: int) -> DataFrame:
    """The best evidence rows: base, lexical score and path boost."""
    out = spans.scored(rows, query).withColumn("total", F.col("score") + T.path_boost(F.lit(query), path))
    return out.filter("lexical > 0").orderBy(F.desc("total"), "start").limit(limit)


def profile(found: DataFrame) -> DataFrame:
    """One row: documents, those with an outline, tasks, and the first deadline of a corpus."""
    return found.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("headings") > 0).alias("outlined"), F.sum("open_tasks").alias("open_tasks"), F.sum("priority_a").alias("priority_a"), F.min("first_deadline").alias("first_deadline"))


def quality_gate(index: DataFrame) -> DataFrame:
    """index_id, empty_summaries, without_provenance, lost_outline, status of chunks (index_id, summary, source_boundary, content, evidence_rows)."""
    checks = index.groupBy("index_id").agg(F.count_if(F.coalesce(T.strip(F.col("summary")), F.lit("")) == "").alias("empty_summaries"), F.count_if(F.coalesce("source_boundary", F.lit("")) == "").alias("without_provenance"), F.count_if(F.col("content").rlike(r"(?m)^\*+ ") & (F.coalesce("evidence_rows", F.lit(0)) == 0)).alias("lost_outline"))
    return checks.withColumn("status", F.when(F.col("without_provenance") + F.col("lost_outline") > 0, "fail").when(F.col("empty_summaries") > 0, "warn").otherwise("pass"))


def recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """fixture, wanted, hits, recall of expected keys (fixture, key) among found ones (fixture, key)."""
    hit = found.select("fixture", "key", F.lit(1).alias("_h")).distinct()
    return expected.distinct().join(hit, ["fixture", "key"], "left").groupBy("fixture").agg(F.count(F.lit(1)).alias("wanted"), F.count("_h").alias("hits")).withColumn("recall", F.col("hits") / F.col("wanted"))


def command_traces(rows: DataFrame, tests: int = 5) -> DataFrame:
    """command, path, line, handler, tests: commands of a code map with their handlers and the tests that mention them.

    A test scores 20 a word it shares with the command, and 40 for the handler's name; the
    join goes through words, so that only tests sharing one meet a command.
    """
    commands = rows.filter("kind = 'command'").select(F.col("name").alias("command"), "path", "line", F.concat(F.lit("command_"), F.replace("name", F.lit("-"), F.lit("_"))).alias("wanted"))
    functions = rows.filter("kind = 'function'").select("name", "qualname", F.col("path").alias("in_path"), "line")
    handlers = functions.groupBy("name").agg(F.min(F.struct("in_path", "qualname")).alias("h"))
    found = commands.join(handlers, commands.wanted == handlers.name, "left").select("command", "path", "line", "wanted", F.col("h.qualname").alias("handler"))
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: (w != "test") & (F.length(w) > 2))
    checks = functions.filter(F.col("name").startswith("test_")).select(F.col("qualname").alias("test"), F.explode(F.array_distinct(words(F.col("name")))).alias("word"), F.col("name").alias("test_name"))
    asked = found.select("command", "wanted", F.explode(F.array_distinct(words(F.col("command")))).alias("word"))
    scored = asked.join(checks, "word").groupBy("command", "test").agg((F.count(F.lit(1)) * 20 + F.max(F.when(F.contains("test_name", "wanted"), 40).otherwise(0))).alias("score"))
    best = scored.groupBy("command").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "test"))), 1, tests), lambda x: x["test"]).alias("tests"))
    return found.join(best, "command", "left").select("command", "path", "line", "handler", F.coalesce("tests", F.array().cast("array<string>")).alias("tests"))
