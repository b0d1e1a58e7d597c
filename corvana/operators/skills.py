"""Skills: ranking by shared terms, matching with feedback, groups to merge, unused ones; text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import similarity

# Words that say nothing about a skill.
GENERIC = ["skill", "workflow", "procedure", "response", "style", "planning", "debugging", "project", "file", "files", "with", "when", "this", "that", "use", "using", "context"]


def terms(text: Column) -> Column:
    return T.without(T.name_tokens(text), GENERIC)


def rank(skills: DataFrame, query: str, limit: int) -> DataFrame:
    """skills: slug, description, body, archived, updated_at. Ten points a shared term, twenty for a name in the query."""
    asked = F.lit(query)
    shared = F.array_intersect(T.name_tokens(asked), T.name_tokens(F.concat_ws(" ", "slug", "description", "body")))
    named = F.array_contains(T.name_tokens(asked), F.lower("slug")) | F.lower(asked).contains(F.lower("slug"))
    scored = skills.filter(~F.coalesce("archived", F.lit(False))).withColumn("score", F.size(shared) * 10 + F.when(named, 20).otherwise(0)).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("updated_at"), "slug").limit(limit)


def support_files(files: DataFrame, query: str, per_skill: int = 2) -> DataFrame:
    """slug, file, score, matched of the best support files (slug, file, content, updated_at) of each skill: ten a shared term, twenty for one in the name."""
    asked = T.name_tokens(F.lit(query))
    spelled = F.translate("file", "/.-", "   ")
    shared = F.array_intersect(asked, T.name_tokens(F.concat_ws("\n", "file", spelled, F.substring("content", 1, 8000))))
    scored = files.withColumn("matched", F.sort_array(shared)).filter(F.size("matched") > 0).withColumn("score", F.size("matched") * 10 + F.when(F.arrays_overlap(asked, T.name_tokens(F.col("file"))), 20).otherwise(0))
    w = Window.partitionBy("slug").orderBy(F.desc("score"), F.desc("updated_at"), "file")
    return scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_skill).select("slug", "file", "score", "matched")


def rendered(skills: DataFrame, files: DataFrame, query: str, limit: int, budget: int) -> DataFrame:
    """slug, place, text: the ranked skills with their best support files, as many as fit a running budget."""
    top = rank(skills, query, limit).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("updated_at"), "slug")))
    best = support_files(files, query).groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "file"))), lambda f: F.concat(F.lit("support: "), f["file"])), "\n").alias("_files"))
    text = F.concat_ws("\n", F.concat(F.lit("skill: "), "slug"), F.nullif("description", F.lit("")), F.nullif("body", F.lit("")), "_files")
    rows = top.join(best, "slug", "left").withColumn("text", text)
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_end", F.sum(F.length("text") + 2).over(w) - 2).filter(F.col("_end") <= budget).select("slug", "place", "text")


# Handlers that a skill may name, with the effects that each may have.
HANDLERS = {
    "prompt-only": ("prompt-context",),
    "temporal": ("retrieval-plan", "source-scoped-evidence"),
    "structural": ("retrieval-plan", "structured-evidence"),
    "codebase": ("retrieval-plan", "code-intelligence"),
}


def handler(name: str | None) -> str:
    """A handler that there is; prompt-only otherwise."""
    wanted = (name or "").strip()
    return wanted if wanted in HANDLERS else "prompt-only"


def effects(requested: list[str] | str | None, handler_name: str | None = None) -> list[str]:
    """Of the effects that are asked for those that the handler may have; all of its own, if none is."""
    allowed = HANDLERS[handler(handler_name)]
    asked = [e.strip() for e in (requested.split(",") if isinstance(requested, str) else requested or [])]
    return list(dict.fromkeys(e for e in asked if e in allowed)) or list(allowed)


def with_terms(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    return rows.select(id_col, terms(text).alias("terms")).withColumn("n_terms", F.size("terms"))


def matches(texts: DataFrame, skills: DataFrame, per_text: int = 3) -> DataFrame:
    """text_id, slug, shared terms: for each text the first skills, in their own order, that share a term with it.

    texts: text_id, text; skills: slug, ord, text.
    """
    left = texts.select(F.col("text_id").alias("id"), terms(F.col("text")).alias("words"))
    right = skills.select(F.col("slug").alias("id"), "ord", terms(F.col("text")).alias("words"))
    return similarity.first_sharing(left, right, per_text).toDF("text_id", "slug", "shared")


def feedback_matches(feedback: DataFrame, skills: DataFrame, per_text: int = 3) -> DataFrame:
    """The same for feedback (id, rating, note, prompt) that is not 'up'."""
    asked = feedback.filter(F.coalesce("rating", F.lit("")) != "up").select(F.col("id").alias("text_id"), F.concat_ws(" ", "note", "prompt").alias("text"))
    return matches(asked, skills, per_text)


def consolidation(rows: DataFrame, id_col: str, text: Column, least: int = 2) -> DataFrame:
    """a, b, shared: pairs of rows (a before b) that share at least `least` terms."""
    return similarity.sharing(rows.select(F.col(id_col).alias("id"), terms(text).alias("words")), least)


def stale_unused(skills: DataFrame, now: Column, days: int) -> DataFrame:
    """Skills that nobody pinned, shipped, used or patched since they were made at least `days` days ago; the oldest first."""
    age = F.floor(F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(T.timestamp(F.col("created_at")))) / 86400)
    idle = ~F.coalesce("pinned", F.lit(False)) & ~F.coalesce("builtin", F.lit(False)) & (F.coalesce("selected_count", F.lit(0)) == 0) & (F.coalesce("patch_count", F.lit(0)) == 0)
    return skills.filter(idle).withColumn("age_days", age).filter(F.col("age_days") >= days).orderBy(F.desc("age_days"), "slug")


def with_lifecycle(skills: DataFrame, state: DataFrame) -> DataFrame:
    """Skills with their lifecycle state; what has none is active and unused."""
    return skills.join(state, "slug", "left").select(*skills.columns, F.coalesce("state", F.lit("active")).alias("state"), F.coalesce("selected_count", F.lit(0)).alias("selected_count"), F.coalesce("pinned", F.lit(False)).alias("pinned"))


# What a text of instructions is searched for: severity, rule, pattern (in any case).
RULES = [
    ("block", "prompt_injection", r"ignore (all )?(previous|above) instructions|system prompt|developer message"),
    ("block", "destructive_shell", r"\brm\s+-rf\b|\bshutil\.rmtree\b|\.unlink\("),
    ("warn", "network_reference", r"\b(socket|urllib|httpx|requests|aiohttp|curl|wget)\b"),
    ("warn", "subprocess_reference", r"\b(subprocess|os\.system|Popen|pty\.spawn)\b"),
    ("warn", "ambient_secret_reference", r"\b(os\.environ|getenv|SSH_|TOKEN|API[_-]?KEY|PASSWORD|SECRET)\b"),
    ("warn", "broad_path_reference", r"(/home/|/etc/|/var/|~\/|Path\.home\()"),
    ("info", "shell_snippet", r"```(?:bash|sh|shell)|\bpython\s+-c\b"),
]
SEVERITIES = ("block", "warn", "info")
_MARK = "\x01"


def rule_findings(rows: DataFrame, id_col: str, text: Column, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, rule, severity, line of every match, by expressions alone.

    A mark before each match stays in its line when the text is split, so that lines are counted once for each rule.
    """
    clean = F.translate(text, _MARK, " ")

    def lines(pattern: str) -> Column:
        marked = F.split(F.regexp_replace(clean, F.lit(f"(?i){pattern}"), F.lit(f"{_MARK}$0")), "\n")
        counted = F.transform(marked, lambda x, i: F.struct((i + 1).alias("line"), (F.length(x) - F.length(F.translate(x, _MARK, ""))).alias("n")))
        return F.flatten(F.transform(F.filter(counted, lambda x: x["n"] > 0), lambda x: F.array_repeat(x["line"], x["n"])))

    found = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), lines(pattern).alias("lines")) for severity, rule, pattern in rules))
    out = rows.select(id_col, F.explode(F.filter(found, lambda f: F.size(f["lines"]) > 0)).alias("f"))
    return out.select(id_col, "f.rule", "f.severity", F.explode("f.lines").alias("line"))


def verdict(findings: DataFrame, id_col: str) -> DataFrame:
    """id, the number of findings of each severity, and status: blocked, review or pass."""
    n = findings.groupBy(id_col).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return n.withColumn("status", F.when(F.col("block") > 0, "blocked").when(F.col("warn") > 0, "review").otherwise("pass"))
