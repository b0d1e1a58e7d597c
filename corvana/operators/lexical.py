"""Lexical scoring: saturated term counts without corpus statistics, and code location.

Queries are scalars, so their terms are worked out on the driver and stand in the plan
as literals; scoring is then a projection, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.functions import text as T

K1, B, AVERAGE_LENGTH = 1.2, 0.75, 400
LONG_TERM, LONG_WEIGHT = 7, 1.15


def query_terms(query: str) -> Counter:
    """Terms of a query with their counts, in order of first occurrence."""
    return Counter(re.findall(T.WORD, query.lower()))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def score_tokens(terms: Counter, tokens: Column) -> Column:
    """Score of a text's tokens: saturated counts, query counts up to two, half a point for adjacent query terms.

    The sum runs in the query's order; the result is ten times it, rounded half to even.
    """
    if not terms:
        return F.lit(0).cast("long")
    names = list(terms)
    # A lambda's free expressions are worked out anew for each element: what they share is bound first.
    parts = F.struct(F.filter(tokens, lambda t: t.isin(names)).alias("hits"), F.greatest(F.lit(1), F.size(tokens)).alias("n"), F.array_join(tokens, " ").alias("joined"))
    entries = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(LONG_WEIGHT if len(t) >= LONG_TERM else 1.0).alias("weight"), F.lit(min(c, 2)).alias("times")) for t, c in terms.items()))
    pairs = _strings([f"{a} {b}" for a, b in zip(names, names[1:], strict=False)])

    def one(hits: Column, base: Column, entry: Column) -> Column:
        n = F.size(F.filter(hits, lambda t: t == entry["term"]))
        return F.when(n > 0, entry["weight"] * (n * (K1 + 1.0) / (n + base)) * entry["times"]).otherwise(0.0)

    def whole(p: Column) -> Column:
        base = K1 * (1.0 - B + B * p["n"] / AVERAGE_LENGTH)
        total = F.when(F.size(p["hits"]) == 0, 0.0).otherwise(F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + one(p["hits"], base, e)))
        return total + 0.5 * F.size(F.filter(pairs, lambda x: F.contains(p["joined"], x)))

    total = F.element_at(F.transform(F.array(parts), whole), 1)
    return F.when(F.size(tokens) == 0, 0).otherwise(F.bround(total * 10)).cast("long")


def score(terms: Counter, text: Column) -> Column:
    return score_tokens(terms, T.tokens(text))


def with_score(rows: DataFrame, query: str, text: Column, name: str = "score") -> DataFrame:
    """Rows with a score; the tokens are computed once for each row."""
    terms = query_terms(query)
    return rows.withColumn("_tokens", T.tokens(text)).withColumn(name, score_tokens(terms, F.col("_tokens"))).drop("_tokens")


def score_parts(rows: DataFrame, query: str, haystack: Column, path: Column) -> DataFrame:
    """lexical, path_boost, total and up to 24 matched terms of each row."""
    terms = query_terms(query)
    out = rows.withColumn("_tokens", T.tokens(haystack)).withColumn("lexical", score_tokens(terms, F.col("_tokens"))).withColumn("path_boost", T.path_boost(F.lit(query), path).cast("long"))
    matched = F.slice(F.filter(_strings(list(terms)), lambda t: F.array_contains("_tokens", t)), 1, 24)
    return out.withColumn("matched_terms", matched).withColumn("total", F.col("lexical") + F.col("path_boost")).drop("_tokens")


def overlap(left: Column, right: Column) -> Column:
    """Overlap coefficient of two token sets, 0 where one is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / least).otherwise(0.0)


# Words, phrases and signs that ask for code, words that are no code terms, and what code looks like.
CODE_HINTS = frozenset(("code", "source", "repo", "repository", "implementation", "implemented", "implements", "handler", "handles", "handled", "function", "class", "module", "method", "command", "cli", "tui", "parser", "render", "renderer", "schema", "route", "endpoint", "test", "tests", "defined", "definition", "called", "calls", "import", "imports"))
CODE_PHRASES = ("which file", "where is", "where does", "takes care of")
CODE_SIGNS = (r"(?<!\S)/[A-Za-z][\w-]*", r"`[^`]{2,120}`", r"\b[A-Za-z_][A-Za-z0-9_]{2,}\s*\(")
CODE_STOP = frozenset(("about", "which", "what", "where", "when", "file", "files", "repo", "repository", "takes", "care", "page", "thing", "this", "that", "does", "with", "from", "into", "there", "have"))
CODE_TOKENS = {"command": r"(?<!\S)/[A-Za-z][\w-]*", "code": r"`([^`]{1,120})`", "quoted": r"\"([^\"]{1,120})\"|'([^']{1,120})'", "identifier": r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"}
HANDLER_NAMES = ("format", "command", "handle")
CODE_SUFFIXES = ("py", "nix", "sh", "bash", "zsh", "fish", "js", "jsx", "ts", "tsx", "rs", "go", "c", "h", "cc", "cpp", "hpp", "java", "kt", "swift", "rb", "lua", "el", "vim", "scm", "sql", "toml", "json", "yaml", "yml")
CODE_LINE = r"(?m)^\s*(?:def|class|import|from|function|const|let|var|export)\s+[A-Za-z_]"
CODE_MARKS = ("add_parser(", "SLASH_COMMANDS")
LONGEST_TERM = 120


def wants_code(query: str) -> bool:
    low = query.lower()
    words = set(re.findall(r"\b[a-z][a-z0-9_:-]*\b", low))
    return not words.isdisjoint(CODE_HINTS) or any(p in low for p in CODE_PHRASES) or any(re.search(s, query) for s in CODE_SIGNS)


def code_tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text) of what a question may name code by; kinds overlap, as a quoted name is an identifier, too."""
    return [(kind, next(filter(None, m.groups()), m[0]).strip()) for kind, pattern in CODE_TOKENS.items() for m in re.finditer(pattern, query)]


def code_terms(query: str) -> list[str]:
    """What to look for: a command also by its bare name and its handlers' names, an identifier unless it is a common word."""
    spelled: list[str] = []
    for kind, text in code_tokens(query):
        if kind == "command":
            spelled += [text, text[1:], *(f"{h}_{text[1:]}" for h in HANDLER_NAMES)]
        elif kind != "identifier" or text.lower() not in CODE_STOP:
            spelled.append(text)
    return list(dict.fromkeys(t for t in spelled if 0 < len(t) <= LONGEST_TERM))


def looks_like_code(path: Column, content: Column) -> Column:
    name, sample = T.base_name(F.lower(path)), F.substring(content, 1, 4000)
    marked = [sample.contains(m) for m in CODE_MARKS]
    return F.greatest(name.rlike(r"\.(?:" + "|".join(CODE_SUFFIXES) + r")$"), name == "makefile", sample.rlike(CODE_LINE), *marked)


# What an occurrence counts (eight at most), what a definition, an assignment and hits in path and summary count.
MOST_HITS, COMMAND_HIT, PLAIN_HIT = 8, 900, 90
DEFINED, ASSIGNED, IN_PATH, IN_SUMMARY, HANDLES, REGISTERED = 1200, 350, 250, 25, 500, 600
_DEFINES, _ASSIGNS, _REGISTERS = r"(?m)^\s*(?:def|class)\s+([A-Za-z_]\w*)", r"(?m)^\s*([^=\n]*?)\s*=", r"\(\s*[\"']/[A-Za-z][\w-]*[\"']"


def code_score(terms: list[str], path: Column, content: Column, summary: Column) -> Column:
    """Points of all terms, as a fold over them: the plan does not grow with a question, and a text is searched for definitions once."""
    entries = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("low"), F.lit(COMMAND_HIT if t.startswith("/") else PLAIN_HIT).alias("hit"), F.lit(HANDLES if t.startswith(tuple(f"{h}_" for h in HANDLER_NAMES)) else 0).alias("handles")) for t in terms))
    shared = F.struct(F.lower(content).alias("low"), F.lower(path).alias("path"), F.lower(summary).alias("summary"), F.regexp_extract_all(content, F.lit(_DEFINES), F.lit(1)).alias("defined"), F.regexp_extract_all(content, F.lit(_ASSIGNS), F.lit(1)).alias("assigned"))

    def points(x: Column, t: Column) -> Column:
        n = F.floor((F.length(x["low"]) - F.length(F.replace(x["low"], t["low"], F.lit("")))) / F.length(t["low"])).cast("int")
        there = F.least(n, F.lit(MOST_HITS)) * t["hit"] + F.when(F.array_contains(x["defined"], t["term"]), DEFINED).otherwise(0) + F.when(F.array_contains(x["assigned"], t["term"]), ASSIGNED).otherwise(0) + t["handles"]
        return F.when(n > 0, there).otherwise(0) + F.when(F.contains(x["path"], t["low"]), IN_PATH).otherwise(0) + F.when(F.contains(x["summary"], t["low"]), IN_SUMMARY).otherwise(0)

    total = F.element_at(F.transform(F.array(shared), lambda x: F.aggregate(entries, F.lit(0), lambda acc, t: acc + points(x, t))), 1)
    return total + (F.when(content.rlike(_REGISTERS), REGISTERED).otherwise(0) if any(t.startswith("/") for t in terms) else 0)


def first_hit(terms: list[str], content: Column) -> Column:
    """Offset of the earliest term, null without one."""
    low = F.lower(content)
    places = F.element_at(F.transform(F.array(low), lambda x: F.transform(_strings([t.lower() for t in terms]), lambda t: F.nullif(F.position(t, x), F.lit(0)))), 1)
    return F.array_min(F.filter(places, lambda p: p.isNotNull())) - 1


def excerpt(terms: list[str], content: Column, limit: int = 1600) -> Column:
    """A window of limit characters that begins a third before the earliest term."""
    start = F.greatest(F.lit(0), first_hit(terms, content) - limit // 3)
    return F.coalesce(T.strip(F.substring(content, start + 1, F.lit(limit))), F.substring(content, 1, limit))


def code_rows(chunks: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """path, chunk, total, path_boost, start, text of the best code chunks; chunks: path, chunk, content, summary."""
    terms = code_terms(query)
    if not wants_code(query) or not terms:
        return chunks.select("path", "chunk", F.lit(0).alias("total"), F.lit(0).alias("path_boost"), F.lit(0).alias("start"), F.col("content").alias("text")).limit(0)
    low_path = F.lower("path")
    boost = F.when(F.exists(_strings([t.lower() for t in terms]), lambda t: F.contains(low_path, t)), 2000).otherwise(0)
    scored = chunks.filter(looks_like_code(F.col("path"), F.col("content"))).withColumn("total", code_score(terms, F.col("path"), F.col("content"), F.col("summary"))).withColumn("path_boost", boost).filter("total > 0")
    top = scored.orderBy(F.desc("total"), F.desc("path_boost"), "path", "chunk").limit(limit)
    return top.select("path", "chunk", "total", "path_boost", F.coalesce(first_hit(terms, F.col("content")), F.lit(0)).alias("start"), excerpt(terms, F.col("content")).alias("text"))
