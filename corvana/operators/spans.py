"""Spans of evidence in a text: dated and headed sections, windows, selection under a budget.

Boundaries follow lines, so a text's sections come from one pass over it: an Arrow
UDF yields them as an array of structs, and everything after that (pruning, scores,
order, limits) is expressions on that array or ordinary rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators.lexical import query_terms, score

SPAN = "array<struct<kind:string,label:string,start:int,end:int,text:string,base_score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("base_score", pa.float64())]))

MOST_WINDOWS, LEAST_CHARS, MOST_SPANS = 32, 240, 4


def line_date(line: str) -> str:
    """The first date in brackets, else the first one, else nothing."""
    found = re.search(r"[<\[](\d{4}-\d{2}-\d{2})\b", line) or re.search(r"\b(\d{4}-\d{2}-\d{2})\b", line)
    return found[1] if found else ""


def sections(content: str, heading: str) -> list[tuple[int, int, int, str, str]]:
    """start, end, level, title, line of each heading's section: up to the next heading of its level or above."""
    heads, at = [], 0
    for line in content.splitlines(keepends=True):
        found = re.match(heading, line.rstrip())
        if found:
            heads.append((at, len(found[1]), found[2].strip(), line))
        at += len(line)
    out, after = [], []  # after: (level, start) of later headings, levels falling towards the end
    for start, level, title, line in reversed(heads):
        while after and after[-1][0] > level:
            after.pop()
        out.append((start, after[-1][1] if after else len(content), level, title, line))
        after.append((level, start))
    return out[::-1]


ORG, MARKDOWN = r"^(\*+)\s+(.*)$", r"^(#{1,6})\s+(.+)$"


def dated_sections(content: str) -> list[dict]:
    return [{"kind": "org-date", "label": d, "start": a, "end": b, "text": content[a:b].strip(), "base_score": 0.0} for a, b, _, _, line in sections(content, ORG) if (d := line_date(line))]


def _short(text: str, limit: int) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= limit else flat[: limit - 1].rstrip() + "…"


def headed_sections(content: str, style: str, deepest: int = 4) -> list[dict]:
    found = sections(content, ORG if style == "org" else MARKDOWN)
    return [{"kind": f"{style}-heading", "label": _short(t, 120), "start": a, "end": b, "text": x, "base_score": 80.0 - 4 * n} for a, b, n, t, _ in found if n <= deepest and (x := content[a:b].strip())]


def windows(content: str, size: int, most: int | None = MOST_WINDOWS) -> list[dict]:
    """Overlapping windows at steps of three quarters that end at a blank line in their second half: at most `most` and the tail, or all (None)."""
    size = max(LEAST_CHARS, size)
    if not content.strip():
        return []

    def made(kind: str, label: str, a: int, b: int, base: float) -> list[dict]:
        text = content[a:b].strip()
        return [{"kind": kind, "label": label, "start": a, "end": b, "text": text, "base_score": base}] if text else []

    if len(content.strip()) <= size:
        return made("whole-chunk", "whole chunk", 0, len(content), 10.0)
    out: list[dict] = []
    at = 0
    while at < len(content) and (most is None or len(out) < most):
        end = min(len(content), at + size)
        blank = content.rfind("\n\n", at, end)
        end = blank if blank > at + size // 2 else end
        out += made("text-window", f"chars {at}-{end}", at, end, 5.0)
        if end >= len(content):
            return out
        at = max(at + int(size * 0.75), end - size // 4)
    if out and out[-1]["end"] < len(content):
        tail = max(0, len(content) - size)
        out += made("text-window", f"tail chars {tail}-{len(content)}", tail, len(content), 8.0)
    return out


def _udf(make: Callable[[str], Iterable[dict]]) -> Callable[[Column], Column]:
    @F.arrow_udf(SPAN)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([list(make(t or "")) for t in texts.to_pylist()], _ARROW)

    return run


def dated(content: Column) -> Column:
    return _udf(dated_sections)(content)


def headed(content: Column, style: str) -> Column:
    return _udf(lambda t: headed_sections(t, style))(content)


def windowed(content: Column, size: int, most: int | None = MOST_WINDOWS) -> Column:
    return _udf(lambda t: windows(t, size, most))(content)


def every_span(content: str, size: int, most: int | None = MOST_WINDOWS) -> list[dict]:
    """Dated sections, headings and windows in that order; of spans of one place that begin alike the first."""
    found = [*dated_sections(content), *headed_sections(content, "org"), *headed_sections(content, "markdown"), *windows(content, size, most)]
    once: dict[tuple, dict] = {}
    for s in found:
        once.setdefault((s["start"], s["end"], s["text"][:240]), s)
    return list(once.values())


def evidence(content: Column, size: int, most: int | None = MOST_WINDOWS) -> Column:
    return _udf(lambda t: every_span(t, size, most))(content)


def prune_nested(spans: Column) -> Column:
    """Without spans that lie in an earlier or longer span of the same date."""
    order = F.array_sort(spans, lambda a, b: F.when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    # By start, and the longest first: a span lies in one before it if that of its date which reaches farthest reaches its end.
    state = F.struct(F.slice(order, 1, 0).alias("kept"), F.lit("").alias("label"), F.lit(-1).alias("far"))

    def step(acc: Column, s: Column) -> Column:
        inside = (acc["label"] == s["label"]) & (s["end"] <= acc["far"])
        return F.when(inside, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(s)).alias("kept"), s["label"].alias("label"), s["end"].alias("far")))

    return F.array_sort(F.aggregate(order, state, step)["kept"], lambda a, b: a["start"] - b["start"])


def newest_dates(rows: DataFrame, date_col: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of the n newest dates (of each key); without keys the dates are found by aggregation, not by one big window."""
    if keys:
        return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(date_col)))).filter(F.col("_r") <= n).drop("_r")
    dates = rows.select(date_col).distinct().orderBy(F.desc(date_col)).limit(n)
    return rows.join(F.broadcast(dates), date_col, "left_semi")


def scored(spans: DataFrame, query: str) -> DataFrame:
    """Spans as rows with lexical and score = base_score + lexical."""
    out = spans.withColumn("lexical", score(query_terms(query), F.col("text")))
    return out.withColumn("score", F.col("base_score") + F.col("lexical"))


def effective(spans: DataFrame) -> DataFrame:
    """Spans with the part that was chosen of them, where there is one (sub_text, sub_start, sub_end), in place of their own text and offsets."""
    part = T.strip(F.coalesce("sub_text", F.lit("")))
    at = lambda own, sub: F.when(part != "", F.coalesce(sub, own)).otherwise(F.col(own)).alias(own)
    return spans.select(*(c for c in spans.columns if c not in ("text", "start", "end", "sub_text", "sub_start", "sub_end")), F.when(part != "", part).otherwise(F.col("text")).alias("text"), at("start", "sub_start"), at("end", "sub_end"))


def model_text(kind: Column, label: Column, text: Column, limit: int) -> Column:
    """A span as a model reads it: kind and label before its text, whose middle goes where it is too long."""
    clean = lambda c: F.nullif(T.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    prefix = F.concat_ws(": ", clean(kind), clean(label))
    plain = T.compact_middle(text, max(1, limit))
    # The prefix decides how much is left: one expression for each length of it that is possible.
    room = F.greatest(F.lit(120), F.lit(limit) - F.length(prefix) - 1)
    flat = T.collapse(text)
    side = F.greatest(F.lit(1), F.floor((room - 5) / 2).cast("int"))
    tail = F.greatest(F.lit(1), room - 5 - side)
    short = F.substring(F.concat(T.rstrip(F.substring(flat, F.lit(1), side)), F.lit(" ... "), T.lstrip(F.substring(flat, F.length(flat) - tail + 1, tail))), F.lit(1), room)
    body = F.when(F.length(flat) <= room, flat).otherwise(short)
    return F.when(prefix == "", plain).otherwise(T.strip(F.substring(F.concat(prefix, F.lit("\n"), body), 1, limit)))


def model_rows(candidates: DataFrame, limit: int, most: int) -> DataFrame:
    """Parts of all candidates' spans (id, spans) as rows for a model: id, span, part, model_text, offsets."""
    flat = candidates.select("id", F.posexplode("spans").alias("span", "s")).select("id", "span", "s.*")
    parts = subspans(flat, limit, most)
    return parts.withColumn("model_text", model_text(F.col("kind"), F.col("label"), F.col("text"), limit))


def ranked(spans: Column, query: str) -> Column:
    """An array of spans as (o, start, end, kind, text), the highest base_score + lexical first; o is its negative."""
    terms = query_terms(query)
    return F.array_sort(F.transform(spans, lambda s: F.struct((-(s["base_score"] + score(terms, s["text"]))).alias("o"), s["start"], s["end"], s["kind"], s["text"])))


def select_non_overlapping(spans: Column, budget: int) -> Column:
    """Greedy choice in the given order: no overlap, at most MOST_SPANS, within the budget with separators of two.

    A first span over the budget is shortened and stands alone; what is chosen is ordered by start.
    """
    state = F.struct(F.slice(spans, 1, 0).alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        size, first = F.length(s["text"]), F.size(acc["kept"]) == 0
        cost = size + F.when(first, 0).otherwise(2)
        clash = F.exists(acc["kept"], lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"]))
        long_first = first & (size > budget)
        shown = F.when(long_first, s.withField("text", T.compact_source_middle(s["text"], budget))).otherwise(s)
        skip = acc["full"] | clash | (T.strip(s["text"]) == "") | (~first & (acc["used"] + cost > budget))
        used = acc["used"] + cost
        taken = F.struct(F.concat(acc["kept"], F.array(shown)).alias("kept"), used.alias("used"), (long_first | (used >= budget) | (F.size(acc["kept"]) + 1 >= MOST_SPANS)).alias("full"))
        return F.when(skip, acc).otherwise(taken)

    return F.array_sort(F.aggregate(spans, state, step)["kept"], lambda a, b: a["start"] - b["start"])


def fit(spans: Column, budget: int) -> Column:
    """Spans by start; over the budget each is cut to an equal share of at least 180 characters."""
    order = F.array_sort(F.filter(spans, lambda s: T.strip(s["text"]) != ""), lambda a, b: a["start"] - b["start"])
    n = F.size(order)
    total = F.aggregate(order, 2 * F.greatest(F.lit(0), n - 1), lambda acc, s: acc + F.length(T.strip(s["text"])))
    share = F.greatest(F.lit(180), F.floor((budget - 2 * (n - 1)) / F.greatest(n, F.lit(1))).cast("int"))

    def cut(s: Column) -> Column:
        text, side = T.strip(s["text"]), F.greatest(F.lit(1), F.floor((share - 5) / 2).cast("int"))
        tail = F.greatest(F.lit(1), share - 5 - side)
        short = F.concat(T.rstrip(F.substring(text, F.lit(1), side)), F.lit("\n...\n"), T.lstrip(F.substring(text, F.length(text) - tail + 1, tail)))
        return s.withField("text", F.when(F.length(text) <= share, text).otherwise(short))

    return F.when(total <= budget, order).otherwise(F.transform(order, cut))


def term_window(content: Column, query: str, size: int) -> Column:
    """A window that begins a third of its size before the earliest query term of four or more letters."""
    terms = [t for t in query_terms(query) if len(t) >= 4]
    low = F.lower(content)
    places = F.filter(F.array(*(F.locate(t, low) for t in terms)).cast("array<int>"), lambda p: p > 0) if terms else F.array().cast("array<int>")
    anchor = F.array_min(places) - 1
    start = F.greatest(F.lit(0), anchor - size // 3)
    end = F.least(F.length(content), start + size)
    start = F.when(end - start < size, F.greatest(F.lit(0), end - size)).otherwise(start)
    hit = T.strip(F.substring(content, start + 1, end - start))
    return F.when(F.length(content) <= size, T.strip(content)).when(F.size(places) == 0, T.strip(F.substring(content, 1, size))).otherwise(hit)


def packed(rows: DataFrame, keys: list[str], order: list[Column], length: Column, budget: int, separator: int = 2) -> DataFrame:
    """Rows of each key that fit, in order, before a running budget: the row that would pass it is left out with all after it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_end", F.sum(length + separator).over(w) - separator)
    return out.filter(F.col("_end") <= budget).drop("_end")


def with_best_content(rows: DataFrame, content_col: str, query: str, limit: int, name: str = "excerpt") -> DataFrame:
    """Rows with what of a text answers a query within a limit: sections of the dates it names (or the newest it asks for), else a window."""
    from corvana.plans.planner import dates, recent_count

    exact, recent, content = dates(query), recent_count(query), F.col(content_col)
    # Sections are a column of their own: a lambda may not hold a Python function.
    out = rows.withColumn("_s", prune_nested(dated(content)))
    if exact:
        out = out.withColumn("_s", F.filter("_s", lambda s: s["label"].isin(exact)))
    elif recent:
        out = out.withColumn("_n", F.slice(F.reverse(F.array_sort(F.array_distinct(F.transform("_s", lambda s: s["label"])))), 1, recent))
        out = out.withColumn("_s", F.filter("_s", lambda s: F.array_contains("_n", s["label"])))
    else:
        out = out.withColumn("_s", F.slice("_s", 1, 0))
    mandatory = F.array_join(F.transform(fit(F.col("_s"), limit), lambda s: s["text"]), "\n\n")
    best = F.when(F.length(content) <= limit, T.strip(content)).when(F.size("_s") > 0, F.substring(mandatory, 1, limit)).otherwise(term_window(content, query, limit))
    return out.withColumn(name, best).drop("_s", "_n")


def _middle(text: str, limit: int) -> str:
    """A text in one line, its middle cut out beyond the limit."""
    flat = " ".join(text.split())
    if len(flat) <= limit:
        return flat
    side = max(1, (limit - 5) // 2)
    return (flat[:side].rstrip() + " ... " + flat[-max(1, limit - 5 - side) :].lstrip())[:limit]


def _pruned(spans: list[dict]) -> list[dict]:
    """Dated sections that lie in no earlier or longer one of their date, by start."""
    kept, far = [], {}
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] > far.get(s["label"], -1):
            kept.append(s)
            far[s["label"]] = s["end"]
    return kept


def dated_excerpt(content: Column, limit: int, dates: list[str] | None = None, recent: int = 0) -> Column:
    """Sections of some dates, or of the `recent` newest of a text, by date: joined, each with its middle cut out where they pass the limit."""

    def one(text: str) -> str:
        found = _pruned(dated_sections(text))
        wanted = set(dates or sorted({s["label"] for s in found})[-max(1, recent) :])
        blocks = [s["text"] for s in sorted(found, key=lambda s: (s["label"], s["start"])) if s["label"] in wanted and s["text"]]
        joined = "\n\n".join(blocks)
        if len(joined) <= limit:
            return joined
        return "\n\n".join(_middle(b, max(240, limit // len(blocks))) for b in blocks)[:limit].strip()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t or "") for t in texts.to_pylist()], pa.string())

    return run(content)


def _term_span(content: str, terms: list[str], size: int) -> list[dict]:
    """A window that begins a third of its size before the first term; the text's beginning without any."""
    low = content.lower()
    places = [at for t in terms if (at := low.find(t)) >= 0]
    a = max(0, min(places) - size // 3) if places else 0
    b = min(len(content), a + size)
    a = max(0, b - size) if b - a < size else a
    text = content[a:b].strip()
    return [{"kind": "term-window", "label": "query term window", "start": a, "end": b, "text": text, "base_score": 60.0}] if text else []


def with_selection(rows: DataFrame, content_col: str, query: str, limit: int, name: str = "excerpt", most: int | None = MOST_WINDOWS) -> DataFrame:
    """Rows with an excerpt of a text that answers a query within a limit, how it was made (method), and its spans.

    Sections of the dates that the query names, or of the newest that it asks for, come first and alone
    (date-span, cut to equal shares over the limit). Else headings, a window about the query's terms and
    windows of the whole text are scored, and the best that do not overlap fill the limit
    (scored-span). A text without any has none (empty). All of it is one pass within the row.
    """
    from corvana.plans.planner import dates, recent_count

    exact, recent = dates(query), recent_count(query)
    terms = [t for t in query_terms(query) if len(t) >= 4]

    def base(content: str) -> list[dict]:
        found = [*headed_sections(content, "org"), *headed_sections(content, "markdown"), *_term_span(content, terms, limit), *windows(content, limit, most)]
        once: dict[tuple, dict] = {}
        for s in found:
            once.setdefault((s["start"], s["end"], s["text"][:240]), s)
        return list(once.values())

    # Python functions are columns of their own: a lambda may not hold one.
    out = rows.withColumn("_t", T.strip(F.coalesce(content_col, F.lit(""))))
    if exact or recent:
        out = out.withColumn("_d", prune_nested(dated(F.col("_t"))))
        kept = F.array(*map(F.lit, exact)) if exact else F.slice(F.reverse(F.array_sort(F.array_distinct(F.transform("_d", lambda s: s["label"])))), 1, recent)
        out = out.withColumn("_n", kept).withColumn("_d", F.filter("_d", lambda s: F.array_contains("_n", s["label"]) & (s["text"] != "")))
        kind = "org-date-exact" if exact else "org-date-recent"
        must = F.transform(fit(F.col("_d"), limit), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["text"]))
    else:
        must = F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")
    out = out.withColumn("_m", must).withColumn("_b", _udf(base)(F.col("_t")))
    chosen = F.transform(select_non_overlapping(ranked(F.col("_b"), query), limit), lambda s: F.struct(s["kind"], s["start"], s["end"], s["text"]))
    out = out.withColumn("spans", F.when(F.size("_m") > 0, F.col("_m")).otherwise(chosen))
    text = T.strip(F.substring(F.array_join(F.transform("spans", lambda s: T.strip(s["text"])), "\n\n"), 1, limit))
    method = F.when(F.col("_t") == "", "empty").when(F.size("_m") > 0, "date-span").otherwise("scored-span")
    return out.withColumns({name: text, "method": method}).drop("_t", "_d", "_n", "_m", "_b")


def subspans(spans_: DataFrame, limit: int, most: int) -> DataFrame:
    """Spans (with text and start) cut into at most `most` overlapping parts of `limit` characters each, the last one the tail.

    Parts keep the place of their parent: parent_start, and their own start and end.
    """
    n, step = F.length("text"), max(1, int(limit * 0.75))
    needed = F.when(n <= limit, 1).otherwise(F.ceil((n - limit) / step) + 1).cast("int")
    kept = F.least(needed, F.lit(most))
    offset = lambda k: F.when((k == kept - 1) & (n > limit), n - limit).otherwise(k * step)
    rows = spans_.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), kept - 1), offset)).alias("part", "offset"))
    out = rows.withColumn("parent_start", F.col("start")).withColumn("text", F.substring(F.col("text"), F.col("offset") + 1, F.lit(limit)))
    return out.withColumn("start", F.col("parent_start") + F.col("offset")).withColumn("end", F.col("start") + F.length("text")).drop("offset")
