"""Scalar text, size and time functions as Columns; all but word_counts() stay in the JVM.

White space is Unicode white space throughout, lengths and offsets are code points,
and rounding is half to even, as the engine's scores need it.
"""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z0-9_'-]{3,}"
_WORDS = re.compile(WORD)


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+\z", "")


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+", "")


def collapse(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def tokens(x: Column) -> Column:
    """Lower-case runs of three or more of letters, digits, _, ' and - (ASCII), in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(WORD), F.lit(0))


def word_counts(x: Column) -> Column:
    """Distinct tokens with their counts, the commonest first, then by first occurrence: one Arrow pass, nothing leaves the row."""

    @F.arrow_udf("array<struct<word:string,n:int>>")
    def run(texts: pa.Array) -> pa.Array:
        out = [[{"word": w, "n": n} for w, n in counted(t).most_common()] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))

    return run(x)


def now() -> str:
    """The driver's time as ISO text with its offset, to the second."""
    return datetime.now().astimezone().isoformat(timespec="seconds")


def counted(text: str | None) -> Counter[str]:
    """Tokens of a text with their counts, by first occurrence."""
    return Counter(_WORDS.findall((text or "").lower()))


def locator_tokens(x: Column | str) -> Column:
    """Code tokens of two or more characters, and their parts between _, ., / and -."""
    x = F.col(x) if isinstance(x, str) else x
    whole = F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9_./-]{2,}"), F.lit(0))
    parts = F.flatten(F.transform(whole, lambda t: F.split(t, r"[_./-]+")))
    return F.array_union(whole, F.filter(parts, lambda p: F.length(p) >= 2))


def name_tokens(x: Column) -> Column:
    """The distinct tokens of three or more of letters, digits, _, . and -."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9_.-]{3,}"), F.lit(0)))


def without(terms: Column, stop: list[str]) -> Column:
    return F.array_except(terms, F.array(*map(F.lit, stop))) if stop else terms


def shared_terms(query_terms: list[str], x: Column) -> Column:
    """The query's distinct terms that occur in a text, in the query's order."""
    have = tokens(x)
    return F.filter(F.array(*map(F.lit, query_terms)).cast("array<string>"), lambda t: F.array_contains(have, t))


def compact(x: Column, limit: int) -> Column:
    """Collapsed; beyond limit characters, cut and closed by an ellipsis."""
    flat = collapse(x)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(rstrip(F.substring(flat, 1, max(0, limit - 1))), F.lit("…")))


def _middle(flat: Column, limit: int, marker: str) -> Column:
    if limit <= 12:
        cut = rstrip(F.substring(flat, 1, limit))
    else:
        side = max(1, (limit - len(marker)) // 2)
        tail = max(1, limit - len(marker) - side)
        cut = F.substring(F.concat(rstrip(F.substring(flat, 1, side)), F.lit(marker), lstrip(F.substring(flat, -tail, tail))), 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def compact_middle(x: Column, limit: int) -> Column:
    """Collapsed; beyond limit, head and tail around ' ... '."""
    return _middle(collapse(x), limit, " ... ")


def compact_source_middle(x: Column, limit: int) -> Column:
    """Stripped; beyond limit, head and tail around a line with '...'."""
    return _middle(strip(x), limit, "\n...\n")


def bounded_preview(x: Column, limit: int, notice: str = "\n[truncated]") -> Column:
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit), F.lit(notice)))


def title(x: Column) -> Column:
    """The first eight words, at most 80 characters; 'Untitled' without a word."""
    words = F.regexp_extract_all(strip(x), F.lit(r"(?U)[\w'-]+"), F.lit(0))
    return F.when(F.size(words) == 0, "Untitled").otherwise(F.substring(F.array_join(F.slice(words, 1, 8), " "), 1, 80))


def human_bytes(n: Column) -> Column:
    """Bytes in binary units with one decimal."""
    value = n.cast("double")
    steps = [(1024.0**k, unit) for k, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB"))]
    shown = lambda size, unit: F.format_string(f"%.1f {unit}", F.bround(value / size, 1))
    out = shown(*steps[4])
    for size, unit in reversed(steps[1:4]):
        out = F.when(value < size * 1024, shown(size, unit)).otherwise(out)
    return F.when(value < 1024, F.concat(value.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def parse_bytes(x: Column) -> Column:
    """'12GiB', '8m', '1_000' in bytes, every unit a power of 1024; null if it is no size."""
    text = F.replace(F.lower(strip(x)), F.lit("_"), F.lit(""))
    unit = F.regexp_extract(text, r"^\d+([kmgt]?)i?b?$", 1)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    valid = text.rlike(r"^\d+([kmgt]?i?b?|)$") & ~text.rlike(r"^\d+ib?$")
    return F.when(valid, F.regexp_extract(text, r"^(\d+)", 1).cast("long") * F.pow(F.lit(1024.0), power).cast("long"))


def duration(seconds: Column, gap: str = "") -> Column:
    """1h02m, 3m04s or 5s; gap: what stands between the two parts; '?' for null."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return (
        F.when(seconds.isNull(), "?")
        .when(hours > 0, F.concat(hours.cast("string"), F.lit(f"h{gap}"), two(minutes), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit(f"m{gap}"), two(rest), F.lit("s")))
        .otherwise(F.concat(rest.cast("string"), F.lit("s")))
    )


# What makes two labels of one phase differ (counters, estimates and refresh modes).
_VOLATILE = (
    r"(?U)\s+(?:initial|full|incremental|resumed|reuse-only|rebuild)(?:\s+(?!(?:reuse|new|batch|parallel|rows|eta)\b)\S+)?(?:\s+reuse\s+\d+)?(?:\s+new\s+\d+)?",
    r"(?U)\s+retry(?=\s|$)",
    r"(?U)\s+batch\s+\d+/\d+.*$",
    r"(?U)\s+rows\s+\d+/\d+.*$",
    r"(?U)\s+file\s+\d+/\d+.*$",
    r"(?U)\s+chunk\s+\d+/\d+.*$",
    r"(?U)\s+eta\s+\S+.*$",
    r"(?U)\s+call\s+\S+.*$",
)


def phase_key(x: Column) -> Column:
    """A phase label without its volatile parts."""
    out = F.coalesce(x, F.lit(""))
    for pattern in _VOLATILE:
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def timestamp(x: Column) -> Column:
    """An ISO-8601 time, UTC where it names no zone; null if it is none."""
    return F.try_to_timestamp(F.nullif(x, F.lit("")))


def relative(x: Column, now: Column) -> Column:
    """How long before now: 3h ago; 'now' under five seconds; '-' for no time."""
    at = timestamp(x)
    s = F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - F.unix_timestamp(at))
    out = F.when(s < 5, F.lit("now")).otherwise(F.concat(s.cast("string"), F.lit("s ago")))
    for suffix, size in (("m", 60), ("h", 3600), ("d", 86400), ("mo", 30 * 86400), ("y", 365 * 86400)):
        out = F.when(s >= size, F.concat(F.floor(s / size).cast("string"), F.lit(f"{suffix} ago"))).otherwise(out)
    return F.when(at.isNull(), "-").otherwise(out)


# What people write for a rating.
RATINGS = {"+": "up", "good": "up", "yes": "up", "thumbsup": "up", "thumbs-up": "up", "up": "up", "-": "down", "bad": "down", "no": "down", "thumbsdown": "down", "thumbs-down": "down", "down": "down", "ok": "ok", "neutral": "ok"}


def rating(x: Column) -> Column:
    """up, down or ok; null if it is no rating."""
    known = F.create_map(*(F.lit(v) for pair in RATINGS.items() for v in pair))
    return F.try_element_at(known, F.lower(strip(F.coalesce(x, F.lit("")))))


def name_slug(x: Column, limit: int = 64) -> Column:
    """Lower case, every run of other characters one hyphen, none at the ends."""
    kebab = F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"[_\s]+", "-"), r"[^a-z0-9-]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(kebab, r"-+", "-"), r"^-+|-+$", ""), 1, limit)


def safe_slug(x: Column, limit: int = 80) -> Column:
    """Letters, digits, _, . and - as they are; every run of others one hyphen."""
    return F.substring(F.regexp_replace(F.regexp_replace(strip(x), r"[^A-Za-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", ""), 1, limit)


def file_component(x: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit(fallback))


def brief_error(x: Column, limit: int = 240) -> Column:
    """One line of an error: terminal colours out, an HTTP status to the front, cut at limit."""
    plain = collapse(F.regexp_replace(x, "\x1b\\[[0-9;]*[A-Za-z]", ""))
    status = F.regexp_extract(plain, r"(?i)\b(?:HTTP(?: Error)?|status)[ :]*(\d{3})\b", 1)
    return compact(F.when((status != "") & ~plain.startswith(F.concat(F.lit("HTTP "), status)), F.concat(F.lit("HTTP "), status, F.lit(": "), plain)).otherwise(plain), limit)


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def short_ref(x: Column, prefix: str) -> Column:
    """prefix:first 12 hexadecimal digits, or prefix:none for nothing."""
    empty = F.coalesce(strip(x), F.lit("")) == ""
    return F.concat(F.lit(f"{prefix}:"), F.when(empty, "none").otherwise(F.substring(sha256(x), 1, 12)))


def json_object(x: Column) -> Column:
    """The JSON object in a reply, fences and chatter around it left out; null without one."""
    plain = strip(F.regexp_replace(strip(x), r"^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(c.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(plain), ok(inner))


def path_mentions(x: Column) -> Column:
    """Distinct file-like words of a text in order: lower case, with a dot in the last part."""
    raw = F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9_./~+-]+\.[A-Za-z0-9][A-Za-z0-9._+-]*"), F.lit(0))
    clean = F.transform(raw, lambda m: F.lower(F.regexp_replace(m, r"""^[.,;:()\[\]{}<>"']+|[.,;:()\[\]{}<>"']+$""", "")))
    return F.array_distinct(F.filter(clean, lambda m: F.element_at(F.split(m, "/"), -1).contains(".")))


def date_mentions(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# What a mentioned file adds to a path that is it, has its name, holds it, or whose name holds its name.
WHOLE_PATH, SAME_NAME, PART_OF_PATH, PART_OF_NAME = 2500, 2000, 1200, 800


def path_boost(query: Column, path: Column) -> Column:
    """What all files mentioned in a query add to a path; of each the first of the cases that holds."""
    low = F.lower(F.coalesce(path, F.lit("")))
    name = base_name(low)

    def add(total: Column, m: Column) -> Column:
        own = base_name(m)
        whole, part = (low == m) | low.endswith(F.concat(F.lit("/"), m)), (own != "") & name.contains(own)
        return total + F.when(whole, WHOLE_PATH).when(name == own, SAME_NAME).when(low.contains(m), PART_OF_PATH).when(part, PART_OF_NAME).otherwise(0)

    return F.when(low == "", 0).otherwise(F.aggregate(path_mentions(query), F.lit(0), add))


def split_sentences(x: Column) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s != "")
