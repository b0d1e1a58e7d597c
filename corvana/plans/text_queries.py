"""Queries of text functions, tokens and lexical ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import lexical, memory, spans
from corvana.plans.tables import TERMS_SQL, first_question, score_sql, table

WORDS = "'[A-Za-z0-9_''-]{3,}'"


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of each word and the documents that have it: a document is one row, so both are counts with map-side combine."""
    counted = table(spark, sf, "documents").select(F.explode(T.word_counts(F.col("text"))).alias("w"))
    return counted.groupBy("w.word").agg(F.sum("w.n").alias("n"), F.count(F.lit(1)).alias("docs"))


def first_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each question with count and first place."""
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word")).groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first_pos"))


def lexical_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that scores against the first question."""
    return lexical.with_score(table(spark, sf, "documents").select("doc_id", "text"), first_question(spark, sf), F.col("text")).filter("score > 0").select("doc_id", "score")


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_scores(spark, sf).orderBy(F.desc("score"), "doc_id").limit(20)


def matched_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = list(lexical.query_terms(first_question(spark, sf)))
    out = table(spark, sf, "documents").select("doc_id", T.shared_terms(terms, F.col("text")).alias("m"))
    return out.select("doc_id", F.size("m").cast("long").alias("n_terms"), F.array_join("m", " ").alias("terms"))


def compact_texts(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.compact(x, 60).alias("compact"), T.compact_middle(x, 60).alias("middle"), T.compact_source_middle(x, 60).alias("source_middle"), T.bounded_preview(x, 80).alias("preview"))


def titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.title(F.col("text")).alias("title"))


def human_units(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    size = F.col("n_chars") * F.col("n_chars") * 16
    return d.select("doc_id", T.human_bytes(size).alias("bytes"), T.duration(F.col("n_chars")).alias("short"), T.duration(F.col("n_chars"), " ").alias("words"))


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.name_slug(u).alias("name_slug"), T.safe_slug(u, 40).alias("safe_slug"), T.short_ref(u, "page").alias("ref"), T.file_component(u, "x").alias("component"))


def path_boost(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://", "")
    query = "see ththth.example.net/en/25#top. and therha.example.com or example.org (a.b)"
    return table(spark, sf, "pages").select("page_id", T.path_boost(F.lit(query), path).cast("long").alias("boost"))


def memory_tags(spark: SparkSession, sf: str) -> DataFrame:
    return memory.tags(table(spark, sf, "documents"), "doc_id", F.col("text")).select("doc_id", "tag", F.col("place").cast("long").alias("place"))


def code_locator(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("chunk"), F.col("html").alias("content"), F.lit("").alias("summary"))
    terms = ["track", "script", "charset"]
    scored = chunks.select(F.col("chunk").alias("page_id"), lexical.code_score(terms, F.col("path"), F.col("content"), F.col("summary")).cast("long").alias("score"), lexical.first_hit(terms, F.col("content")).cast("long").alias("first_hit"))
    return scored.filter("score > 0")


def evidence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of every document, scored against the first question, chosen without overlap: all within the row."""
    d = table(spark, sf, "documents").select("doc_id", spans.windowed(F.col("text"), 600).alias("w"))
    ranked = d.select("doc_id", spans.ranked(F.col("w"), first_question(spark, sf)).alias("w"))
    chosen = ranked.select("doc_id", F.explode(spans.select_non_overlapping(F.col("w"), 1500)).alias("s"))
    return chosen.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), (-F.col("s.o")).alias("score"))


def term_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", spans.term_window(F.col("text"), first_question(spark, sf), 200).alias("excerpt"))


QUERIES = {f.__name__: f for f in (tokenize_counts, first_words, lexical_scores, lexical_topk, matched_terms, compact_texts, titles, human_units, slugs, path_boost, memory_tags, code_locator, evidence_windows, term_windows)}


_LEX = f"WITH {TERMS_SQL},\n{score_sql('documents', 'doc_id', 'text')}\nSELECT k AS doc_id, score FROM scored WHERE score > 0"
_STRIP = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
_FLAT = rf"regexp_replace({_STRIP.format(x='text')}, '\s+', ' ', 'g')"
ORACLE = {
    "tokenize_counts": f"SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS w FROM documents) GROUP BY w",
    "first_words": f"SELECT item_id, w AS word, count(*) AS n, min(p) - 1 AS first_pos FROM (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM (SELECT item_id, regexp_extract_all(lower(text), {WORDS}) AS t FROM benchmark)) GROUP BY item_id, w",
    "lexical_scores": _LEX,
    "lexical_topk": f"{_LEX} ORDER BY score DESC, doc_id LIMIT 20",
    "matched_terms": f"WITH {TERMS_SQL}, have AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM documents), m AS (SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY numbered.n) AS t FROM have JOIN numbered USING (term) GROUP BY doc_id) SELECT d.doc_id, coalesce(m.n, 0) AS n_terms, coalesce(m.t, '') AS terms FROM documents d LEFT JOIN m USING (doc_id)",
    "compact_texts": rf"WITH f AS (SELECT doc_id, text, {_FLAT} AS flat, {_STRIP.format(x='text')} AS s FROM documents) SELECT doc_id, CASE WHEN length(flat) <= 60 THEN flat ELSE rtrim(left(flat, 59)) || '…' END AS compact, CASE WHEN length(flat) <= 60 THEN flat ELSE left(rtrim(left(flat, 27)) || ' ... ' || ltrim(right(flat, 28)), 60) END AS middle, CASE WHEN length(s) <= 60 THEN s ELSE left(regexp_replace(left(s, 27), '\s+$', '') || chr(10) || '...' || chr(10) || regexp_replace(right(s, 28), '^\s+', ''), 60) END AS source_middle, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || chr(10) || '[truncated]' END AS preview FROM f",
    "titles": r"SELECT item_id, left(array_to_string(list_slice(regexp_extract_all(text, '[\p{L}\p{N}_''-]+'), 1, 8), ' '), 80) AS title FROM benchmark",
    "human_units": "WITH d AS (SELECT doc_id, n_chars AS s, n_chars * n_chars * 16 AS v FROM documents) SELECT doc_id, CASE WHEN v < 1024 THEN v::VARCHAR || ' B' WHEN v < 1048576 THEN format('{:.1f} KiB', v / 1024.0::DOUBLE) WHEN v < 1073741824 THEN format('{:.1f} MiB', v / 1048576.0::DOUBLE) WHEN v < 1099511627776 THEN format('{:.1f} GiB', v / 1073741824.0::DOUBLE) ELSE format('{:.1f} TiB', v / 1099511627776.0::DOUBLE) END AS bytes, CASE WHEN s >= 3600 THEN format('{}h{:02d}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{}m{:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS short, CASE WHEN s >= 3600 THEN format('{}h {:02d}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{}m {:02d}s', s // 60, s % 60) ELSE format('{}s', s) END AS words FROM d",
    "slugs": r"WITH p AS (SELECT page_id, url, regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g') AS s FROM pages) SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[_\s]+', '-', 'g'), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS name_slug, left(regexp_replace(s, '^[-.]+|[-.]+$', '', 'g'), 40) AS safe_slug, 'page:' || left(sha256(url), 12) AS ref, coalesce(nullif(regexp_replace(s, '^[-.]+|[-.]+$', '', 'g'), ''), 'x') AS component FROM p",
    "path_boost": r"WITH p AS (SELECT page_id, lower(regexp_replace(url, '^[a-z]+://', '')) AS l FROM pages), m(m, own) AS (VALUES ('ththth.example.net', 'ththth.example.net'), ('therha.example.com', 'therha.example.com'), ('example.org', 'example.org'), ('a.b', 'a.b')), n AS (SELECT page_id, l, list_last(string_split(l, '/')) AS name FROM p) SELECT page_id, CAST(sum(CASE WHEN l = m OR ends_with(l, '/' || m) THEN 2500 WHEN name = own THEN 2000 WHEN contains(l, m) THEN 1200 WHEN contains(name, own) THEN 800 ELSE 0 END) AS BIGINT) AS boost FROM n, m GROUP BY page_id",
    "memory_tags": f"WITH w AS (SELECT doc_id, t AS tag, count(*) AS n, min(p) AS first_pos FROM (SELECT doc_id, unnest(k) AS t, generate_subscripts(k, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORDS}) AS k FROM documents)) GROUP BY doc_id, t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS r FROM w), s AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS place FROM r WHERE r <= 20 AND tag NOT IN ({', '.join(repr(x) for x in memory.TAG_STOP)})) SELECT doc_id, tag, place FROM s WHERE place <= 8",
    "code_locator": "WITH c AS (SELECT page_id, html, lower(html) AS l, lower(url) AS u FROM pages), t(term) AS (VALUES ('track'), ('script'), ('charset')), x AS (SELECT page_id, term, (length(l) - length(replace(l, term, ''))) // length(term) AS n, contains(u, term) AS inu, strpos(l, term) AS hit, regexp_matches(html, '(?m)^\\s*' || term || '\\s*=') AS eq, regexp_matches(html, '(?m)^\\s*(def|class)\\s+' || term || '\\b') AS de FROM c, t) SELECT page_id, CAST(sum(least(n, 8) * 90 + CASE WHEN inu THEN 250 ELSE 0 END + CASE WHEN eq THEN 350 ELSE 0 END + CASE WHEN de THEN 1200 ELSE 0 END) AS BIGINT) AS score, min(nullif(hit, 0)) - 1 AS first_hit FROM x GROUP BY page_id HAVING score > 0",
    "term_windows": rf"WITH {TERMS_SQL}, w AS (SELECT list(term) AS ts FROM numbered WHERE length(term) >= 4), h AS (SELECT doc_id, text, length(text) AS n, list_min(list_filter(list_transform(ts, lambda t: strpos(lower(text), t)), lambda p: p > 0)) - 1 AS a FROM documents, w), s AS (SELECT *, greatest(0, a - 66) AS s0, least(n, greatest(0, a - 66) + 200) AS e FROM h), f AS (SELECT doc_id, CASE WHEN n <= 200 THEN text WHEN a IS NULL THEN left(text, 200) ELSE substr(text, CASE WHEN e - s0 < 200 THEN greatest(0, e - 200) ELSE s0 END + 1, e - CASE WHEN e - s0 < 200 THEN greatest(0, e - 200) ELSE s0 END) END AS x FROM s) SELECT doc_id, {_STRIP.format(x='x')} AS excerpt FROM f",
}
