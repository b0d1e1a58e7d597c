"""Queries of grammars: strings, trees, outlines, answers and sources that rows of the given tables are turned into.

Each row takes one of some templates, by its number, with the number where the template says {n};
the SQL makes the same strings from the same rows (tables.spread and tables.spread_sql).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.functions import text as T
from corvana.operators import audit, code, corpus, dossiers, lifecycle, memory, services, spans, vectors
from corvana.plans import planner
from corvana.plans.tables import shared_folder, spread, spread_sql, table
from corvana.sources import lines, state
from corvana.streaming import refresh

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE[run.__name__] = sql
        return run

    return add


# Strings

SIZES = ["{n}GiB", "{n}m", "1_{n}", " {n} kb", "{n}kib", "{n}", "{n}tb", "{n}b", "x{n}", "{n}ib", ""]


@_query(f"WITH t AS (SELECT {spread_sql('doc_id', SIZES)} AS size FROM documents), n AS (SELECT size, replace(lower(trim(size)), '_', '') AS x FROM t) SELECT size, CASE WHEN regexp_full_match(x, '\\d+([kmgt]i?b?|b|)') THEN regexp_extract(x, '^\\d+')::BIGINT * (CASE regexp_extract(x, '^\\d+([kmgt])', 1) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN 't' THEN 1099511627776 ELSE 1 END) END AS bytes FROM n")
def parse_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(spread(F.col("doc_id"), SIZES).alias("size"))
    return rows.select("size", T.parse_bytes(F.col("size")).alias("bytes"))


PHASES = ["embedding full reuse {n} new {n} batch {n}/9 eta 3m", "summaries retry", "index file {n}/8 x", "chunk chunk {n}/5", "plain {n}", "call abc{n} def", " rebuild route rows {n}/2"]
PHASE_KEYS = ["embedding", "summaries", "index", "chunk", "plain {n}", "call abc{n} def", ""]


@_query(f"SELECT {spread_sql('event_id', PHASES)} AS phase, {spread_sql('event_id', PHASE_KEYS)} AS key FROM events")
def phase_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(spread(F.col("event_id"), PHASES).alias("phase"))
    return rows.select("phase", T.phase_key(F.col("phase")).alias("key"))


@_query("WITH t AS (SELECT event_id, date_trunc('second', ts) AS ts, event_id % 5 AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events), s AS (SELECT *, CASE k WHEN 0 THEN iso WHEN 1 THEN iso || '+02:00' WHEN 2 THEN left(iso, 10) WHEN 3 THEN 'on ' || iso ELSE '' END AS moment, greatest(0, epoch(TIMESTAMP '2024-03-01 12:00:00')::BIGINT - epoch(CASE k WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR ELSE date_trunc('day', ts) END)::BIGINT) AS s FROM t) SELECT event_id, moment, CASE WHEN k > 2 THEN '-' WHEN s < 5 THEN 'now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' WHEN s < 31536000 THEN s // 2592000 || 'mo ago' ELSE s // 31536000 || 'y ago' END AS ago FROM s")
def relative_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times of events with and without a zone, days, and what is no time."""
    e, k = table(spark, sf, "events"), F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    moment = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("+02:00"))).when(k == 2, F.substring(iso, 1, 10)).when(k == 3, F.concat(F.lit("on "), iso)).otherwise("")
    return e.select("event_id", moment.alias("moment")).withColumn("ago", T.relative(F.col("moment"), F.lit("2024-03-01T12:00:00Z").cast("timestamp")))


RATINGS = ["+", " Good ", "thumbs-down", "neutral", "maybe {n}", "NO", ""]


@_query(f"WITH t AS (SELECT conv_id, turn, {spread_sql('conv_id + turn', RATINGS)} AS given FROM conversations) SELECT conv_id, turn, CASE WHEN lower(trim(given)) IN ('+', 'good', 'yes', 'thumbsup', 'thumbs-up', 'up') THEN 'up' WHEN lower(trim(given)) IN ('-', 'bad', 'no', 'thumbsdown', 'thumbs-down', 'down') THEN 'down' WHEN lower(trim(given)) IN ('ok', 'neutral') THEN 'ok' END AS rating FROM t")
def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.rating(spread(F.col("conv_id") + F.col("turn"), RATINGS)).alias("rating"))


REPLIES = ['{"a": {n}}', 'text {"b": [1, {n}]} more', '```json\n{"c": {"d": {n}}}\n```', "no json {n}", "[1, {n}]", '{"broken": ']
_TURN = "(conv_id * 1000 + turn)"


def _turns(spark: SparkSession, sf: str, templates: list[str | None], name: str) -> DataFrame:
    """id and a string of each turn."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf, "conversations").select(number.alias("id"), spread(number, templates).alias(name))


@_query(f"SELECT id, json_valid(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1)) AND regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) <> '' AS found, CASE WHEN json_valid(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1)) AND regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) <> '' THEN regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) END AS object FROM (SELECT {_TURN} AS id, {spread_sql(_TURN, REPLIES)} AS reply FROM conversations)")
def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a reply holds an object, and the object itself."""
    found = T.json_object(F.col("reply"))
    return _turns(spark, sf, REPLIES, "reply").select("id", found.isNotNull().alias("found"), found.alias("object"))


IGNORE = "*.log\nbuild/\n/docs/private\ncache"
PATHS = ["a{n}.log", "x/b{n}.log", "build/y{n}.txt", "src/build/z{n}.c", "docs/private/k{n}", "x{n}/docs/private", "cache", "a{n}/cache/b", "keep{n}.txt", "building{n}"]


@_query(f"SELECT {spread_sql('page_id', PATHS)} AS path, ([1, 1, 2, 2, 3, NULL, 4, 4, NULL, NULL])[page_id % 10 + 1]::INT AS line FROM pages")
def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(spread(F.col("page_id"), PATHS).alias("path"))
    return rows.select("path", R.ignored_by(F.col("path"), R.parse_ignore(IGNORE)).alias("line"))


# Trees

TREES = [
    '{"a": {"conversation_id": "c1"}, "n": {n}}',
    '{"x": [{"source_conversations": [{"id": "c2"}, {"id": "c1"}]}]}',
    '{"conversation": "c1"}',
    '{"note": "c1"}',
    '{"index_ids": ["i1", {"id": "i{n}"}]}',
    '{"owner_conversation_id": "c1", "index": {"id": "i1"}}',
    '{"conversation_ids": ["c1", {n}], "dossier_id": "d{n}"}',
    '{"kind": "topic", "id": "t{n}", "topics": ["t2", {"id": "t{n}x"}]}',
    '{"context_items": [{"kind": "index", "id": "i1"}, {"kind": "file", "id": "i9"}]}',
    '{"source_conversations": ["c1"]}',
    '{"source_index": {n}, "created_by_conversation_id": 12}',
    "no json {n}",
    None,
]
_NODES = f"t AS (SELECT {_TURN} AS id, {spread_sql(_TURN, TREES)} AS tree FROM conversations), n AS (SELECT t.id, j.id AS node, j.parent, j.key, j.type, j.value FROM t, json_tree(CASE WHEN json_valid(t.tree) THEN t.tree END) j)"


@_query(f"WITH {_NODES} SELECT DISTINCT n.id FROM n LEFT JOIN n p ON p.id = n.id AND p.node = n.parent WHERE (n.key IN ('conversation_id', 'owner_conversation_id', 'created_by_conversation_id') AND n.value->>'$' = 'c1') OR (p.type = 'ARRAY' AND p.key IN ('conversation_ids', 'source_conversation_ids') AND n.value->>'$' = 'c1') OR (p.type = 'ARRAY' AND p.key = 'source_conversations' AND n.value->>'id' = 'c1')")
def tree_references(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, TREES, "tree").filter(R.references(F.col("tree"), R.CONVERSATION, "c1")).select("id")


@_query(f"WITH {_NODES} SELECT DISTINCT n.id FROM n LEFT JOIN n p ON p.id = n.id AND p.node = n.parent WHERE (n.key IN ('index', 'index_id', 'source_index', 'source_index_id', 'created_by_index_id', 'source_fingerprint_index') AND (n.value->>'$' = 'i1' OR n.value->>'id' = 'i1')) OR (p.type = 'ARRAY' AND p.key IN ('indexes', 'index_ids', 'source_indexes', 'source_index_ids') AND (n.value->>'$' = 'i1' OR n.value->>'id' = 'i1')) OR (p.type = 'ARRAY' AND p.key = 'context_items' AND n.value->>'kind' = 'index' AND n.value->>'id' = 'i1')")
def tree_index_references(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, TREES, "tree").filter(R.references(F.col("tree"), R.INDEX, "i1")).select("id")


@_query(f"WITH {_NODES}, one(key, kind) AS (VALUES ('index', 'index'), ('index_id', 'index'), ('source_index', 'index'), ('source_index_id', 'index'), ('created_by_index_id', 'index'), ('topic', 'topic'), ('topic_id', 'topic'), ('source_topic', 'topic'), ('dossier', 'dossier'), ('dossier_id', 'dossier'), ('source_dossier', 'dossier')), many(key, kind) AS (VALUES ('indexes', 'index'), ('index_ids', 'index'), ('source_indexes', 'index'), ('source_index_ids', 'index'), ('topics', 'topic'), ('topic_ids', 'topic'), ('dossiers', 'dossier'), ('dossier_ids', 'dossier')), c AS (SELECT id, kind, value FROM n JOIN one USING (key) UNION ALL SELECT n.id, kind, n.value FROM n JOIN n p ON p.id = n.id AND p.node = n.parent AND p.type = 'ARRAY' JOIN many ON many.key = p.key UNION ALL SELECT id, value->>'kind', value FROM n WHERE type = 'OBJECT' AND value->>'kind' IN ('index', 'topic', 'dossier')), r AS (SELECT id, kind, CASE json_type(value) WHEN 'VARCHAR' THEN value->>'$' WHEN 'OBJECT' THEN value->>'id' END AS ref FROM c) SELECT DISTINCT id, kind, ref FROM r WHERE ref <> ''")
def tree_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf, TREES, "tree").select("id", F.explode(R.artifact_links(F.col("tree"))).alias("l"))
    return rows.select("id", "l.kind", F.col("l.id").alias("ref")).distinct()


SOURCES = ['{"index_id": "i1", "files": ["/s/x.org", {n}]}', '{"note": "see /s/y.org {n}"}', '{"source_index_ids": ["i2", "i1"], "n": {n}}', '{"conversation_id": "c{n}"}', "no json {n}"]
_SOURCE_PATHS = ["/s/x.org", "/s/y.org"]


@_query(f"WITH t AS (SELECT {_TURN} AS id, {_TURN} % 5 AS k, {spread_sql(_TURN, SOURCES)} AS json FROM conversations) SELECT id AS artifact_id, k <> 1 AS by_index, CASE WHEN k < 2 THEN 1 ELSE 0 END::BIGINT AS n_paths, octet_length(encode(json))::BIGINT AS bytes_estimate FROM t WHERE k < 3")
def artifact_records(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as topics: those that name an index or mention one of its sources."""
    rows = lifecycle.artifact_records(_turns(spark, sf, SOURCES, "json").withColumnRenamed("id", "file"), "topic", "delete-derived", "i1", _SOURCE_PATHS)
    return rows.select("artifact_id", "by_index", F.size("source_paths").cast("long").alias("n_paths"), "bytes_estimate")


@_query(f"WITH t AS (SELECT conv_id % 7 AS artifact_id, {_TURN} % 5 AS k FROM conversations) SELECT artifact_id, bool_or(k <> 1) AS by_index, concat_ws(',', CASE WHEN bool_or(k = 0) THEN '/s/x.org' END, CASE WHEN bool_or(k = 1) THEN '/s/y.org' END) AS paths, count(*) AS row_count FROM t WHERE k < 3 GROUP BY artifact_id")
def ledger_record(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines of seven ledgers."""
    ledgers = _turns(spark, sf, SOURCES, "json").select((F.floor(F.col("id") / 1000) % 7).cast("long").alias("file"), "json")
    rows = lifecycle.ledger_record(ledgers, "ledger", "rewrite", "i1", _SOURCE_PATHS)
    return rows.select("artifact_id", "by_index", F.array_join("source_paths", ",").alias("paths"), "row_count")


@_query("SELECT source AS index_id, CASE WHEN count(*) FILTER (WHERE doc_id % 7 = 3 OR doc_id % 11 = 5) > 0 THEN count(*) FILTER (WHERE doc_id % 7 = 3 OR doc_id % 11 = 5) || ' files without a source boundary' ELSE '' END AS reason FROM documents GROUP BY source")
def boundary_reasons(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(F.col("source").alias("index_id"), F.when(d % 7 == 3, "").otherwise("r").alias("source_root"), F.when(d % 11 != 5, "b").alias("source_boundary"))
    return lifecycle.boundary_reason(rows)


# Outlines

OUTLINE = ["* TODO [#A] Prepare {n} :sample:urgent:\nDEADLINE: <2026-05-20 Wed>\n* TODO [#B] Later\nSCHEDULED: <2026-05-21 Thu>\n** DONE old :x:\n* plain", "no outline {n}", None]


def _outlined(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), spread(F.col("doc_id"), OUTLINE).alias("content"))


@_query("SELECT doc_id AS id, place, level, todo, priority, replace(title, '{n}', doc_id::VARCHAR) AS title, tags FROM documents, (VALUES (0::BIGINT, 1::BIGINT, 'TODO', 'A', 'Prepare {n}', 'sample,urgent'), (1, 1, 'TODO', 'B', 'Later', ''), (2, 2, 'DONE', '', 'old', 'x'), (3, 1, '', '', 'plain', '')) AS h(place, level, todo, priority, title, tags) WHERE doc_id % 3 = 0")
def outlines(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.outline(_outlined(spark, sf), "id", F.col("content"))
    return rows.select("id", F.col("place").cast("long").alias("place"), F.col("level").cast("long").alias("level"), "todo", "priority", "title", F.array_join("tags", ",").alias("tags"))


@_query("SELECT doc_id AS id, CASE WHEN k THEN 4 ELSE 0 END::BIGINT AS headings, CASE WHEN k THEN 2 ELSE 0 END::BIGINT AS open_tasks, CASE WHEN k THEN 1 ELSE 0 END::BIGINT AS done_tasks, CASE WHEN k THEN 1 ELSE 0 END::BIGINT AS priority_a, CASE WHEN k THEN '2026-05-20' END AS first_deadline, CASE WHEN k THEN 60 ELSE 0 END::BIGINT AS boost FROM (SELECT doc_id, doc_id % 3 = 0 AS k FROM documents)")
def outline_signals(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus.signals(_outlined(spark, sf), "id", F.col("content"))
    return corpus.task_boost("open tasks", found).withColumn("boost", F.col("boost").cast("long"))


@_query("SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id % 3 = 0) AS outlined, 2 * count(*) FILTER (WHERE doc_id % 3 = 0) AS open_tasks, count(*) FILTER (WHERE doc_id % 3 = 0) AS priority_a, '2026-05-20' AS first_deadline FROM documents")
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.profile(corpus.signals(_outlined(spark, sf), "id", F.col("content")))


@_query("WITH g AS (SELECT source AS index_id, count(*) FILTER (WHERE doc_id % 50 = 1) AS empty_summaries, count(*) FILTER (WHERE doc_id % 500 = 2) AS without_provenance, count(*) FILTER (WHERE doc_id % 300 = 3) AS lost_outline FROM documents GROUP BY source) SELECT *, CASE WHEN without_provenance + lost_outline > 0 THEN 'fail' WHEN empty_summaries > 0 THEN 'warn' ELSE 'pass' END AS status FROM g")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of the index of their source: some without a summary, a boundary, or evidence of their outline."""
    d = F.col("doc_id")
    content = F.when(d % 300 == 3, F.concat(F.lit("* heading\n"), F.replace("text", F.lit("*"), F.lit("")))).otherwise(F.replace("text", F.lit("*"), F.lit("")))
    rows = table(spark, sf, "documents").select(F.col("source").alias("index_id"), F.when(d % 50 == 1, " ").otherwise("s").alias("summary"), F.when(d % 500 != 2, "b").alias("source_boundary"), content.alias("content"), F.lit(0).alias("evidence_rows"))
    return corpus.quality_gate(rows)


_DAYS = ["* [2024-05-01 Wed] one{n}\ntext\n", "** sub [2024-05-01 Wed]\nmore ", "* plain\n", "* <2024-05-03> two\nend"]


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as outlines with their source in a section, as Markdown, and without text."""
    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    org = F.concat(F.replace(F.lit(_DAYS[0]), F.lit("{n}"), n), F.lit(_DAYS[1]), "source", F.lit("\n" + _DAYS[2] + _DAYS[3]))
    content = F.when(d % 3 == 0, org).when(d % 3 == 1, F.concat(F.lit("# md"), n, F.lit("\nx\n## deep\ny"))).otherwise("")
    return table(spark, sf, "documents").select(d.alias("id"), content.alias("content"))


_PLACES = "p AS (SELECT doc_id AS id, length('* [2024-05-01 Wed] one') + length(doc_id::VARCHAR) + 6 AS a, 29 + length(source) + 1 AS b FROM documents WHERE doc_id % 3 = 0)"


@_query(f"WITH {_PLACES} SELECT id, '2024-05-01' AS date, 0::BIGINT AS start, (a + b)::BIGINT AS \"end\" FROM p UNION ALL SELECT id, '2024-05-03', (a + b + 8)::BIGINT, (a + b + 30)::BIGINT FROM p")
def dated_sections(spark: SparkSession, sf: str) -> DataFrame:
    out = _dated(spark, sf).select("id", F.explode(spans.prune_nested(spans.dated(F.col("content")))).alias("s"))
    return out.select("id", F.col("s.label").alias("date"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@_query(f"WITH {_PLACES} SELECT id, 'org-heading' AS kind, '[2024-05-01 Wed] one' || id AS label, 0::BIGINT AS start, (a + b)::BIGINT AS \"end\", 76.0::DOUBLE AS base_score FROM p UNION ALL SELECT id, 'org-heading', 'sub [2024-05-01 Wed]', a, a + b, 72.0 FROM p UNION ALL SELECT id, 'org-heading', 'plain', a + b, a + b + 8, 76.0 FROM p UNION ALL SELECT id, 'org-heading', '<2024-05-03> two', a + b + 8, a + b + 30, 76.0 FROM p UNION ALL SELECT doc_id, 'markdown-heading', 'md' || doc_id, 0, 16 + length(doc_id::VARCHAR), 76.0 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'markdown-heading', 'deep', 7 + length(doc_id::VARCHAR), 16 + length(doc_id::VARCHAR), 72.0 FROM documents WHERE doc_id % 3 = 1")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat(spans.headed(F.col("content"), "org"), spans.headed(F.col("content"), "markdown"))
    return _dated(spark, sf).select("id", F.explode(both).alias("s")).select("id", "s.kind", "s.label", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.base_score")


# Answers, routes and states

EMBEDDED = ['{"embedding": [3, 4], "n": {n}}', '{"data": [{"index": 1, "embedding": [0, {n}]}, {"index": 0, "embedding": [{n}, 0]}]}', '{"data": []}', "nonsense {n}", '{"embedding": [{n}, 0, 0]}']


@_query("SELECT vec_id AS id, (['0.6 0.8', '1.0 0.0 0.0 1.0', NULL, NULL, '1.0 0.0 0.0'])[(vec_id + 1) % 5 + 1] AS vectors FROM embeddings")
def embedding_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), spread(F.col("vec_id") + 1, EMBEDDED).alias("payload"))
    n = F.when(F.col("payload").startswith('{"data"'), services.embeddings(F.col("payload"), 2)).otherwise(services.embeddings(F.col("payload"), 1))
    return rows.select("id", F.array_join(F.transform(F.flatten(n), lambda x: x.cast("string")), " ").alias("vectors"))


RANKED = ['{"scores": [0.5, {n}]}', '{"results": [{"index": 1, "relevance_score": {n}.75}]}', '{"data": [{"document_index": 0, "score": {n}.0}, {"document_index": 1, "logit": 3.0}]}', '[{"index": 0, "rank_score": 0.5}]', "{}"]


@_query(f"SELECT event_id AS id, {spread_sql('event_id', ['0.5 {n}.0', '0.0 {n}.75', '{n}.0 3.0', '0.5 0.0', None])} AS scores FROM events")
def rerank_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), spread(F.col("event_id"), RANKED).alias("payload"))
    return rows.select("id", F.array_join(F.transform(services.rerank_scores(F.col("payload"), 2), lambda x: x.cast("string")), " ").alias("scores"))


_ROUTES = "r AS (SELECT 'r' || s_suppkey AS route, (['chat', 'embed', 'rerank'])[s_suppkey % 3 + 1] AS kind, (['summarize', 'embed', 'rerank', 'plan'])[s_suppkey % 4 + 1] AS task, s_nationkey AS priority, s_suppkey % 10 = 7 AS is_default FROM supplier)"


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as routes of a model catalogue."""
    k, pick = F.col("s_suppkey"), lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % len(names) + 1).cast("int"))
    kind = pick(["chat", "embed", "rerank"])
    return table(spark, sf, "supplier").select(F.concat(F.lit("r"), k).alias("route"), kind.alias("kind"), F.array(pick(["summarize", "embed", "rerank", "plan"])).alias("tasks"), F.array(F.concat(F.lit("/v1/"), kind)).alias("endpoints"), F.col("s_nationkey").alias("priority"), (k % 10 == 7).alias("is_default"))


@_query(f"WITH {_ROUTES} SELECT route FROM r WHERE task IN ('summarize', 'rerank')")
def task_routes(spark: SparkSession, sf: str) -> DataFrame:
    return services.routes_for_tasks(_routes(spark, sf), ["summarize", "rerank"]).select("route")


@_query(f"WITH {_ROUTES} SELECT route FROM r WHERE task = 'summarize' ORDER BY is_default DESC, priority DESC, route LIMIT 1")
def task_route(spark: SparkSession, sf: str) -> DataFrame:
    return services.route_for_task(_routes(spark, sf), "summarize").select("route")


@_query(f"WITH {_ROUTES} SELECT route FROM r WHERE kind = 'embed' OR task = 'rerank' OR kind = 'chat' AND false")
def capability_routes(spark: SparkSession, sf: str) -> DataFrame:
    return services.routes_for_capability(_routes(spark, sf), "embed", ["rerank"], "/v1/none").select("route")


@_query(f"SELECT event_id AS id, greatest(0.0::DOUBLE, coalesce(try_cast({spread_sql('event_id', ['{n}.5', 'x{n}', None])} AS DOUBLE), 0), coalesce(value, 0), CASE WHEN user_id % 2 = 0 THEN user_id::DOUBLE ELSE 0 END) AS signal FROM events")
def source_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), spread(F.col("event_id"), ["{n}.5", "x{n}", None]).alias("score"), F.col("value").alias("vector_score"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("double")).alias("rerank_score"))
    return rows.select("id", dossiers.signal(rows).alias("signal"))


_MODES = "m AS (SELECT event_id AS id, event_id % 2 AS resumed, event_id % 3 AS reused, user_id % 4 AS stored, event_id % 5 AS pending, (['', 'schema', 'missing', 'route'])[event_id % 4 + 1] AS cause FROM events), d AS (SELECT *, CASE WHEN resumed > 0 THEN 'resumed' WHEN reused > 0 THEN CASE WHEN pending = 0 THEN 'reuse-only' ELSE 'incremental' END WHEN stored > 0 OR cause IN ('schema', 'route') THEN 'rebuild' ELSE 'full' END AS mode FROM m)"


@_query(f"WITH {_MODES} SELECT id, mode, CASE WHEN mode = 'full' AND cause = 'missing' THEN 'initial' ELSE mode END AS shown, CASE WHEN stored * 10 - resumed > 0 AND 100 - stored * 10 > 0 THEN CAST(floor(30.0::DOUBLE / (stored * 10 - resumed) * (100 - stored * 10)) AS BIGINT) END AS eta, CAST(pending * 1024 * 4 + pending * 768 AS BIGINT) AS bytes FROM d")
def refresh_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as states of a refresh."""
    e = F.col("event_id")
    cause = F.element_at(F.array(*map(F.lit, ("", "schema", "missing", "route"))), (e % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select(e.alias("id"), (e % 2).alias("resumed"), (e % 3).alias("reused"), (F.col("user_id") % 4).alias("stored"), (e % 5).alias("pending"), cause.alias("cause"))
    mode = vectors.refresh_mode(*(F.col(c) for c in ("resumed", "reused", "stored", "pending", "cause")))
    shown = vectors.shown_mode(mode, F.col("cause"))
    return rows.select("id", mode.alias("mode"), shown["mode"].alias("shown"), vectors.eta_seconds(F.lit(100), F.col("stored") * 10, F.col("resumed"), F.lit(30.0)).alias("eta"), vectors.planned_bytes(F.col("pending"), F.lit(1024)).cast("long").alias("bytes"))


WORKERS = ['{"summary": "Deadline on May 20", "tasks": [{n}]}', 'Sure! {"summary": "no date {n}"}', "<think>x</think> deadline May 20", '{"summary": "SECRET deadline May 20", "tasks": {n}}']


@_query(f"SELECT {_TURN} AS id, ([100.0::DOUBLE, 40.0, 70.0, 90.0])[{_TURN} % 4 + 1] AS score, (['pass', 'fail', 'fail', 'fail'])[{_TURN} % 4 + 1] AS status FROM conversations")
def worker_scores(spark: SparkSession, sf: str) -> DataFrame:
    fact = lambda name, *options: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, options)).alias("any"))
    rows = _turns(spark, sf, WORKERS, "output").withColumns({
        "required_keys": F.array(F.lit("summary"), F.lit("tasks")),
        "required_facts": F.array(fact("deadline", "deadline"), fact("date", "may 20", "20 may")),
        "forbidden_facts": F.array(fact("secret", "secret")),
        "max_output_chars": F.lit(400),
        "min_fact_ratio": F.lit(0.8),
    })
    return memory.worker_score(rows).select("id", "score", "status")


@_query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'not-needed' WHEN event_id % 3 = 0 THEN 'path-warning' WHEN event_id % 5 = 0 THEN 'stale-warning' WHEN user_id % 3 > 0 THEN 'sufficient' WHEN value >= 40 THEN 'expand' ELSE 'no-candidate' END AS decision FROM events")
def expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Events as questions: whether a second pass is needed."""
    e = F.col("event_id")
    decision = audit.expansion_decision(e % 4 != 0, e % 3 == 0, e % 5 == 0, F.col("user_id") % 3, F.col("value"), 40.0)
    return table(spark, sf, "events").select(e.alias("id"), decision.alias("decision"))


# Lines

@_query("WITH l AS (SELECT *, conv_id % 4 AS part FROM conversations WHERE turn % 3 < 2) SELECT conv_id, turn, text FROM l WHERE part = (SELECT max(part) FROM l) ORDER BY conv_id DESC, turn DESC LIMIT 5")
def jsonl_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines of JSON with noise, in a file for each fourth conversation, read back: the last five rows."""
    folder = shared_folder(spark)
    row = F.to_json(F.struct("conv_id", "turn", "text"))
    noise = F.element_at(F.array(*map(F.lit, ("not json", "[1, 2]", "", "7"))), (F.col("conv_id") % 4 + 1).cast("int"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % 4).alias("part"), F.when(F.col("turn") % 3 == 2, noise).otherwise(row).alias("value"))
    turns.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(folder)
    return state.jsonl(spark, folder, "conv_id long, turn long, text string", limit=5).select("conv_id", "turn", "text")


@_query("WITH l AS (SELECT conv_id AS c, turn AS t, false AS done, CASE WHEN role = 'assistant' THEN text ELSE '' END AS content, CASE WHEN role = 'user' THEN text ELSE '' END AS reasoning FROM conversations UNION ALL SELECT DISTINCT conv_id, NULL, true, '', '' FROM conversations) SELECT done, content, reasoning, count(*) AS n FROM l GROUP BY done, content, reasoning")
def stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as stored answers, line by line through the stream of lines: the assistant's turns as content, the user's as reasoning."""
    root = shared_folder(spark)
    c = table(spark, sf, "conversations")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(F.col("role") == "assistant", F.col("text")).alias("content"), F.when(F.col("role") == "user", F.col("text")).alias("reasoning_content")).alias("delta"))).alias("choices")))
    told = F.when(F.col("role").isin("assistant", "user"), F.concat(F.lit("data: "), delta)).otherwise(": ping")
    ends = c.select("conv_id").distinct().select(F.lit("data: [DONE]").alias("value"))
    c.select(told.alias("value")).union(ends).write.text(f"{root}/in")

    def sink(batch: DataFrame, number: int) -> None:
        refresh.sse_columns(batch).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream = lines.line_stream(spark, f"{root}/in")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("done", "content", "reasoning").agg(F.count(F.lit(1)).alias("n"))


# Questions

QUESTIONS = ["notes in a/b{n}.org from 2024-05-01", "last three days", "latest [#A] TODO items :work{n}: of c.org", "where is function parse{n}", "hello {n}", "todo items and things on hold", "headings tagged urgent{n}, waiting or canceled", "entries with the tag home{n} priority 2", "is anything scheduled", "the kitchen sink {n}", "org-mode tasks of the week", "to-dos under tag #garden{n} last 12 entries", "newest entries in x/y{n}.md", "what happened on 2024-01-02"]


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [planner.build_plan(q) for q in batch.column(1).to_pylist()]
        parts = [(p.query, ",".join(p.paths), ",".join(p.dates), p.recent, ",".join(p.tags), ",".join(sorted(p.todo)), ",".join(p.priorities), ",".join(k for k, v in p.flags.items() if v), ",".join(p.handlers)) for p in plans]
        columns = list(zip(*parts, strict=True)) if parts else [[]] * 9
        kinds = [pa.int32() if k == 3 else pa.string() for k in range(9)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "question", "paths", "dates", "recent", "tags", "todo", "priorities", "flags", "handlers"])


@_query(f"WITH q AS (SELECT item_id AS id, {spread_sql('item_id', QUESTIONS)} AS question FROM benchmark), s(state) AS (VALUES ('CANCELED'), ('CANCELLED'), ('DONE'), ('HOLD'), ('NEXT'), ('TODO'), ('WAIT'), ('WAITING')), c AS (SELECT id, question, lower(question) AS low, list_filter(regexp_extract_all(lower(question), '[a-z0-9_./~+-]+\\.[a-z0-9][a-z0-9._+-]*'), lambda w: true) AS paths, regexp_extract_all(question, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) AS dates, CASE WHEN regexp_matches(lower(question), '\\blast\\s+(\\d+|one|two|three|four|five)\\s+(day|days|entry|entries|date|dates)\\b') THEN least(7, CASE regexp_extract(lower(question), '\\blast\\s+(\\d+|one|two|three|four|five)\\s', 1) WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5 ELSE try_cast(regexp_extract(lower(question), '\\blast\\s+(\\d+)\\s', 1) AS INT) END) WHEN regexp_matches(lower(question), '\\b(latest|recent|newest|today|yesterday)\\b') THEN 2 ELSE 0 END AS recent, list_distinct(list_filter([regexp_extract(question, ':([A-Za-z0-9_@#%+-]+):', 1), regexp_extract(question, '(?i)\\btag\\s*[:=]\\s*#?:?([A-Za-z0-9_@#%+-]+)', 1), lower(regexp_extract(question, '(?i)\\b(?:tagged|with\\s+(?:the\\s+)?tag|under\\s+(?:the\\s+)?tag)\\s+#?:?([A-Za-z0-9_@#%+-]+)', 1)), lower(regexp_extract(question, '(?i)\\b(?:elements?|headings?|tasks?|entries?)\\s+(?:with|tagged)\\s+#?:?([A-Za-z0-9_@#%+-]+)', 1))], lambda t: t NOT IN ('', 'the', 'tag', 'with'))) AS tags, (SELECT list(DISTINCT replace(state, 'CANCELED', 'CANCELLED') ORDER BY replace(state, 'CANCELED', 'CANCELLED')) FROM s WHERE regexp_matches(question, '(?i)\\b' || state || '\\b') OR (state = 'TODO' AND regexp_matches(question, '(?i)\\bto[- ]dos?\\b'))) AS todo, list_filter([coalesce(nullif(regexp_extract(question, '\\[#([A-Za-z0-9])\\]', 1), ''), regexp_extract(question, '(?i)\\bpriority\\s+([a-z0-9])\\b', 1))], lambda p: p <> '') AS priorities, list_filter([CASE WHEN regexp_matches(lower(question), '\\bdeadlines?\\b') THEN 'deadline' END, CASE WHEN regexp_matches(lower(question), '\\bscheduled?\\b') THEN 'scheduled' END, CASE WHEN regexp_matches(lower(question), '\\b(headings?|elements?|entries)\\b') THEN 'heading' END], lambda f: f IS NOT NULL) AS flags FROM q) SELECT id, question, array_to_string(paths, ',') AS paths, array_to_string(dates, ',') AS dates, recent::INT AS recent, array_to_string(tags, ',') AS tags, coalesce(array_to_string(todo, ','), '') AS todo, upper(array_to_string(priorities, ',')) AS priorities, array_to_string(flags, ',') AS flags, 'lexical,vector' || CASE WHEN len(paths) > 0 AND recent > 0 THEN ',temporal' ELSE '' END || CASE WHEN len(tags) > 0 OR todo IS NOT NULL OR len(priorities) > 0 OR regexp_matches(low, '\\borg(-mode|mode)?\\b.*\\b(headings?|entries|tasks?|deadlines?|scheduled|tags?)\\b|\\b(deadlines?|scheduled)\\b') THEN ',structural' ELSE '' END || CASE WHEN regexp_matches(low, '\\b(function|class|method|command)\\b|where is|which file') THEN ',code' ELSE '' END AS handlers FROM c")
def query_plans(spark: SparkSession, sf: str) -> DataFrame:
    """What the planner makes of a question for each benchmark item."""
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), spread(F.col("item_id"), QUESTIONS).alias("question"))
    return rows.mapInArrow(_plans, "id long, question string, paths string, dates string, recent int, tags string, todo string, priorities string, flags string, handlers string")


# Sources

SOURCE = '''"""Module doc."""
import os
from a import b

LIMIT = 3


def helper{n}(x):
    """Help."""
    return os.path.join(x)


class Box{n}:
    def open{n}(self):
        helper{n}(1)
        self.close{n}()

    def close{n}(self):
        eval("1")


parser.add_parser("cmd{n}-open{n}")
'''
OTHER = "from m{n} import helper{n}\n\n\ndef main{n}():\n    helper{n}(2)\n    helper{n}(3)\n"
RISKY = """import socket, json
from urllib import parse, request
import shutil as s
from .pty import spawn
shutil.rmtree("/tmp/x{n}"); os.system("ls")
home = Path.home()
subprocess.run(["curl", "x"])
"""
TESTS = "def command_cmd{n}_open{n}():\n    pass\ndef test_cmd{n}_open{n}():\n    pass\ndef test_command_cmd{n}_open{n}_empty():\n    pass\ndef test_other_open{n}():\n    pass\n"
BAD = "def ("
FILES = {"m": SOURCE, "n": OTHER, "r": RISKY, "t": TESTS, "b": BAD}


def _sources(spark: SparkSession, sf: str, kinds: str) -> DataFrame:
    """Files of Python for each document, whose names it numbers."""
    n = F.col("doc_id").cast("string")
    parts = F.array(*(F.struct(F.concat(F.lit(k), n, F.lit(".py")).alias("path"), F.replace(F.lit(FILES[k]), F.lit("{n}"), n).alias("content")) for k in kinds))
    return table(spark, sf, "documents").select(F.explode(parts).alias("f")).select("f.*")


def _rows_sql(rows: list[tuple], columns: str) -> str:
    """Rows of VALUES for each document, with {n} for its number."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    names = columns.split(", ")
    shown = ", ".join(f"replace({c}, '{{n}}', doc_id::VARCHAR) AS {c}" if any(isinstance(r[k], str) for r in rows) else c for k, c in enumerate(names))
    return f"SELECT {shown} FROM documents, (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


_SYMBOLS = [
    ("m{n}.py", "module", "m{n}", "", 1), ("m{n}.py", "import", "os", "", 2), ("m{n}.py", "import", "a", "", 3), ("m{n}.py", "constant", "LIMIT", "", 5),
    ("m{n}.py", "function", "helper{n}", "helper{n}", 8), ("m{n}.py", "class", "Box{n}", "Box{n}", 13), ("m{n}.py", "function", "open{n}", "Box{n}.open{n}", 14), ("m{n}.py", "function", "close{n}", "Box{n}.close{n}", 18),
    ("m{n}.py", "command", "cmd{n}-open{n}", "", 22), ("b{n}.py", "error", "SyntaxError", "", 1),
]


@_query(_rows_sql(_SYMBOLS, "path, kind, name, qualname, line"))
def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Everything but calls in the files of each document."""
    rows = code.code_rows(_sources(spark, sf, "mb")).filter("kind NOT IN ('call', 'family')")
    return rows.select("path", "kind", "name", "qualname", F.col("line").cast("long").alias("line"))


@_query(f"SELECT path, kind, count(*) AS n, min(line)::BIGINT AS first_line FROM ({_rows_sql(_SYMBOLS, 'path, kind, name, qualname, line')}) GROUP BY GROUPING SETS ((path, kind), (kind), (path), ())")
def code_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Everything but calls in the files of each document, counted by file and kind from a stored code map."""
    rows = code.code_map(_sources(spark, sf, "mb"), shared_folder(spark)).filter("kind NOT IN ('call', 'family')")
    return code.summary(rows).withColumn("first_line", F.col("first_line").cast("long"))


_EDGES = [("m{n}.py", "Box{n}.open{n}", "m{n}.py", "helper{n}", 15), ("m{n}.py", "Box{n}.open{n}", "m{n}.py", "Box{n}.close{n}", 16), ("n{n}.py", "main{n}", "m{n}.py", "helper{n}", 5), ("n{n}.py", "main{n}", "m{n}.py", "helper{n}", 6)]


@_query(_rows_sql(_EDGES, "caller_path, caller, callee_path, callee, line"))
def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    return code.call_edges(code.code_rows(_sources(spark, sf, "mnb"))).withColumn("line", F.col("line").cast("long"))


@_query(_rows_sql([("m{n}.py", 2, 2, 2), ("n{n}.py", 1, 1, 0), ("b{n}.py", 0, 0, 0)], "path, public_symbols, imports, incoming"))
def code_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return code.boundaries(code.code_rows(_sources(spark, sf, "mnb")))


@_query(f"SELECT * FROM ({_rows_sql([('m{n}.py', 'helper{n}', 3, 1), ('m{n}.py', 'Box{n}.open{n}', 3, 2), ('m{n}.py', 'Box{n}.close{n}', 2, 1), ('n{n}.py', 'main{n}', 3, 2)], 'path, qualname, lines, calls')}) ORDER BY lines DESC, calls DESC, path, qualname LIMIT 15")
def code_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen longest functions."""
    return code.hotspots(code.code_rows(_sources(spark, sf, "mnb"))).select("path", "qualname", F.col("lines").cast("long").alias("lines"), "calls")


@_query(_rows_sql([("cmd{n}-open{n}", "command_cmd{n}_open{n}", "test_command_cmd{n}_open{n}_empty,test_cmd{n}_open{n},test_other_open{n}")], "command, handler, tests"))
def command_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Commands of each document's files with their handlers and tests."""
    rows = code.code_rows(_sources(spark, sf, "mt"))
    return corpus.command_traces(rows).select("command", "handler", F.array_join("tests", ",").alias("tests"))


def _files_sql(kinds: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT '{k}' || doc_id || '.py' AS path, replace({quoted(FILES[k])}, '{{n}}', doc_id::VARCHAR) AS content FROM documents" for k in kinds)


def _findings_sql() -> str:
    from corvana.plans.audit_queries import _WORDS_SQL

    return rf"WITH t AS ({_files_sql('mnr')}), l AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM t), imports(root, rule) AS (VALUES ('subprocess', 'subprocess_import'), ('socket', 'network_import'), ('urllib', 'network_import'), ('http', 'network_import'), ('requests', 'network_import'), ('aiohttp', 'network_import'), ('shutil', 'filesystem_mutation_import'), ('pty', 'terminal_import')), calls(name, rule) AS (VALUES ('os.system', 'subprocess_call'), ('subprocess.Popen', 'subprocess_call'), ('subprocess.run', 'subprocess_call'), ('subprocess.call', 'subprocess_call'), ('shutil.rmtree', 'destructive_call'), ('Path.home', 'broad_path_call')), words(severity, rule, pattern) AS (VALUES {_WORDS_SQL}) SELECT path, line, rule, 'warn' AS severity FROM l, imports WHERE regexp_matches(x, '^\s*(import|from)\s.*\b' || root || '\b') AND NOT regexp_matches(x, ' import .*\b' || root || '\b') UNION ALL SELECT path, line, rule, CASE rule WHEN 'destructive_call' THEN 'block' ELSE 'warn' END FROM l, calls WHERE contains(x, name || '(') UNION ALL SELECT path, line, rule, severity FROM (SELECT path, line, rule, severity, unnest(regexp_extract_all(x, pattern, 0, 'i')) FROM l, words) UNION ALL SELECT 'b' || doc_id || '.py', 1, 'python_syntax_error', 'block' FROM documents"


@_query(_findings_sql())
def code_findings(spark: SparkSession, sf: str) -> DataFrame:
    return code.python_findings(_sources(spark, sf, "mnrb")).select("path", F.col("line").cast("long").alias("line"), "rule", "severity")
