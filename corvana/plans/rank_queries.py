"""Queries of vectors, fusion, memories, conversations, feedback and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import fusion, lexical, memory, skills, spans, vectors
from corvana.plans import retrieval
from corvana.plans.audit_queries import _WORDS_SQL
from corvana.plans.tables import TERMS_SQL, first_question, score_sql, table


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def _first_vector(spark: SparkSession, sf: str) -> list[float]:
    rows = _embeddings(spark, sf).orderBy("vec_id").limit(1).collect()
    return list(rows[0]["vector"]) if rows else []


def hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.lexical_vectors(table(spark, sf, "documents"), "doc_id", F.col("text"))
    return out.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.bround(F.col("weight") * 1_000_000).cast("long").alias("millionths"))


def sparse_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Dot product of each document's hashed vector with the first question's, joined by bucket."""
    asked = spark.createDataFrame([(0, first_question(spark, sf))], "item_id int, text string")
    q = vectors.lexical_vectors(asked, "item_id", F.col("text")).select("bucket", F.col("weight").alias("q"))
    d = vectors.lexical_vectors(table(spark, sf, "documents"), "doc_id", F.col("text"))
    # The question has at most LEXICAL_DIMS buckets.
    return d.join(F.broadcast(q), "bucket").groupBy("doc_id").agg(F.bround(F.sum(F.col("weight") * F.col("q")), 3).alias("similarity"))


def dense_unit(spark: SparkSession, sf: str) -> DataFrame:
    v = _embeddings(spark, sf).select("vec_id", vectors.dense_normalize(F.col("vector")).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("dims"), F.bround(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) * 1_000_000).cast("long").alias("millionths"))


def dense_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf).withColumns({"id": F.col("vec_id"), "path": F.lit(""), "chunk": F.col("label"), "haystack": F.lit("")})
    ranked = vectors.rank(rows, _first_vector(spark, sf))
    return ranked.select("vec_id", "score", F.bround("vector_score", 4).alias("vector_score"))


def best_per_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = _embeddings(spark, sf).withColumns({"id": F.col("vec_id"), "path": F.lit(""), "chunk": F.col("label"), "haystack": F.lit("")})
    ranked = vectors.rank(rows, _first_vector(spark, sf)).select("label", "vec_id", "score")
    return vectors.best_per_key(ranked, ["label"], "vec_id").select("label", "vec_id", "score", "hits")


def content_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = vectors.content_parts(F.col("text"), 400, 6)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("p", "t")).select("doc_id", (F.col("p") + 1).cast("long").alias("part"), T.sha256(F.col("t")).alias("sha"))


def byte_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-bounded parts of each question; without SQL, and held against a plain split in Python."""
    parts = vectors.byte_bounded(table(spark, sf, "benchmark"), "item_id", "text", 64)
    return parts.groupBy("item_id").agg(F.max(F.octet_length("text")).cast("long").alias("most"), F.count(F.lit(1)).alias("parts"))


def _stores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), "doc_id").alias("id"), T.sha256(F.col("text")).alias("input_sha256"), F.lit("v2").alias("schema"), F.lit("chunk").alias("kind"), F.lit(4).alias("dims"))
    vector = F.array(*(F.lit(1.0) for _ in range(4)))
    checkpoint = d.filter("ord % 5 = 0").withColumn("vector", vector)
    previous = d.filter("ord % 3 = 0").withColumn("input_sha256", F.when(F.col("ord") % 2 == 0, "old").otherwise(F.col("input_sha256"))).withColumn("vector", vector)
    return d, checkpoint, previous


def reuse_report(spark: SparkSession, sf: str) -> DataFrame:
    candidates, checkpoint, previous = _stores(spark, sf)
    return vectors.reuse_report(vectors.reuse(candidates, checkpoint, previous), previous).select("from_checkpoint", "from_previous", "pending", "stored", "superseded", "mode")


def pending_batches(spark: SparkSession, sf: str) -> DataFrame:
    batches = vectors.pending_batches(vectors.reuse(*_stores(spark, sf)), 64)
    return batches.select(F.col("offset").cast("long").alias("offset"), F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"))


def _lanes(spark: SparkSession, sf: str) -> list[DataFrame]:
    d = table(spark, sf, "documents").select(F.lit("doc").alias("path"), F.col("doc_id").cast("string").alias("chunk"), "text")
    lex = lexical.with_score(d, first_question(spark, sf), F.col("text")).filter("score > 0").orderBy(F.desc("score"), F.col("chunk").cast("long")).limit(40)
    e = _embeddings(spark, sf).withColumns({"id": F.col("vec_id"), "path": F.lit("doc"), "chunk": F.col("vec_id").cast("string"), "haystack": F.lit("")})
    vec = vectors.rank(e, _first_vector(spark, sf)).orderBy(F.desc("score"), "vec_id").limit(40)
    return [fusion.lane(lex, "lexical", path_boost=F.lit(10.0)), fusion.lane(vec, "vector", vector_score=F.col("vector_score"))]


def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.fuse(_lanes(spark, sf))
    return fused.select("path", "chunk", F.array_join("methods", ",").alias("methods"), "lexical_score", "vector_rank_score", "base", "guard")


def hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve candidates in the order of a stand-in rerank score (the chunk's last digit)."""
    fused = fusion.fuse(_lanes(spark, sf))
    scores = fused.select("path", "chunk", (F.col("chunk").cast("long") % 10 / 10).alias("rerank"))
    ranked = fusion.rerank(fused, scores, 12)
    return ranked.select("chunk", "phase", "hybrid_score")


def retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The whole hybrid query over pages as code and text, with the first question's words and a path."""
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("page_id").cast("string").alias("chunk"), F.lit("").alias("summary"), F.col("html").alias("content"))
    return retrieval.retrieve(pages, "where is function track in example.com/en " + " ".join(lexical.query_terms(first_question(spark, sf)))).select("place", "path", "chunk", "hybrid_score")


def newest_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the three newest days."""
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return spans.newest_dates(e, "day", 3).select("event_id", "day")


def packed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation within a running budget of characters."""
    m = table(spark, sf, "conversations")
    return spans.packed(m, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.length("text"), 800).select("conv_id", "turn", "role")


def _memories(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.format_string("m%d", "doc_id").alias("id"), F.lit("").alias("created"), "source", "text", (F.col("doc_id") % 7).cast("string").alias("importance"), (F.col("doc_id") % 97 == 5).alias("pinned"), F.array(F.col("lang")).alias("tags"), (F.col("doc_id") % 11).cast("int").alias("seen_count"))


def normal_memories(spark: SparkSession, sf: str) -> DataFrame:
    return memory.normalize(_memories(spark, sf)).select("id", F.col("importance").cast("long").alias("importance"), "pinned", F.size("tags").cast("long").alias("n_tags"))


def memory_relevance(spark: SparkSession, sf: str) -> DataFrame:
    rows = memory.relevance(memory.normalize(_memories(spark, sf)), first_question(spark, sf))
    return rows.select("id", "recency", "matched", "relevance")


def memory_rank(spark: SparkSession, sf: str) -> DataFrame:
    return memory.rank(memory.normalize(_memories(spark, sf)), first_question(spark, sf), 25).select(F.col("place").cast("long").alias("place"), "id", "relevance")


def similar_memory(spark: SparkSession, sf: str) -> DataFrame:
    """For each question the other question that is most like it, at half of the shorter one's words."""
    b = table(spark, sf, "benchmark")
    texts, rows = b.select(F.col("item_id").alias("id"), "text"), b.select((F.col("item_id") + 1000).alias("id"), F.col("item_id").alias("ord"), F.concat("text", F.lit(" appended")).alias("text"))
    return memory.most_similar(texts, rows).select("text_id", "row_id", F.bround("overlap", 6).alias("overlap"))


def nearest_previous_user(spark: SparkSession, sf: str) -> DataFrame:
    m = memory.nearest_previous(table(spark, sf, "conversations"), "user")
    return m.filter("role = 'assistant'").select("conv_id", "turn", "previous_turn", "previous_text")


def last_assistant(spark: SparkSession, sf: str) -> DataFrame:
    return memory.last_of_role(table(spark, sf, "conversations"), "assistant")


def recall_texts(spark: SparkSession, sf: str) -> DataFrame:
    return memory.recall_text(table(spark, sf, "conversations"), 4)


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return memory.transcript(table(spark, sf, "conversations"), 6, 0)


def conversation_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The newest conversations and those that match the first question best."""
    recall = memory.recall_text(table(spark, sf, "conversations"), 6)
    newest = recall.agg(F.max("conv_id").alias("last"))
    rows = recall.join(F.broadcast(newest)).select("conv_id", (F.col("last") - F.col("conv_id")).alias("ord"), F.col("conv_id").cast("string").alias("updated"), "text")
    return memory.recent_and_relevant(rows, first_question(spark, sf), 5, 8, 20).select("conv_id", "matched", "recall", F.array_join("reasons", ",").alias("reasons"))


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*(F.lit(w) for w in ("stale page", "wrong file here", "please plan", "did not use it", "", "source missing")))
    n = F.col("doc_id")
    return table(spark, sf, "labels").select(n, F.when(F.col("quality") == 1, "up").when(F.col("toxic") == 1, "down").otherwise("ok").alias("rating"), F.element_at(words, (n % 6 + 1).cast("int")).alias("note"), F.lit("a question").alias("prompt"))


def feedback_counts(spark: SparkSession, sf: str) -> DataFrame:
    return memory.feedback_counts(_feedback(spark, sf))


def feedback_status(spark: SparkSession, sf: str) -> DataFrame:
    return _feedback(spark, sf).select("doc_id", memory.quality_status(F.col("rating")).alias("status"))


def _skill_rows(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.format_string("skill-%d", "item_id").alias("slug"), F.col("item_id").alias("ord"), F.lit("").alias("description"), F.col("text").alias("body"), (F.col("item_id") % 10 == 0).alias("archived"), F.format_string("2024-01-%02d", (F.col("item_id") % 28 + 1).cast("int")).alias("updated_at"))


def skill_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Skills of the whole texts, ranked for the whole first question."""
    return skills.rank(_skill_rows(spark, sf), "use skill-7 and " + first_question(spark, sf), 12).select("slug", F.col("score").cast("long").alias("score"))


def skill_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of questions that share at least four terms."""
    return skills.consolidation(table(spark, sf, "benchmark"), "item_id", F.col("text"), 4)


def skill_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The first three questions that share a term with each piece of text feedback."""
    texts = table(spark, sf, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("text_id"), "text")
    rows = table(spark, sf, "benchmark").select(F.format_string("skill-%d", "item_id").alias("slug"), F.col("item_id").alias("ord"), "text")
    return skills.matches(texts, rows, 3).select("text_id", "slug", F.array_join("shared", " ").alias("shared"))


def stale_skills(spark: SparkSession, sf: str) -> DataFrame:
    rows = _skill_rows(spark, sf).withColumns({"created_at": F.col("updated_at"), "pinned": F.col("ord") % 3 == 0, "builtin": F.lit(False), "selected_count": (F.col("ord") % 2).cast("int"), "patch_count": F.lit(0)})
    return skills.stale_unused(rows, F.lit("2024-03-01T00:00:00Z").cast("timestamp"), 40).select("slug", "age_days")


def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = skills.rule_findings(table(spark, sf, "pages"), "page_id", F.col("html"))
    return found.withColumn("line", F.col("line").cast("long"))


def rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return skills.verdict(skills.rule_findings(table(spark, sf, "documents"), "doc_id", F.col("text")), "doc_id")


def recency_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user, by id."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return vectors.last_per_id(e, "user_id", "event_id")


_ALL = (hash_vectors, sparse_similarity, dense_unit, dense_scores, best_per_label, content_parts, byte_parts, reuse_report, pending_batches, hybrid_fusion, hybrid_rerank, retrieve, newest_dates, packed_turns, normal_memories, memory_relevance, memory_rank, similar_memory, nearest_previous_user, last_assistant, recall_texts, transcripts, conversation_recall, feedback_counts, feedback_status, skill_rank, skill_groups, skill_matches, stale_skills, rule_findings, rule_verdicts, recency_rows)
QUERIES = {f.__name__: f for f in _ALL}

_TOK = "regexp_extract_all(lower({x}), '[A-Za-z0-9_''-]{{3,}}')"
_BUCKETS = "SELECT k, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS weight FROM (SELECT k, ('0x' || left(sha256(term), 8))::BIGINT % 256 AS bucket, sum((1 + sqrt(least(4, n))) * CASE WHEN length(term) >= 7 THEN 1.2::DOUBLE ELSE 1.0 END) AS w FROM (SELECT k, term, count(*) AS n FROM (SELECT {k} AS k, unnest(" + _TOK.format(x="text").replace("{", "{{").replace("}", "}}") + ") AS term FROM {src}) GROUP BY k, term) GROUP BY k, bucket)"
_DOT = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(v, qv), lambda x: x[1] * x[2])) AS sim FROM e, q), r AS (SELECT vec_id, label, CAST(round_even(sim * 1000, 0) AS BIGINT) AS score, sim FROM s)"
_NAME = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_.-]{{3,}}'))"
_MEM = "mem AS (SELECT doc_id, 'm' || doc_id AS id, source, text, greatest(1, least(5, doc_id % 7)) AS importance, doc_id % 97 = 5 AS pinned, lang, doc_id % 11 AS seen, text || chr(10) || lang || chr(10) || source AS hay, 1 + least(10, doc_id * 10 // greatest(1, (SELECT count(*) FROM documents) - 1)) AS recency FROM documents)"
_REL = f"WITH {TERMS_SQL}, {_MEM}, a AS (WITH {score_sql('mem', 'doc_id', 'text')} SELECT k, score AS matched FROM scored), b AS (WITH {score_sql('mem', 'doc_id', 'hay')} SELECT k, score AS hay FROM scored), rel AS (SELECT mem.*, a.matched, b.hay * 8 + importance * 4 + recency + CASE WHEN pinned THEN 40 ELSE 0 END + least(8, seen) AS relevance FROM mem JOIN a ON a.k = doc_id JOIN b ON b.k = doc_id)"
_LANES = f"lex AS (SELECT k::VARCHAR AS chunk, score FROM scored WHERE score > 0 ORDER BY score DESC, k LIMIT 40), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), qv AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1), vs AS (SELECT vec_id, CAST(round_even(list_sum(list_transform(list_zip(v, qv), lambda x: x[1] * x[2])) * 1000, 0) AS BIGINT) AS score FROM e, qv), vec AS (SELECT vec_id::VARCHAR AS chunk, score FROM vs WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 40), fused AS (SELECT coalesce(lex.chunk, vec.chunk) AS chunk, coalesce(lex.score, 0)::DOUBLE AS ls, coalesce(vec.score, 0)::DOUBLE AS vs, CASE WHEN lex.chunk IS NULL THEN 'vector' WHEN vec.chunk IS NULL THEN 'lexical' ELSE 'lexical,vector' END AS methods, CASE WHEN lex.chunk IS NULL THEN 0.0 ELSE 10.0 END::DOUBLE AS guard FROM lex FULL JOIN vec ON lex.chunk = vec.chunk)"
_FUSED = f"WITH {TERMS_SQL},\n{score_sql('documents', 'doc_id', 'text')},\n{_LANES}"
_FEED = "f AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'up' WHEN toxic = 1 THEN 'down' ELSE 'ok' END AS rating, (['stale page', 'wrong file here', 'please plan', 'did not use it', '', 'source missing'])[doc_id % 6 + 1] AS note FROM labels)"
_RULES = f"rules(severity, rule, pattern) AS (VALUES {_WORDS_SQL})"
_FOUND = r"SELECT k, rule, severity, line FROM (SELECT {k} AS k, unnest(string_split({x}, chr(10))) AS x, generate_subscripts(string_split({x}, chr(10)), 1) AS line FROM {src}), rules, unnest(regexp_extract_all(x, pattern, 0, 'i'))"
_STOP = "['skill', 'workflow', 'procedure', 'response', 'style', 'planning', 'debugging', 'project', 'file', 'files', 'with', 'when', 'this', 'that', 'use', 'using', 'context']"
ORACLE = {
    "hash_vectors": f"SELECT k AS doc_id, bucket, CAST(round_even(weight * 1000000, 0) AS BIGINT) AS millionths FROM ({_BUCKETS.format(k='doc_id', src='documents')})",
    "sparse_similarity": f"WITH d AS ({_BUCKETS.format(k='doc_id', src='documents')}), q AS ({_BUCKETS.format(k='item_id', src='(SELECT * FROM benchmark ORDER BY item_id LIMIT 1)')}) SELECT d.k AS doc_id, round_even(sum(round_even(d.weight, 6) * round_even(q.weight, 6)), 3) AS similarity FROM d JOIN q USING (bucket) GROUP BY d.k",
    "dense_unit": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT vec_id, len(v) AS dims, CAST(round_even(list_sum(list_transform(v, lambda x: round_even(x / n, 6))) * 1000000, 0) AS BIGINT) AS millionths FROM n",
    "dense_scores": f"{_DOT} SELECT vec_id, score, round_even(round_even(sim, 6), 4) AS vector_score FROM r WHERE score > 0",
    "best_per_label": f"{_DOT} SELECT label, arg_max(vec_id, (score, -vec_id)) AS vec_id, max(score) AS score, count(*) AS hits FROM r WHERE score > 0 GROUP BY label",
    "content_parts": r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT doc_id, t, length(t) AS n, CASE WHEN length(t) <= 400 THEN 1 ELSE (length(t) - 400 + 339) // 340 + 1 END AS need FROM f), p AS (SELECT doc_id, t, n, need, unnest(range(1, least(need, 6) + 1)) AS part FROM n WHERE n > 0) SELECT doc_id, part, sha256(trim(CASE WHEN need > 6 AND part = 6 THEN right(t, 400) ELSE substr(t, (part - 1) * 340 + 1, 400) END)) AS sha FROM p",
    "reuse_report": "WITH d AS (SELECT doc_id % 5 = 0 AS c, doc_id % 3 = 0 AS p, doc_id % 2 = 0 AS old FROM documents), n AS (SELECT count(*) FILTER (WHERE c) AS from_checkpoint, count(*) FILTER (WHERE NOT c AND p AND NOT old) AS from_previous, count(*) FILTER (WHERE NOT c AND (NOT p OR old)) AS pending, count(*) FILTER (WHERE p) AS stored FROM d) SELECT *, greatest(0, stored - from_previous) AS superseded, 'resumed' AS mode FROM n",
    "pending_batches": "SELECT doc_id // 64 * 64 AS \"offset\", count(*) AS n, 'd' || min(doc_id) AS first_id FROM documents WHERE NOT (doc_id % 5 = 0 OR (doc_id % 3 = 0 AND doc_id % 2 <> 0)) GROUP BY 1",
    "hybrid_fusion": f"{_FUSED} SELECT 'doc' AS path, chunk, methods, ls AS lexical_score, vs AS vector_rank_score, greatest(ls, vs) AS base, guard FROM fused",
    "hybrid_rerank": f"{_FUSED}, o AS (SELECT chunk, greatest(ls, vs) AS base, guard, row_number() OVER (ORDER BY greatest(ls, vs) DESC, guard DESC, chunk) AS r FROM fused) SELECT chunk, CASE WHEN r <= 12 THEN 0 ELSE 1 END AS phase, CASE WHEN r <= 12 THEN round_even(base * 0.2 + (chunk::BIGINT % 10) / 10 * 1000 + guard, 6) ELSE base END AS hybrid_score FROM o",
    "newest_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE strftime(ts, '%Y-%m-%d') IN (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS d FROM events ORDER BY d DESC LIMIT 3)",
    "packed_turns": "SELECT conv_id, turn, role FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - 2 AS e FROM conversations) WHERE e <= 800",
    "normal_memories": f"WITH {_MEM} SELECT id, importance, pinned, 1 AS n_tags FROM mem",
    "memory_relevance": f"{_REL} SELECT id, recency, matched, relevance FROM rel",
    "memory_rank": f"{_REL} SELECT row_number() OVER (ORDER BY pinned DESC, matched DESC, relevance DESC, importance DESC, doc_id) AS place, id, relevance FROM rel WHERE pinned OR matched > 0 QUALIFY place <= 25",
    "similar_memory": f"WITH a AS (SELECT item_id AS text_id, list_distinct({_TOK.format(x='text')}) AS w FROM benchmark), b AS (SELECT item_id AS ord, item_id + 1000 AS row_id, list_distinct({_TOK.format(x=chr(39).join(['text || ', ' appended', '']))}) AS w FROM benchmark), o AS (SELECT text_id, row_id, ord, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) AS overlap FROM a, b) SELECT text_id, arg_max(row_id, (overlap, -ord)) AS row_id, round_even(max(overlap), 6) AS overlap FROM o WHERE overlap >= 0.72 GROUP BY text_id",
    "nearest_previous_user": "SELECT conv_id, turn, p.t AS previous_turn, p.x AS previous_text FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN {'t': turn, 'x': text} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations) WHERE role = 'assistant'",
    "last_assistant": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "recall_texts": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 AND role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id",
    "transcripts": r"SELECT conv_id, string_agg(CASE WHEN role IN ('user', 'assistant', 'system', 'summary', 'error', 'queued') THEN role ELSE 'message' END || ': ' || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10) || chr(10) ORDER BY turn) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 AND trim(text) <> '' GROUP BY conv_id",
    "conversation_recall": f"WITH {TERMS_SQL}, rec AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 AND role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id),\n{score_sql('rec', 'conv_id', 'text')}, s AS (SELECT k AS conv_id, (SELECT max(conv_id) FROM rec) - k AS ord, score AS matched, score * 8 + greatest(1, 10 - ((SELECT max(conv_id) FROM rec) - k)) AS recall FROM scored), rel AS (SELECT conv_id FROM s WHERE matched > 0 ORDER BY matched DESC, recall DESC, conv_id::VARCHAR DESC, ord LIMIT 8) SELECT conv_id, matched, recall, CASE WHEN ord < 5 AND conv_id IN (SELECT conv_id FROM rel) THEN 'recent,relevant' WHEN ord < 5 THEN 'recent' ELSE 'relevant' END AS reasons FROM s WHERE ord < 5 OR conv_id IN (SELECT conv_id FROM rel)",
    "feedback_counts": "WITH " + _FEED + ", x AS (SELECT lower(rating || ' ' || note || ' a question') AS t FROM f), l AS (SELECT list_filter([CASE WHEN t LIKE '%missing%' OR t LIKE '%didn''t find%' OR t LIKE '%did not find%' OR t LIKE '%not found%' OR t LIKE '%absent%' OR t LIKE '%sources%' THEN 'recall' END, CASE WHEN t LIKE '%wrong source%' OR t LIKE '%wrong file%' OR t LIKE '%irrelevant%' OR t LIKE '%ranking%' OR t LIKE '%top result%' THEN 'ranking' END, CASE WHEN t LIKE '%citation%' OR t LIKE '%source%' OR t LIKE '%excerpt%' OR t LIKE '%ground%' OR t LIKE '%quote%' THEN 'evidence' END, CASE WHEN t LIKE '%ignored%' OR t LIKE '%didn''t use%' OR t LIKE '%did not use%' OR t LIKE '%answer%' THEN 'prompt_use' END, CASE WHEN t LIKE '%stale%' OR t LIKE '%old%' OR t LIKE '%outdated%' OR t LIKE '%changed%' THEN 'staleness' END, CASE WHEN t LIKE '%summary%' OR t LIKE '%prioritize%' OR t LIKE '%todo%' OR t LIKE '%plan%' THEN 'synthesis' END], lambda v: v IS NOT NULL) AS l FROM x) SELECT 'rating' AS facet, rating AS value, count(*) AS n FROM f GROUP BY rating UNION ALL SELECT 'focus', v, count(*) FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['answer_quality'] ELSE l END) AS v FROM l) GROUP BY v",
    "feedback_status": f"WITH {_FEED} SELECT doc_id, CASE rating WHEN 'up' THEN 'accepted-good' WHEN 'ok' THEN 'accepted-mixed' ELSE 'needs-review' END AS status FROM f",
    "skill_rank": f"WITH q AS (SELECT 'use skill-7 and ' || text AS q FROM benchmark ORDER BY item_id LIMIT 1), s AS (SELECT 'skill-' || item_id AS slug, text AS t, format('2024-01-{{:02d}}', item_id % 28 + 1) AS u FROM benchmark WHERE item_id % 10 <> 0), r AS (SELECT slug, u, len(list_intersect({_NAME.format(x='q')}, {_NAME.format(x='slug || chr(32) || t')})) * 10 + CASE WHEN contains(lower(q), slug) THEN 20 ELSE 0 END AS score FROM s, q) SELECT slug, score FROM r WHERE score > 0 ORDER BY score DESC, u DESC, slug LIMIT 12",
    "skill_groups": f"WITH t AS (SELECT item_id AS i, unnest(list_filter({_NAME.format(x='text')}, lambda w: NOT list_contains({_STOP}, w))) AS term FROM benchmark) SELECT a.i AS a, b.i AS b, count(*) AS shared FROM t a JOIN t b ON a.term = b.term AND a.i < b.i GROUP BY 1, 2 HAVING shared >= 4",
    "skill_matches": f"WITH a AS (SELECT DISTINCT conv_id || '-' || turn AS text_id, unnest(list_filter({_NAME.format(x='text')}, lambda w: NOT list_contains({_STOP}, w))) AS term FROM conversations WHERE role = 'user'), b AS (SELECT item_id AS ord, unnest(list_filter({_NAME.format(x='text')}, lambda w: NOT list_contains({_STOP}, w))) AS term FROM benchmark), p AS (SELECT text_id, ord, string_agg(DISTINCT term, ' ' ORDER BY term) AS shared FROM a JOIN b USING (term) GROUP BY text_id, ord) SELECT text_id, 'skill-' || ord AS slug, shared FROM p QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY ord) <= 3",
    "stale_skills": "WITH s AS (SELECT item_id, 'skill-' || item_id AS slug, date_diff('day', make_date(2024, 1, (item_id % 28 + 1)::INT), DATE '2024-03-01') AS age_days FROM benchmark) SELECT slug, age_days FROM s WHERE item_id % 3 <> 0 AND item_id % 2 = 0 AND age_days >= 40",
    "rule_findings": f"WITH {_RULES} SELECT k AS page_id, rule, severity, line FROM ({_FOUND.format(k='page_id', src='pages', x='html')})",
    "rule_verdicts": f"WITH {_RULES}, f AS ({_FOUND.format(k='doc_id', src='documents', x='text')}) SELECT k AS doc_id, count(*) FILTER (WHERE severity = 'block') AS block, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, CASE WHEN block > 0 THEN 'blocked' WHEN warn > 0 THEN 'review' ELSE 'pass' END AS status FROM f GROUP BY k",
    "recency_rows": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
}
