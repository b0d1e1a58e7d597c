"""Queries of index building: chunks, evidence, gates, recall, commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.operators import corpus
from corvana.plans.tables import table


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.chunks(table(spark, sf, "documents"), "doc_id", F.col("text"), 1000, 100).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), "digest")


def stored_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.chunks(table(spark, sf, "documents"), "doc_id", F.col("text"), 1000, 100)
    return corpus.stored_bodies(rows, "doc_id").groupBy("duplicate").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Number of evidence rows of each kind in each document."""
    rows = corpus.evidence(table(spark, sf, "documents"), "doc_id", F.col("text"), 1200)
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("end").cast("long").alias("last"))


def fixture_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each language as expected keys, labelled ones as found."""
    expected = table(spark, sf, "documents").select(F.col("lang").alias("fixture"), F.col("doc_id").alias("key"))
    found = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("lang").alias("fixture"), F.col("doc_id").alias("key"))
    return corpus.recall(expected, found).withColumn("recall", F.bround("recall", 6))


_ALL = (chunked, stored_bodies, evidence_rows, fixture_recall)
QUERIES = {f.__name__: f for f in _ALL}

_CHUNKS = "c AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE (length(text) - 1000 + 899) // 900 + 1 END)) AS chunk FROM documents), k AS (SELECT doc_id, chunk, chunk * 900 AS start, substr(text, chunk * 900 + 1, 1000) AS content FROM c)"
ORACLE = {
    "chunked": f"WITH {_CHUNKS} SELECT doc_id, chunk, start, sha256(content) AS digest FROM k",
    "stored_bodies": f"WITH {_CHUNKS} SELECT duplicate, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM (SELECT content, row_number() OVER (PARTITION BY content ORDER BY doc_id, chunk) > 1 AS duplicate FROM k) GROUP BY duplicate",
    "fixture_recall": "SELECT d.lang AS fixture, count(*) AS wanted, count(l.doc_id) AS hits, round_even(count(l.doc_id) / count(*), 6) AS recall FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.lang",
}
