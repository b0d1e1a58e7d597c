"""Queries of state that changes: versioned tables, memories as files, reused vectors, files and chunks in two levels, chosen spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.functions import references as R
from corvana.operators import derived, dossiers, memory, spans, vectors
from corvana.plans import retrieval
from corvana.plans.tables import TERMS_SQL, first_question, score_sql, shared_folder, table
from corvana.sources import listing, versioned

_TURNS = "conv_id long, turn long, role string, text string"


def _conversations(spark: SparkSession, sf: str) -> versioned.Table:
    """Conversations as a versioned table, appended in three parts."""
    stored, turns = versioned.Table(spark, f"{shared_folder(spark)}/table", _TURNS), table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    for k in range(3):
        stored.append(turns.filter(F.col("conv_id") % 3 == k))
    return stored


def versioned_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh conversation deleted from a versioned table: turns of each role that stay, and how many went."""
    stored = _conversations(spark, sf)
    change = stored.delete(table(spark, sf, "conversations").filter("conv_id % 7 = 3").select("conv_id").distinct())
    left = stored.read().groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return left.withColumn("removed", F.lit(change.removed).cast("long"))


def versioned_merge(spark: SparkSession, sf: str) -> DataFrame:
    """First turns put in place of the stored ones, in upper case, and a turn more for each conversation."""
    stored, turns = _conversations(spark, sf), table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("note").alias("role"), F.lit("end").alias("text"))
    change = stored.merge(turns.filter("turn = 0").withColumn("text", F.upper("role")).union(ends), ["conv_id", "turn"])
    out = stored.read().groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return out.withColumns({"removed": F.lit(change.removed).cast("long"), "added": F.lit(change.added).cast("long")})


def memories_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as memories in files of JSON lines, read back with defaults, those of one conversation taken out."""
    folder = shared_folder(spark)
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(F.when(d % 5 > 0, F.concat(F.lit("m"), d)).alias("id"), F.when(d % 2 == 0, F.col("text")).alias("text"), (d % 9).cast("string").alias("importance"), F.concat(F.lit("c"), d % 10).alias("conversation_id"))
    rows.write.json(folder)
    kept, removed = memory.without_conversation(memory.load(spark, folder, None), "c4")
    counts = kept.groupBy("importance").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("id").startswith("legacy-")).alias("named"))
    return counts.join(F.broadcast(removed))  # one row


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(v.alias("ord"), F.concat(F.lit("v"), v).alias("id"), F.sha2(v.cast("string"), 256).alias("input_sha256"), F.lit("s2").alias("schema"), F.lit("raw").alias("kind"), F.when(v % 4 == 0, 0).when(v % 4 == 1, 64).otherwise(32).alias("route_dims"))


def reusable_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors that still stand for a candidate: some of another schema, another text, other dimensions, or empty."""
    v = F.col("vec_id")
    stored = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), v).alias("id"), F.sha2((v + F.when(v % 5 == 0, 1).otherwise(0)).cast("string"), 256).alias("input_sha256"), F.when(v % 7 == 0, "s1").otherwise("s2").alias("schema"), F.lit("raw").alias("kind"), F.when(v % 11 > 0, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("vector"))
    return vectors.reusable(_candidates(spark, sf), stored).select("ord", "id", F.size("vector").cast("long").alias("dims"))


def completed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a checkpoint in the order of their candidates, with a time where they lack one."""
    v = F.col("vec_id")
    progress = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), v * 2).alias("id"), v.alias("ord"), F.when(v % 3 > 0, F.concat(F.lit("t"), v)).alias("created"))
    kept = vectors.checkpointed(progress, _candidates(spark, sf), "t0")
    return vectors.completed(_candidates(spark, sf).select("id", (-F.col("ord")).alias("ord")), kept.drop("ord")).select("id", "created")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("chunk"), F.concat(F.lit("notes "), "source").alias("summary"), F.col("text").alias("content"))


def two_level(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as files and documents as chunks: the three best chunks of each of the best files for a question about notes."""
    plan = retrieval.build_plan("notes of src7 and src3: " + first_question(spark, sf))
    return retrieval.two_level(_sources(spark, sf), plan, 3).select("path", F.col("chunk").alias("doc_id"), "total", "file_score", F.col("place").cast("long").alias("place"))


def selected_spans(spark: SparkSession, sf: str) -> DataFrame:
    """What of each document answers the first question within 900 characters, and how it was chosen."""
    out = spans.with_selection(table(spark, sf, "documents"), "text", first_question(spark, sf), 900, most=None)
    return out.select("doc_id", "method", F.size("spans").cast("long").alias("n_spans"), "excerpt")


def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as a tree of sources and languages, listed with one language ignored: files to index and folders left out, by source."""
    root = shared_folder(spark)
    d = table(spark, sf, "documents").select("source", "lang", F.col("n_chars").cast("string").alias("value"))
    d.repartition("source", "lang").write.partitionBy("source", "lang").text(f"{root}/tree")
    found = listing.listing(spark, f"{root}/tree", f"{root}/rounds", R.parse_ignore("lang=de/"))
    source = F.regexp_extract("path", "^source=([^/]*)", 1)
    files = found.sources().groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("files"))
    left = found.found.filter("rule IS NOT NULL").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("ignored"))
    opened = found.opened.filter("path LIKE '%/%'").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("opened"))
    return files.join(left, "source", "left").join(opened, "source", "left").fillna(0, ["ignored"])


def topic_dossiers(spark: SparkSession, sf: str) -> DataFrame:
    """What of each conversation answers the first question, stored; after a change of some conversations only these are built again."""
    root, question = shared_folder(spark), first_question(spark, sf)
    result = versioned.Table(spark, f"{root}/dossiers", "conv_id long, turn long, score long")
    known = versioned.Table(spark, f"{root}/known", "conv_id long, fingerprint string")

    def build(turns: DataFrame) -> DataFrame:
        rows = turns.select(F.col("conv_id").alias("dossier_id"), F.col("turn").alias("ord"), "text")
        return dossiers.from_dossier(rows, question, 900).select(F.col("dossier_id").alias("conv_id"), F.col("ord").alias("turn"), "score")

    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    derived.refresh(turns, "conv_id", build, result, known)
    changed = turns.filter("conv_id % 10 <> 3").withColumn("text", F.when((F.col("conv_id") % 5 == 1) & (F.col("turn") == 0), "changed").otherwise(F.col("text")))
    told = derived.refresh(changed, "conv_id", build, result, known)
    return result.read().withColumns({"built": F.lit(told.built).cast("long"), "removed": F.lit(told.removed).cast("long")})


_ALL = (listed_files, topic_dossiers, versioned_delete, versioned_merge, memories_loaded, reusable_vectors, completed_vectors, two_level, selected_spans)
QUERIES = {f.__name__: f for f in _ALL}

_ASKED = TERMS_SQL.replace("SELECT text FROM benchmark ORDER BY item_id LIMIT 1", "SELECT 'notes of src7 and src3: ' || text AS text FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)")
_FILES = score_sql("fc", "path", "own").replace("toks AS", "ftoks AS").replace("FROM toks", "FROM ftoks").replace("JOIN toks", "JOIN ftoks").replace("toks.", "ftoks.").replace("fftoks", "ftoks").replace("tf AS", "ftf AS").replace("FROM tf ", "FROM ftf ").replace("tf.", "ftf.").replace("sat AS", "fsat AS").replace("sat.", "fsat.").replace("LEFT JOIN sat", "LEFT JOIN fsat").replace("bonus AS", "fbonus AS").replace("bonus.", "fbonus.").replace("JOIN bonus", "JOIN fbonus").replace("scored AS", "fscored AS")
ORACLE = {
    "listed_files": "SELECT source, count(DISTINCT lang) FILTER (WHERE lang <> 'de') AS files, count(DISTINCT lang) FILTER (WHERE lang = 'de') AS ignored, count(DISTINCT lang) FILTER (WHERE lang <> 'de') AS opened FROM documents GROUP BY source HAVING count(*) FILTER (WHERE lang <> 'de') > 0",
    "topic_dossiers": f"WITH {TERMS_SQL}, c AS (SELECT conv_id * 10000 + turn AS key, conv_id, turn, CASE WHEN conv_id % 5 = 1 AND turn = 0 THEN 'changed' ELSE text END AS text FROM conversations WHERE conv_id % 10 <> 3),\n{score_sql('c', 'key', 'text')}, r AS (SELECT conv_id, turn, score, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY score DESC, turn ROWS UNBOUNDED PRECEDING) - 2 AS e FROM c JOIN scored ON k = key) SELECT conv_id, turn, score, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 5 = 1) AS built, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 10 = 3) AS removed FROM r WHERE e <= 900",
    "versioned_delete": "SELECT role, count(*) AS n, (SELECT count(*) FROM conversations WHERE conv_id % 7 = 3) AS removed FROM conversations WHERE conv_id % 7 <> 3 GROUP BY role",
    "versioned_merge": "WITH e AS (SELECT conv_id, max(turn) + 1 AS turn FROM conversations GROUP BY conv_id), r AS (SELECT role, CASE WHEN turn = 0 THEN upper(role) ELSE text END AS text FROM conversations UNION ALL SELECT 'note', 'end' FROM e), n AS (SELECT count(*) AS removed FROM conversations WHERE turn = 0) SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, removed, removed + (SELECT count(*) FROM e) AS added FROM r, n GROUP BY role, removed",
    "memories_loaded": "SELECT CASE WHEN doc_id % 9 = 0 THEN 1 ELSE least(5, doc_id % 9) END::INT AS importance, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 1 OR text = '') AS empty, count(*) FILTER (WHERE doc_id % 5 = 0) AS named, (SELECT count(*) FROM documents WHERE doc_id % 10 = 4) AS removed FROM documents WHERE doc_id % 10 <> 4 GROUP BY 1",
    "reusable_vectors": "SELECT vec_id AS ord, 'v' || vec_id AS id, 64::BIGINT AS dims FROM embeddings WHERE vec_id % 5 > 0 AND vec_id % 7 > 0 AND vec_id % 11 > 0 AND vec_id % 4 < 2",
    "completed_vectors": "SELECT 'v' || p.vec_id * 2 AS id, CASE WHEN p.vec_id % 3 > 0 THEN 't' || p.vec_id ELSE 't0' END AS created FROM embeddings p JOIN embeddings c ON c.vec_id = p.vec_id * 2",
    "two_level": f"WITH {_ASKED}, dc AS (SELECT doc_id, source AS path, source || chr(10) || 'notes ' || source || chr(10) || text AS hay FROM documents), fc AS (SELECT DISTINCT source AS path, source || chr(10) || 'notes ' || source AS own FROM documents),\n{score_sql('dc', 'doc_id', 'hay')},\n{_FILES}, f AS (SELECT k AS path, score AS file_score FROM fscored WHERE score > 0 ORDER BY score DESC, k LIMIT 8), c AS (SELECT path, doc_id, score AS total, row_number() OVER (PARTITION BY path ORDER BY score DESC, doc_id) AS place FROM scored JOIN dc ON k = doc_id) SELECT path, doc_id, total, file_score, place FROM c JOIN f USING (path) WHERE place <= 3",
}
