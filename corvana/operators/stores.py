"""Embedding stores as tables: candidates, rows with provenance, keys of unfinished runs, records, plans and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import vectors

SUMMARY_CHARS = 280
# What a vector row tells of the evidence it stands for.
EVIDENCE = ("evidence_id", "evidence_kind", "evidence_title", "evidence_date", "evidence_todo", "evidence_priority", "evidence_start", "evidence_end", "evidence_excerpt", "evidence_text_sha256")
# Families of vector rows, the count that sizes each, and what makes its rows stale.
FAMILIES = (
    ("raw_chunk_embedding", "raw_rows", "content_sha256 embedding_model embedding_input_schema embedding_split_policy source_realm"),
    ("evidence_embedding", "evidence_rows", "evidence_schema evidence_input_schema content_sha256 source_fingerprint embedding_model"),
    ("chunk_summary_embedding", "chunk_summaries", "artifact_schema summary_prompt_version source_fingerprint embedding_model"),
    ("file_summary_embedding", "file_summaries", "artifact_schema source_fingerprint embedding_model"),
    ("file_label_embedding", "files", "file_path signal_schema label_schema embedding_model"),
    ("memory_embedding", "memories", "memory_id memory_updated embedding_model source_realm"),
    ("conversation_summary_embedding", "conversations", "conversation_id conversation_updated summary_schema embedding_model"),
    ("topic_dossier_embedding", "topics", "topic_id topic_schema source_fingerprint embedding_model"),
    ("memory_dossier_embedding", "dossiers", "dossier_id dossier_schema memory_updated conversation_updated embedding_model"),
)
# What tells one unfinished run from another, in the order of its digest.
PROGRESS_KEY = ("embedding_dimensions", "embedding_input_bytes", "embedding_input_chars", "embedding_input_schema", "embedding_max_parts_per_chunk", "method", "model", "route", "schema", "source_fingerprint", "source_index", "target_schema", "vector_row_id_schema")
_NUMBERS = {"embedding_dimensions", "embedding_input_bytes", "embedding_input_chars", "embedding_max_parts_per_chunk"}


def candidates(chunk_rows: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """Texts to embed, those of chunks (lane 0) and of evidence (lane 1), without blank ones.

    Both sides: id, index_id, path, chunk, text, and of EVIDENCE what there is.
    """
    both = chunk_rows.withColumn("lane", F.lit(0)).unionByName(evidence_rows.withColumn("lane", F.lit(1)), allowMissingColumns=True)
    return both.filter(T.strip(F.coalesce("text", F.lit(""))) != "")


def vector_rows(found: DataFrame, embedded: DataFrame, schema: str) -> DataFrame:
    """Candidates with their vectors (id, vector) as rows of a store; an evidence excerpt stands before a summary.

    found: what candidates() gives, with content_sha256 and summary of the chunk, and part and parts.
    """
    have = set(found.columns)
    given = lambda name, kind: F.nullif(F.col(name).cast("string"), F.lit("")) if name in have else F.lit(None).cast(kind)
    excerpt = given("evidence_excerpt", "string")
    rows = found.join(embedded.select("id", "vector"), "id")
    return rows.select(
        "id",
        F.when(F.col("lane") == 1, "evidence_embedding").otherwise("raw_chunk_embedding").alias("kind"),
        F.when(F.col("lane") == 1, "evidence").otherwise("chunk_content").alias("embedding_kind"),
        F.lit(schema).alias("embedding_input_schema"),
        F.length("text").alias("embedding_input_chars"),
        T.sha256(F.col("text")).alias("embedding_input_sha256"),
        *((F.coalesce(n, F.lit(1)) if n in have else F.lit(1)).alias(f"embedding_{n}") for n in ("part", "parts")),
        "index_id",
        "path",
        "chunk",
        "content_sha256",
        F.col("content_sha256").alias("source_fingerprint"),
        "vector",
        T.compact(F.coalesce(excerpt, F.nullif("summary", F.lit("")), F.lit("")), SUMMARY_CHARS).alias("summary"),
        *(given(n, "string").alias(n) for n in EVIDENCE),
    )


def progress_key(runs: DataFrame) -> DataFrame:
    """Runs with progress_key (JSON, keys in order) and progress_id, its digest; numbers that are missing are 0."""
    entry = {n: F.coalesce(F.expr(f"try_cast({n} AS bigint)"), F.lit(0)).cast("string") if n in _NUMBERS else F.regexp_extract(F.to_json(F.array(F.coalesce(n, F.lit("")))), r"^\[(.*)\]$", 1) for n in PROGRESS_KEY}
    key = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), entry[n]) for n in PROGRESS_KEY)), F.lit("}"))
    return runs.withColumn("progress_key", key).withColumn("progress_id", F.concat(F.lit("embedding-"), F.substring(T.sha256(F.col("progress_key")), 1, 16)))


def elapsed_seconds(created: Column, session: Column, now: Column) -> Column:
    """Whole seconds since a run was created; without such a time, those of the session."""
    since = F.unix_timestamp(now) - F.unix_timestamp(T.timestamp(created))
    return F.greatest(F.lit(0), F.coalesce(since, F.floor(session), F.lit(0))).cast("long")


def age_seconds(moment: Column, now: Column) -> Column:
    """Whole seconds since a moment, at least 0; null if there is no such time."""
    since = F.unix_timestamp(now) - F.unix_timestamp(T.timestamp(moment))
    return F.when(since.isNotNull(), F.greatest(F.lit(0), since)).cast("long")


def row_plans(stats: DataFrame, dims: int = vectors.DENSE_DIMS) -> DataFrame:
    """kind, rows, dims, vector_bytes, metadata_bytes, estimated_bytes, invalidates_on of every family, for one row of counts."""
    counted = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))).cast("long") if c in stats.columns else F.lit(0).cast("long")
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), counted(c).alias("rows"), F.lit(stale).alias("invalidates_on")) for kind, c, stale in FAMILIES))
    rows = stats.select(F.explode(each).alias("f")).select("f.*").withColumn("dims", F.lit(max(1, dims)))
    sized = rows.withColumn("vector_bytes", F.col("rows") * F.col("dims") * 4).withColumn("metadata_bytes", F.col("rows") * vectors.ROW_OVERHEAD)
    return sized.withColumn("estimated_bytes", F.col("vector_bytes") + F.col("metadata_bytes"))


def readiness_gates(evaluation: DataFrame, audit: DataFrame, routes: DataFrame) -> DataFrame:
    """name, status of what a vector store needs: a passed evaluation, a sound index storage, routes to embed and to rerank.

    evaluation: status (no row: not run); audit: one row with missing_targets and
    missing_chunks; routes: route, task.
    """
    tasks = routes.agg(F.count_if(F.col("task") == "embed").alias("e"), F.count_if(F.col("task") == "rerank").alias("r"))
    ran = evaluation.agg(F.coalesce(F.max("status"), F.lit("not-run")).alias("status"))
    sound = audit.agg(F.coalesce(F.sum(F.coalesce("missing_targets", F.lit(0)) + F.coalesce("missing_chunks", F.lit(0))), F.lit(0)).alias("lost"))
    one = ran.join(F.broadcast(sound)).join(F.broadcast(tasks))  # one row each
    state = {
        "retrieval_eval": F.col("status"),
        "index_storage_audit": F.when(F.col("lost") == 0, "pass").otherwise("warn"),
        "embedding_route": F.when(F.col("e") > 0, "available").otherwise("not-configured"),
        "reranker_route": F.when(F.col("r") > 0, "available").otherwise("not-configured"),
        "privacy_boundary": F.lit("pass"),
    }
    gates = F.array(*(F.struct(F.lit(name).alias("name"), status.alias("status")) for name, status in state.items()))
    return one.select(F.explode(gates).alias("g")).select("g.*")


def query_input(text: Column) -> Column:
    """query and rerank of what a user typed: the flag may stand anywhere."""
    words = F.filter(F.split(T.collapse(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    return F.struct(F.array_join(F.array_remove(words, "--rerank"), " ").alias("query"), F.array_contains(words, "--rerank").alias("rerank"))


def route_identity(routes: DataFrame) -> DataFrame:
    """route_id (that of the catalogue, if there is one), route_model, route_dims."""
    return routes.select(F.coalesce(F.nullif("catalog_route", F.lit("")), "route", F.lit("")).alias("route_id"), F.coalesce("model", F.lit("")).alias("route_model"), F.coalesce(F.expr("try_cast(embedding_dimensions AS int)"), F.lit(0)).alias("route_dims"))


def route_record() -> Column:
    return F.struct(F.col("route_id").alias("catalog_route"), F.col("route_model").alias("model"), F.coalesce("request_path", F.lit("/v1/embeddings")).alias("request_path"), F.coalesce("route_dims", F.lit(0)).alias("embedding_dimensions"), F.col("max_parallel"))


def source_index_record(default_glob: str = "**/*") -> Column:
    return F.struct(F.col("index_id").alias("id"), F.col("name"), F.col("root"), F.col("index_created").alias("created"), F.coalesce(F.nullif("glob", F.lit("")), F.lit(default_glob)).alias("glob"), F.col("family_key"), F.col("fingerprint"))


def progress_records(runs: DataFrame) -> DataFrame:
    """Unfinished runs (progress_id, counts, route and index columns) as records: what a next run resumes from."""
    counts = [F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("expected_rows", "completed_rows", "checkpoint_rows", "previous_rows")]
    eta = vectors.eta_seconds(F.col("expected_rows"), F.col("completed_rows"), F.col("checkpoint_rows") + F.col("previous_rows"), F.col("elapsed"))
    return runs.select("progress_id", source_index_record().alias("source_index"), route_record().alias("embedding_route"), *counts, F.col("elapsed").cast("long").alias("elapsed_seconds"), eta.alias("eta_seconds"))


def store_records(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Finished stores with their counts of rows (rows: store_id), what was reused, and provenance."""
    n = rows.groupBy("store_id").agg(F.count(F.lit(1)).alias("row_count"), F.max(F.size("vector")).alias("dims"))
    reused = F.coalesce("checkpoint_rows", F.lit(0)) + F.coalesce("previous_rows", F.lit(0))
    out = runs.join(n, "store_id", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0))).withColumn("reused_rows", reused.cast("long"))
    return out.select(
        "store_id",
        "row_count",
        F.coalesce("dims", F.lit(0)).alias("dims"),
        "reused_rows",
        F.greatest(F.lit(0), F.col("row_count") - F.col("reused_rows")).alias("embedded_rows"),
        F.when(F.coalesce("previous_rows", F.lit(0)) > 0, F.col("previous_store")).otherwise("").alias("reuse_store_id"),
        route_record().alias("embedding_route"),
        source_index_record().alias("source_index"),
        F.struct(F.lit("vector-store").alias("artifact_kind"), F.col("route_id").alias("route"), F.col("route_model").alias("model"), F.col("fingerprint").alias("input_hash"), F.col("fingerprint").alias("source_sha256")).alias("provenance"),
    )


def batch_plan(waiting: int, batch: int, slots: int, failures: int = 0, most_slots: int = 32) -> tuple[int, int]:
    """(rows of a batch, batches at once): smaller batches where the waiting rows would leave slots idle, half the slots after each failure."""
    slots = max(1, min(most_slots, slots) >> failures)
    return (max(1, min(batch, -(-waiting // slots))), slots) if waiting else (batch, slots)


def reduced(rows: DataFrame, key: str, order: str, text: str, fan_in: int, combine) -> DataFrame:
    """key, text: texts of each key reduced level by level, `fan_in` neighbours at a time, by combine (a Column of the array of texts).

    A level is one aggregation; a task holds `fan_in` texts, however many a key has.
    """
    from pyspark.sql import Window

    level = rows.select(F.col(key).alias("_k"), (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("_n"), F.col(text).alias("_t"))
    most = level.agg(F.max("_n").alias("m")).first()["m"]
    while most is not None:
        groups = level.groupBy("_k", F.floor(F.col("_n") / fan_in).cast("int").alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_r"))
        level = groups.select("_k", F.col("_g").alias("_n"), combine(F.transform("_r", lambda r: r["_t"])).alias("_t"))
        if most < fan_in:
            break
        most //= fan_in
    return level.select(F.col("_k").alias(key), F.col("_t").alias(text))
