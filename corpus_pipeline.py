"""Corpus pipeline: toxicity, language, near copies, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), where docs are what the stage before kept,
and returns a DataFrame; all but the last return the columns of documents. A row
without a doc_id passes the stages that work by id; a null text has no toxicity,
no language (so the second stage rejects it), no copies and no leak.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.llm import byte_bpe, langid, prob_minhash, templates, toxicity
from corvana.llm.common import materialise, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below toxicity.TOXIC_AT; the classifier learns from labels outside the held-out quarter."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language whose proportion is langid.KEEP_AT or more."""
    return langid.with_language(docs, langid.train(docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id."""
    return prob_minhash.one_per_class(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or with other values in its slots."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and decoded bytes."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    decoded = byte_bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("language", language_known),
    ("near copies", near_copies_out),
    ("decontamination", leaks_out),
    ("tokens", tokens),
]
#: Trained classifiers, min-hashes and byte pair merges are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
