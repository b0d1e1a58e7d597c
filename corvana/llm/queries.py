"""The queries of this subpackage, each over the whole of its tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvana.llm import byte_bpe, langid, licenses, main_text, merkle, ngram_join, ogg, oracles, prob_minhash, templates, token_files, toxicity, variants, warc
from corvana.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from labels outside the held-out quarter."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, read back and assembled into its capture."""
    captures = warc.round_trip(table(spark, sf_dir, "pages")).filter("response IS NOT NULL")
    return captures.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", F.col("response.warc_type").alias("record_type"), "response.refers_to")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, read back from token files."""
    read = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, match_added=True)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that is in a document, verbatim or with other values in its slots."""
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document, with its coverage and span."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Ogg file of every document's text holds, read back from its bytes."""
    return ogg.probe(ogg.media_column(table(spark, sf_dir, "documents"))).drop("page_times")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixture of every document, learned outside the held-out quarter."""
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, text_id of every document; classes of near copies at 0.8 or more."""
    return prob_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all texts with its near words, its commoner form and the root of its chain of forms."""
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of word n-grams and its component of links at 0.85 or more."""
    return ngram_join.linked_components(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's digest, its proof up to the manifest's root, and whether the checked row folds back to it."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_files": op4_token_files,
    "op5_templates": op5_templates,
    "op6_licenses": op6_licenses,
    "op7_ogg": op7_ogg,
    "op8_main_text": op8_main_text,
    "op9_languages": op9_languages,
    "op10_prob_minhash": op10_prob_minhash,
    "op11_variants": op11_variants,
    "op12_ngram_join": op12_ngram_join,
    "op13_merkle": op13_merkle,
}

ORACLE: dict[str, str] = {"op11_variants": oracles.VARIANTS, "op12_ngram_join": oracles.NGRAM_JOIN, "op13_merkle": oracles.MERKLE}
