"""Derived artifacts that follow their sources: a stored result, refreshed for the keys whose sources changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.sources.versioned import Table


def fingerprints(sources: DataFrame, key: str) -> DataFrame:
    """key, fingerprint of each key's rows, whatever their order: counts and sums of two hashes, combined before the exchange."""
    rest = [c for c in sources.columns if c != key]
    # Fields are told apart by their lengths, null from the empty string.
    row = F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in rest))
    hashed = sources.select(key, F.xxhash64(row).alias("_a"), F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("long").alias("_b"))
    sums = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("_a").alias("_x"), F.sum(F.col("_b").cast("decimal(38,0)")).alias("_s"))
    return sums.select(key, F.concat_ws(":", "_n", "_x", F.col("_s").cast("string")).alias("fingerprint"))


@dataclass(frozen=True)
class Refreshed:
    """Keys that were built, left as they are, and removed as their sources are gone."""

    built: int
    kept: int
    removed: int


def refresh(sources: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], result: Table, known: Table) -> Refreshed:
    """Bring a stored result up to date with its sources.

    known holds the fingerprint of each key's sources (key, fingerprint) when its rows were built.
    Keys that are new or changed are built again, from their own sources alone; those without
    sources go; files of the result that hold none of these keys are not touched. The result is
    committed before the fingerprints: a refresh that ends between the two builds its keys again,
    to the same rows. build gives rows with the key, any number for each.
    """
    now = fingerprints(sources, key)
    before = known.read().select(F.col(key).alias("_k"), F.col("fingerprint").alias("_f"))
    both = now.join(before, now[key].eqNullSafe(F.col("_k")), "full")
    state = F.when(F.col("fingerprint").isNull(), "gone").when(F.col("_f").isNull() | (F.col("_f") != F.col("fingerprint")), "built").otherwise("kept")
    counts = {r["state"]: r["n"] for r in both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n")).collect()}
    told = Refreshed(counts.get("built", 0), counts.get("kept", 0), counts.get("gone", 0))
    if told.built or told.removed:
        moved = both.filter(state != "kept").select(F.coalesce(key, "_k").alias(key))
        fresh = both.filter(state == "built").select(key, "fingerprint")
        result.replace(moved, build(sources.join(fresh.select(key), key, "left_semi")))
        known.replace(moved, fresh)
    return told
