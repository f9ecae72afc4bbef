"""Lookup joins that tolerate hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str,
                how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a large relation to a lookup with one row per key (left, semi or anti).

    Rows of one key are spread over ``salts`` tasks by the hash of ``spread``; the much
    smaller lookup is repeated once per salt.  Spark's size estimate does not see the repeats, so
    the copies are kept from being broadcast: they would pass the driver at ``salts`` times that size.
    They are hashed in each task, and the rows stream past them unsorted: sorting the rows is what
    would take a task's memory.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("shuffle_hash")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def mint_to_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate of every mint: earliest discovery, then smallest id."""
    best = F.min(F.struct("discovered_at", "candidate_id"))
    return candidates.groupBy("mint").agg(best.alias("b")).select(
        "mint", F.col("b.candidate_id").alias("resolved_id"))


def resolve_candidates(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fill missing candidate ids of liquidity events from the mint.

    An event keeps a NULL id until its mint is discovered and can be resolved later.
    """
    joined = salted_join(events, mint_to_candidate(candidates), "mint", "tx_signature")
    return joined.withColumn(
        "candidate_id", F.coalesce(F.nullif(F.col("candidate_id"), F.lit("")), "resolved_id")
    ).select(*events.columns)


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The newest row of every key, reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(
        *keys, "r.*").select(*df.columns)

