"""Sparse time series from raw swaps and liquidity events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions.timecols import bucket_start
from marketlab.operators.joins import salted_join

INTERVALS = (60, 300, 3600)  # fixed bucket widths in seconds


def exact_sum(amount: Column) -> Column:
    """Sum to twelve decimals that does not depend on the order of addition."""
    return F.sum(amount.cast("decimal(38,12)")).cast("double")


def price_timeseries(swaps: DataFrame) -> DataFrame:
    """One row per (candidate, millisecond): last price in event order, volume, count."""
    order = F.struct("slot", "tx_signature", "event_index")
    return (
        swaps.groupBy("candidate_id", F.col("timestamp").alias("timestamp_ms"))
        .agg(
            F.max_by(F.struct("slot", "price"), order).alias("last"),
            exact_sum(F.col("amount_out")).alias("volume"),
            F.count(F.lit(1)).alias("swap_count"),
        )
        .select("candidate_id", "timestamp_ms", "last.slot", "last.price", "volume", "swap_count")
    )


def liquidity_timeseries(events: DataFrame) -> DataFrame:
    """One row per (candidate, millisecond): the last reserves in event order.

    Events whose mint has no candidate yet (NULL candidate_id) have no series.
    """
    order = F.struct("slot", "tx_signature", "event_index")
    return (
        events.where("candidate_id is not null")
        .groupBy("candidate_id", F.col("timestamp").alias("timestamp_ms"))
        .agg(F.max_by(F.struct("slot", "liquidity_after", "amount_token", "amount_quote"), order)
             .alias("last"))
        .select(
            "candidate_id", "timestamp_ms", "last.slot",
            F.col("last.liquidity_after").alias("liquidity"),
            F.col("last.amount_token").alias("liquidity_token"),
            F.col("last.amount_quote").alias("liquidity_quote"))
    )


def volume_timeseries(swaps: DataFrame, intervals=INTERVALS) -> DataFrame:
    """Volume buckets of every width.

    The narrowest width is aggregated from the swaps; the wider ones, being multiples of
    it, are rolled up from that much smaller result.
    """
    widths = sorted(intervals)
    base = widths[0]
    if any(w % base for w in widths):
        raise ValueError(f"bucket widths must be multiples of the narrowest: {widths}")

    def side(name: str):
        return F.coalesce(F.sum(F.when(F.col("side") == name, F.col("amount_out"))), F.lit(0.0))

    narrow = swaps.groupBy(
        "candidate_id", bucket_start("timestamp", base * 1000).alias("timestamp_ms")
    ).agg(
        F.sum("amount_out").alias("volume"), F.count(F.lit(1)).alias("swap_count"),
        side("buy").alias("buy_volume"), side("sell").alias("sell_volume"))
    return widened(narrow, widths)


def widened(narrow: DataFrame, widths) -> DataFrame:
    """Buckets of every width from those of the narrowest one, or from parts of them."""
    return (
        narrow.withColumn("interval_seconds", F.explode(F.array(*[F.lit(w) for w in widths])))
        .withColumn("timestamp_ms", F.expr(
            "(timestamp_ms div (interval_seconds * 1000L)) * (interval_seconds * 1000L)"))
        .groupBy("candidate_id", "timestamp_ms", "interval_seconds")
        .agg(*[F.sum(c).alias(c) for c in ("volume", "swap_count", "buy_volume", "sell_volume")])
    )


def lifecycle(series: DataFrame) -> DataFrame:
    """First and last time, span and number of points per candidate."""
    return series.groupBy("candidate_id").agg(
        F.min("timestamp_ms").alias("first_ts"), F.max("timestamp_ms").alias("last_ts"),
        (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("total_lifetime_ms"),
        F.count(F.lit(1)).alias("total_points"))


def only_missing(swaps: DataFrame, existing: DataFrame, mode: str = "skip") -> DataFrame:
    """Input of the next normalisation run.

    ``skip`` leaves out candidates that already have a series; ``recompute`` keeps all.
    """
    if mode == "recompute":
        return swaps
    if mode != "skip":
        raise ValueError(f"unknown mode: {mode}")
    done = existing.select("candidate_id").distinct()
    return salted_join(swaps, done, "candidate_id", "tx_signature", "left_anti")
