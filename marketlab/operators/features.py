"""Derived features per price point: one pass over the merged price/liquidity series.

Both series are merged, cut into slices (see ``slices``) and sorted once.  At a given time
the price row sorts before the liquidity row, so "earlier liquidity" is strict and an exact
match is the row that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.operators.slices import (
    SLICE, add_slice, attach, before, earlier_slices, last_known, slice_window)

KEY = ["candidate_id"]


def _rate(value: Column, start: Column, ts: Column, start_ts: Column) -> Column:
    return F.when(ts > start_ts, (value - start) / (ts - start_ts))


def derivatives(series: DataFrame, value: str, carry_gaps: bool = False) -> DataFrame:
    """Previous point, delta, time delta, velocity and acceleration of one series.

    A row without velocity (first row, repeated time) breaks the chain of accelerations;
    with ``carry_gaps`` the last known velocity is used instead.
    """
    x, t = F.col(value), F.col("timestamp_ms")
    w = slice_window(KEY, "timestamp_ms")
    # all functions of one select run in a single window pass
    rows = (
        add_slice(series, KEY)
        .select("*", F.lag(t).over(w).alias("_pt"), F.lag(x).over(w).alias("_px"),
                F.row_number().over(w).alias("_n"))
        .withColumn("_v", _rate(x, F.col("_px"), t, F.col("_pt")))
        .withColumn("_pv", last_known("_v", before(w)) if carry_gaps else F.lag("_v").over(w))
    )
    edges = rows.groupBy(*KEY, SLICE).agg(
        F.min(t).alias("t0"), F.min_by(x, F.col("_n")).alias("x0"),
        F.max(t).alias("t1"), F.max_by(x, F.col("_n")).alias("x1"),
        F.max_by("_v", F.when(F.col("_v").isNotNull() | F.lit(not carry_gaps), F.col("_n")))
        .alias("v1"),
        F.max("_n").alias("n"))
    e = earlier_slices(KEY)
    carried = (
        edges.withColumn("ct", last_known("t1", e)).withColumn("cx", last_known("x1", e))
        .withColumn("v0", _rate(F.col("x0"), F.col("cx"), F.col("t0"), F.col("ct")))
        .withColumn("vend", F.coalesce("v1", "v0") if carry_gaps
                    else F.when(F.col("n") > 1, F.col("v1")).otherwise(F.col("v0")))
        .withColumn("cv", last_known("vend", e) if carry_gaps
                    else F.last("vend").over(e))
        .withColumn("first_ts", F.coalesce(F.min("t0").over(e), F.col("t0")))
        .select(*KEY, SLICE, "ct", "cx", "v0", "cv", "first_ts")
    )
    first_in_slice = F.col("_n") == 1
    prev_v = F.when(first_in_slice, F.col("cv")).otherwise(
        F.coalesce("_pv", "v0") if carry_gaps
        else F.when(F.col("_n") == 2, F.col("v0")).otherwise(F.col("_pv")))
    return (
        attach(rows, carried, KEY)
        .withColumn("prev_timestamp_ms", F.when(first_in_slice, F.col("ct")).otherwise(F.col("_pt")))
        .withColumn("prev_value", F.when(first_in_slice, F.col("cx")).otherwise(F.col("_px")))
        .withColumn("delta", x - F.col("prev_value"))
        .withColumn("time_delta_ms", t - F.col("prev_timestamp_ms"))
        .withColumn("velocity", F.when(F.col("time_delta_ms") > 0,
                                       F.col("delta") / F.col("time_delta_ms")))
        .withColumn("acceleration", F.when(
            F.col("time_delta_ms") > 0,
            (F.col("velocity") - prev_v) / F.col("time_delta_ms")))
        .select(*series.columns, "prev_timestamp_ms", "prev_value", "delta", "time_delta_ms",
                "velocity", "acceleration", "first_ts")
    )


def price_derivatives(price: DataFrame) -> DataFrame:
    return derivatives(price, "price").select(
        "candidate_id", "timestamp_ms", "slot", "price", "volume", "swap_count",
        "prev_timestamp_ms", F.col("prev_value").alias("prev_price"),
        F.col("delta").alias("price_delta"), "time_delta_ms",
        F.col("velocity").alias("price_velocity"))


def price_acceleration(price: DataFrame) -> DataFrame:
    return derivatives(price, "price").select(
        "candidate_id", "timestamp_ms", "price", F.col("delta").alias("price_delta"),
        F.col("velocity").alias("price_velocity"), "time_delta_ms",
        F.col("acceleration").alias("price_acceleration"))


def liquidity_derivatives(liquidity: DataFrame) -> DataFrame:
    return derivatives(liquidity, "liquidity").select(
        "candidate_id", "timestamp_ms", "slot", "liquidity", "liquidity_token",
        "liquidity_quote", "prev_timestamp_ms", F.col("prev_value").alias("prev_liquidity"),
        F.col("delta").alias("liquidity_delta"), "time_delta_ms",
        F.col("velocity").alias("liquidity_velocity"))


def event_interval(series: DataFrame, value: str, name: str) -> DataFrame:
    """Time since the previous point of the same series, NULL on the first one."""
    return derivatives(series.select("candidate_id", "timestamp_ms", value), value).select(
        "candidate_id", "timestamp_ms", F.col("time_delta_ms").alias(name))


def last_swap_interval(price: DataFrame) -> DataFrame:
    return event_interval(price, "price", "last_swap_interval_ms")


def last_liq_event_interval(liquidity: DataFrame) -> DataFrame:
    return event_interval(liquidity, "liquidity", "last_liq_event_interval_ms")


def feature_validation(price: DataFrame) -> DataFrame:
    """Velocity times elapsed time must give the delta; the first row has neither."""
    first = F.col("prev_timestamp_ms").isNull()
    return derivatives(price, "price").select(
        "candidate_id", "timestamp_ms", F.col("delta").alias("price_delta"),
        F.col("velocity").alias("price_velocity"),
        F.when(F.col("velocity").isNotNull() & (F.col("time_delta_ms") > 0),
               F.abs(F.col("velocity") * F.col("time_delta_ms") - F.col("delta")) < 0.0001)
        .otherwise(True).alias("velocity_valid"),
        F.when(first, F.col("delta").isNull() & F.col("velocity").isNull())
        .otherwise(True).alias("first_row_valid"))


def derived_features(price: DataFrame, liquidity: DataFrame,
                     liq_interval: str = "any") -> DataFrame:
    """All features of every price point.

    ``liq_interval``: ``any`` measures from any earlier liquidity event, ``exact`` only
    where a liquidity event falls on the very time of the price point.
    """
    if liq_interval not in ("any", "exact"):
        raise ValueError(f"unknown liq_interval: {liq_interval}")
    def side(df: DataFrame, kind: int, value: str) -> DataFrame:
        mine, none = F.col(value), F.lit(None)
        t = F.col("timestamp_ms")
        return df.select(
            *KEY, "timestamp_ms", F.lit(kind).alias("kind"),
            (mine if kind == 0 else none).cast("double").alias("price"),
            (mine if kind == 1 else none).cast("double").alias("liq"),
            (t if kind == 0 else none).cast("long").alias("p_ts"),
            (t if kind == 1 else none).cast("long").alias("q_ts"))

    t, x, liq = F.col("timestamp_ms"), F.col("price"), F.col("liq")
    is_p, is_q = F.col("kind") == 0, F.col("kind") == 1
    w = slice_window(KEY, "timestamp_ms", "kind")
    b = before(w)
    rows = (
        add_slice(side(price, 0, "price").unionByName(side(liquidity, 1, "liquidity")), KEY)
        # all functions of one select run in a single window pass
        .select("*", last_known("p_ts", b).alias("pt"), last_known("price", b).alias("px"),
                last_known("q_ts", b).alias("qt"), last_known("liq", b).alias("qx"),
                F.lead("q_ts").over(w).alias("next_q"), F.lead("liq").over(w).alias("next_liq"))
        .withColumn("v", F.when(is_p, _rate(x, F.col("px"), t, F.col("pt"))))
        .withColumn("pv", last_known("v", b))
        .withColumn("match", F.when(F.col("next_q") == t, F.col("next_liq")))
    )

    def at(agg, value: Column, cond: Column, name: str):
        return agg(value, F.when(cond, t)).alias(name)

    edges = rows.groupBy(*KEY, SLICE).agg(
        F.min("p_ts").alias("t0"), at(F.min_by, x, is_p, "x0"),
        F.max("p_ts").alias("t1"), at(F.max_by, x, is_p, "x1"),
        at(F.max_by, F.col("v"), F.col("v").isNotNull(), "v1"),
        F.max("q_ts").alias("q1"), at(F.max_by, liq, is_q, "l1"))
    e = earlier_slices(KEY)
    carried = (
        edges.withColumn("ct", last_known("t1", e)).withColumn("cx", last_known("x1", e))
        .withColumn("cqt", last_known("q1", e)).withColumn("cqx", last_known("l1", e))
        .withColumn("v0", _rate(F.col("x0"), F.col("cx"), F.col("t0"), F.col("ct")))
        .withColumn("cv", last_known(F.coalesce("v1", "v0"), e))
        .withColumn("first_ts", F.coalesce(F.min("t0").over(e), F.col("t0")))
        .select(*KEY, SLICE, "ct", "cx", "cqt", "cqx", "v0", "cv", "first_ts")
    )
    head = F.col("pt").isNull()  # first price row of its slice
    prev_q = F.coalesce("qt", "cqt")
    interval = t - prev_q
    if liq_interval == "exact":
        interval = F.when(F.col("match").isNotNull(), interval)
    return (
        attach(rows.where(is_p), carried, KEY)
        .withColumn("dt", t - F.coalesce("pt", "ct"))
        .withColumn("price_delta", x - F.coalesce("px", "cx"))
        .withColumn("price_velocity", F.when(F.col("dt") > 0, F.col("price_delta") / F.col("dt")))
        .withColumn("prev_v", F.coalesce("pv", F.when(~head, F.col("v0")), "cv"))
        .withColumn("liquidity_delta", F.col("match") - F.coalesce("qx", "cqx"))
        .select(
            "candidate_id", "timestamp_ms", "price_delta", "price_velocity",
            F.when(F.col("dt") > 0, (F.col("price_velocity") - F.col("prev_v")) / F.col("dt"))
            .alias("price_acceleration"),
            "liquidity_delta",
            F.when(t > prev_q, F.col("liquidity_delta") / (t - prev_q))
            .alias("liquidity_velocity"),
            (t - F.col("first_ts")).alias("token_lifetime_ms"),
            F.col("dt").alias("last_swap_interval_ms"),
            interval.alias("last_liq_event_interval_ms"))
    )
