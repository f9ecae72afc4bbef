"""As-of lookups of many probes against a series, and exact-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.operators.slices import (
    SLICE, add_slice, attach, earlier_slices, last_known, later_slices, slice_window, upto)

TS = "_at"


def asof(probes: DataFrame, series: DataFrame, values: list[str], at: str,
         key: str = "candidate_id", ts: str = "timestamp_ms", strict: bool = False,
         forward: bool = False) -> DataFrame:
    """Look up the series at every probe time; all probe columns are kept.

    Adds ``prev_<v>``, ``prev_ts``: last point at or before the probe (before it if
    ``strict``), and ``first_<v>``, ``first_ts``: first point of the key.  With
    ``forward`` also ``next_<v>``, ``next_ts``: first point at or after the probe.

    Probes and points are merged, sorted once per (key, slice) and filled from the last
    point seen; state crosses slices through the edge rows.  No pairs are formed.
    """
    keys = [key]
    probe_kind = 0 if strict else 1
    cols = ["ts", *values]
    points = series.select(
        key, F.col(ts).alias(TS), F.lit(1 - probe_kind).alias("_kind"),
        F.struct(F.col(ts).alias("ts"), *values).alias("_point"))
    asked = probes.select(
        key, F.col(at).alias(TS), F.lit(probe_kind).alias("_kind"),
        F.struct(*[c for c in probes.columns]).alias("_probe"))
    merged = add_slice(points.unionByName(asked, allowMissingColumns=True), keys, TS)

    w = slice_window(keys, TS, "_kind")
    rows = merged.withColumn("_prev", last_known("_point", upto(w)))
    if forward:
        # at equal times the point must come first when walking backwards
        back = slice_window(keys, F.col(TS).desc(),
                            F.col("_kind").asc() if not strict else F.col("_kind").desc())
        rows = rows.withColumn("_next", last_known("_point", upto(back)))
    # Edge rows come from the windowed rows and touch every column, so that both branches
    # read one and the same shuffle.
    edges = rows.groupBy(key, SLICE).agg(
        F.max("_prev").alias("_hi"), F.min("_point").alias("_lo"),
        F.count("_probe").alias("_asked")).where("_asked > 0 or _hi is not null")
    e, later = earlier_slices(keys), later_slices(keys)
    carried = edges.select(
        key, SLICE,
        last_known("_hi", e).alias("_chi"),
        F.coalesce(F.first("_lo", ignorenulls=True).over(e), "_lo").alias("_clo"),
        last_known("_lo", later).alias("_cnext"))
    found = attach(rows.where(F.col("_probe").isNotNull()), carried, keys)
    prev = F.coalesce("_prev", "_chi")
    # a probe earlier than every point sees the first point in its own or a later slice
    first = F.coalesce("_clo", "_cnext")
    out = found.select(
        "_probe.*", prev.alias("_p"), first.alias("_f"),
        *([F.coalesce("_next", "_cnext").alias("_n")] if forward else []))
    return out.select(
        *probes.columns,
        *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in cols],
        *[F.col(f"_f.{c}").alias(f"first_{c}") for c in cols],
        *([F.col(f"_n.{c}").alias(f"next_{c}") for c in cols] if forward else []))


def price_at(probes: DataFrame, price: DataFrame, at: str) -> DataFrame:
    """Price at or before the probe time, else the first price; NULL without any price."""
    return (
        asof(probes, price, ["price"], at)
        .withColumn("price_at", F.coalesce("prev_price", "first_price"))
        .select(*probes.columns, "price_at")
    )


def liquidity_at(probes: DataFrame, liquidity: DataFrame, at: str) -> DataFrame:
    """Liquidity at or before the probe time, else NULL; ``has_liquidity`` tells the two
    kinds of NULL apart (no earlier point, or no points at all)."""
    return (
        asof(probes, liquidity, ["liquidity"], at)
        .select(*probes.columns, F.col("prev_liquidity").alias("liquidity_at"),
                F.col("first_ts").isNotNull().alias("has_liquidity"))
    )


def previous_event_time(probes: DataFrame, events: DataFrame, at: str) -> DataFrame:
    """Time of the last event strictly before the probe."""
    return asof(probes, events, [], at, strict=True).select(
        *probes.columns, F.col("prev_ts").alias("previous_ts"))


def exact_time(price: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Left join on the exact (candidate, time)."""
    return price.join(
        liquidity.select("candidate_id", "timestamp_ms", "liquidity", "liquidity_token",
                         "liquidity_quote"),
        ["candidate_id", "timestamp_ms"], "left")
