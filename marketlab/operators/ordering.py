"""Event order: checks, the merged event stream, runs of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.timecols import utc_day
from marketlab.schemas import EVENT_ORDER
from marketlab.session import materialize

# Fixed tie order of the merged stream.
LIQUIDITY_FIRST = {"liquidity": 0, "swap": 1}


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the row's place, from 0, in the order of all rows; nothing is sorted in one task.

    Rows are range partitioned and sorted inside their part, then each part starts where the counts of
    the parts before it end.  The parts are staged once, since a second partitioning could cut
    elsewhere.  Rows that are equal in all of ``order`` are numbered as they come.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    parts = materialize(parts, "positions")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each part
    starts = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return parts.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))


def canonical_sort(events: DataFrame, *ties: str) -> DataFrame:
    """Global event order with the position of every event, for sinks."""
    return with_position(events, [*EVENT_ORDER, *ties])


def merged_events(swaps: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Both event kinds in one relation with a tag and nested payloads.

    ``tie`` orders liquidity before swaps at the same event position.
    """
    s_cols = [c for c in swaps.columns if c not in ("candidate_id", *EVENT_ORDER, "timestamp")]
    l_cols = [c for c in liquidity.columns if c not in ("candidate_id", *EVENT_ORDER, "timestamp")]
    base = ["candidate_id", *EVENT_ORDER, "timestamp"]
    s = swaps.select(*base, F.lit("swap").alias("kind"), F.struct(*s_cols).alias("swap"))
    q = liquidity.select(*base, F.lit("liquidity").alias("kind"),
                         F.struct(*l_cols).alias("liquidity"))
    return s.unionByName(q, allowMissingColumns=True).withColumn(
        "tie", F.when(F.col("kind") == "liquidity", LIQUIDITY_FIRST["liquidity"])
        .otherwise(LIQUIDITY_FIRST["swap"]))


def order_violations(events: DataFrame, position: str, keys: list[str]) -> DataFrame:
    """Neighbours (by ``position`` within ``keys``) whose event order does not increase.

    Cut into slices of a million positions; the edge of each slice is compared with the
    last row of the slice before it.
    """
    ev = F.struct(*EVENT_ORDER)
    sliced = events.select(*keys, position, ev.alias("ev"),
                           F.expr(f"{position} div 1000000").alias("_part"))
    w = Window.partitionBy(*keys, "_part").orderBy(position)
    rows = sliced.withColumn("prev", F.lag("ev").over(w))
    edges = rows.groupBy(*keys, "_part").agg(F.max_by("ev", position).alias("last"))
    carried = edges.select(*keys, "_part", F.lag("last").over(
        Window.partitionBy(*keys).orderBy("_part")).alias("carried"))
    return (
        rows.join(carried, [*keys, "_part"], "left")
        .withColumn("prev", F.coalesce("prev", "carried"))
        .where(F.col("prev").isNotNull() & ~(F.col("prev") < F.col("ev")))
        .select(*keys, position, "prev", "ev")
    )


def duplicate_positions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Event positions that occur more than once within the keys."""
    return events.groupBy(*keys, *EVENT_ORDER).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def day_runs(times: DataFrame, ts: str) -> DataFrame:
    """Runs of consecutive UTC days that hold at least one row.

    Reduced to distinct days first: the window sees one row per calendar day.
    """
    days = times.select(utc_day(ts).alias("day")).distinct()
    island = F.col("day") - F.row_number().over(Window.orderBy("day"))
    return days.withColumn("island", island).groupBy("island").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("days")).drop("island")


def event_statistics(merged: DataFrame) -> DataFrame:
    """Per candidate: events by kind, first and last time."""
    return merged.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "swap").alias("swaps"),
        F.count_if(F.col("kind") == "liquidity").alias("liquidity_events"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
