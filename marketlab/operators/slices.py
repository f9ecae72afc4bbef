"""Ordered computations per key that survive a key holding most of the rows.

A window over one key sorts all of its rows in one task.  Here every key is cut into
fixed time slices instead.  Windows run inside (key, slice); each slice is reduced to one
edge row with map-side combine; an exclusive running window over the edge rows of a key
yields the state carried into each slice, which is joined back on (key, slice).

Size bounds: a series is unique per (key, millisecond), so a slice of one hour holds at
most 3.6 million rows; a key has at most one edge row per hour of its time span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.timecols import HOUR_MS, slice_no

SLICE = "_slice"


def add_slice(df: DataFrame, keys: list[str], ts: str = "timestamp_ms",
              width_ms: int = HOUR_MS) -> DataFrame:
    """Tag rows with their time slice.  Rows without a key belong to no series.

    The explicit NOT NULL filter also keeps the two readers of the tagged rows (the rows
    and their edges) identical to the optimizer, so that they share one shuffle.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.withColumn(SLICE, slice_no(ts, width_ms))


def slice_window(keys: list[str], *order):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def before(window):
    """Rows strictly before the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window):
    """Rows up to and including the current one."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier_slices(keys: list[str]):
    """Exclusive running window over the edge rows of a key."""
    return before(Window.partitionBy(*keys).orderBy(SLICE))


def later_slices(keys: list[str]):
    return before(Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()))


def last_known(col: str | Column, window) -> Column:
    return F.last(col, ignorenulls=True).over(window)


def attach(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Join the state carried into each slice back to its rows."""
    return rows.join(carried, [*keys, SLICE], "left")
