"""Epoch-millisecond time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def epoch_ms(ts: str) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def slice_no(ts: str, width_ms: int = HOUR_MS) -> Column:
    """Number of the fixed-width slice that holds the time; rounds down below zero too."""
    return F.expr(f"({ts} - pmod({ts}, {width_ms})) div {width_ms}")


def bucket_start(ts: str, width_ms: int) -> Column:
    """Start of the fixed-width bucket that holds the time."""
    return F.expr(f"({ts} div {width_ms}) * {width_ms}")


def utc_day(ts: str) -> Column:
    """UTC calendar day number (days since the epoch)."""
    return F.expr(f"{ts} div {DAY_MS}")
