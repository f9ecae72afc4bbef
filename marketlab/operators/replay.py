"""Ordered replay of the merged event stream through a user function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlab.functions.timecols import HOUR_MS, slice_no
from marketlab.schemas import EVENT_ORDER

Events = dict[str, np.ndarray]  # consecutive events as one array per column
ReplayFn = Callable[[str, Iterator[Events]], Iterator[tuple]]
ROWS_PER_BATCH = 10_000


def replay_apply(merged: DataFrame, fn: ReplayFn, schema: StructType | str,
                 columns: list[str] | None = None, slice_ms: int | None = None,
                 start: int | None = None, end: int | None = None) -> DataFrame:
    """Feed ordered events to ``fn``; the tuples it yields are the result rows.

    ``fn(candidate_id, batches)`` is a generator: it receives the events of one candidate in
    event order, as consecutive batches of column arrays with the given ``columns``.  A partition
    streams through one batch at a time, so no group is held in memory.

    A candidate is one sequence in one task.  ``slice_ms`` cuts it into time slices that are
    called each on their own: only for functions whose rows do not depend on earlier events.
    State that must cross slices of a hot candidate is for ``replay_fold``.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names
    t = F.col("timestamp")
    if start is not None:
        merged = merged.where(t >= start)
    if end is not None:
        merged = merged.where(t < end)
    part = F.lit(0).cast("long") if slice_ms is None else slice_no("timestamp", slice_ms)
    ordered = (
        merged.withColumn("_slice", part).repartition("candidate_id", "_slice")
        .sortWithinPartitions("candidate_id", "_slice", *EVENT_ORDER, "tie")
    )
    if columns is not None:
        ordered = ordered.select("candidate_id", "_slice", *columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        groups = _Groups(batches)
        for candidate in groups:
            for row in fn(candidate, groups.batches()):
                rows.append(row)
                if len(rows) == ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return ordered.mapInPandas(run, schema)


FAN, LEVELS = 256, 3  # states that meet in one task, and how often: 256 hours, 256 of those, and the rest


def replay_fold(merged: DataFrame, zero: tuple, step: Callable[[tuple, Events], tuple],
                merge: Callable[[tuple, tuple], tuple], schema: StructType | str,
                columns: list[str], slice_ms: int = HOUR_MS) -> DataFrame:
    """Fold the ordered events of every candidate, a hot one in many tasks.

    ``step(state, batch)`` takes a slice through its batches from ``zero``, and ``merge(earlier,
    later)`` joins the states of neighbouring slices; it has to be associative.  The result has
    one row per candidate: its id and the state, whose fields ``schema`` names.
    """
    state = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def fold(candidate: str, batches: Iterator[Events]) -> Iterator[tuple]:
        now, at = zero, None
        for b in batches:
            at = int(b["timestamp"][0]) // slice_ms if at is None else at
            now = step(now, b)
        yield (candidate, at, *now)

    rows_of = StructType([*StructType.fromDDL("candidate_id string, _at long").fields, *state.fields])
    parts = replay_apply(merged, fold, rows_of, list(dict.fromkeys(["timestamp", *columns])), slice_ms)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Merges runs of rows with the same candidate and block, in the order of a sorted partition."""
        key, at, now, done = None, None, None, []
        for b in batches:
            ids, blocks, first = b["candidate_id"].tolist(), b["_block"].tolist(), b["_at"].tolist()
            for one, block, t, part in zip(ids, blocks, first, b[state.names].itertuples(index=False, name=None)):
                if (one, block) == key:
                    now = merge(now, part)
                    continue
                if key is not None:
                    done.append((key[0], at, *now))
                key, at, now = (one, block), t, part
            if len(done) >= ROWS_PER_BATCH:
                yield pd.DataFrame(done, columns=rows_of.names)
                done = []
        if key is not None:
            done.append((key[0], at, *now))
        if done:
            yield pd.DataFrame(done, columns=rows_of.names)

    # neighbouring slices first, FAN at a time, then neighbours of those: no run is longer than that,
    # and a candidate with few slices costs no more than its rows
    for level in range(1, LEVELS + 1):
        block = F.expr(f"floor(_at / {FAN ** level})") if level < LEVELS else F.lit(0).cast("long")
        parts = parts.withColumn("_block", block).repartition("candidate_id", "_block").sortWithinPartitions(
            "candidate_id", "_block", "_at").mapInPandas(join, rows_of)
    return parts.drop("_at")


class _Groups:
    """Cuts sorted batches at the change of group without holding more than one batch."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        self._parts = self._split(batches)
        self._next = next(self._parts, None)

    @staticmethod
    def _split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Events]]:
        for b in batches:
            if b.empty:
                continue
            cols = {c: b[c].to_numpy() for c in b.columns}
            slices = cols.pop("_slice")
            keys = cols["candidate_id"]
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
                yield (keys[lo], slices[lo]), {c: v[lo:hi] for c, v in cols.items()}

    def __iter__(self) -> Iterator[str]:
        while self._next is not None:
            self._current = self._next[0]
            yield self._current[0]
            for _ in self.batches():  # what a function that stopped early left over
                pass

    def batches(self) -> Iterator[Events]:
        while self._next is not None and self._next[0] == self._current:
            part = self._next[1]
            self._next = next(self._parts, None)
            yield part


COUNTS = ("candidate_id string, events long, swaps long, liquidity_events long, "
          "first_ts long, last_ts long")


def count_events(candidate: str, batches: Iterator[Events]) -> Iterator[tuple]:
    """Replay function that counts the events it sees."""
    n = swaps = 0
    first, last = None, None
    for b in batches:
        kind, ts = b["kind"], b["timestamp"]  # sorted by event order, not by time
        n += len(ts)
        swaps += int((kind == "swap").sum())
        lo, hi = int(ts.min()), int(ts.max())
        first = lo if first is None else min(first, lo)
        last = hi if last is None else max(last, hi)
    yield candidate, n, swaps, n - swaps, first, last


def replay_statistics(merged: DataFrame) -> DataFrame:
    """Events by kind and time range per candidate, counted by the replay itself."""
    parts = replay_apply(merged, count_events, COUNTS, ["kind", "timestamp"], HOUR_MS)
    return parts.groupBy("candidate_id").agg(
        *[F.sum(c).alias(c) for c in ("events", "swaps", "liquidity_events")],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


SIGNALS = "candidate_id string, reason string, timestamp long"


def signals_when(test: Callable[[Events], np.ndarray], reason: str) -> ReplayFn:
    """Replay function that reports every event for which a vectorised test holds."""
    def run(candidate: str, batches: Iterator[Events]) -> Iterator[tuple]:
        for b in batches:
            for ts in b["timestamp"][test(b)]:
                yield candidate, reason, int(ts)
    return run
