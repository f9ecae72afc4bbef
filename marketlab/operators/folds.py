"""Order-dependent folds (drawdown, losing streak) over huge groups.

A run of outcomes is summarised by a small row, and two neighbouring summaries combine into
one.  Rows are dealt by (group, day), so a group that holds most of the rows is spread over its
days, and the input is read once.  Each task folds its sorted rows with numpy, one batch at a
time; the summaries of a group, one for each of its days, are then combined in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from marketlab.functions import ids
from marketlab.functions.timecols import DAY_MS

# total, highest and lowest prefix sum, deepest fall from a prefix inside the run;
# length, leading / trailing / longest losing run.
PIECE = 10_000  # summaries that a task holds before it hands them on
SUMMARY = ["s", "hi", "lo", "fall", "n", "lead", "trail", "best"]


@dataclass
class Run:
    """Summary of consecutive outcomes."""

    s: float
    hi: float
    lo: float
    fall: float
    n: int
    lead: int
    trail: int
    best: int

    @staticmethod
    def of(x: np.ndarray) -> Run:
        cum = np.cumsum(x)
        wins = np.flatnonzero(x > 0)
        gaps = np.diff(np.concatenate(([-1], wins, [len(x)]))) - 1
        return Run(float(cum[-1]), float(cum.max()), float(cum.min()),
                   float((np.maximum.accumulate(cum) - cum).max()), len(x),
                   int(gaps[0]), int(gaps[-1]), int(gaps.max()))

    def then(self, b: Run) -> Run:
        return Run(
            self.s + b.s, max(self.hi, self.s + b.hi), min(self.lo, self.s + b.lo),
            max(self.fall, b.fall, self.hi - (self.s + b.lo)), self.n + b.n,
            self.n + b.lead if self.lead == self.n else self.lead,
            b.n + self.trail if b.trail == b.n else b.trail,
            max(self.best, b.best, self.trail + b.lead))


def _local_runs(df: DataFrame, keys: list[str], time: str, tie: str, outcome: str) -> DataFrame:
    """One run per (group, day); text ties move packed and are sorted as text."""
    kind = df.schema[tie].dataType
    moved = ids.packed(tie).alias(tie) if isinstance(kind, StringType) else F.col(tie)
    order = ids.unpacked(tie) if isinstance(kind, (StringType, BinaryType)) else F.col(tie)
    ordered = (
        df.where(F.col(outcome).isNotNull())
        .select(*keys, F.expr(f"floor({time} / {DAY_MS})").alias("part"), F.col(time), moved, F.col(outcome).cast("double").alias("x"))
        .repartition(*keys, "part").withColumn(tie, order).sortWithinPartitions(*keys, "part", time, tie)
        .select(*keys, "part", F.xxhash64(*keys, "part").alias("g"), "x")
    )
    kinds = dict(zip(SUMMARY, [DoubleType()] * 4 + [LongType()] * 4))
    schema = StructType(
        [df.schema[k] for k in keys] + [StructField("part", LongType())]
        + [StructField(n, t) for n, t in kinds.items()])
    kinds_pa = [pa.string()] * len(keys) + [pa.int64()] + [pa.float64()] * 4 + [pa.int64()] * 4

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = [[r[i] for r in rows] for i in range(len(schema))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_pa)], names=schema.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, run, rows = None, None, None, []
        for b in batches:
            g, x = b.column("g").to_numpy(), b.column("x").to_numpy()
            if not len(g):
                continue
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(g)]):
                piece = Run.of(x[lo:hi])
                if g[lo] == group:
                    run = run.then(piece)
                    continue
                if run is not None:
                    rows.append((*key, *vars(run).values()))
                group, run = g[lo], piece
                key = tuple(b.column(k)[int(lo)].as_py() for k in (*keys, "part"))
            if len(rows) >= PIECE:
                yield batch_of(rows)
                rows = []
        if run is not None:
            rows.append((*key, *vars(run).values()))
        if rows:
            yield batch_of(rows)

    return ordered.mapInArrow(fold, schema)


def _combine(runs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Fold the runs of each group, taken in order, into one run."""
    w = Window.partitionBy(*group).orderBy(*order)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    whole = c("best") == c("n")  # nothing but losses
    steps = (
        runs.withColumn("base", F.coalesce(F.sum("s").over(prior), F.lit(0.0)))
        .withColumn("losses", F.sum(F.when(whole, c("n")).otherwise(0)).over(so_far))
        # losing run in progress at the end of each run
        .withColumn("reset", F.last(F.when(~whole, c("losses") - c("trail")),
                                    ignorenulls=True).over(so_far))
        .withColumn("open", c("losses") - F.coalesce("reset", F.lit(0)))
        .withColumn("open_before", F.coalesce(F.lag("open").over(w), F.lit(0)))
        .withColumn("no_win_before", F.coalesce(
            F.min(F.when(whole, 1).otherwise(0)).over(prior), F.lit(1)) == 1)
        .withColumn("peak_before", F.max(c("base") + c("hi")).over(prior))
        .withColumn("pos", F.row_number().over(w))
    )
    return steps.groupBy(*group).agg(
        F.sum("s").alias("s"), F.max(c("base") + c("hi")).alias("hi_"),
        F.min(c("base") + c("lo")).alias("lo_"),
        F.max(F.greatest(c("fall"), c("peak_before") - (c("base") + c("lo")))).alias("fall_"),
        F.sum("n").alias("n_"),
        F.max(F.when(c("no_win_before"), c("open_before") + c("lead"))).alias("lead_"),
        F.max_by("open", "pos").alias("trail_"),
        F.max(F.greatest(c("best"), c("open_before") + c("lead"))).alias("best_"),
    ).select(*group, "s", *[c(f"{x}_").alias(x) for x in SUMMARY[1:]])


def drawdown_and_streak(df: DataFrame, keys: list[str], time: str = "entry_signal_time",
                        tie: str = "trade_id", outcome: str = "outcome") -> DataFrame:
    """Max drawdown of the running sum (peak floored at 0) and longest run of losses,
    in (time, tie) order; ``tie`` makes the order total.  Keys are text columns."""
    runs = _combine(_local_runs(df, keys, time, tie, outcome), keys, ["part"])
    return runs.select(
        *keys, F.greatest(F.lit(0.0), F.col("fall"), -F.col("lo")).alias("max_drawdown"),
        F.col("best").alias("max_consecutive_losses"))
