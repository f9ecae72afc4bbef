"""Sums over append-only tables that are kept up to date write by write.

Every write of a table has an id and never changes.  What is derived from it (sums that can be merged
later) is stored under the same id, after the write is visible.  So a part can be computed again at any
time, one that is missing after a crash is made up for at the next call, and none can count twice:
only parts of writes that are visible now take part.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketlab.operators.series import INTERVALS, volume_timeseries, widened
from marketlab.functions.timecols import DAY_MS, HOUR_MS
from marketlab.schemas import EVENT_ORDER, TABLES
from marketlab.session import delete_path, list_names, move_path
from marketlab.sources.tables import TableStore, half_open


class DerivedParts:
    """Parts below ``root``, one for each write of ``table``: ``derive`` of its rows."""

    def __init__(self, spark: SparkSession, root: str, table: str, schema: StructType,
                 derive: Callable[[DataFrame], DataFrame], store: TableStore | None = None):
        self.spark, self.root, self.table, self.schema, self.derive = spark, root, table, schema, derive
        self.store = store

    def _covers(self) -> dict[str, frozenset[str]]:
        """The parts that each sum stands for."""
        names = [n for n in list_names(self.spark, self.root) if n.startswith("sum-")]
        if not names:
            return {}
        listed = StructType([StructField("part", StringType()), StructField("sum", StringType())])
        rows = reduce(DataFrame.unionByName, [
            self.spark.read.schema("part string").parquet(os.path.join(self.root, n, "covers")).withColumn("sum", F.lit(n))
            for n in names]).select(*listed.names).collect()  # names of folders
        return {n: frozenset(r["part"] for r in rows if r["sum"] == n) for n in names}

    def _visible(self) -> tuple[list[str], list[str]]:
        """Folders whose rows make up the table, and ids of writes that have no part yet."""
        writes = self.store.parts(self.table)
        have = {n.removeprefix("part-") for n in list_names(self.spark, self.root) if n.startswith("part-")}
        folders, open_ = [], set(writes)
        for name, parts in sorted(self._covers().items(), key=lambda x: (-len(x[1]), x[0])):
            if parts <= open_:  # all its writes are there and none has been counted
                folders.append(os.path.join(self.root, name, "rows"))
                open_ -= parts
        folders += [os.path.join(self.root, f"part-{p}") for p in sorted(open_ & have)]
        return folders, sorted(open_ - have)

    def _put(self, rows: DataFrame, name: str) -> None:
        staged = os.path.join(self.root, f"_{uuid.uuid4().hex}")
        rows.write.parquet(staged)
        move_path(self.spark, staged, os.path.join(self.root, name))

    def catch_up(self) -> int:
        """Derive the parts of all writes that have none; returns their number."""
        _, missing = self._visible()
        paths = self.store.parts(self.table) if missing else {}
        for part in missing:
            rows = self.spark.read.schema(TABLES[self.table]).parquet(paths[part])
            self._put(self.derive(rows).select(*self.schema.names), f"part-{part}")
        return len(missing)

    def rows(self, condition=None) -> DataFrame:
        """All parts side by side, those of a condition if one is given."""
        self.catch_up()
        folders, _ = self._visible()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        out = self.spark.read.schema(self.schema).parquet(*folders)
        return out if condition is None else out.where(condition)

    def combine(self, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Put one sum in the place of all parts.

        The sum and the list of what it covers appear with one rename; from then on it is read
        instead of its parts, which are deleted afterwards.
        """
        rows = self.rows()
        old = self._covers()
        singles = [n for n in list_names(self.spark, self.root) if n.startswith("part-")]
        covered = sorted(self.store.parts(self.table))
        staged = os.path.join(self.root, f"_{uuid.uuid4().hex}")
        merge(rows).select(*self.schema.names).write.parquet(os.path.join(staged, "rows"))
        self.spark.createDataFrame([(p,) for p in covered], "part string").coalesce(1).write.parquet(os.path.join(staged, "covers"))
        move_path(self.spark, staged, os.path.join(self.root, f"sum-{uuid.uuid4().hex}"))
        for n in [*singles, *old]:
            delete_path(self.spark, os.path.join(self.root, n))


class VolumeParts(DerivedParts):
    """Volume buckets as sums of parts, one small part per write of ``swaps``.

    A part holds what its swaps add to the narrowest buckets, so a late swap simply adds to its
    bucket again; no bucket is ever closed and none waits for a watermark.
    """

    def __init__(self, spark: SparkSession, root: str, run: str = "run", store: TableStore | None = None):
        super().__init__(spark, root, "swaps", TABLES["volume_timeseries"],
                         lambda swaps: volume_timeseries(swaps, INTERVALS[:1]), store)
        self.run = run

    def read(self, intervals=INTERVALS) -> DataFrame:
        """Buckets of every width over all parts."""
        return widened(self.rows(), intervals).select(*self.schema.names)

    def compact(self) -> None:
        self.combine(lambda rows: widened(rows, INTERVALS[:1]))


class HourParts(DerivedParts):
    """Moved amounts by mint and hour, what spikes are measured against: 23 sums instead of a day's events."""

    SCHEMA = "mint string, hour long, amount double, n long, timestamp long"

    def __init__(self, spark: SparkSession, root: str, table: str = "swap_events", store: TableStore | None = None):
        self.amount = "amount_out" if table == "swap_events" else "amount_quote"
        self.moved = F.col(self.amount) if table == "swap_events" else F.abs(self.amount)
        schema = spark.createDataFrame([], self.SCHEMA).schema
        super().__init__(spark, root, table, schema, self._by_hour, store)

    def _by_hour(self, events: DataFrame) -> DataFrame:
        return self._merged(events.select(
            "mint", F.expr(f"floor(timestamp / {HOUR_MS})").alias("hour"), self.moved.alias("amount"),
            F.lit(1).cast("long").alias("n"), "timestamp").where("timestamp is not null"))

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("mint", "hour").agg(
            F.sum("amount").alias("amount"), F.sum("n").alias("n"), F.min("timestamp").alias("timestamp"))

    def compact(self) -> None:
        self.combine(self._merged)

    def window(self, at: int) -> DataFrame:
        """The day before ``at``, for ``active_tokens``: sums of whole hours, and the events of the others.

        The last hour has all of its events, since one of them is the trigger; the first hour of the
        day is cut by its events.
        """
        start, last = at - DAY_MS, at - HOUR_MS
        first_whole, end_whole = -(-start // HOUR_MS), last // HOUR_MS
        whole = self.rows((F.col("hour") >= first_whole) & (F.col("hour") < end_whole))
        edges = [half_open(self.store.read(self.table, lo, hi), "timestamp", lo, hi)
                 for lo, hi in ((start, min(first_whole * HOUR_MS, at)), (max(end_whole * HOUR_MS, start), at)) if lo < hi]
        raw = reduce(DataFrame.unionByName, edges).withColumn("n", F.lit(1).cast("long"))
        sums = whole.select("mint", F.col("amount").alias(self.amount), "n", "timestamp")
        return raw.select("mint", "pool", *EVENT_ORDER, "timestamp", self.amount, "n").unionByName(sums, allowMissingColumns=True)
