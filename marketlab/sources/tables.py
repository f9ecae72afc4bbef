"""Stored tables: scans, append-only writes and report sinks."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from marketlab.functions import ids
from marketlab.operators.joins import latest
from marketlab.functions.timecols import DAY_MS
from marketlab.schemas import (
    ALLOWED_VALUES, EVENT_ORDER, PRUNE_BY, REPLACED_BY, TABLES, TIME_OF, UNIQUE_KEYS, check_enums,
    conform)
from marketlab.session import (
    delete_path, discard_intermediates, glob_paths, intermediates_mark, list_names, make_folder,
    materialize, move_path)


class DuplicateKey(Exception):
    """A row repeats a key of its table or of its own batch."""


class InvalidRows(Exception):
    """A row breaks an enumeration constraint."""


# --- scans: filters that reach the parquet reader -----------------------------------------

def by_key(df: DataFrame, value: str, key: str = "candidate_id",
           order=("timestamp_ms",)) -> DataFrame:
    return df.where(F.col(key) == value).orderBy(*order)


def between(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    """Closed range [start, end]."""
    return df.where(F.col(ts).between(start, end))


def half_open(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    """Half-open range [start, end)."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def with_values(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the given values."""
    for name, value in wanted.items():
        df = df.where(F.col(name) == value)
    return df


def trades_of_family(trades: DataFrame, family: str, scenario: str) -> DataFrame:
    return trades.where((ids.canonical_type() == family) & (F.col("scenario_id") == scenario))


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """The newest snapshot of every mint."""
    return latest(metadata, ["mint"], ["fetched_at", "candidate_id"])


def newest_version(df: DataFrame, keys: list[str], version: str = "created_at") -> DataFrame:
    return latest(df, keys, [version])


def active_mints(events: DataFrame, start: int, end: int) -> DataFrame:
    """Distinct mints with events in [start, end), sorted."""
    return half_open(events, "timestamp", start, end).select("mint").distinct().orderBy("mint")


def time_range(series: DataFrame, ts: str = "timestamp_ms") -> DataFrame:
    """First and last time of a table; (0, 0) when empty."""
    return series.agg(F.coalesce(F.min(ts), F.lit(0)).alias("min_ts"),
                      F.coalesce(F.max(ts), F.lit(0)).alias("max_ts"))


def all_trades(trades: DataFrame) -> DataFrame:
    return trades.orderBy("entry_signal_time", "trade_id")


def all_aggregates(aggregates: DataFrame) -> DataFrame:
    return aggregates.orderBy("strategy_id", "scenario_id", "entry_event_type")


# --- append-only writes -------------------------------------------------------------------

def _key_columns(keys: list[str]) -> list[Column]:
    return [F.expr(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once in a batch."""
    return df.select(*_key_columns(keys)).groupBy(*_names(keys)).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")


def any_repeated(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key occurs more than once: eight-byte hashes first, the keys themselves only if one of those does."""
    hashes = df.select(F.xxhash64(*[F.expr(k) for k in keys]).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    return not hashes.where("n > 1").isEmpty() and not repeated_keys(df, keys).isEmpty()


def existing_rows(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key is already stored."""
    have = stored.select(*_key_columns(keys))
    return df.select("*", *_key_columns(keys)).join(have, _names(keys), "left_semi").drop(
        *_names(keys))


def _hashed_keys(keys: list[str]) -> list[Column]:
    """The key columns behind their hash, by which rows sort fast: keys often share their first bytes."""
    return [F.xxhash64(*[F.expr(k) for k in keys]).alias("_h"), *_key_columns(keys)]


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest row in column order, so reruns pick the same one."""
    return new_rows(df, None, keys)


def new_rows(df: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Batch rows to add: one per key, keys not stored yet.

    The rows move and sort once: the stored keys meet them where they were grouped.
    """
    cols = df.columns
    fresh = df.groupBy(*_hashed_keys(keys)).agg(F.min(F.struct(*cols)).alias("r"))
    if stored is not None:
        fresh = fresh.join(stored.select(*_hashed_keys(keys)), ["_h", *_names(keys)], "left_anti")
    return fresh.select("r.*").select(*cols)


def _has_enums(table: str) -> bool:
    return any(t == table for t, _ in ALLOWED_VALUES)


class _Staged:
    """Rows that were written and are not shown yet; dropped if the block around them fails."""

    def __init__(self, store: TableStore, table: str, path: str, n: int, lo: int, hi: int):
        self.store, self.table, self.path, self.n, self.lo, self.hi = store, table, path, n, lo, hi

    def __enter__(self) -> _Staged:
        return self

    def __exit__(self, *_) -> None:
        if self.path is not None:
            delete_path(self.store.spark, self.path)

    def read(self) -> DataFrame:
        schema = StructType([*TABLES[self.table].fields]).add("_version", "long")
        return self.store.spark.read.schema(schema).parquet(self.path)

    def show(self) -> int:
        """One rename; returns the number of rows, none leave no folder."""
        if self.n:
            known = self.store._generations(self.table)
            root = known[-1][2] if known else os.path.join(self.store.path(self.table), "g000000_v0")
            move_path(self.store.spark, self.path, os.path.join(root, f"lo={self.lo}", f"hi={self.hi}", f"part={uuid.uuid4().hex}"))
            self.path = None
        return self.n


class TableStore:
    """Append-only parquet tables below one shared folder; one writer per table.

    Layout: ``<table>/g<generation>_v<version>/lo=<day>/hi=<day>/part=<id>/*.parquet``.  Every write is
    staged and becomes visible by one rename, whole or not at all.  ``lo`` and ``hi`` are the first and
    last day of its rows, so a range of time prunes the folders of other days before any file is
    opened, and a hot key lies in as many folders as it has days.  A generation replaces all earlier
    ones: ``compact`` writes the visible rows by day into the next one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def _generations(self, table: str) -> list[tuple[int, int, str]]:
        """(generation, version it starts from, path), oldest first."""
        found = []
        for name in list_names(self.spark, self.path(table)):
            numbers = re.fullmatch(r"g(\d+)_v(\d+)", name)
            if numbers:
                found.append((int(numbers[1]), int(numbers[2]), os.path.join(self.path(table), name)))
        return sorted(found)

    def exists(self, table: str) -> bool:
        return bool(self._generations(table))

    def parts(self, table: str) -> dict[str, str]:
        """Paths of the visible writes by their id."""
        known = self._generations(table)
        paths = glob_paths(self.spark, os.path.join(known[-1][2], "lo=*/hi=*/part=*")) if known else []
        return {p.rsplit("part=", 1)[1]: p for p in paths}

    def _stored(self, table: str) -> DataFrame | None:
        """Rows of the newest generation with their version and the days of their write."""
        known = self._generations(table)
        if not known:
            return None
        schema = StructType([*TABLES[table].fields]).add("_version", "long")
        return self.spark.read.schema(schema.add("lo", IntegerType()).add("hi", IntegerType()).add("part", "string")).parquet(known[-1][2])

    def read(self, table: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """The visible rows, of replaced groups only those of their newest version.

        With a range of time only [start, end), and only the folders of its days.
        """
        schema, rows = TABLES[table], self._stored(table)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if start is not None:
            rows = rows.where((F.col("hi") >= start // DAY_MS) & (F.col("lo") <= (end - 1) // DAY_MS))
            rows = half_open(rows, TIME_OF[table], start, end)
        if table not in REPLACED_BY:
            return rows.select(*schema.names)
        keys, base = REPLACED_BY[table], self._generations(table)[-1][1]
        marks = self._marks(table)
        rows = rows.withColumn("_version", F.coalesce("_version", F.lit(base)))
        if marks is None:
            return rows.where(F.col("_version") <= base).select(*schema.names)
        # a write whose marks are missing broke off: it is not visible, whatever came later
        done = [r[0] for r in marks.select("_version").distinct().collect()]  # one number for each replacement
        newest = marks.groupBy(*keys).agg(F.max("_version").alias("_newest"))
        rows = rows.where((F.col("_version") <= base) | F.col("_version").isin(done))
        return rows.join(newest, keys, "left").where(
            F.col("_newest").isNull() | (F.col("_version") >= F.col("_newest"))).select(*schema.names)

    def last_time(self, table: str) -> int | None:
        """The largest time in a table, read from the writes that end on its last day."""
        days = [int(m[1]) for p in self.parts(table).values() if (m := re.search(r"/hi=(-?\d+)/", p))]
        if not days:
            return None
        return self._stored(table).where(F.col("hi") == max(days)).agg(F.max(TIME_OF[table])).first()[0]

    def _marks_path(self, table: str) -> str:
        known = self._generations(table)
        return os.path.join(self.path(f"{table}.replaced"), f"g{known[-1][0] if known else 0:06d}")

    def _marks(self, table: str) -> DataFrame | None:
        """Groups that were replaced in this generation, with the version that replaced them."""
        parts = glob_paths(self.spark, os.path.join(self._marks_path(table), "part=*")) if table in REPLACED_BY else []
        if not parts:
            return None
        schema = StructType([TABLES[table][k] for k in REPLACED_BY[table]]).add("_version", "long")
        return self.spark.read.schema(schema).parquet(*parts)

    def replace(self, df: DataFrame, table: str, groups: DataFrame | None = None) -> int:
        """Put new rows in the place of all stored rows of their groups; returns the version.

        ``groups`` names groups that are emptied although they have no new row.  The rows are
        written first and become visible with the marks of their groups, so a run that breaks off
        in between leaves the old rows.
        """
        keys, version = REPLACED_BY[table], 1 + self._last_version(table)
        number = F.lit(version).cast("long")
        with self._staged(conform(df, TABLES[table]).withColumn("_version", number), table) as staged:
            rows = staged.read()
            self._check(rows, table)
            touched = rows.select(*keys)
            if groups is not None:
                touched = touched.unionByName(groups.select(*keys))
            marks = os.path.join(self.path(f"{table}.replaced"), f"_{uuid.uuid4().hex}")
            touched.distinct().withColumn("_version", number).write.parquet(marks)
            if not self.exists(table):
                make_folder(self.spark, os.path.join(self.path(table), "g000000_v0"))
            staged.show()
            move_path(self.spark, marks, os.path.join(self._marks_path(table), f"part={uuid.uuid4().hex}"))
            return version

    def _check(self, rows: DataFrame, table: str) -> None:
        """Rows of one write: allowed values only, and no key twice."""
        if _has_enums(table) and not check_enums(rows, table).isEmpty():
            raise InvalidRows(table)
        if any_repeated(rows, UNIQUE_KEYS[table]):
            raise DuplicateKey(f"{table}: key repeated within the batch")

    def _last_version(self, table: str) -> int:
        """The largest version in use, also by a write that broke off."""
        rows, known = self._stored(table), self._generations(table)
        return max(known[-1][1] if known else 0, (rows.agg(F.max("_version")).first()[0] or 0) if rows is not None else 0)

    def compact(self, table: str, keep: int = 1) -> int:
        """Write the visible rows by day as a new generation, which takes the place of all others.

        Superseded versions and the many small files of streams go with the old generations, of which
        the last ``keep`` stay for readers that are under way.  A run that breaks off before the rename
        changes nothing, one that breaks off after it has only old folders left to delete.
        """
        known = self._generations(table)
        if not known:
            return 0
        version, time = self._last_version(table), TIME_OF.get(table)
        rows = self.read(table)
        day = F.coalesce(F.expr(f"cast(floor({time} / {DAY_MS}) as int)"), F.lit(0)) if time else F.lit(0)
        rows = rows.withColumn("lo", day).withColumn("hi", F.col("lo")).withColumn("part", F.lit(uuid.uuid4().hex))
        if table in REPLACED_BY:
            rows = rows.withColumn("_version", F.lit(version).cast("long"))
        staged = os.path.join(self.path(table), f"_{uuid.uuid4().hex}")
        order = [c for c in (*REPLACED_BY.get(table, ()), time, *EVENT_ORDER) if c and c in rows.columns]
        rows.hint("rebalance", "lo").sortWithinPartitions("lo", *dict.fromkeys(order)).write.partitionBy("lo", "hi", "part").parquet(staged)
        number = known[-1][0] + 1
        move_path(self.spark, staged, os.path.join(self.path(table), f"g{number:06d}_v{version}"))
        for n, _, path in known[:len(known) - keep]:
            delete_path(self.spark, path)
            delete_path(self.spark, os.path.join(self.path(f"{table}.replaced"), f"g{n:06d}"))
        return number

    def _staged(self, rows: DataFrame, table: str) -> _Staged:
        """Write rows where no reader looks."""
        seen, time = Observation(), TIME_OF.get(table)
        found = [F.count(F.lit(1)).alias("n")]
        if time:
            found += [F.min(time).alias("lo"), F.max(time).alias("hi")]
        path = os.path.join(self.path(table), f"_{uuid.uuid4().hex}")
        rows.observe(seen, *found).write.parquet(path)
        got = seen.get
        lo, hi = ((got[k] or 0) // DAY_MS for k in ("lo", "hi")) if time else (0, 0)
        return _Staged(self, table, path, got["n"], lo, hi)

    def _commit(self, rows: DataFrame, table: str) -> int:
        """Write rows and show them with one rename; returns their number, none leave no folder."""
        with self._staged(rows, table) as staged:
            return staged.show()

    def append_unique(self, df: DataFrame, table: str, on_conflict: str = "error",
                      staged: bool = False) -> dict[str, int]:
        """Append a batch; returns ``stored`` and ``duplicates``.

        ``staged`` says that the batch is a stored table already and need not be computed once more.

        ``error``: nothing is written if any key repeats in the batch or in the table.
        ``skip``: repeated keys are left out silently, so a batch can be replayed safely.
        """
        mark = intermediates_mark()
        try:
            return self._append(df, table, on_conflict, staged)
        finally:
            discard_intermediates(self.spark, mark)

    def _append(self, df: DataFrame, table: str, on_conflict: str, staged: bool) -> dict[str, int]:
        keys = UNIQUE_KEYS[table]
        batch, exists = conform(df, TABLES[table]), self.exists(table)
        if on_conflict == "error":
            with self._staged(self._versioned(batch, table), table) as written:  # checked where it was written
                rows = written.read()
                self._check(rows, table)
                if exists and not existing_rows(rows, self._overlap(rows, table), keys).isEmpty():
                    raise DuplicateKey(f"{table}: key already stored")
                return {"stored": written.show(), "duplicates": 0}
        if on_conflict != "skip":
            raise ValueError(f"unknown on_conflict: {on_conflict}")
        if not staged and exists and (table in PRUNE_BY or _has_enums(table)):
            # the checks and the write read the batch several times: compute it once
            batch = materialize(batch, f"batch-{table}")
        stored = self._overlap(batch, table) if exists else None
        if _has_enums(table) and not check_enums(batch, table).isEmpty():
            raise InvalidRows(table)
        seen = Observation()
        batch = batch.observe(seen, F.count(F.lit(1)).alias("n"))
        added = self._write(new_rows(batch, stored, keys), table)
        return {"stored": added, "duplicates": seen.get["n"] - added}

    def _overlap(self, batch: DataFrame, table: str) -> DataFrame:
        """The part of the stored table that can hold keys of the batch.

        Where a column belongs to the key, one min/max over the batch leaves only the folders of
        its days; elsewhere the key columns of the whole table are read.
        """
        col = PRUNE_BY.get(table)
        if col is None:
            return self.read(table)
        r = batch.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count_if(F.col(col).isNull()).alias("none")).first()
        if r["none"]:
            return self.read(table)
        return self.read(table, r["lo"] or 0, (r["hi"] or 0) + 1)

    def add_new(self, rows: DataFrame, table: str) -> int:
        """Append stored rows that are known to be new (``new_rows``): no check, one write."""
        return self._write(conform(rows, TABLES[table]), table)

    def _versioned(self, rows: DataFrame, table: str) -> DataFrame:
        """Rows of now, not older than what was replaced."""
        marks = self._marks(table)
        if marks is None:
            return rows
        return rows.withColumn("_version", F.lit(marks.agg(F.max("_version")).first()[0]).cast("long"))

    def _write(self, rows: DataFrame, table: str) -> int:
        return self._commit(self._versioned(rows, table), table)

    def ingest(self, df: DataFrame, table: str, start: int | None = None, end: int | None = None,
               ts: str = "timestamp", on_conflict: str = "error") -> dict[str, int]:
        """Range of raw events in canonical order into its table."""
        if start is not None and end is not None:
            df = half_open(df, ts, start, end)
        order = [c for c in EVENT_ORDER if c in df.columns]
        return self.append_unique(df.sortWithinPartitions(*order) if order else df, table,
                                  on_conflict)


def seen_mints(progress: DataFrame, batch: DataFrame) -> DataFrame:
    """Mints of a batch that are not in the seen table yet: what insert-if-absent adds."""
    return batch.select("mint").distinct().join(progress.select("mint"), "mint", "left_anti")


# --- report sinks -------------------------------------------------------------------------

AGGREGATE_CSV = ["strategy_id", "scenario_id", "entry_event_type", "total_trades", "wins",
                 "losses", "win_rate", "outcome_mean", "outcome_median", "outcome_p10",
                 "outcome_p25", "outcome_p75", "outcome_p90", "outcome_min", "outcome_max",
                 "outcome_stddev", "max_drawdown", "max_consecutive_losses"]
SCENARIO_CSV = ["strategy_id", "entry_event_type", "outcome_optimistic", "outcome_realistic",
                "outcome_pessimistic", "outcome_degraded"]


def csv_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Report formatting: text quoted, doubles with six digits, NULL as empty."""
    out = []
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    for name in columns:
        c = F.col(name)
        if types[name] == "double":
            c = F.format_string("%.6f", c)
        elif types[name] == "string":
            c = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        else:
            c = c.cast("string")
        out.append(F.when(F.col(name).isNull(), F.lit("")).otherwise(c).alias(name))
    return df.select(*out)


def scenario_outcomes(sensitivity: DataFrame) -> DataFrame:
    return sensitivity.select("strategy_id", "entry_event_type", *[
        F.col(f"{s}_median").alias(f"outcome_{s}")
        for s in ("optimistic", "realistic", "pessimistic", "degraded")])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    # values are quoted by csv_text; the writer must not quote them again
    csv_text(df, columns).write.mode("errorifexists").option("header", True).option(
        "quote", "\u0000").option("escape", "\u0000").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_database(spark: SparkSession, url: str, table: str, lower: int, upper: int,
                  partitions: int, column: str = "slot") -> DataFrame:
    """Parallel range read of a raw table from a relational database."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions)
