"""Live ingestion with Structured Streaming."""

from __future__ import annotations

import hashlib
import os
import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from marketlab.operators import discovery
from marketlab.operators.joins import resolve_candidates
from marketlab.schemas import (
    LIQUIDITY_EVENTS, SWAP_EVENTS, TABLES, TX_LOGS, UNIQUE_KEYS, check_enums, conform)
from marketlab.session import (
    delete_path, discard_intermediates, intermediates_mark, list_names, materialize, path_exists)
from marketlab.sources import decode
from marketlab.sources.tables import InvalidRows, TableStore, half_open, new_rows
from marketlab.streaming.parts import HourParts, VolumeParts
from marketlab.streaming.seen import first_swaps, rocksdb_state

SLOT_LAG = 5            # fixed: slots behind the highest one until a slot is final
FLUSH_SECONDS = 5       # fixed: trigger interval
DAY_MS = 86_400_000


def table_stream(spark: SparkSession, path: str, schema: StructType,
                 files_per_trigger: int | None = None, **options) -> DataFrame:
    """Stream of new parquet files of a folder."""
    reader = spark.readStream.schema(schema).format("parquet").options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


class SlotBuffer:
    """Holds back events until their slot is final.

    A slot is final once the highest slot seen is ``lag`` ahead of it.  Events that arrive
    for a slot that is already final are released at once, never dropped.  What is pending
    lies in one numbered folder per micro-batch below the shared root and is found there, not
    in memory: a restarted run, also one with a new checkpoint, goes on with the last folder.
    A batch that is retried finds its own number, reads the same input and writes the same
    output.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, lag: int = SLOT_LAG,
                 run: str = "run"):
        self.spark, self.root, self.schema, self.lag, self.run = spark, root, schema, lag, run

    def _folders(self) -> list[tuple[int, str]]:
        """(number, name of the batch) of the pending folders that were written in full."""
        found = []
        for name in list_names(self.spark, self.root):
            number, _, batch = name.partition("-")
            if number.isdigit() and path_exists(self.spark, os.path.join(self.root, name, "_SUCCESS")):
                found.append((int(number), batch))
        return sorted(found)

    def _read(self, folder: tuple[int, str] | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(*folder))

    def _path(self, number: int, batch: str) -> str:
        return os.path.join(self.root, f"{number:012d}-{batch}")

    def release(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Final events of this batch; the rest becomes pending.

        The highest slot seen so far is always in the pending set or in the batch, because
        a slot at the head is never final.  It is one number, so both filters reach the reader.
        """
        name, known = f"{self.run}-{batch_id}", self._folders()
        own = [n for n, b in known if b == name]
        number = own[0] if own else (known[-1][0] + 1 if known else 0)
        before = [f for f in known if f[0] < number]
        pool = batch.select(*self.schema.names)
        if before:
            pool = self._read(before[-1]).unionByName(pool)
        top = pool.agg(F.max("slot")).first()[0]
        final = F.lit(None if top is None else top - self.lag).cast("long")
        pool.where(F.col("slot") > final).write.mode("overwrite").parquet(self._path(number, name))
        for old in before[:-2]:  # no retry reaches back that far
            delete_path(self.spark, self._path(*old))
        return pool.where(F.col("slot") <= final)

    def drain(self) -> DataFrame:
        """Everything still pending, at shutdown; storing it twice changes nothing."""
        known = self._folders()
        return self._read(known[-1] if known else None)


RAW_EVENTS = StructType(
    [f for f in SWAP_EVENTS.fields] + [f for f in LIQUIDITY_EVENTS.fields if f.name not in SWAP_EVENTS.names]
    + [StructField("kind", StringType())])


def raw_events(swaps: DataFrame | None, liquidity: DataFrame | None) -> DataFrame:
    """Swaps and liquidity events as one stream, so that both wait for the same highest slot."""
    parts = []
    for kind, df in (("swap", swaps), ("liquidity", liquidity)):
        if df is not None:
            parts.append(conform(df.withColumn("kind", F.lit(kind)), RAW_EVENTS))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class LivePipeline:
    """Micro-batch handlers over append-only tables.

    All writes skip keys that are already stored, so a replayed micro-batch changes nothing;
    the checkpoint and the tables themselves are the only state.  Repeated events are dropped by
    their key, whenever they come, and late ones are kept.  Spikes are looked for whenever the
    stored events enter a new period of event time; with ``hours`` they are measured against sums
    by hour.  ``first_seen`` makes candidates of new mints in each batch; ``run_first_seen`` does the
    same with keyed state.  With ``metadata`` (snapshots of mint and of name accounts) new candidates
    get theirs.
    """

    def __init__(self, store: TableStore, buffer: SlotBuffer | None = None,
                 volumes: VolumeParts | None = None, spikes_every_ms: int | None = None,
                 hours: HourParts | None = None, first_seen: bool = True,
                 metadata: tuple[DataFrame, DataFrame] | None = None):
        self.store, self.buffer, self.volumes, self.hours = store, buffer, volumes, hours
        self.spikes_every_ms, self.first_seen, self.metadata = spikes_every_ms, first_seen, metadata
        for parts in (volumes, hours):
            if parts is not None:
                parts.store = store

    def on_first_seen(self, batch: DataFrame, batch_id: int) -> None:
        """New candidates that keyed state let through."""
        mark = intermediates_mark()
        try:  # stored first: every look at the batch would go through the state again
            self.store.append_unique(materialize(batch, "first-seen"), "token_candidates", "skip", staged=True)
        finally:
            discard_intermediates(self.store.spark, mark)

    def on_logs(self, batch: DataFrame, batch_id: int, accounts: DataFrame | None = None) -> None:
        """Transactions of all programs, decoded in one pass; their events go on as ``on_events``.

        A transaction that several streams deliver is decoded as often as it comes and stored once.
        """
        mark = intermediates_mark()
        try:
            decoded = materialize(decode.events(batch, accounts), "decoded")
            self.on_events(raw_events(decode.complete_swaps(decoded), decode.complete_liquidity(decoded)), batch_id)
        finally:
            discard_intermediates(self.store.spark, mark)

    def on_events(self, batch: DataFrame, batch_id: int) -> None:
        """Both kinds of events, as ``raw_events`` builds them."""
        mark = intermediates_mark()
        try:
            if self.buffer is not None:
                batch = self.buffer.release(batch, batch_id)
            # computed once, then stored in several tables
            self.handle_events(materialize(batch, "released"), staged=True)
        finally:
            discard_intermediates(self.store.spark, mark)

    def handle_events(self, events: DataFrame, staged: bool = False) -> None:
        self.handle_swaps(events.where("kind = 'swap'"), staged)
        if not events.where("kind = 'liquidity'").isEmpty():
            self.on_liquidity(events.where("kind = 'liquidity'"))

    def on_swaps(self, batch: DataFrame, batch_id: int) -> None:
        self.on_events(raw_events(batch, None), batch_id)

    def handle_swaps(self, swaps: DataFrame, staged: bool = False) -> dict[str, int]:
        """Store swaps, then first-seen candidates of mints without one, then look for spikes."""
        before = self._last_event() if self.spikes_every_ms else None
        result = self.store.append_unique(swaps, "swap_events", "skip", staged)
        new = {"stored": 0}
        if self.first_seen:
            found = discovery.new_tokens(swaps, self.store.read("token_candidates"))
            if self.metadata is not None:
                found = materialize(found, "found")
            new = self.store.append_unique(found, "token_candidates", "skip", self.metadata is not None)
            if self.metadata is not None:
                self.store.append_unique(decode.token_metadata(*self.metadata, found), "token_metadata", "skip")
        if self.spikes_every_ms:
            now = self._last_event()
            if now is not None and (before is None or now // self.spikes_every_ms > before // self.spikes_every_ms):
                self.detect_active()
        return {**result, "candidates": new["stored"]}

    def _last_event(self) -> int | None:
        return self.store.last_time("swap_events")

    def on_liquidity(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Store liquidity events with the candidate that their mint has by now, if any."""
        known = resolve_candidates(batch, self.store.read("token_candidates"))
        self.store.append_unique(known, "liquidity_events", "skip")

    def on_candidate_swaps(self, batch: DataFrame, batch_id: int) -> None:
        """Swaps of known candidates: stored once; new ones are added to the volume buckets."""
        mark = intermediates_mark()
        try:
            fresh = new_rows(conform(batch, TABLES["swaps"]), self.store.read("swaps"), UNIQUE_KEYS["swaps"])
            fresh = materialize(fresh, "swaps")
            if not check_enums(fresh, "swaps").isEmpty():
                raise InvalidRows("swaps")
            self.store.add_new(fresh, "swaps")
            if self.volumes is not None:  # also what an earlier run stored and did not count
                self.volumes.catch_up()
        finally:
            discard_intermediates(self.store.spark, mark)

    def detect_active(self, with_liquidity: bool = False) -> dict[str, int]:
        """Spikes at the time of the last stored event; nothing before the first event."""
        at = self._last_event()
        if at is None:
            return {"stored": 0, "duplicates": 0}
        recent = self.store.read("swap_events", at - DAY_MS, at) if self.hours is None else self.hours.window(at)
        liquidity = self.store.read("liquidity_events", at - DAY_MS, at) if with_liquidity else None
        found = discovery.active_tokens(recent, at, self.store.read("token_candidates"), liquidity)
        return self.store.append_unique(found, "token_candidates", "skip")

    def drain(self) -> DataFrame:
        """Everything still pending, at shutdown; storing it twice changes nothing."""
        known = self._folders()
        return self._read(known[-1] if known else None)


RAW_EVENTS = StructType(
    [f for f in SWAP_EVENTS.fields] + [f for f in LIQUIDITY_EVENTS.fields if f.name not in SWAP_EVENTS.names]
    + [StructField("kind", StringType())])


def raw_events(swaps: DataFrame | None, liquidity: DataFrame | None) -> DataFrame:
    """Swaps and liquidity events as one stream, so that both wait for the same highest slot."""
    parts = []
    for kind, df in (("swap", swaps), ("liquidity", liquidity)):
        if df is not None:
            parts.append(conform(df.withColumn("kind", F.lit(kind)), RAW_EVENTS))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class LivePipeline:
    """Micro-batch handlers over append-only tables.

    All writes skip keys that are already stored, so a replayed micro-batch changes nothing;
    the checkpoint and the tables themselves are the only state.  Repeated events are dropped by
    their key, whenever they come, and late ones are kept.  Spikes are looked for whenever the
    stored events enter a new period of event time; with ``hours`` they are measured against sums
    by hour.  ``first_seen`` makes candidates of new mints in each batch; ``run_first_seen`` does the
    same with keyed state.  With ``metadata`` (snapshots of mint and of name accounts) new candidates
    get theirs.
    """

    def __init__(self, store: TableStore, buffer: SlotBuffer | None = None,
                 volumes: VolumeParts | None = None, spikes_every_ms: int | None = None,
                 hours: HourParts | None = None, first_seen: bool = True,
                 metadata: tuple[DataFrame, DataFrame] | None = None):
        self.store, self.buffer, self.volumes, self.hours = store, buffer, volumes, hours
        self.spikes_every_ms, self.first_seen, self.metadata = spikes_every_ms, first_seen, metadata
        for parts in (volumes, hours):
            if parts is not None:
                parts.store = store

    def on_first_seen(self, batch: DataFrame, batch_id: int) -> None:
        """New candidates that keyed state let through."""
        mark = intermediates_mark()
        try:  # stored first: every look at the batch would go through the state again
            self.store.append_unique(materialize(batch, "first-seen"), "token_candidates", "skip", staged=True)
        finally:
            discard_intermediates(self.store.spark, mark)

    def on_logs(self, batch: DataFrame, batch_id: int, accounts: DataFrame | None = None) -> None:
        """Transactions of all programs, decoded in one pass; their events go on as ``on_events``.

        A transaction that several streams deliver is decoded as often as it comes and stored once.
        """
        mark = intermediates_mark()
        try:
            decoded = decode.events(batch, accounts, staged=True)
            self.on_events(raw_events(decode.complete_swaps(decoded), decode.complete_liquidity(decoded)), batch_id, staged=True)
        finally:
            discard_intermediates(self.store.spark, mark)

    def on_events(self, batch: DataFrame, batch_id: int, staged: bool = False) -> None:
        """Both kinds of events, as ``raw_events`` builds them; ``staged`` if they lie in a stored table already."""
        mark = intermediates_mark()
        try:
            if self.buffer is not None:
                batch = self.buffer.release(batch, batch_id)
            # computed once, then stored in several tables
            self.handle_events(batch if staged else materialize(batch, "released"), staged=True)
        finally:
            discard_intermediates(self.store.spark, mark)

    def handle_events(self, events: DataFrame, staged: bool = False) -> None:
        self.handle_swaps(events.where("kind = 'swap'"), staged)
        if not events.where("kind = 'liquidity'").isEmpty():
            self.on_liquidity(events.where("kind = 'liquidity'"), staged=staged)

    def on_swaps(self, batch: DataFrame, batch_id: int) -> None:
        self.on_events(raw_events(batch, None), batch_id)

    def handle_swaps(self, swaps: DataFrame, staged: bool = False) -> dict[str, int]:
        """Store swaps, then first-seen candidates of mints without one, then look for spikes."""
        before = self._last_event() if self.spikes_every_ms else None
        result = self.store.append_unique(swaps, "swap_events", "skip", staged)
        new = {"stored": 0}
        if self.first_seen:
            found = discovery.new_tokens(swaps, self.store.read("token_candidates"))
            if self.metadata is not None:
                found = materialize(found, "found")
            new = self.store.append_unique(found, "token_candidates", "skip", self.metadata is not None)
            if self.metadata is not None:
                self.store.append_unique(decode.token_metadata(*self.metadata, found), "token_metadata", "skip")
        if self.spikes_every_ms:
            now = self._last_event()
            if now is not None and (before is None or now // self.spikes_every_ms > before // self.spikes_every_ms):
                self.detect_active()
        return {**result, "candidates": new["stored"]}

    def _last_event(self) -> int | None:
        return self.store.last_time("swap_events")

    def on_liquidity(self, batch: DataFrame, batch_id: int = 0, staged: bool = False) -> None:
        """Store liquidity events with the candidate that their mint has by now, if any."""
        if self.store.exists("token_candidates"):
            batch, staged = resolve_candidates(batch, self.store.read("token_candidates")), False
        else:  # nothing to look up
            batch = batch.withColumn("candidate_id", F.nullif("candidate_id", F.lit("")))
        self.store.append_unique(batch, "liquidity_events", "skip", staged)

    def on_candidate_swaps(self, batch: DataFrame, batch_id: int) -> None:
        """Swaps of known candidates: stored once; new ones are added to the volume buckets."""
        mark = intermediates_mark()
        try:
            fresh = new_rows(conform(batch, TABLES["swaps"]), self.store.read("swaps"), UNIQUE_KEYS["swaps"])
            fresh = materialize(fresh, "swaps")
            if not check_enums(fresh, "swaps").isEmpty():
                raise InvalidRows("swaps")
            self.store.add_new(fresh, "swaps")
            if self.volumes is not None:  # also what an earlier run stored and did not count
                self.volumes.catch_up()
        finally:
            discard_intermediates(self.store.spark, mark)

    def detect_active(self, with_liquidity: bool = False) -> dict[str, int]:
        """Spikes at the time of the last stored event; nothing before the first event."""
        events = self.store.read("swap_events")
        at = self._last_event()
        if at is None:
            return {"stored": 0, "duplicates": 0}
        recent = half_open(events, "timestamp", at - DAY_MS, at)
        liquidity = half_open(self.store.read("liquidity_events"), "timestamp", at - DAY_MS, at)
        found = discovery.active_tokens(recent, at, self.store.read("token_candidates"),
                                        liquidity if with_liquidity else None)
        return self.store.append_unique(found, "token_candidates", "skip")

    def drain(self) -> None:
        """Store what the slot buffer still holds."""
        if self.buffer is not None:
            self.handle_events(self.buffer.drain())

    def _start(self, events: DataFrame, handler, checkpoint: str, once: bool) -> StreamingQuery:
        trigger = {"availableNow": True} if once else {"processingTime": f"{FLUSH_SECONDS} seconds"}
        if self.buffer is not None:  # batches count anew with each checkpoint
            self.buffer.run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        query = (
            events.writeStream.foreachBatch(handler)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
        if once:
            query.awaitTermination()
            self.drain()
            return query
        return LiveRun(query, self)

    def run(self, swaps: DataFrame, checkpoint: str, once: bool = False,
            liquidity: DataFrame | None = None) -> StreamingQuery:
        """Start the stream; ``once`` takes what is there, waits and drains the slot buffer.

        A run that goes on is drained when it is stopped.
        """
        return self._start(raw_events(swaps, liquidity), self.on_events, checkpoint, once)

    def run_logs(self, logs: list[DataFrame], checkpoint: str, once: bool = False,
                 accounts: DataFrame | None = None) -> StreamingQuery:
        """Start one query over several streams of transaction logs, one for each program or node."""
        merged = reduce(DataFrame.unionByName, [conform(tx, TX_LOGS) for tx in logs])
        return self._start(merged, lambda batch, n: self.on_logs(batch, n, accounts), checkpoint, once)

    def run_first_seen(self, swaps: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """New candidates by keyed state, for swaps that are stored elsewhere or not at all.

        The candidates stored now are the initial state of a new checkpoint.
        """
        found = first_swaps(swaps, self.store.read("token_candidates"))
        with rocksdb_state(self.store.spark):
            return self._start(found, self.on_first_seen, checkpoint, once)

    def run_liquidity(self, events: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return self._start(events, self.on_liquidity, checkpoint, once)

    def run_candidate_swaps(self, swaps: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return self._start(swaps, self.on_candidate_swaps, checkpoint, once)


class LiveRun:
    """A running query that stores what the slot buffer holds when it is stopped, by whomever.

    A query that fails is not drained: what is pending stays in the buffer's folder for the next run.
    """

    def __init__(self, query: StreamingQuery, pipeline: LivePipeline):
        self.query, self.pipeline, self.drained = query, pipeline, threading.Event()
        self._lock, self.failure = threading.Lock(), None
        self.listener = _Ended(self)
        pipeline.store.spark.streams.addListener(self.listener)

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def stop(self) -> None:
        """Stop after the batch that is running, then drain."""
        self.query.stop()
        self.ended()

    def ended(self) -> None:
        with self._lock:
            if self.drained.is_set():
                return
            try:
                if self.query.exception() is None:
                    self.pipeline.drain()
            finally:
                self.drained.set()
        self.pipeline.store.spark.streams.removeListener(self.listener)


class _Ended(StreamingQueryListener):
    """Drains a run that was stopped through its query; jobs do not run on the listener's own thread."""

    def __init__(self, run: LiveRun):
        self.run = run

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == str(self.run.query.runId):
            threading.Thread(target=self.run.ended, daemon=True).start()


def backfill(store: TableStore, swaps: DataFrame, liquidity: DataFrame | None, start: int,
             end: int) -> dict[str, int]:
    """Load [start, end) from batch sources: store, discover, count."""
    live = LivePipeline(store)
    s = live.handle_swaps(half_open(swaps, "timestamp", start, end))
    out = {"swap_events": s["stored"], "candidates": s["candidates"],
           "duplicates": s["duplicates"], "liquidity_events": 0}
    if liquidity is not None:
        part = resolve_candidates(half_open(liquidity, "timestamp", start, end),
                                  store.read("token_candidates"))
        q = store.append_unique(part, "liquidity_events", "skip")
        out["liquidity_events"] = q["stored"]
        out["duplicates"] += q["duplicates"]
    return out
