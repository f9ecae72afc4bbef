"""First-seen mints of a stream, told apart by keyed state.

The state of a mint is that it was seen.  It starts from the candidates stored so far and lives in the
checkpoint, so a batch touches the state of its own mints only, however many candidates there are, and
a restarted stream goes on where it was.  Late events change nothing: the first to come counts, within a
batch the first in event order.  Each task reduces its rows to one for each mint before they move, so a
hot mint sends one row per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlab.operators.discovery import as_candidates
from marketlab.schemas import EVENT_ORDER, NEW_TOKEN

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST = "mint string, pool string, tx_signature string, event_index int, slot long, timestamp long"
_COLUMNS = ["mint", "pool", "tx_signature", "event_index", "slot", "timestamp"]


def _first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.sort_values(EVENT_ORDER, kind="stable").drop_duplicates("mint")


class FirstSwap(StatefulProcessor):
    """Emits the first row of a key that has no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        best = None
        for part in rows:
            if not known:
                part = part if best is None else pd.concat([best, part])
                best = part.sort_values(EVENT_ORDER, kind="stable").head(1)
        if best is not None:
            self.seen.update((True,))
            yield best[_COLUMNS]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_swaps(swaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """A stream of new candidates from a stream of swaps; ``candidates`` are known when it first starts."""
    reduced = swaps.select(*_COLUMNS).where("mint is not null").mapInPandas(_first_of_each, FIRST)
    known = candidates.select("mint").where("mint is not null").distinct().groupBy("mint")
    first = reduced.groupBy("mint").transformWithStateInPandas(
        FirstSwap(), FIRST, outputMode="Append", timeMode="None", initialState=known)
    return as_candidates(first, NEW_TOKEN)


class rocksdb_state:
    """Keyed state needs this provider; a query keeps the one it was started with."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(PROVIDER)
        self.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:
        self.conf.set(PROVIDER, self.before)
