"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 250


def small_batches(spark: SparkSession) -> None:
    """Rows of documents are long: fewer of them go to Python at once than Spark's default of 10,000.

    The setting is read when a plan runs, so it stays on the session; a smaller one is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    small_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def per_batch(fn: Callable[[pa.Table], pa.Table | None], nbytes: int = 4_000_000):
    """A mapInArrow function that applies ``fn`` to pieces of a partition of about ``nbytes`` bytes.

    Small batches are gathered and large ones cut by rows, so a task holds one bounded piece at a time
    whatever the size of its partition or of Spark's batches.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            out = fn(pa.Table.from_batches(held))
            return [] if out is None else out.combine_chunks().to_batches()

        for batch in batches:
            step = max(1, batch.num_rows // max(1, batch.nbytes // nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.append(part)
                size += part.nbytes
                if size >= nbytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        _give_back()

    return run


def _give_back() -> None:
    """Return freed memory to the system: a worker process lives on with what its tasks once needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def binary_view(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]
