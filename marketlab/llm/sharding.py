"""Sharding by histogram sort: exact byte counts below probes refine the splitters, then one exchange.

Documents are ordered by (hash of the text, document id, row).  Equal texts are neighbours in that
order, so they share a shard unless a splitter has to cut their group.  Splitters are found by rounds:
every task counts the bytes and rows that lie between candidate boundaries (probes), the counts are
summed, and each splitter keeps the one cell that holds its target.  A cell that is down to one hash is
refined by document id and then by row, so a hot text is cut like any other stretch of keys.  No row
moves before the splitters are known.

Defined cases: a null text counts as the empty text (size 16); a null id sorts before all others;
repeated rows are told apart by their row number; an empty table gives no rows; a document larger than a
shard makes its shard larger.  Only ``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.session import materialize

LOW, HIGH = -(2**63), 2**63 - 1
LEVELS = ("_h", "_d", "_r")


@dataclass
class Cell:
    """Keys that share ``prefix`` and whose next component is in [lo, hi]; totals below and inside."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: tuple[int, int]
    inside: tuple[int, int]


@dataclass
class Splitters:
    """Boundaries of the pieces, (m, 3), and bytes and rows below each of them."""

    keys: np.ndarray
    below_bytes: list[int]
    below_rows: list[int]
    rounds: int


def keyed(docs: DataFrame) -> DataFrame:
    """Ids, sizes and sort keys: all that the search for splitters reads."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("_d"),
    ).withColumn("_r", F.monotonically_increasing_id())


def _probes(cell: Cell, n: int) -> np.ndarray:
    width = cell.hi - cell.lo
    return np.unique(np.array([cell.lo + (width * (i + 1)) // (n + 1) + 1 for i in range(n)], dtype=object).clip(
        cell.lo + 1, cell.hi)).astype(np.int64)


def _count(rows: DataFrame, cells: list[Cell], probes: list[np.ndarray]) -> pd.DataFrame:
    """Bytes, rows, least and greatest key between neighbouring probes of each cell."""

    def count(batches):
        parts = []
        for b in batches:
            keys = [b[c].to_numpy() for c in LEVELS]
            size = b["size"].to_numpy()
            for i, (cell, probe) in enumerate(zip(cells, probes)):
                level = len(cell.prefix)
                m = (keys[level] >= cell.lo) & (keys[level] <= cell.hi)
                for k, v in zip(keys, cell.prefix):
                    m &= k == v
                k, s = keys[level][m], size[m]
                if not len(k):
                    continue
                slot = np.searchsorted(probe, k, side="right")
                order = np.argsort(slot, kind="stable")
                slot, k, s = slot[order], k[order], s[order]
                at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                parts.append(pd.DataFrame({
                    "cell": i, "slot": slot[at].astype(np.int64), "bytes": np.add.reduceat(s, at),
                    "n": np.diff(np.r_[at, len(k)]).astype(np.int64),
                    "least": np.minimum.reduceat(k, at), "most": np.maximum.reduceat(k, at)}))
        if parts:
            yield pd.concat(parts).groupby(["cell", "slot"], as_index=False).agg(
                bytes=("bytes", "sum"), n=("n", "sum"), least=("least", "min"), most=("most", "max"))

    return (
        rows.select("size", *LEVELS)
        .mapInPandas(count, "cell long, slot long, bytes long, n long, least long, most long")
        .groupBy("cell", "slot")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        .toPandas()  # at most probes + 1 rows for each splitter
        .sort_values(["cell", "slot"])
    )


def find_splitters(rows: DataFrame, shards: int, piece_rows: int = 1_000_000, tolerance: float = 0.001, probes: int = 256) -> Splitters:
    """Boundaries of equal bytes, ``f`` pieces to a shard so that a piece holds about ``piece_rows`` rows.

    A boundary is final when the bytes below it miss the target by at most ``tolerance`` of a piece, or
    when its cell holds a single row; then the nearer side is taken.
    """
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    bytes_, n = int(total.b or 0), int(total.n)
    if n == 0:
        return Splitters(np.zeros((0, 3), np.int64), [], [], 0)
    f = -(-n // (shards * piece_rows))
    pieces = shards * f
    slack = tolerance * bytes_ / pieces
    whole = Cell((), LOW, HIGH, (0, 0), (bytes_, n))
    open_: dict[int, Cell] = {i: whole for i in range(1, pieces)}
    done: dict[int, tuple[tuple[int, ...], tuple[int, int]]] = {}
    rounds = 0
    while open_:
        rounds += 1
        cells = list({id(c): c for c in open_.values()}.values())
        marks = [_probes(c, probes * 16 if len(cells) == 1 else probes) for c in cells]
        counted = _count(rows, cells, marks)
        split: dict[int, list[Cell]] = {}
        for i, cell in enumerate(cells):
            below, out = cell.below, []
            for r in counted[counted["cell"] == i].itertuples():
                out.append(Cell(cell.prefix, int(r.least), int(r.most), below, (int(r.bytes), int(r.n))))
                below = (below[0] + int(r.bytes), below[1] + int(r.n))
            split[id(cell)] = out
        for i, cell in list(open_.items()):
            target = bytes_ * i / pieces
            parts = split[id(cell)]
            starts = np.array([c.below[0] for c in parts])
            at = max(0, int(np.searchsorted(starts, target, side="right")) - 1)
            part = parts[at]
            end = (part.below[0] + part.inside[0], part.below[1] + part.inside[1])
            near_low = target - part.below[0] <= end[0] - target
            miss = min(target - part.below[0], end[0] - target)
            last = len(part.prefix) == len(LEVELS) - 1 and part.lo == part.hi
            if miss <= slack or part.inside[1] == 1 or last:
                # the least key of the part, or of what follows it, is the boundary
                if near_low:
                    done[i] = ((*part.prefix, part.lo), part.below)
                else:
                    done[i] = ((*part.prefix, part.hi, "next"), end)
                del open_[i]
            elif part.lo == part.hi:
                open_[i] = split.setdefault(("deeper", id(part)), Cell((*part.prefix, part.lo), LOW, HIGH, part.below, part.inside))
            else:
                open_[i] = part
    keys = []
    for i in sorted(done):
        key = done[i][0]
        if key[-1] == "next":  # the first key above this one
            key = list(key[:-1])
            while key and key[-1] == HIGH:
                key.pop()
            if key:
                key[-1] += 1
            else:
                key = [HIGH]
        keys.append([*key, *[LOW] * (3 - len(key))])
    order = sorted(done)
    return Splitters(np.array(keys, dtype=np.int64).reshape(-1, 3), [done[i][1][0] for i in order], [done[i][1][1] for i in order], rounds)


def rank(keys: list[np.ndarray], splits: np.ndarray) -> np.ndarray:
    """How many splitters are at or below each key, by lexicographic order."""
    first = np.ascontiguousarray(splits[:, 0])
    right = np.searchsorted(first, keys[0], side="right")
    if len(keys) == 1:
        return right
    out = np.searchsorted(first, keys[0], side="left")
    tied = np.flatnonzero(right > out)
    for v in np.unique(keys[0][tied]):
        at = tied[keys[0][tied] == v]
        out[at] += rank([k[at] for k in keys[1:]], splits[first == v][:, 1:])
    return out


def assign(rows: DataFrame, splitters: Splitters, shards: int) -> DataFrame:
    """Shard and gapless slot of each row; the only exchange deals rows to their pieces."""
    f = (len(splitters.keys) + 1) // shards or 1
    below = np.array([0, *splitters.below_rows], dtype=np.int64)

    def place(batches):
        for b in batches:
            piece = rank([b[c].to_numpy() for c in LEVELS], splitters.keys) if len(splitters.keys) else np.zeros(len(b), np.int64)
            shard = piece // f
            b["_piece"], b["shard"] = piece.astype(np.int32), shard.astype(np.int32)
            b["_before"] = below[np.minimum(piece, len(below) - 1)] - below[np.minimum(shard * f, len(below) - 1)]
            yield b

    # ids may be null, which pandas would turn into doubles: the key column stands for them
    placed = rows.drop("doc_id").mapInPandas(
        place, "size long, text_crc32 long, _h long, _d long, _r long, _piece int, shard int, _before long")
    at = Window.partitionBy("_piece").orderBy(*LEVELS)
    return placed.withColumn("slot", F.row_number().over(at) - 1 + F.col("_before"))


def shard_documents(docs: DataFrame, shards: int = 40, piece_rows: int = 1_000_000, tolerance: float = 0.001) -> DataFrame:
    """Thin rows (doc_id, size, text_crc32, shard, slot) of all documents, shards of near equal bytes."""
    rows = materialize(keyed(docs), "shard_keys")
    placed = assign(rows, find_splitters(rows, shards, piece_rows, tolerance), shards)
    return placed.select(
        F.when(F.col("_d") != LOW, F.col("_d")).alias("doc_id"), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, piece_rows: int = 1_000_000, tolerance: float = 0.001) -> None:
    """Write whole documents as folders ``shard=N``, in key order within each file.

    Rows that repeat both id and text go to one shard here.
    """
    rows = materialize(keyed(docs), "shard_keys")
    found = find_splitters(rows, shards, piece_rows, tolerance)
    f = (len(found.keys) + 1) // shards or 1

    @F.pandas_udf("int")
    def piece(h: pd.Series, d: pd.Series) -> pd.Series:
        if not len(found.keys):
            return pd.Series(np.zeros(len(h), np.int32))
        return pd.Series(rank([h.to_numpy(), d.to_numpy(), np.full(len(h), LOW)], found.keys).astype(np.int32))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "_piece")])
    out = kept.withColumn("_piece", piece(F.xxhash64(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))))
    (out.withColumn("shard", F.floor(F.col("_piece") / f).cast("int"))
        .repartition("_piece").sortWithinPartitions("_piece", F.xxhash64(text), "doc_id").drop("_piece")
        .write.partitionBy("shard").parquet(path))


def query(spark, sf_dir) -> DataFrame:
    """op6: all documents into 40 shards of near equal bytes."""
    from marketlab.llm.common import table

    rows = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
