"""Best-fit packing of tokenised documents by bin completion over the histogram of lengths.

A sequence holds at most ``capacity`` tokens and lengths are small integers, so what has to be searched is
a histogram of at most ``capacity`` numbers, whatever the number of documents.  Best-fit decreasing gives
the first incumbent.  The search then takes the longest remaining document, enumerates fillings of the
space beside it that no other filling dominates (least waste first, longer documents first), applies one
as often as the counts allow and goes on; a branch ends when its waste exceeds what the incumbent leaves.
The result is a list of patterns with repetitions.  Documents find their place by rank within their
length, which is counted in salted buckets, so a length held by a third of all rows is not one task.

Defined cases: a null or empty text is the single end id; longer documents are cut into full pieces and a
rest; repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import per_batch, table
from marketlab.session import materialize

END_ID = 0
_PLAIN = [c for c in map(chr, range(0x20, 0x180)) if not unicodedata.category(c).startswith("C") and c != "İ"] + list("\t\n\r")
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")


def _set(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-" else c for c in chars)


# The split pattern of the vocabulary file, fixed by it, for characters below U+0180.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_set(_LETTERS)}]+|[{_set(_NUMBERS)}]|[^\\s{_set(_LETTERS)}{_set(_NUMBERS)}]+")
_OTHER = re.compile(f"[^{_set(''.join(_PLAIN))}]|<\\|")


class WordEncoder:
    """Ids of whole texts through a cache of words; the library encodes each new word once.

    The library splits a text into words before it looks at any of them, so the ids of a text are those
    of its words in a row.  Texts with characters beyond U+017F or with ``<|`` go to the library whole.
    The cache is emptied at ``most`` words, which bounds its memory.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache: dict[str, bytes] = {}
        self.most = most

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # never seen; kept exact all the same
                for w in part:
                    self.cache[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, (4 * stops).tolist()):
                self.cache[w] = raw[a:b]
                a = b

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end id."""
        split: list[list[str] | bytes] = []
        for t in texts:
            if not t:
                split.append([])
            elif _OTHER.search(t):
                split.append(np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())
            else:
                split.append(_PIECES.findall(t.lower()))
        new = set().union(*(s for s in split if isinstance(s, list))).difference(self.cache)
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = set().union(*(s for s in split if isinstance(s, list)))
        self._learn(list(new))
        known = self.cache.__getitem__
        return [s if isinstance(s, bytes) else b"".join(map(known, s)) for s in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): documents as ids, cut at the capacity."""
    step = 4 * capacity

    def run(t: pa.Table) -> pa.Table:
        out = defaultdict(list)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for doc, ids in zip(t["doc_id"].to_pylist(), encoder(path).encode(t["text"].to_pylist())):
            ids += end
            for k in range(0, len(ids), step):
                part = ids[k:k + step]
                out["doc_id"].append(doc)
                out["piece"].append(k // step)
                out["start"].append(k // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                if with_ids:
                    out["ids"].append(part)
        kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(per_batch(run, nbytes=1_000_000),
                             "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, many equal bins at a time."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, bins]
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_ if r >= size and open_[r]), default=None)
            if room is None:
                each = capacity // size
                bins, rest = divmod(n, each)
                if bins:
                    open_[capacity - each * size].append([(size,) * each, bins])
                if rest:
                    open_[capacity - rest * size].append([(size,) * rest, 1])
                break
            pattern, bins = open_[room].pop()
            each = room // size
            full = min(bins, n // each)
            if full:
                open_[room - each * size].append([pattern + (size,) * each, full])
                n -= full * each
            elif n:
                open_[room - n * size].append([pattern + (size,) * n, 1])
                full, n = 1, 0
            if bins > full:
                open_[room].append([pattern, bins - full])
    return [(tuple(p), b) for group in open_.values() for p, b in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: total length, and documents that cannot share one."""
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    for small in sorted({min(k, capacity - k) for k in counts if 0 < min(k, capacity - k)} | {1}):
        over = sum(v for k, v in counts.items() if k > capacity - small)
        half = {k: v for k, v in counts.items() if capacity // 2 < k <= capacity - small}
        rest = sum(k * v for k, v in counts.items() if small <= k <= capacity // 2)
        room = sum((capacity - k) * v for k, v in half.items())
        best = max(best, over + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


class _Stock:
    """Counts by length with bit sets of the lengths in stock, ascending and descending."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n, self.capacity = dict(counts), capacity
        self.up = sum(1 << k for k, v in counts.items() if v)
        self.down = sum(1 << (capacity - k) for k, v in counts.items() if v)

    def largest(self, room: int) -> int:
        return (self.up & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 else -1

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for k in pattern:
            self.n[k] -= times
            if not self.n[k]:
                self.up &= ~(1 << k)
                self.down &= ~(1 << (self.capacity - k))

    def times(self, pattern: tuple[int, ...]) -> int:
        return min(self.n[k] // pattern.count(k) for k in set(pattern))

    def pairs(self, total: int, width: int):
        """Up to ``width`` pairs in stock with this sum, the one with the longest document first."""
        hits = self.up & (self.down >> (self.capacity - total)) if total > 1 else 0
        while hits and width:
            a = hits.bit_length() - 1
            b = total - a
            if a < b:
                break
            if a != b or self.n[a] > 1:
                yield a, b
                width -= 1
            hits &= ~(1 << a)


def fillings(stock: _Stock, first: tuple[int, ...], room: int, waste: int, width: int) -> list[tuple[int, ...]]:
    """Fillings of ``room`` beside ``first`` that waste at most ``waste``, least waste first.

    Of one document only the longest that fits is undominated, of two those with the greatest sum.  Large
    rooms are first filled with the longest documents in stock.
    """
    base = list(first)
    while True:
        x = stock.largest(room)
        if x <= 0 or room <= 3 * x or stock.n[x] <= base.count(x):
            break
        add = min(room // x - 2, stock.n[x] - base.count(x))
        if add <= 0:
            break
        base += [x] * add
        room -= add * x
    found, top = [], stock.largest(room)
    if top <= 0:
        return [tuple(base)]
    for lost in range(0, min(waste, room - top) + 1):
        total = room - lost
        if total <= stock.capacity and stock.up >> total & 1:
            found.append((*base, total))
        found += [(*base, *p) for p in stock.pairs(total, width)]
        if len(found) < width:  # three: a long one and a pair with the rest
            x = top
            for _ in range(width):
                if x <= 0:
                    break
                found += [(*base, x, *p) for p in stock.pairs(total - x, 1)]
                x = stock.largest(x - 1)
        found = [p for p in found if stock.times(p) > 0]
        if len(found) >= width:
            break
    if not found:
        extra = list(base)
        while (x := stock.largest(room)) > 0:
            while x > 0 and stock.n.get(x, 0) <= extra.count(x):
                x = stock.largest(x - 1)
            if x <= 0:
                break
            extra.append(x)
            room -= x
        found = [tuple(extra)]
    return list(dict.fromkeys(found))[:width]


def complete_bins(counts: dict[int, int], capacity: int, width: int = 6, nodes: int = 20_000) -> list[Pattern]:
    """The fewest sequences found, as patterns with repetitions.

    ``nodes`` bounds the search; every document is packed whether or not the bound is met.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v}
    incumbent = best_fit(counts, capacity)
    best = sum(b for _, b in incumbent)
    least = lower_bound(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    left = nodes
    # depth-first; a frame is (stock, patterns so far, sequences, waste, choices still to try)

    def choices(stock: _Stock, waste: int) -> list[tuple[int, ...]]:
        allowed = (best - 1) * capacity - total - waste
        if allowed < 0:
            return []
        x = stock.largest(capacity)
        return fillings(stock, (x,), capacity - x, min(allowed, capacity), width)[::-1]

    start = _Stock(counts, capacity)
    stack = [(start, [], 0, 0, choices(start, 0))] if best > least and counts else []
    while stack and left > 0 and best > least:
        stock, path, bins, waste, open_ = stack[-1]
        if not open_:
            stack.pop()
            continue
        pattern = open_.pop()
        left -= 1
        times = stock.times(pattern)
        lost = waste + times * (capacity - sum(pattern))
        if times < 1 or lost > (best - 1) * capacity - total:
            if times > 1 and (fit := ((best - 1) * capacity - total - waste) // max(1, capacity - sum(pattern))) > 0:
                times, lost = fit, waste + fit * (capacity - sum(pattern))
            else:
                continue
        after = _Stock.__new__(_Stock)
        after.n, after.capacity, after.up, after.down = dict(stock.n), capacity, stock.up, stock.down
        after.take(pattern, times)
        done = [*path, (pattern, times)]
        if not after.up:
            if bins + times < best:
                incumbent, best = done, bins + times
            continue
        stack.append((after, done, bins + times, lost, choices(after, lost)))
    return incumbent


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of places, by rank."""
    taken: dict[int, int] = defaultdict(int)
    found: dict[int, list] = defaultdict(list)
    base = 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            found[size].append((taken[size], base, offset))
            taken[size] += times
            offset += size
        base += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in found.items()}


def pack(rows: DataFrame, capacity: int = 2048, bucket_rows: int = 500_000, nodes: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored rows of ``pieces``."""
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if not counts:
        return rows.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    places = slots(complete_bins(counts, capacity, nodes=nodes))
    buckets = 8 * -(-sum(counts.values()) // (8 * bucket_rows))
    salted = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = salted.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    held = held.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(held, ["length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
        for k in np.unique(size):
            m = size == k
            first, base, at = places[int(k)]
            i = np.searchsorted(first, r[m], side="right") - 1
            sequence[m], offset[m] = base[i] + r[m] - first[i], at[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_p", place("length", F.col("_own") + F.col("_before")))
    return placed.select(*rows.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; ``with_ids`` adds the token ids."""
    return pack(materialize(pieces(docs, path or tokenizer_path(), capacity, with_ids), "pieces"), capacity)


def query(spark, sf_dir) -> DataFrame:
    """op8: all documents in as few sequences of 2048 tokens as found."""
    return pack_documents(table(spark, sf_dir, "documents"))
