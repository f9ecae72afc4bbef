"""Suffix-array dedup: bytes under any string of ``LENGTH`` bytes that also starts somewhere else.

Sorting all suffixes of a corpus is not needed to find repeats of a fixed length.  Every stretch of LENGTH
bytes holds an anchor, the least hash among its GRAM-byte substrings, and equal stretches hold equal
anchors at equal places.  So only windows around anchors that occur twice can hold a repeat, and two
occurrences of a repeated stretch always meet in the group of their common anchor, aligned at it.

Inside the groups the repeats are found on Burrows-Wheeler transforms.  Symbols are hashes of STEP bytes
together with the group and the place relative to the anchor; a window is STEP interleaved strings of such
symbols.  Shards of windows are sorted and transformed on their own and then merged: the interleave of the
shards is refined symbol by symbol from the transforms alone, and after LENGTH / STEP rounds its blocks are
the intervals of suffixes that share LENGTH bytes.  No suffix is sorted again.

Equal texts are one text with a number of copies, equal windows of a group one window with a list of
places; both are combined before they are sent.  Texts are stored in buckets of their key, so they are
moved once.  A group with very many windows is cut by context: the stretches around an anchor fall into
PARTS classes by the bytes they hold before it, and those of a class agree on all but PART bytes to each
side.  Anchors with more than SPREAD places are cut before they are sent, so that their windows are dealt by
their contexts; the transforms are then built on the two sides alone, and a context that is still crowded is
halved until the rest fits or stretches are equal.  A task holds one row of each different pair of sides.

Defined cases: a null text is empty; texts below LENGTH bytes lose nothing; rows that repeat a text lose all
of it from LENGTH bytes on; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read, and the
other columns of documents kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import binary_view, per_batch, table
from marketlab.session import shared_dir

LENGTH, GRAM, STEP = 200, 64, 50
LEFT = LENGTH - GRAM  # bytes of a window before its anchor, and after the anchor's end
PARTS = 4  # classes of the stretches around an anchor, by the bytes before it
PART = LEFT // PARTS
SPREAD = 5_000  # places of an anchor above which its windows are cut by context before they are sent
CROWD = 1_500  # windows of a group above which it is cut by context
BATCH = 500_000  # bytes of windows that are transformed at once
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _A, _B = (np.uint64(x) for x in (0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)])


def rolling(body: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on; zero never occurs."""
    n = len(body)
    if n < gram:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[body] * _powers(_BASE, n), out=total[1:])
    h = total[gram:] - total[:-gram]
    h *= _powers(_INVERSE, len(h))
    return _mix(h) | np.uint64(1)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


def anchors(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that lie one after another, text i from at[i] to at[i + 1]."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(body) < LENGTH:
        return none
    edge = np.zeros(len(body) + 1, np.int32)
    long_ = np.diff(at) >= LENGTH
    np.add.at(edge, at[:-1][long_], 1)
    np.add.at(edge, at[1:][long_] - LENGTH + 1, -1)
    inside = np.cumsum(edge)[:len(body) - LENGTH + 1] > 0  # a stretch starts here and ends in the same text
    h = rolling(body, GRAM)
    width = LENGTH - GRAM + 1
    least = _slide(h, width, np.minimum)
    least[~inside] = 0
    # an anchor is the least hash of some stretch that covers it
    covering = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    place = np.flatnonzero(covering == h)
    return place, h[place]


def stored_texts(docs: DataFrame) -> DataFrame:
    """Distinct texts with their copies, in buckets of their key (k8, k4)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*text_key(body), body.alias("text"))
    texts = keyed.groupBy("k8", "k4").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (texts.write.bucketBy(buckets, "k8", "k4").format("parquet")
     .option("path", os.path.join(shared_dir(spark), name)).saveAsTable(name))
    return spark.table(name)


def text_key(text: Column) -> tuple[Column, Column]:
    """96 bits that stand for a text."""
    return F.xxhash64(text).alias("k8"), F.crc32(text).alias("k4")


WINDOW, SIDES, KNOWN = 0, 1, 2  # kinds of rows that are dealt: a window, its sides by context, places that recur
_PLACE = np.dtype([("k8", "<i8"), ("cp", "<u8")])  # cp: crc32 of the text in the upper half, a place in it below


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """(k8, k4, hits array<struct<pos, h, many>>) of the texts that hold anchors which occur twice.

    ``many``: the anchor has more than SPREAD places.
    """

    def run(t: pa.Table) -> pa.Table:
        body, at = binary_view(t["text"])
        place, h = anchors(body, at)
        doc = np.searchsorted(at, place, side="right") - 1
        where = np.empty(len(place), _PLACE)
        where["k8"] = t["k8"].to_numpy()[doc]
        where["cp"] = (t["k4"].to_numpy()[doc].astype(np.uint64) << np.uint64(32)) | (place - at[doc]).astype(np.uint64)
        order = np.argsort(h, kind="stable")
        h, where = h[order], where[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        ends = np.r_[first[1:], len(h)]
        # one row for each anchor of the piece; further places of the same anchor ride along
        rest = [where[a + 1:b].tobytes() if b - a > 1 else None for a, b in zip(first.tolist(), ends.tolist())]
        return pa.table({"h": h[first].view(np.int64), "k8": where["k8"][first], "cp": where["cp"][first].view(np.int64), "rest": pa.array(rest, pa.binary())})

    found = texts.select("text", "k8", "k4").mapInArrow(per_batch(run, nbytes=1_500_000), "h long, k8 long, cp long, rest binary")
    n = F.coalesce(F.octet_length("rest") / _PLACE.itemsize, F.lit(0)).cast("long") + 1
    twice = found.withColumn("n", F.sum(n).over(Window.partitionBy("h"))).where("n > 1")

    def spread(t: pa.Table) -> pa.Table:
        rest = t["rest"].to_pylist()
        more = [np.frombuffer(r, _PLACE) for r in rest if r]
        times = [len(r) // _PLACE.itemsize if r else 0 for r in rest]
        extra = np.concatenate(more) if more else np.zeros(0, _PLACE)
        h, many = t["h"].to_numpy(), t["many"].to_numpy()
        cp = np.r_[t["cp"].to_numpy().view(np.uint64), extra["cp"]]
        return pa.table({"k8": np.r_[t["k8"].to_numpy(), extra["k8"]], "k4": (cp >> np.uint64(32)).astype(np.int64),
                         "pos": (cp & np.uint64(2**32 - 1)).astype(np.int64), "h": np.r_[h, np.repeat(h, times)], "many": np.r_[many, np.repeat(many, times)]})

    flat = twice.select("h", "k8", "cp", "rest", (F.col("n") > SPREAD).alias("many")).mapInArrow(
        per_batch(spread), "k8 long, k4 long, pos long, h long, many boolean")
    return flat.groupBy("k8", "k4").agg(F.collect_list(F.struct("pos", "h", "many")).alias("hits"))


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of shards (the shard at each place of the merged order) and its blocks.

    ``transforms`` hold the symbol before each sorted suffix of a shard.  After round r the interleave is
    right for the first r symbols: the suffixes that a round's order puts in front of equal symbols keep
    their order behind it.
    """
    z = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    joined = np.concatenate(transforms)
    block = np.zeros(len(z), np.int64)
    symbols = np.empty_like(joined)
    for _ in range(rounds):
        symbols[np.argsort(z, kind="stable")] = joined
        order = np.argsort(symbols, kind="stable")
        z, s, b = z[order], symbols[order], block[order]
        block = np.cumsum(np.r_[0, (s[1:] != s[:-1]) | (b[1:] != b[:-1])])
    return z, block


def repeated_starts(windows: list[bytes], group: list[int], anchor: list[int], shard: int = 300_000,
                    length: int = LENGTH, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Windows and places in them from which ``length`` bytes recur at the same place of another window of the group."""
    body = np.frombuffer(b"".join(w + b"\0" for w in windows), np.uint8)  # the extra byte ends the last of the strings
    at = np.r_[0, np.cumsum([len(w) + 1 for w in windows])]
    group, anchor = np.array(group, np.int64), np.array(anchor, np.int64)
    n = len(body)
    window = np.repeat(np.arange(len(group)), np.diff(at))
    place = np.arange(n) - at[window]
    whole = np.arange(n) + step < at[window + 1]  # a full symbol starts here; elsewhere a string ends
    salt = _mix(group[window].view(np.uint64) + _mix((place - anchor[window] + length).astype(np.uint64)))
    h = np.zeros(n, np.uint64)
    grams = rolling(body, step)
    h[:len(grams)] = grams
    h = _mix(h ^ salt) | np.uint64(1)
    h[~whole] = 0
    rounds = length // step
    _, symbol, times = np.unique(h, return_inverse=True, return_counts=True)
    # a stretch recurs only if each of its symbols does: strings are cut where no such stretch is left
    again = (times > 1)[symbol] & whole

    def later(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k * step:], np.zeros(k * step, bool)]) if k else x

    def earlier(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(k * step, bool), x[:n - k * step]]) if k else x

    # a symbol that is whole is followed by a place of its own window, so runs of them never leave it
    run = np.logical_and.reduce([later(again, k) for k in range(rounds)])
    keep = np.logical_or.reduce([earlier(run, k) for k in range(rounds)])
    if not keep.any():
        return window[:0], place[:0]
    used = np.flatnonzero(keep | earlier(keep, 1))  # and the end of each string
    symbol = np.where(keep, symbol + 1, 0).astype(np.int32)
    owner = window[used]

    def ahead(idx: np.ndarray, k: int) -> np.ndarray:
        """Symbol k steps on; the end of a string where there is none."""
        to = idx + k * step
        return np.where(to < at[window[idx] + 1], symbol[np.minimum(to, n - 1)], 0)

    # shards are whole windows
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    cuts = [0]
    for e in edges[1:].tolist():
        if e - cuts[-1] >= shard:
            cuts.append(e)
    cuts.append(len(used))
    arrays, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        idx = used[a:b]
        suffixes = idx[np.lexsort([ahead(idx, k) for k in range(rounds - 1, -1, -1)])]
        before = np.where(place[suffixes] >= step, symbol[np.maximum(suffixes - step, 0)], 0)
        arrays.append(suffixes)
        transforms.append(before)
    z, block = merge_transforms(transforms, rounds)
    merged = np.empty(len(used), np.int64)
    merged[np.argsort(z, kind="stable")] = np.concatenate(arrays)
    shared = np.bincount(block)[block] > 1
    starts = np.sort(merged[shared])
    starts = starts[run[starts]]
    return window[starts], place[starts]


def _sides(window: bytes, anchor: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """A window by classes of its stretches: what all of a class hold, up to PART bytes to the left and right
    of it, how many of these are left, and where they begin in the window.  Class i holds from i * PART to
    (i + 1) * PART bytes before the anchor."""
    after = len(window) - anchor - GRAM
    for i in range(PARTS):
        lo, hi = anchor - PART * i, anchor + LENGTH - PART * (i + 1)
        left, right = min(lo, PART), min(len(window) - hi, PART)
        if lo >= 0 and after >= LEFT - PART * (i + 1) and left + right >= PART:
            yield window[lo:hi] + bytes((i,)), window[lo - left:lo] + window[hi:hi + right], left, lo - left


def _line(outer: bytes, left: int) -> bytes:
    """Both sides, each from the context outwards, and their lengths, in 2 * PART + 2 bytes."""
    return outer[:left][::-1].ljust(PART, b"\0") + outer[left:].ljust(PART, b"\0") + bytes((left, len(outer) - left))


def _collapsed(lines: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines by group: the first of each that are equal, for each the number of its first, and how many are equal."""
    whole = np.ascontiguousarray(np.concatenate([lines, group.view(np.uint8).reshape(-1, 8)], axis=1))
    _, first, same, times = np.unique(whole.view(f"S{whole.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    return first, same, times


def _by_context(group: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Groups cut by the bytes of ``context``."""
    out = np.empty(len(group), np.uint64)
    for at in range(0, len(group), 50_000):
        part = slice(at, at + 50_000)
        out[part] = _mix((_BYTE[context[part]] * _powers(_BASE, context.shape[1])).sum(axis=1, dtype=np.uint64))
    return _mix(out ^ _mix(group.view(np.uint64))).view(np.int64)


def shared_sides(lines: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the least and the greatest number of bytes to the left that a stretch of PART bytes around
    the context holds which recurs in another line of the group (greatest -1: none does)."""
    first, same, times = _collapsed(lines, group)
    lines, group = lines[first], group[first]
    left, right = lines[:, -2].astype(np.int16), lines[:, -1].astype(np.int16)
    least, most = np.where(times > 1, PART - right, PART + 1).astype(np.int16), np.where(times > 1, left, -1).astype(np.int16)

    def transformed(picked: np.ndarray, ids: np.ndarray, l0: int, r0: int, width: int) -> None:
        x = np.minimum(left[picked] - l0, width)
        y = np.minimum(right[picked] - r0, width)
        windows = [lines[j, l0:l0 + a][::-1].tobytes() + lines[j, PART + r0:PART + r0 + b].tobytes()
                   for j, a, b in zip(picked.tolist(), x.tolist(), y.tolist())]
        owner, starts = repeated_starts(windows, ids.tolist(), x.tolist(), length=width, step=width if width % 2 else width // 2)
        before = (l0 + x[owner] - starts).astype(np.int16)
        np.minimum.at(least, picked[owner], before)
        np.maximum.at(most, picked[owner], before)

    # stretches of ``width`` bytes around a context that goes on l0 bytes to the left and r0 to the right
    todo = [(0, 0, PART, np.arange(len(lines)), group)]
    while todo:
        l0, r0, width, idx, ids = todo.pop()
        _, ids, n = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(ids, kind="stable")
        order = order[n[ids[order]] > 1]
        idx, ids, size = idx[order], ids[order], n[ids[order]]
        if not width:
            least[idx], most[idx] = np.minimum(least[idx], l0), np.maximum(most[idx], l0)
            continue
        crowded = size > BATCH // (2 * width)
        picked, own = idx[~crowded], ids[~crowded]
        at = 0
        while at < len(picked):
            # whole groups; one fits
            to = min(len(picked), at + BATCH // (2 * width))
            if to < len(picked):
                to = int(np.searchsorted(own, own[to]))
            transformed(picked[at:to], own[at:to], l0, r0, width)
            at = to
        idx, ids = idx[crowded], ids[crowded].astype(np.int64)
        if len(idx):
            half = width // 2
            more = right[idx] >= r0 + width - half
            todo.append((l0, r0 + width - half, half, idx[more], _by_context(ids[more], lines[idx[more], PART + r0:PART + r0 + width - half])))
            more = left[idx] >= l0 + half + 1
            todo.append((l0 + half + 1, r0, width - half - 1, idx[more], _by_context(ids[more], lines[idx[more], l0:l0 + half + 1])))
    return least[same], most[same]


def _runs(places: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """Stretches of texts, counted from places in them."""
    start = (places["cp"] & np.uint64(2**32 - 1)).astype(np.int64)
    return {"k8": np.ascontiguousarray(places["k8"]), "k4": (places["cp"] >> np.uint64(32)).astype(np.int64), "lo": start + lo, "hi": start + hi}


class _Crowds:
    """Lines of whole contexts; a place goes with a line unless all of the line is known to recur."""

    def __init__(self):
        self.lines, self.places, self.group, self.known, self.kept = bytearray(), bytearray(), array("q"), bytearray(), 0

    def __len__(self):
        return len(self.known)

    def add(self, group: int, outer: bytes, left: int, place: bytes) -> None:
        self.lines += _line(outer, left)
        self.places += place or bytes(_PLACE.itemsize)
        self.group.append(group)
        self.known.append(not place)

    def _arrays(self):
        return (np.frombuffer(bytes(self.lines), np.uint8).reshape(-1, 2 * PART + 2), np.frombuffer(bytes(self.places), _PLACE),
                np.array(self.group, np.int64), np.frombuffer(bytes(self.known), bool))

    def full(self) -> bool:
        return len(self) > 2 * self.kept + 50_000

    def collapse(self) -> dict[str, np.ndarray]:
        """Keeps one of equal lines, and gives the runs of their places."""
        lines, places, group, known = self._arrays()
        first, same, times = _collapsed(lines, group)
        own = (times > 1)[same] & ~known
        left, right = lines[own, -2].astype(np.int64), lines[own, -1].astype(np.int64)
        out = _runs(places[own], np.zeros(len(left), np.int64), left + right + LENGTH - PART)
        known = known[first] | (times > 1)
        self.lines, self.places = bytearray(lines[first].tobytes()), bytearray(places[first].tobytes())
        self.group, self.known = array("q", group[first].tobytes()), bytearray(known.tobytes())
        self.kept = len(self)
        return out

    def runs(self) -> dict[str, np.ndarray]:
        lines, places, group, known = self._arrays()
        least, most = shared_sides(lines, group)
        own = (most >= 0) & ~known
        left = lines[own, -2].astype(np.int64)
        return _runs(places[own], left - most[own], left - least[own] + LENGTH)


def _covered(windows: list[bytes], group: list[int], anchor: list[int], found: list[np.ndarray]) -> None:
    """Adds to ``found[i]`` the starts in window i that another window of its group shares."""
    owner, starts = repeated_starts(windows, group, anchor)
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    for a, b in zip(cut, np.r_[cut[1:], len(owner)]):
        found[owner[a]].append(starts[a:b])


class _Group:
    """Different windows of one anchor, with the places where each occurs."""

    def __init__(self, h: int):
        self.h, self.places = h, {}
        self.size = 0

    def add(self, window: bytes, anchor: int, places: bytes) -> None:
        got = self.places.get((window, anchor))
        if got is None:
            self.places[(window, anchor)] = [places]
            self.size += len(window)
        else:
            got.append(places)


def _marks(groups: list[_Group]) -> dict[str, np.ndarray] | None:
    """Stretches (k8, k4, lo, hi) that recur, for a number of whole groups."""
    keys, places, group = [], [], []
    for g in groups:
        for key, p in g.places.items():
            keys.append(key), places.append(np.frombuffer(b"".join(p), _PLACE)), group.append(g.h)
    found: list[list[np.ndarray]] = [[] for _ in keys]
    batch: list[int] = []
    size, i = 0, 0

    def run(picked: list[int]) -> None:
        if len(picked) > 1:
            _covered([keys[j][0] for j in picked], [group[j] for j in picked], [keys[j][1] for j in picked],
                     sink := [[] for _ in picked])
            for j, s in zip(picked, sink):
                found[j].extend(s)

    def run_crowded(mine: list[int]) -> None:
        contexts: dict[bytes, int] = {}
        lines, owner, at, ids = bytearray(), [], [], []
        for j in mine:
            for context, outer, left, off in _sides(*keys[j]):
                lines += _line(outer, left)
                owner.append(j), at.append(off + left), ids.append(contexts.setdefault(context, len(contexts)))
        least, most = shared_sides(np.frombuffer(bytes(lines), np.uint8).reshape(-1, 2 * PART + 2), np.array(ids, np.int64))
        for k in np.flatnonzero(most >= 0).tolist():
            found[owner[k]].append(at[k] - np.array([most[k], least[k]], np.int64))

    for g in groups:
        mine = list(range(i, i + len(g.places)))
        i += len(mine)
        if len(mine) < 2:
            continue
        if len(mine) > CROWD:
            run_crowded(mine)
            continue
        batch += mine
        size += g.size
        if size > BATCH:
            run(batch)
            batch, size = [], 0
    run(batch)
    out = []
    for (w, _), p, starts in zip(keys, places, found):
        if len(p) > 1:
            runs = [(0, len(w))]
        elif starts:
            s = np.unique(np.concatenate(starts))
            cut = np.flatnonzero(np.diff(s) > LENGTH)
            runs = list(zip(s[np.r_[0, cut + 1]].tolist(), (s[np.r_[cut, len(s) - 1]] + LENGTH).tolist()))
        else:
            continue
        start = (p["cp"] & np.uint64(2**32 - 1)).astype(np.int64)
        for lo, hi in runs:
            out.append((p["k8"], (p["cp"] >> np.uint64(32)).astype(np.int64), start + lo, start + hi))
    return dict(zip(("k8", "k4", "lo", "hi"), map(np.concatenate, zip(*out)))) if out else None


def repeated_stretches(texts: DataFrame) -> DataFrame:
    """(k8, k4, marks array<struct<lo, hi>>): what recurs of each text, overlaps included."""

    def cut(t: pa.Table) -> pa.Table:
        body, at = binary_view(t["text"])
        raw = body.tobytes()
        seen: dict[tuple, list] = {}
        k8, k4, hits = t["k8"].to_numpy(), t["k4"].to_numpy(), t["hits"].combine_chunks()
        pos, h, many = (hits.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("pos", "h", "many"))
        ends = np.r_[0, np.cumsum(hits.value_lengths().to_numpy())]
        for i in range(t.num_rows):
            for j in range(ends[i], ends[i + 1]):
                p = int(pos[j])
                lo = max(0, p - LEFT)
                window = raw[at[i] + lo:min(at[i] + p + LENGTH, at[i + 1])]
                seen.setdefault((int(h[j]), window, p - lo, bool(many[j])), []).append((int(k8[i]), (int(k4[i]) << 32) | lo))
        rows = []
        for (anchor, window, before, crowded), v in seen.items():
            if not crowded:
                rows.append((anchor, WINDOW, window, before, np.array(v, _PLACE).tobytes()))
                continue
            if len(v) > 1:  # all of it recurs here already
                rows.append((v[0][0], KNOWN, b"", len(window), np.array(v, _PLACE).tobytes()))
            for context, outer, left, off in _sides(window, before):
                key = hashlib.blake2b(context, digest_size=8).digest()
                place = struct.pack("<qQ", v[0][0], v[0][1] + off) if len(v) == 1 else b""
                rows.append((struct.unpack("<q", key)[0], SIDES, outer, left, place))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
            (pa.int64(), pa.int8(), pa.binary(), pa.int32(), pa.binary()))], ["h", "kind", "window", "anchor", "places"])

    def gather(batches):
        """Whole groups, as the rows come sorted by anchor or context, about a megabyte of windows at a time."""
        ready: list[_Group] = []
        now, crowds, size, last = None, _Crowds(), 0, None
        known: list[tuple[np.ndarray, int]] = []

        def flush():
            marks = _marks(ready)
            ready.clear()
            if marks:
                yield pa.RecordBatch.from_pydict(marks)

        for b in batches:
            for h, kind, w, a, p in zip(*(b[x].to_pylist() for x in ("h", "kind", "window", "anchor", "places"))):
                if kind == KNOWN:
                    known.append((np.frombuffer(p, _PLACE), a))
                    continue
                if kind == SIDES:
                    if h != last and len(crowds) > BATCH // (2 * PART):
                        yield pa.RecordBatch.from_pydict(crowds.runs())
                        crowds = _Crowds()
                    elif crowds.full():
                        yield pa.RecordBatch.from_pydict(crowds.collapse())
                    last = h
                    crowds.add(h, w, a, p)
                    continue
                if now is None or h != now.h:
                    if now is not None:
                        ready.append(now)
                        size += now.size
                        if size > 4 * BATCH:
                            yield from flush()
                            size = 0
                    now = _Group(h)
                now.add(w, a, p)
            if known:
                places, n = np.concatenate([p for p, _ in known]), [len(p) for p, _ in known]
                yield pa.RecordBatch.from_pydict(_runs(places, np.zeros(len(places), np.int64), np.repeat([a for _, a in known], n)))
                known.clear()
        if now is not None:
            ready.append(now)
            yield from flush()
        if len(crowds):
            yield pa.RecordBatch.from_pydict(crowds.runs())

    joined = texts.select("k8", "k4", "text").join(repeated_anchors(texts), ["k8", "k4"])
    windows = joined.mapInArrow(per_batch(cut, nbytes=2_000_000), "h long, kind byte, window binary, anchor int, places binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = windows.repartition(parts, "h").sortWithinPartitions("h")
    marks = sorted_.mapInArrow(gather, "k8 long, k4 long, lo long, hi long")
    return marks.groupBy("k8", "k4").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))


def cut_out(text: bytes, marks, copies: int) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed and the number of runs removed."""
    if copies > 1:
        return (b"", len(text), 1) if len(text) >= LENGTH else (text, 0, 0)
    if marks is None or not len(marks):
        return text, 0, 0
    kept, last, spans = [], 0, 0
    for lo, hi in sorted((m["lo"], m["hi"]) for m in marks):
        if lo > last or not spans:
            kept.append(text[last:lo])
            spans += 1
            last = hi
        else:
            last = max(last, hi)
    kept.append(text[last:])
    left = b"".join(kept)
    return left, len(text) - len(left), spans


def _digest(text: pd.Series, marks: pd.Series, copies: pd.Series) -> pd.DataFrame:
    out = []
    for t, m, c in zip(text, marks, copies):
        raw = t.encode()
        left, removed, spans = cut_out(raw, m, c)
        out.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _left(text: pd.Series, marks: pd.Series, copies: pd.Series) -> pd.Series:
    return pd.Series([cut_out(t.encode(), m, c)[0].decode(errors="ignore") for t, m, c in zip(text, marks, copies)])


def _found(docs: DataFrame) -> DataFrame:
    texts = stored_texts(docs)
    return texts.join(repeated_stretches(texts), ["k8", "k4"], "left")


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))), *columns)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is left, of every row."""
    digest = F.pandas_udf(_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = _found(docs).select("k8", "k4", digest("text", "marks", "copies").alias("d")).select("k8", "k4", "d.*")
    return _keyed(docs, "doc_id").join(out, ["k8", "k4"]).drop("k8", "k4")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows of documents with what is left of their texts; a character cut in two is dropped."""
    left = F.pandas_udf(_left, "string")
    out = _found(docs).select("k8", "k4", left("text", "marks", "copies").alias("text"))
    others = [c for c in docs.columns if c not in ("text", "n_chars", "k8", "k4")]
    joined = _keyed(docs, *others).join(out, ["k8", "k4"]).drop("k8", "k4")
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select([c for c in docs.columns if c in joined.columns])


def query(spark, sf_dir) -> DataFrame:
    """op7: what is left of every document without repeated stretches of 200 bytes."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


# All starts of 200 bytes, as 400 hexadecimal digits cut from pieces of a text, counted.
ORACLE = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
starts AS (
  SELECT row, b + j AS i, md5_number(substr(part, CAST(2 * j + 1 AS BIGINT), 400)) AS k
  FROM (SELECT row, b, part, unnest(range(least(500, n - 199 - b))) AS j
    FROM (SELECT row, n, b, substr(h, CAST(2 * b + 1 AS BIGINT), 1398) AS part
      FROM (SELECT row, n, h, unnest(range(0, n - 199, 500)) AS b FROM texts WHERE n >= 200)))),
again AS (SELECT row, i FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
cut AS (SELECT row, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS opens FROM again WINDOW w AS (PARTITION BY row ORDER BY i)),
numbered AS (SELECT row, i, sum(opens) OVER (PARTITION BY row ORDER BY i) AS run FROM cut),
runs AS (SELECT row, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY row, run),
gaps AS (SELECT row, lo, hi, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS after FROM runs),
kept AS (
  SELECT row, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last,
    string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (lo - after) AS BIGINT)), '' ORDER BY lo) AS left_over
  FROM gaps JOIN texts USING (row) GROUP BY row)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_over, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM texts LEFT JOIN kept USING (row)
"""
