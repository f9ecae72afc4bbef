"""SimHash near-dedup: fingerprints of word shingles, tiled exact comparison within a Hamming radius.

Equal fingerprints collapse into one class first.  Classes are dealt into tiles of one population count
each; a tile is compared only with tiles whose population count differs by no more than the radius, since
every differing bit changes the count by one.  Inside a pair of tiles the same bound is applied to the
counts of the four 16-bit quarters, and what is left is compared with exclusive-or and bit counts in
numpy.  Links of a block are reduced to a forest before they leave the task, so a large group of near
copies never becomes all its pairs.

Defined cases: null, empty and blank texts have fingerprint zero; fewer words than a shingle make one
shingle; a null id takes part but never names a component; repeated rows are returned as often as they
occur; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import binary_view, per_batch, table
from marketlab.llm.components import components, forest
from marketlab.session import materialize

SEED = 42
TILE = 65_536
_EACH = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every shingle; the whole sequence where it is shorter; nothing without words."""
    found = text.lower().split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) < words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.r_[0, ends[:-words]].tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[s:e], SEED) for s, e in zip(starts, (ends[words - 1:] - 1).tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes of each document; ``counts`` hashes belong to each."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.r_[0, np.cumsum(n)[:-1]]
    # byte counters hold up to 255, so documents are summed in runs of that length
    runs = -(-n // 255)
    run_of = np.repeat(np.arange(len(n)), runs)
    first = np.r_[0, np.cumsum(runs)[:-1]]
    at = starts[run_of] + 255 * (np.arange(len(run_of)) - first[run_of])
    found = np.zeros(len(n), dtype=np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _EACH, at)
        for byte in range(8):
            part = ((lanes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            over = 2 * np.add.reduceat(part, first) > n
            found |= over.astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = found
    return out


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(t: pa.Table) -> pa.Table:
        body, at = binary_view(t["text"])
        raw = body.tobytes()
        hashes, counts = [], np.zeros(t.num_rows, dtype=np.int64)
        for i in range(t.num_rows):
            found = shingle_hashes(raw[at[i]:at[i + 1]], words)
            counts[i] = len(found)
            hashes.append(np.array(found, dtype=np.uint64))
        fp = majority(np.concatenate(hashes), counts)
        return pa.table({"doc_id": t["doc_id"], "fp": pa.array(fp.view(np.int64))})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(per_batch(run, nbytes=2_000_000), "doc_id long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    parts = fp.view(np.uint16).reshape(-1, 4)
    return np.bitwise_count(parts).astype(np.int8)


def _cells(fp: np.ndarray):
    """Fingerprints in order of their quarter counts; the counts and bounds of each cell."""
    q = _quarters(fp)
    key = q.astype(np.int64) @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(key, kind="stable")
    fp, q, key = fp[order], q[order], key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return fp, q[at], np.r_[at, len(fp)]


def compare(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles, or within one."""
    a, qa, ea = _cells(a)
    own = b is None
    b, qb, eb = (a, qa, ea) if own else _cells(b)
    sizes = np.diff(eb)
    left, right = [], []
    for c in range(len(qa)):
        near = np.abs(qb - qa[c]).sum(axis=1) <= radius
        if own:
            near[:c] = False
        if not near.any():
            continue
        others = b[np.repeat(near, sizes)]
        step = max(1, block // len(others))
        for s in range(ea[c], ea[c + 1], step):
            rows = a[s:min(s + step, ea[c + 1])]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ others[None, :]) <= radius)
            x, y = rows[i], others[j]
            other = x != y
            if other.any():
                x, y = forest(x[other].view(np.int64), y[other].view(np.int64))
                left.append(x)
                right.append(y)
    if not left:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return forest(np.concatenate(left), np.concatenate(right))


def near_links(classes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that join all distinct ``fp`` within the radius; not every pair."""
    pop = F.bit_count("fp")
    # 65 counts at most: how many tiles each population count needs
    tiles = {int(p): -(-int(n) // tile) for p, n in classes.groupBy(pop.alias("pop")).count().collect()}
    partners = {}
    for p, n in tiles.items():
        for i in range(n):
            partners[(p, i)] = [(q, j) for q in range(p - radius, p + radius + 1) for j in range(tiles.get(q, 0))]

    def pack(key, rows):
        blob = rows["fp"].to_numpy().tobytes()
        me = (int(key[0]), int(key[1]))
        pairs = [min((me, other), (other, me)) for other in partners[me]]
        return pd.DataFrame({"pair": [f"{x}-{y}" for x, y in pairs], "own": [x == y for x, y in pairs],
                             "fps": [blob] * len(pairs)})

    def match(key, rows):
        tiles_ = [np.frombuffer(x, dtype=np.uint64) for x in rows["fps"]]
        a, b = compare(tiles_[0], None if rows["own"].iloc[0] else tiles_[1], radius)
        return pd.DataFrame({"a": a, "b": b})

    counts = F.create_map(*[F.lit(x) for kv in tiles.items() for x in kv]) if tiles else F.create_map(F.lit(0), F.lit(1))
    dealt = classes.select("fp", pop.alias("pop")).withColumn("part", F.pmod(F.xxhash64("fp"), counts[F.col("pop")]))
    packed = dealt.groupBy("pop", "part").applyInPandas(pack, "pair string, own boolean, fps binary")
    return packed.groupBy("pair").applyInPandas(match, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (least id reachable), n_class, n_component."""
    fps = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_class")), "classes")
    linked = components(near_links(classes, radius))
    classes = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    whole = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n_class").alias("n_component"))
    classes = classes.join(whole, "component").select("fp", "component_id", "n_class", "n_component")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id", "n_class", "n_component")


# --- similar documents: wider fingerprints for a similarity of shingle sets ----------------

LANES = 4  # fingerprints of 64 bits each, from independent mixtures of the same shingle hashes
_WIDE = np.dtype([("fp", "<u8"), ("more", "<u8", LANES - 1), ("node", "<i8")])


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, node, fp, f1, f2, f3) of every row; node stands for all four fingerprints."""

    def mixed(h: np.ndarray, lane: int) -> np.ndarray:
        if not lane:
            return h
        x = h + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(t: pa.Table) -> pa.Table:
        body, at = binary_view(t["text"])
        raw = body.tobytes()
        found = [np.array(shingle_hashes(raw[at[i]:at[i + 1]], words), dtype=np.uint64) for i in range(t.num_rows)]
        h, counts = np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)
        lanes = [majority(mixed(h, k), counts).view(np.int64) for k in range(LANES)]
        return pa.table({"doc_id": t["doc_id"], **{name: pa.array(x) for name, x in zip(("fp", "f1", "f2", "f3"), lanes)}})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = picked.mapInArrow(per_batch(run, nbytes=2_000_000), "doc_id long, fp long, f1 long, f2 long, f3 long")
    return out.withColumn("node", F.xxhash64("fp", "f1", "f2", "f3"))


def allowed_bits(similarity: float, spread: float = 2.3) -> tuple[int, int]:
    """Differing bits of the first fingerprint and of all that still count as similar.

    Sets of Jaccard similarity s have a cosine of 2s / (1 + s); each bit differs with the share
    that the angle has of a half turn.  ``spread`` standard deviations are added, so a pair at the
    bound is missed about once in a hundred, and pairs somewhat below it pass.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)

    def most(bits: int) -> int:
        return int(bits * p + spread * np.sqrt(bits * p * (1 - p)))

    return most(64) + 1, most(64 * LANES)


def compare_wide(a: np.ndarray, b: np.ndarray | None, first: int, whole: int, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the similar pairs of two tiles, or within one: the first fingerprint, then all."""
    own = b is None
    b = a if own else b
    fa, fb = np.ascontiguousarray(a["fp"]), np.ascontiguousarray(b["fp"])
    step = max(1, block // max(1, len(b)))
    left, right = [], []
    differing, bits = np.empty((step, len(b)), np.uint64), np.empty((step, len(b)), np.uint8)  # stay in the cache
    for s in range(0, len(a), step):
        k = min(step, len(a) - s)
        np.bitwise_xor(fa[s:s + k, None], fb[None, :], out=differing[:k])
        np.bitwise_count(differing[:k], out=bits[:k])
        i, j = np.divmod(np.flatnonzero(bits[:k] <= first), len(b))
        i += s
        if own:
            i, j = i[i < j], j[i < j]
        far = np.bitwise_count(fa[i] ^ fb[j]).astype(np.int64) + np.bitwise_count(a["more"][i] ^ b["more"][j]).sum(axis=1, dtype=np.int64)
        near = far <= whole
        x, y = forest(a["node"][i[near]], b["node"][j[near]])
        left.append(x)
        right.append(y)
    return forest(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = 16_384) -> DataFrame:
    """(doc_id, component_id) of every row: groups of documents whose shingle sets are similar.

    Tiles, bounds on the population count and forests are those of ``near_duplicates``; the
    similarity is the estimate of 256 bits (see ``allowed_bits``), not a count of shared shingles.
    """
    first, whole = allowed_bits(similarity)
    fps = materialize(wide_fingerprints(docs, words), "wide_fingerprints")
    classes = materialize(fps.groupBy("node", "fp", "f1", "f2", "f3").agg(F.min("doc_id").alias("least")), "wide_classes")
    pop = F.bit_count("fp")
    tiles = {int(p): -(-int(n) // tile) for p, n in classes.groupBy(pop.alias("pop")).count().collect()}  # 65 counts at most
    counts = F.create_map(*[F.lit(x) for kv in tiles.items() for x in kv]) if tiles else F.create_map(F.lit(0), F.lit(1))

    def pack(key, rows):
        rec = np.empty(len(rows), _WIDE)
        rec["fp"] = rows["fp"].to_numpy().view(np.uint64)
        rec["more"] = rows[["f1", "f2", "f3"]].to_numpy().view(np.uint64)
        rec["node"] = rows["node"].to_numpy()
        me, blob = (int(key[0]), int(key[1])), rec.tobytes()
        others = [(q, j) for q in range(me[0] - first, me[0] + first + 1) for j in range(tiles.get(q, 0))]
        pairs = [min((me, other), (other, me)) for other in others]
        return pd.DataFrame({"pair": [f"{x}-{y}" for x, y in pairs], "own": [x == y for x, y in pairs], "fps": [blob] * len(pairs)})

    def match(key, rows):
        got = [np.frombuffer(x, _WIDE) for x in rows["fps"]]
        a, b = compare_wide(got[0], None if rows["own"].iloc[0] else got[1], first, whole)
        return pd.DataFrame({"a": a, "b": b})

    dealt = classes.select("node", "fp", "f1", "f2", "f3", pop.alias("pop")).withColumn("part", F.pmod(F.xxhash64("node"), counts[F.col("pop")]))
    packed = dealt.groupBy("pop", "part").applyInPandas(pack, "pair string, own boolean, fps binary")
    linked = components(packed.groupBy("pair").applyInPandas(match, "a long, b long"))
    classes = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("node", "component_id")
    return fps.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that name their group: one for each group of similar documents.

    Of rows that repeat an id one stays; rows without an id stay.
    """
    found = similar_documents(docs, words, similarity)
    # stored, so that Spark knows their size: few ids are sent to the rows, many are joined by hash
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near_duplicates")
    twice = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated_ids")
    kept = docs.join(gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    again = kept.join(twice, "doc_id", "left_semi")
    first = again.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))).where("_n = 1")
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(first.select(docs.columns))


def query(spark, sf_dir) -> DataFrame:
    """op1: fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
