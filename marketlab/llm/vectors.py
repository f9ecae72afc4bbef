"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into halves and each half has a codebook of its own; the pairs of codewords form the
grid of cells.  Every vector is indexed in its nearest cell.  As a query it visits its nearest cells in
multi-sequence order (by the sum of both distances) and is compared in double precision with all vectors
of its label that are indexed there.  How many cells are visited follows from the data: links of a bounded
sample of queries against all rows are found by brute force, and the number of cells is the least that
reaches the target recall.

Equal vectors of a label are one class.  Crowded cells are cut into parts on both sides, so a task has at
most ``part`` vectors against ``part`` others.  A task returns link counts and a forest of its links, never
its pairs.

Vectors of different lengths never link; each length has an index of its own.

Defined cases: rows whose label is null, or whose vector is null, empty, zero, or has null or non-finite
components link with nothing; a null id is counted as a partner but never
names a component and is not kept; rows that repeat an id are vectors of their own; an empty table gives
no rows.  Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import per_batch, table
from marketlab.llm.components import components, forest
from marketlab.session import materialize


def unit(embeddings: pa.ChunkedArray | pd.Series) -> np.ndarray:
    """Rows scaled to length 1; their greatest component is made 1 first, so squares stay finite."""
    if isinstance(embeddings, pd.Series):
        x = np.array(embeddings.tolist(), dtype=np.float64)
    else:
        flat = embeddings.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(embeddings), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), size=int((n == 0).sum()))]
    return c


@dataclass
class MultiIndex:
    """Two codebooks, the number of cells that a query visits, and the recall measured with it."""

    first: np.ndarray
    second: np.ndarray
    visit: int = 1
    recall: float = 1.0

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row in multi-sequence order.

        A cell at ranks (r, s) of the two sorted lists is preceded by every cell at lower ranks, so only
        ranks with (r + 1)(s + 1) <= n can be among the first n.
        """
        half = x.shape[1] // 2
        ranked = []
        for c, part in ((self.first, x[:, :half]), (self.second, x[:, half:])):
            d = (part * part).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * part @ c.T
            order = np.argsort(d, axis=1, kind="stable")
            ranked.append((order, np.take_along_axis(d, order, axis=1)))
        r, s = np.array([(r, s) for r in range(min(len(self.first), n)) for s in range(min(len(self.second), n // (r + 1)))]).T
        scores = ranked[0][1][:, r] + ranked[1][1][:, s]
        best = np.argsort(scores, axis=1, kind="stable")[:, :n]
        return (np.take_along_axis(ranked[0][0][:, r], best, axis=1) * len(self.second)
                + np.take_along_axis(ranked[1][0][:, s], best, axis=1)).astype(np.int32)


def _valid(rows: DataFrame) -> DataFrame:
    """Rows that can link."""
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    return rows.where(F.coalesce(usable, F.lit(False)))


def fit(classes: DataFrame, similarity: float, recall: float = 0.9999, sample: int = 20_000, queries: int = 500, cell_rows: int = 1500) -> MultiIndex:
    """Codebooks from at most ``sample`` vectors; cells to visit from ``queries`` of them against all rows."""
    picked = classes.select("node", "label", "embedding").orderBy(F.xxhash64("node"), "node").limit(sample).toPandas()
    if not len(picked):
        return MultiIndex(np.zeros((1, 1)), np.zeros((1, 1)))
    n = classes.count()
    k = int(min(256, len(picked), max(2, np.ceil(np.sqrt(n / cell_rows)))))
    x = unit(picked["embedding"])
    half = x.shape[1] // 2
    if not half:
        k = 1  # nothing to cut
    index = MultiIndex(k_means(x[:, :half], k), k_means(x[:, half:], k))
    if index.cells == 1:
        return index
    q, q_node, q_label = x[:queries], picked["node"].to_numpy()[:queries], picked["label"].to_numpy()[:queries]
    deep = min(64, index.cells)
    while True:
        theirs = index.nearest(q, deep)

        def ranks(t: pa.Table) -> pa.Table:
            b = unit(t["embedding"])
            close = b @ q.T >= similarity
            close &= (t["label"].to_numpy()[:, None] == q_label[None, :]) & (t["node"].to_numpy()[:, None] != q_node[None, :])
            i, j = np.nonzero(close)
            mine = index.nearest(b[i], deep) if len(i) else np.zeros((0, deep), np.int32)
            there = theirs[j] == mine[:, :1]
            back = mine == theirs[j][:, :1]
            at = np.minimum(*(np.where(m.any(axis=1), m.argmax(axis=1), deep) for m in (there, back)))
            return pa.table({"rank": pa.array(at.astype(np.int64))}).group_by("rank").aggregate([([], "count_all")]).rename_columns(["rank", "n"])

        found = (classes.select("node", "label", "embedding").mapInArrow(per_batch(ranks), "rank long, n long")
                 .groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").toPandas())  # deep + 1 rows
        total = found["n"].sum()
        reached = found["rank"].to_numpy()[np.cumsum(found["n"].to_numpy()) >= recall * total] if total else np.array([3])
        if reached[0] < deep or deep == index.cells:
            index.visit = int(min(index.cells, reached[0] + 1))
            index.recall = float(found["n"][found["rank"] < index.visit].sum() / total) if total else 1.0
            return index
        deep = min(4 * deep, index.cells)


def _compare(similarity: float, block: int = 512):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        home, guest = rows[~rows["guest"]], rows[rows["guest"]]
        if not len(home) or not len(guest):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x = unit(home["embedding"])
        h_node, h_m = home["node"].to_numpy(), home["m"].to_numpy()
        h_visit = np.array(home["visit"].tolist())
        g_all, g_node, g_m, g_home = guest["embedding"], guest["node"].to_numpy(), guest["m"].to_numpy(), guest["home"].to_numpy()
        h_links, left, right = np.zeros(len(home), np.int64), [], []
        g_links = np.zeros(len(guest), np.int64)
        for s in range(0, len(guest), block):
            g = slice(s, min(s + block, len(guest)))
            i, j = np.nonzero(unit(g_all.iloc[g]) @ x.T >= similarity)
            i += s
            # a pair that both sides find counts where the guest has the lower number
            both = (h_visit[j] == g_home[i][:, None]).any(axis=1)
            once = (g_node[i] != h_node[j]) & (~both | (g_node[i] < h_node[j]))
            i, j = i[once], j[once]
            h_links += np.bincount(j, weights=g_m[i], minlength=len(home)).astype(np.int64)
            g_links += np.bincount(i, weights=h_m[j], minlength=len(guest)).astype(np.int64)
            a, b = forest(g_node[i], h_node[j])
            left.append(a), right.append(b)
        a, b = forest(np.concatenate(left), np.concatenate(right))
        node = np.concatenate([h_node, g_node])
        n = np.concatenate([h_links, g_links])
        some = n > 0
        return pd.DataFrame({"a": np.r_[a, node[some]], "b": np.r_[b, node[some]], "n": np.r_[np.zeros(len(a), np.int64), n[some]]})

    return run


def find_links(classes: DataFrame, index: MultiIndex, similarity: float, part: int = 4096) -> DataFrame:
    """Rows (a, b, 0) for the edges of a forest of the links and (a, a, n) for link counts of a class."""

    def place(t: pa.Table) -> pa.Table:
        visit = index.nearest(unit(t["embedding"]), index.visit)
        flat = pa.array(visit.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, index.visit, dtype=np.int32)), flat)
        return t.append_column("home", pa.array(visit[:, 0])).append_column("visit", lists)

    columns = "node long, label long, embedding array<double>, m long"
    placed = classes.select("node", "label", F.col("embedding"), "m").mapInArrow(per_batch(place), f"{columns}, home int, visit array<int>")
    placed = materialize(placed, "placed")
    visits = placed.withColumn("cell", F.explode("visit"))
    # parts of each cell on both sides: one row for each label and cell
    homes = placed.groupBy("label", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    guests = visits.groupBy("label", "cell").agg(F.ceil(F.count("*") / part).cast("int").alias("guest_parts"))
    cells = materialize(homes.join(guests, ["label", "cell"]), "cells")
    share = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = placed.withColumn("cell", F.col("home")).join(cells, ["label", "cell"]).withColumn("p", share("parts")).withColumn("g", every("guest_parts"))
    guest = visits.withColumn("visit", F.lit(None).cast("array<int>")).join(cells, ["label", "cell"]).withColumn(
        "g", share("guest_parts")).withColumn("p", every("parts"))
    both = home.withColumn("guest", F.lit(False)).unionByName(guest.withColumn("guest", F.lit(True)))
    return both.groupBy("label", "cell", "p", "g").applyInPandas(_compare(similarity), "a long, b long, n long")


def near_duplicates(rows: DataFrame, similarity: float = 0.93, recall: float = 0.9999, sample: int = 20_000, part: int = 4096,
                    exact: bool = False) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    With ``exact`` a query visits every cell of its label, and no link is lost.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    good = _valid(rows)
    classes = good.groupBy("label", "embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.min("row").alias("node"))
    classes = materialize(classes, "vector_classes")
    links = None
    for length in sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect()) or [0]:  # numbers, one as a rule
        own = classes.where(F.size("embedding") == length)
        index = fit(own, similarity, recall, sample)
        if exact:
            index.visit = index.cells
        more = find_links(own, index, similarity, part)
        links = more if links is None else links.unionByName(more)
    links = materialize(links, "links")
    linked = components(links.where("a <> b").select("a", "b"))
    counts = links.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    classes = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "component").join(counts, "node", "left").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id", "node")
    # a row finds its class by label and vector; one that links with nothing finds none
    known = good.join(classes, ["label", "embedding"]).select("row", "n_links", "component_id")
    out = rows.select("row", "vec_id").join(known, "row", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir) -> DataFrame:
    """op10: links and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id
"""
