"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text becomes a short vector of statistics (length, repetition, character mix), each put on a
log or log-odds scale.  Class moments are sums, so all labelled rows take part and each task sends one
small matrix per class.  A class covariance is shrunk towards the pooled one and that towards its
diagonal; its Cholesky factor is computed once and cached in the model.  The score is the logistic of the
difference of the two log densities plus the log prior ratio.

Defined cases: null and empty texts have the statistics of an empty text; a label that is neither 0 nor 1
is not used; a document labelled twice counts twice; with labels of one class only every document gets
that class, with none a score of 0.5; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import binary_view, id_remainder, per_batch, table
from marketlab.session import materialize

NAMES = ("words", "word_bytes", "distinct", "top_word", "repeats", "lines", "line_repeats", "upper", "digits",
         "symbols", "stops", "commas", "longest", "spaces")


def _byte_classes() -> np.ndarray:
    """(256, 6) indicators: upper case, digit, symbol, sentence end, comma, white space."""
    out = np.zeros((256, 6))
    for b in range(128):
        c = chr(b)
        out[b] = (c.isupper(), c.isdigit(), not c.isalnum() and not c.isspace() and c not in ".!?,", c in ".!?", c == ",", c.isspace())
    return out


_CLASSES = _byte_classes()


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    words = text.split()
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    upper, digits, symbols, stops, commas, spaces = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES).tolist()

    def odds(part, whole, prior=0.5):
        return float(np.log((part + prior) / (whole - part + prior)))

    size = len(text)
    return [
        float(np.log1p(n)), float(np.log1p((size - spaces) / n if n else 0)), odds(len(counts), n),
        odds(max(counts.values(), default=0), n), odds(sum(map(eq, words, words[1:])), n),
        float(np.log1p(len(lines))), odds(len(lines) - len(set(lines)), len(lines)),
        odds(upper, size), odds(digits, size), odds(symbols, size), odds(stops, size), odds(commas, size),
        float(np.log1p(max(map(len, counts), default=0))), odds(spaces, size),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row."""

    def run(t: pa.Table) -> pa.Table:
        body, at = binary_view(t["text"])
        raw = body.tobytes()
        x = [statistics(raw[at[i]:at[i + 1]]) for i in range(t.num_rows)]
        return pa.table({"doc_id": t["doc_id"], "x": pa.array(x, pa.list_(pa.float64()))})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(per_batch(run), "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Standardisation, class means, inverse Cholesky factors and constants; ``fixed`` where no fit is possible."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    roots: np.ndarray
    constants: np.ndarray
    fixed: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        z = (x - self.centre) / self.scale
        log = [c - 0.5 * (((z - m) @ r.T) ** 2).sum(axis=1) for m, r, c in zip(self.means, self.roots, self.constants)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit on ``labelled(x, y)``; a covariance is (1-ridge)((1-shrink) own + shrink pooled) + ridge diagonal."""
    p = len(NAMES)

    def moments(batches):
        for b in batches:
            x = np.array(b["x"].tolist(), dtype=float).reshape(-1, p)
            y = b["y"].to_numpy()
            for k in (0, 1):
                one = np.c_[np.ones((y == k).sum()), x[y == k]]
                m = one.T @ one
                i, j = np.nonzero(m)
                yield pd.DataFrame({"k": k, "i": i, "j": j, "v": m[i, j]})

    sums = labelled.mapInPandas(moments, "k long, i long, j long, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    m = np.zeros((2, p + 1, p + 1))
    for r in sums.collect():  # two matrices of one row and column for each statistic
        m[r.k, r.i, r.j] = r.v
    n = m[:, 0, 0]
    empty = np.zeros(p)
    if min(n) < 2:
        fixed = 0.5 if max(n) == 0 else float(n[1] > n[0])
        return Discriminant(empty, empty + 1, np.zeros((2, p)), np.zeros((2, p, p)), np.zeros(2), fixed)
    total = m.sum(axis=0)
    centre = total[0, 1:] / total[0, 0]
    scale = np.sqrt(np.maximum(np.diag(total[1:, 1:] / total[0, 0] - np.outer(centre, centre)), 1e-6))
    means = m[:, 0, 1:] / n[:, None]
    covariances = np.array([m[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]) / np.outer(scale, scale)
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    roots, constants = [], []
    for k in (0, 1):
        mixed = (1 - shrink) * covariances[k] + shrink * pooled
        mixed = (1 - ridge) * mixed + ridge * np.diag(np.maximum(np.diag(pooled), 1e-3)) + 1e-6 * np.eye(p)
        factor = np.linalg.cholesky(mixed)
        roots.append(np.linalg.inv(factor))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, (means - centre) / scale, np.array(roots), np.array(constants))


def train(docs: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> tuple[DataFrame, Discriminant]:
    """Stored statistics (doc_id, x, held_out) of all rows and the model fitted on those not held out."""
    held = id_remainder(F.col("doc_id"), 3) == 1
    rows = materialize(with_statistics(docs).withColumn("held_out", held), "quality_statistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    return rows, fit(rows.where("not held_out").join(marks, "doc_id").select("x", "y"), shrink, ridge)


def classify(docs: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rows with ``held_out`` take no part in the fit."""
    rows, model = train(docs, labels, shrink, ridge)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(-1, len(NAMES))))

    return rows.withColumn("score", score("x")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, whose score is at least ``least``; no row is moved for it."""
    _, model = train(docs, labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = [statistics((t or "").encode()) for t in text]
        return pd.Series(model.score(np.array(x, dtype=float).reshape(-1, len(NAMES))))

    return docs.where(score(F.col("text").cast("string")) >= least)


def query(spark, sf_dir) -> DataFrame:
    """op4: quality of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
