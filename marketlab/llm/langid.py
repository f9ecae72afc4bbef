"""Language identification as a mixture: languages of a document and their shares.

Training counts byte trigrams inside words for each language, hashed into a fixed number of buckets, so
the model has a proven size (buckets x languages) and can go to every task.  A document is a bag of words,
each written in one language: expectation-maximisation estimates the shares of the languages from the
words' n-gram likelihoods.  Which languages take part is a penalised likelihood choice: starting from the
best single one, the next is added while the gain exceeds half the logarithm of the number of words for
each further share.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing
can be learned; rows without a language are predicted but not learned from; repeated rows are predicted
alike; an empty table gives no rows.  Only ``doc_id``, ``text`` and ``lang`` are read, the last one in
training only.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import binary_view, id_remainder, per_batch, table

BUCKETS = 1 << 16
UNKNOWN = "und"
_ASCII = re.compile("[A-Za-z]")
_WORD = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def has_letter(text: str) -> bool:
    return bool(_ASCII.search(text)) or any(c.isalpha() for c in text)


def trigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around every word byte; start of each word in it; words of each document."""
    body, at = binary_view(pc.utf8_lower(column))
    n = len(at) - 1
    # one blank after each document keeps words apart
    shifted = at + np.arange(n + 1)
    padded = np.full(shifted[-1] + 2, 32, dtype=np.uint8)
    padded[1 + np.arange(len(body)) + np.repeat(np.arange(n), np.diff(at))] = body
    word = _WORD[padded]
    padded = np.where(word, padded, 32).astype(np.uint32)
    pos = np.flatnonzero(word)
    code = (padded[pos - 1] << np.uint32(16)) | (padded[pos] << np.uint32(8)) | padded[np.minimum(pos + 1, len(padded) - 1)]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(16)
    first = np.flatnonzero(~word[pos - 1]) if len(pos) else pos
    owner = np.searchsorted(shifted + 1, pos[first], side="right") - 1
    return bucket, first, np.bincount(owner, minlength=n)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets, languages), from all rows that have a language."""
    learn = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(t: pa.Table) -> pa.Table:
        coded = t["lang"].combine_chunks().dictionary_encode()
        bucket, first, words = trigrams(t["text"])
        lang = np.asarray(coded.indices).astype(np.int64)
        of_word = np.repeat(lang, words)
        each = np.repeat(of_word, np.diff(np.r_[first, len(bucket)]))
        n = np.bincount(each * BUCKETS + bucket, minlength=1)
        at = np.flatnonzero(n)
        return pa.table({"lang": coded.dictionary.take(pa.array(at // BUCKETS)), "bucket": pa.array(at % BUCKETS), "n": pa.array(n[at].astype(np.int64))})

    counts = (learn.mapInArrow(per_batch(count, nbytes=4_000_000), "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # buckets x languages at most
    names = sorted(counts["lang"].unique())
    c = np.zeros((BUCKETS, len(names)))
    c[counts["bucket"].to_numpy(dtype=np.int64), np.searchsorted(names, counts["lang"].to_numpy(dtype=str))] = counts["n"].to_numpy(dtype=float)
    smoothed = c + 0.05
    return names, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32) if names else c


def mixture(p: np.ndarray, words: np.ndarray, allowed: np.ndarray, steps: int = 30, tol: float = 1e-3):
    """Shares (documents, languages) and log-likelihoods for word likelihoods ``p``, scaled to a maximum of 1.

    ``allowed`` marks the languages that each document may use.
    """
    at = np.r_[0, np.cumsum(words)[:-1]]
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        r = np.repeat(pi, words, axis=0) * p
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(r, at, axis=0) / words[:, None]
        moved = np.abs(new - pi).max()
        pi = new
        if moved < tol:
            break
    mix = (np.repeat(pi, words, axis=0) * p).sum(axis=1)
    return pi, np.add.reduceat(np.log(np.maximum(mix, 1e-300)), at)


def shares(log_p: np.ndarray, bucket: np.ndarray, first: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Shares of the chosen languages of each document; all zero where it has no words."""
    n_langs = log_p.shape[1]
    out = np.zeros((len(words), n_langs))
    full = np.flatnonzero(words)
    if not len(full) or not n_langs:
        return out
    w = words[full]
    at = np.r_[0, np.cumsum(w)[:-1]]
    ll = np.add.reduceat(log_p[bucket], first, axis=0).astype(np.float64)
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(ll - top, -60))
    single = np.add.reduceat(np.log(p), at, axis=0)
    chosen = np.zeros((len(full), n_langs), dtype=bool)
    chosen[np.arange(len(full)), single.argmax(axis=1)] = True
    best = single.max(axis=1)
    pi = chosen.astype(float)
    open_pi, _ = mixture(p, w, np.ones_like(chosen))
    active = np.arange(len(full))
    for _ in range(min(most, n_langs) - 1):
        rest = np.where(chosen[active], -1.0, open_pi[active])
        more = chosen[active].copy()
        more[np.arange(len(active)), rest.argmax(axis=1)] = True
        sel = np.isin(np.repeat(np.arange(len(full)), w), active) if len(active) < len(full) else slice(None)
        new, like = mixture(p[sel], w[active], more)
        gain = like - best[active] > 0.5 * np.log(w[active] + 1.0) + 1.0
        active = active[gain]
        chosen[active], best[active], pi[active] = more[gain], like[gain], new[gain]
        if not len(active):
            break
    out[full] = pi
    return out


def identify(docs: DataFrame, names: list[str], log_p: np.ndarray, most: int = 4) -> DataFrame:
    """(doc_id, lang_pred, score, langs) of every row: main language, its share, all chosen ones."""

    def run(t: pa.Table) -> pa.Table:
        bucket, first, words = trigrams(t["text"])
        pi = shares(log_p, bucket, first, words, most)
        pred, score, langs = [], [], []
        for text, row in zip(t["text"].to_pylist(), pi):
            k = int(row.argmax()) if len(row) else 0
            if text is None or not len(row) or row[k] <= 0 or not has_letter(text):
                pred.append(UNKNOWN), score.append(0.0), langs.append([])
            else:
                pred.append(names[k]), score.append(min(1.0, float(row[k])))
                langs.append([names[j] for j in np.flatnonzero(row > 0)])
        return pa.table({"doc_id": t["doc_id"], "lang_pred": pred, "score": score, "langs": pa.array(langs, pa.list_(pa.string()))})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(per_batch(run, nbytes=1_000_000), "doc_id long, lang_pred string, score double, langs array<string>")


def query(spark, sf_dir) -> DataFrame:
    """op2: language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 5) == 0
    names, log_p = train(docs.where(~held))
    return identify(docs, names, log_p).select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs")
