"""Katz back-off language model: Good-Turing discounted counts with exactly normalised back-off weights.

Tokens are lower-cased words and one end mark for each document.  Pairs of words back off to single words:

    P(w | u) = d(c) c(u, w) / c(u)   if the pair was seen c times
             = a(u) P(w)             else, with a(u) such that the sum over all words is 1

Words that hold at least ``SHARE`` of the training tokens are classes of their own, so there are at most
1 / SHARE of them whatever the corpus, and what every task has to hold is bounded.  P(w) is the share of its
class; the other words are rare and have (c(w) + 1) / (N_rare + V_rare + 1) of the share of all rare words,
one word that was never seen included.  Pairs with a rare word are counted like all others; they lie in the
bucket of that word, since no rare word has many.

Counts are kept in tables of hash buckets, one row for each bucket, sorted by key.  The corpus is read
three times: for words, for pairs and for scores.  A pair with a rare word is scored as unseen by its two words,
and its bucket adds what it gains by having been seen.  In the last pass a task scores on its own what the
bounded part of the model decides (classes, and pairs that hold at least ``HOT`` of all) and sends the
rest, one entry for each key and document, to the bucket of its key; what comes back is sums by document.
So no key that is frequent anywhere is ever gathered in one place.

Words are known by 64-bit hashes.  Defined cases: a null or empty text is a single end mark; without
training documents every score follows from the two floors of the class distribution; repeated rows count
each; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import id_remainder, per_batch, table
from marketlab.session import intermediates_mark, materialize, settle

SHARE, HOT = 2.0**-19, 2.0**-17  # of words that are classes, of pairs that every task holds
K = 5
RARE, END = 0, 1
END_HASH = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word contains a blank
START_HASH = np.uint64(xxhash.xxh64_intdigest(b" start"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """Token codes of a piece in order, the document of each, and the hash of each code."""

    codes: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    n_docs: int


def tokenise(column: pa.ChunkedArray) -> Tokens:
    text = pc.fill_null(column.combine_chunks().cast(pa.large_string()), "")
    n = len(text)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[some.to_numpy(zero_copy_only=False)]
    coded = flat.filter(some).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(w) for w in words], dtype=np.uint64)
    codes = np.empty(len(owner) + n, dtype=np.int64)
    at_end = np.cumsum(np.bincount(owner, minlength=n)) + np.arange(n)
    codes[np.arange(len(owner)) + owner] = coded.indices.to_numpy()
    codes[at_end] = len(words)
    doc = np.repeat(np.arange(n), np.diff(np.r_[-1, at_end]))
    return Tokens(codes, doc, np.append(hashes, END_HASH), n)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of ``n`` for each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(33)).astype(np.int64) % buckets


COUNTED = "bucket int, keys binary, counts binary"
STORED = COUNTED + ", types long, total long, seldom array<long>"


def _by_bucket(keys: np.ndarray, n: np.ndarray, buckets: int) -> pa.Table:
    keys, n = _sums(keys, n)
    b = _bucket(keys, buckets)
    order = np.argsort(b, kind="stable")
    ends = np.searchsorted(b[order], np.arange(buckets + 1))
    rows = [(i, keys[o].tobytes(), n[o].astype(np.int32).tobytes()) for i in range(buckets) if len(o := order[ends[i]:ends[i + 1]])]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()),
                     "counts": pa.array([r[2] for r in rows], pa.binary())})


def _concatenated(column: pd.Series, dtype: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column]) if len(column) else np.zeros(0, dtype)


def _stored_row(bucket: int, keys: np.ndarray, n: np.ndarray, **more) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [bucket], "keys": [keys.tobytes()], "counts": [n.tobytes()], "types": [len(keys)], "total": [int(n.sum())],
                         "seldom": [np.bincount(np.minimum(n, K + 2), minlength=K + 3)[1:K + 2].tolist()], **more})


def _merged(counted: DataFrame, name: str) -> DataFrame:
    """One stored row for each bucket: keys, counts (int64), their number and sum, n_1 .. n_(K+1)."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _stored_row(rows["bucket"].iloc[0], *_sums(_concatenated(rows["keys"], np.uint64), _concatenated(rows["counts"], np.int32).astype(np.int64)))

    return materialize(counted.groupBy("bucket").applyInPandas(merge, STORED), name)


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of two words, given by their hashes."""
    return (u * _MIX) ^ w


def _rare_by_bucket(u: np.ndarray, w: np.ndarray, rare_w: np.ndarray, buckets: int) -> list[tuple]:
    """Counted pairs (bucket, first words, counts, second words) in the bucket of the second word if it is rare, else of the first."""
    order = np.argsort(_pair_key(u, w), kind="stable")
    u, w, rare_w = u[order], w[order], rare_w[order]
    at = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]) if len(u) else np.zeros(0, np.int64)
    n = np.diff(np.r_[at, len(u)]).astype(np.int32)
    u, w, b = u[at], w[at], _bucket(np.where(rare_w, w, u)[at], buckets)
    order = np.argsort(b, kind="stable")
    ends = np.searchsorted(b[order], np.arange(buckets + 1))
    return [(buckets + i, u[o].tobytes(), n[o].tobytes(), w[o].tobytes()) for i in range(buckets) if len(o := order[ends[i]:ends[i + 1]])]


def _frequent(stored: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys counted at least ``least`` times, sorted; 1 / SHARE of them at most."""

    def pick(batches):
        for b in batches:
            for k, c in zip(b["keys"], b["counts"]):
                keys, n = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                m = n >= least
                yield pd.DataFrame({"key": keys[m].view(np.int64), "n": n[m]})

    found = stored.select("keys", "counts").mapInPandas(pick, "key long, n long").toPandas()
    keys, n = found["key"].to_numpy(dtype=np.int64).view(np.uint64), found["n"].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted key in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discounts(seldom: np.ndarray) -> np.ndarray:
    """Good-Turing discount of counts 1 .. K (index 0 unused); 1 where the estimate is no proper fraction."""
    d = np.ones(K + 1)
    n = np.asarray(seldom, dtype=float)  # n_1 .. n_(K+1)
    if (n > 0).all() and (common := (K + 1) * n[K] / n[0]) < 1:
        for r in range(1, K + 1):
            x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
            if 0 < x < 1:
                d[r] = x
    return d


@dataclass
class Katz:
    """The bounded part of the model, and the stored tables of words and pairs."""

    words: DataFrame
    pairs: DataFrame
    buckets: int
    tokens: int
    types: int
    keys: np.ndarray  # hashes of the classes, sorted
    key_class: np.ndarray
    count: np.ndarray  # of each class
    rare_tokens: int
    rare_types: int
    p: np.ndarray  # probability of each class without context
    rare: DataFrame = field(default=None)  # gains of pairs with a rare word, weights of rare contexts
    seen_total: np.ndarray = field(default=None)  # what divides a discounted pair count, by context
    weight: np.ndarray = field(default=None)  # back-off weight by context
    discount: np.ndarray = field(default=None)
    hot: np.ndarray = field(default=None)
    hot_n: np.ndarray = field(default=None)

    @property
    def start(self) -> int:
        return len(self.count)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        at, known = _find(self.keys, hashes)
        return np.where(known, self.key_class[at], RARE) if len(self.keys) else np.zeros(len(hashes), np.int64)

    def contexts(self, hashes: np.ndarray) -> np.ndarray:
        """Class of each word, or the start, as a context."""
        return np.where(hashes == START_HASH, self.start, self.classes(hashes))

    def single(self, code: np.ndarray) -> np.ndarray:
        """Probability without context of a word: its count if it is rare, else -1 - its class."""
        rare = self.p[RARE] * (code + 1.0) / (self.rare_tokens + self.rare_types + 1)
        return np.where(code < 0, self.p[np.maximum(-1 - code, 0)], rare)

    def kept(self, n: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(n <= K, self.discount[np.minimum(n, K)], 1.0) * n

    def pairs_of(self, classes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Key of each token's pair with the one before it."""
        before = np.r_[self.start, classes[:-1]]
        before[np.r_[True, doc[1:] != doc[:-1]]] = self.start
        return (before.astype(np.uint64) << np.uint64(20)) | classes.astype(np.uint64)

    def seen(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of pairs seen n > 0 times."""
        return np.log10(np.where(n <= K, self.discount[np.minimum(n, K)], 1.0) * n / self.seen_total[keys >> np.uint64(20)])

    def unseen(self, keys: np.ndarray) -> np.ndarray:
        return np.log10(self.weight[keys >> np.uint64(20)] * self.p[keys & np.uint64((1 << 20) - 1)])


def _weights(c: np.ndarray, kept: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What divides discounted counts, and the back-off weight, of contexts with c tokens whose followers have probability q."""
    full = q > 1 - 1e-9  # every class follows: nothing to back off to
    flat = (c - kept < 1e-9 * c) & ~full  # no count was discounted: one is added for what was not seen
    whole = np.where(full, kept, np.where(flat, c + 1, c))
    return whole, np.where(full, 0.0, (1 - kept / whole) / np.maximum(1 - q, 1e-300))


def _log(weight: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(weight, 1e-300))


def train(docs: DataFrame) -> Katz:
    """Count words and pairs of all ``docs`` and fix discounts and back-off weights."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    buckets = max(72, -(-int(size.b or 0) // 12_000_000))

    def count_words(t: pa.Table) -> pa.Table:
        x = tokenise(t["text"])
        return _by_bucket(x.hashes, np.bincount(x.codes, minlength=len(x.hashes)), buckets)

    words = _merged(texts.mapInArrow(per_batch(count_words, nbytes=6_000_000), COUNTED), "words")
    total = words.agg(F.sum("total").alias("n"), F.sum("types").alias("v")).first()
    n, v = int(total.n or 0), int(total.v or 0)
    least = max(1.0, n * SHARE)
    keys, freq = _frequent(words, least)
    m = keys != END_HASH
    keys, freq = keys[m], freq[m]
    count = np.r_[0, size.n, freq].astype(np.int64)
    rare_tokens, rare_types = n - int(size.n) - int(freq.sum()), max(0, v - (size.n > 0) - len(keys))
    count[RARE] = rare_tokens
    p = count.astype(float)
    p[[RARE, END]] += 1
    all_keys, all_class = np.r_[keys, END_HASH], np.r_[np.arange(len(keys)) + 2, END]
    order = np.argsort(all_keys)
    model = Katz(words, None, buckets, n, v, all_keys[order], all_class[order], count, rare_tokens, rare_types, p / p.sum())

    def count_pairs(t: pa.Table) -> pa.Table:
        x = tokenise(t["text"])
        token_class, first = model.classes(x.hashes)[x.codes], np.r_[True, x.doc[1:] != x.doc[:-1]]
        w = x.hashes[x.codes]
        u = np.where(first, START_HASH, np.r_[START_HASH, w[:-1]])
        rare_w = token_class == RARE
        rare = rare_w | (~first & np.r_[False, rare_w[:-1]])
        keys = model.pairs_of(token_class, x.doc)[~rare]
        common = _by_bucket(keys, np.ones(len(keys), np.int64), buckets).append_column("ws", pa.nulls(0, pa.binary()) if not len(keys) else pa.nulls(
            len(np.unique(_bucket(keys, buckets))), pa.binary()))
        rows = _rare_by_bucket(u[rare], w[rare], rare_w[rare], buckets)
        return pa.concat_tables([common, pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), **{
            c: pa.array([r[i] for r in rows], pa.binary()) for i, c in ((1, "keys"), (2, "counts"), (3, "ws"))}})])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of classes by key; those with a rare word also with the first word and what the second is (``single``)."""
        bucket = rows["bucket"].iloc[0]
        if bucket < buckets:
            got = _sums(_concatenated(rows["keys"], np.uint64), _concatenated(rows["counts"], np.int32).astype(np.int64))
            return _stored_row(bucket, *got, us=[None], cw=[None])
        of_words, rows = rows[rows["ws"].isna()], rows[rows["ws"].notna()]
        u, w, c = (_concatenated(rows[name], kind) for name, kind in (("keys", np.uint64), ("ws", np.uint64), ("counts", np.int32)))
        keys = _pair_key(u, w)
        order = np.argsort(keys, kind="stable")
        keys, u, w, c = keys[order], u[order], w[order], c[order].astype(np.int64)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, u, w, c = keys[at], u[at], w[at], np.add.reduceat(c, at) if len(at) else c
        known = _concatenated(of_words["keys"], np.uint64), _concatenated(of_words["counts"], np.int64)
        place, found = _find(known[0], w)
        cls = model.classes(w)
        code = (-1 - cls).astype(np.int32)
        rare = cls == RARE
        code[rare] = known[1][place[rare]]
        return _stored_row(bucket, keys, c.astype(np.int32), us=[u.tobytes()], cw=[code.tobytes()])  # rare words have few tokens

    whole, model.words = model.words, None  # a task gets the arrays, not the handle of the table
    model.pairs = None
    mark = intermediates_mark()
    of_words = whole.select((F.col("bucket") + buckets).alias("bucket"), "keys", "counts", F.lit(None).cast("binary").alias("ws"))
    counted = texts.mapInArrow(per_batch(count_pairs, nbytes=6_000_000), COUNTED + ", ws binary").unionByName(of_words)
    every = materialize(counted.groupBy("bucket").applyInPandas(merge, STORED + ", us binary, cw binary"), "counted-pairs")
    pairs = every.where(F.col("bucket") < buckets)
    seldom = np.zeros(K + 1)
    for r in every.select(F.posexplode("seldom").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect():  # K + 1 rows
        seldom[r.r] = r.n
    model.discount = discounts(seldom)
    hot, hot_n = _frequent(pairs, max(1.0, n * HOT))
    contexts = model.start + 1

    def by_context(batches):
        for b in batches:
            for k, c, us, cw in zip(b["keys"], b["counts"], b["us"], b["cw"]):
                keys, n = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64 if us is None else np.int32)
                if us is None:
                    u, p = (keys >> np.uint64(20)).astype(np.int64), model.p[keys & np.uint64((1 << 20) - 1)]
                else:
                    u, p = model.contexts(np.frombuffer(us, np.uint64)), model.single(np.frombuffer(cw, np.int32))
                    m = u != RARE
                    u, p, n = u[m], p[m], n[m]
                sums = [np.bincount(u, weights=w, minlength=contexts) for w in (n, model.kept(n), p)]
                at = np.flatnonzero(sums[0])
                yield pd.DataFrame({"u": at, "n": sums[0][at], "kept": sums[1][at], "prior": sums[2][at]})

    sums = every.select("keys", "counts", "us", "cw").mapInPandas(by_context, "u long, n double, kept double, prior double")
    sums = sums.groupBy("u").agg(*[F.sum(c).alias(c) for c in ("n", "kept", "prior")]).toPandas()  # a row for each class
    model.seen_total, model.weight = np.ones(contexts), np.ones(contexts)
    u, c, kept, q = (sums[x].to_numpy() for x in ("u", "n", "kept", "prior"))
    model.seen_total[u], model.weight[u] = _weights(c, kept, q)

    def to_context(batches):
        """Pairs of two rare words go on to the bucket of the first."""
        for b in batches:
            for bucket, *raw in zip(b["bucket"], b["keys"], b["counts"], b["us"], b["cw"]):
                keys, n, us, cw = (np.frombuffer(x, kind) for x, kind in zip(raw, (np.uint64, np.int32, np.uint64, np.int32)))
                both = (model.contexts(us) == RARE) & (cw >= 0)
                to = np.where(both, _bucket(us, buckets), bucket - buckets)
                order = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[order], np.arange(buckets + 1))
                some = [(i, *[x[o].tobytes() for x in (keys, n, us, cw)]) for i in range(buckets) if len(o := order[ends[i]:ends[i + 1]])]
                yield pd.DataFrame(some, columns=["bucket", "keys", "counts", "us", "cw"])

    def gains(rows: pd.DataFrame) -> pd.DataFrame:
        """What a pair gains by having been seen, and the back-off weights of rare contexts, both as log10."""
        keys, n, us, cw = (_concatenated(rows[c], kind) for c, kind in (("keys", np.uint64), ("counts", np.int32), ("us", np.uint64), ("cw", np.int32)))
        p, kept, cls = model.single(cw), model.kept(n), model.contexts(us)
        total, weight = model.seen_total[cls], model.weight[cls]
        rare = cls == RARE
        own, at = np.unique(us[rare], return_inverse=True)
        whole, back = _weights(*[np.bincount(at, weights=x[rare], minlength=len(own)) for x in (n, kept, p)])
        total[rare], weight[rare] = whole[at], back[at]
        gain = np.log10(kept / total) - _log(weight) - np.log10(p)
        order = np.argsort(keys)
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "keys": [keys[order].tobytes()], "counts": [gain[order].tobytes()],
                             "us": [own.tobytes()], "cw": [_log(back).tobytes()], "rare": [True]})

    columns = ["bucket", "keys", "counts", "us", "cw"]
    dealt = every.where(F.col("bucket") >= buckets).select(*columns).mapInPandas(to_context, COUNTED + ", us binary, cw binary")
    rare = dealt.groupBy("bucket").applyInPandas(gains, COUNTED + ", us binary, cw binary, rare boolean")
    stored = settle(pairs.select(*columns).withColumn("rare", F.lit(False)).unionByName(rare), "pairs", mark)
    model.hot, model.hot_n = hot, hot_n
    model.words, model.pairs, model.rare = whole, stored.where("not rare").select("bucket", "keys", "counts"), stored.where("rare")
    return model


SENT = "bucket int, kind int, base long, keys binary, n binary, docs binary, reps binary, ids array<long>, held array<boolean>"


def _entries(keys: np.ndarray, doc: np.ndarray, kind: int, base: int, buckets: int, turn: tuple[int, int], owner: np.ndarray | None = None) -> list[tuple]:
    """Entries (key, document, repetitions), one row for each bucket of this turn, that of the key or of its owner."""
    b = _bucket(keys if owner is None else owner, buckets)
    mine = b % turn[1] == turn[0]
    b, keys, doc = b[mine], keys[mine], doc[mine]
    if not len(keys):
        return []
    order = np.lexsort((doc, keys, b))
    b, keys, doc = b[order], keys[order], doc[order]
    at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
    reps = np.diff(np.r_[at, len(keys)])
    b, keys, doc = b[at], keys[at], doc[at].astype(np.uint16 if doc.max() < 1 << 16 else np.uint32)
    out = []
    ends = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for s, e in zip(ends, np.r_[ends[1:], len(b)]):
        own = np.flatnonzero(np.r_[True, keys[s + 1:e] != keys[s:e - 1]])
        out.append((int(b[s]), kind, base, keys[s:e][own].tobytes(), np.diff(np.r_[own, e - s]).astype(np.uint32).tobytes(),
                    doc[s:e].tobytes(), reps[s:e].astype(np.uint32).tobytes(), None, None))
    return out


def score(docs: DataFrame, model: Katz, held: Column, turns: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every row.

    With several ``turns`` each one sends the entries of its share of the buckets, and their shuffles need not
    lie on disk at once; ``docs`` are read again for each, so they must be a stored table, whose rows keep their places.
    """
    words, pairs, rare_pairs, buckets = model.words, model.pairs, model.rare, model.buckets
    model.words = model.pairs = model.rare = None  # not needed in the tasks
    base_log = np.log10(float(model.tokens) + model.types + 1)
    rare_log = np.log10(float(model.rare_tokens) + model.rare_types + 1)
    columns = [x.split()[0] for x in SENT.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def local(t: pa.Table, turn: int) -> pa.Table:
        base = t["row"][0].as_py()
        x = tokenise(t["text"])
        cls = model.classes(x.hashes)
        token_class = cls[x.codes]
        rare = token_class == RARE
        n = np.bincount(x.doc, minlength=x.n_docs)
        c = np.where(rare, 0, model.count[token_class]).astype(float)
        known = np.bincount(x.doc, weights=c > 0, minlength=x.n_docs)
        base_sum = np.bincount(x.doc, weights=np.log10(c + 1), minlength=x.n_docs) - n * base_log
        keys = model.pairs_of(token_class, x.doc)
        w, first = x.hashes[x.codes], np.r_[True, x.doc[1:] != x.doc[:-1]]
        u = np.where(first, START_HASH, np.r_[START_HASH, w[:-1]])
        rare_u = ~first & np.r_[False, rare[:-1]]
        pair = rare | rare_u
        at, hot = _find(model.hot, keys)
        hot &= ~pair
        part = np.zeros(len(keys))
        part[hot] = model.seen(keys[hot], model.hot_n[at[hot]])
        part[pair] = np.log10(model.p[token_class[pair]])  # as if not seen; a rare word adds its share and its weight as a context
        known_u = pair & ~rare_u
        part[known_u] += _log(model.weight[(keys[known_u] >> np.uint64(20)).astype(np.int64)])
        total = np.bincount(x.doc, weights=part - rare * rare_log, minlength=x.n_docs)
        own = np.c_[n, known, base_sum, total].astype(np.float64)
        rows = []
        if turn == 0:
            rows.append((int(base % buckets), 0, base, own.tobytes(), None, None, None, t["doc_id"].to_pylist(), t["held"].to_pylist()))
        rows += _entries(w[rare], x.doc[rare], 1, base, buckets, (turn, turns))
        rows += _entries(keys[~hot & ~pair], x.doc[~hot & ~pair], 2, base, buckets, (turn, turns))
        rows += _entries(_pair_key(u[pair], w[pair]), x.doc[pair], 3, base, buckets, (turn, turns), np.where(rare_u, u, w)[pair])
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(columns, kinds))})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    picked = picked.withColumn("row", F.monotonically_increasing_id())  # numbers of a piece are consecutive

    def tables(df: DataFrame, kind: int, keys: str = "keys", values: str = "counts") -> DataFrame:
        nothing = F.lit(None)
        return df.select("bucket", F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("base"), F.col(keys).alias("keys"), F.col(values).alias("n"),
                         nothing.cast("binary").alias("docs"), nothing.cast("binary").alias("reps"), nothing.cast("array<long>").alias("ids"),
                         nothing.cast("array<boolean>").alias("held"))

    stored = tables(words, -1).unionByName(tables(pairs, -2)).unionByName(tables(rare_pairs, -3)).unionByName(tables(rare_pairs, -4, "us", "cw"))

    def answer(batches):
        """Rows of a bucket: its four tables first, then whole documents and entries, one row at a time."""
        now, held_tables = None, {}
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        sums: dict[int, np.ndarray] = {}
        held_rows = 0

        def flush():
            out = pa.table({"base": pa.array(list(sums), pa.int64()), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary()),
                            "ids": pa.array([None] * len(sums), pa.list_(pa.int64())), "held": pa.array([None] * len(sums), pa.list_(pa.bool_()))})
            sums.clear()
            return out.to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, kind = batch["bucket"][i].as_py(), batch["kind"][i].as_py()
                if bucket != now:
                    now, held_tables = bucket, {}
                if kind < 0:
                    values = np.int64 if kind >= -2 else np.float64
                    held_tables[-kind] = (np.frombuffer(batch["keys"][i].as_py(), np.uint64), np.frombuffer(batch["n"][i].as_py(), values))
                    continue
                base = batch["base"][i].as_py()
                if kind == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), batch["keys"].slice(i, 1).cast(pa.binary()), batch["ids"].slice(i, 1),
                                                      batch["held"].slice(i, 1)], names=["base", "sums", "ids", "held"])
                    continue
                keys = np.frombuffer(batch["keys"][i].as_py(), np.uint64)
                each = np.frombuffer(batch["n"][i].as_py(), np.uint32)
                reps = np.frombuffer(batch["reps"][i].as_py(), np.uint32).astype(float)
                raw = batch["docs"][i].as_py()
                doc = np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(reps) else np.uint32)
                asked = held_tables.get(kind, empty)
                at, found = _find(asked[0], keys)
                got = np.zeros(len(keys), asked[1].dtype)
                got[found] = asked[1][at[found]]
                size = int(doc.max()) + 1
                add = np.zeros((size, 4))
                if kind == 1:
                    lg = np.log10(got + 1.0)
                    add[:, 1] = np.bincount(doc, weights=np.repeat(got > 0, each) * reps, minlength=size)
                    add[:, 2] = np.bincount(doc, weights=np.repeat(lg, each) * reps, minlength=size)
                    asked = held_tables.get(4, empty)
                    at, found = _find(asked[0], keys)
                    lg[found] += asked[1][at[found]]  # the word as a context; one that was not seen has weight 1
                    add[:, 3] = np.bincount(doc, weights=np.repeat(lg, each) * reps, minlength=size)
                elif kind == 3:
                    add[:, 3] = np.bincount(doc, weights=np.repeat(got, each) * reps, minlength=size)
                else:
                    lg = np.empty(len(keys))
                    lg[found] = model.seen(keys[found], got[found])
                    lg[~found] = model.unseen(keys[~found])
                    add[:, 3] = np.bincount(doc, weights=np.repeat(lg, each) * reps, minlength=size)
                old = sums.get(base)
                if old is None:
                    sums[base] = add
                    held_rows += size
                elif len(old) < size:
                    add[:len(old)] += old
                    sums[base] = add
                else:
                    old[:size] += add
                if held_rows > 500_000:
                    yield from flush()
                    held_rows = 0
        if sums:
            yield from flush()

    def answers_of(turn: int) -> DataFrame:
        sent = picked.mapInArrow(per_batch(lambda t: local(t, turn), nbytes=4_000_000), SENT)
        own = sent.unionByName(stored.where(F.col("bucket") % turns == turn))
        dealt = own.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
        got = dealt.mapInArrow(answer, "base long, sums binary, ids array<long>, held array<boolean>")
        return got if turns == 1 else materialize(got, "answers")

    answers = reduce(DataFrame.unionByName, [answers_of(turn) for turn in range(turns)])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows[rows["ids"].notna()].iloc[0]
        total = np.frombuffer(whole["sums"], np.float64).reshape(-1, 4).copy()
        for s in rows[rows["ids"].isna()]["sums"]:
            part = np.frombuffer(s, np.float64).reshape(-1, 4)
            total[:len(part)] += part
        return pd.DataFrame({"doc_id": pd.array(list(whole["ids"]), dtype="Int64"), "held_out": list(whole["held"]), "n_tokens": total[:, 0].astype(np.int64),
                             "n_known": np.rint(total[:, 1]).astype(np.int64), "base_score": total[:, 2], "score": total[:, 3]})

    out = answers.groupBy("base").applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    model.words, model.pairs, model.rare = words, pairs, rare_pairs
    return out


def query(spark, sf_dir) -> DataFrame:
    """op9: log probability of every document, learned from those that are not held out."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # counts are stored: their shuffles are done with
    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), 7) == 2
    model = train(docs.where(~held))
    return score(docs, model, held, turns=2).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
