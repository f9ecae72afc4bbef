"""Toxicity: a convolutional text classifier over hashed word embeddings, thresholds calibrated by language.

A word is embedded by three hashes, of the whole word, its first four and its first six bytes, each into a
table of 2^16 rows; the stems catch inflected forms that no training text has.  Filters over one, two and
three words are max-pooled over the whole text and feed one logistic unit.

Training: for every bucket the number of toxic and of other documents that hold it is counted over all
labelled rows; the shrunken log-odds are the first coordinate of the embeddings.  Filters, output and the
other coordinates start from a fit in numpy to a bounded part of the labelled documents, ``SAMPLE`` of each
class and ``SAMPLE_WORDS`` words in all (the smallest hashes of their ids; whole texts).  If there are more,
``ROUNDS`` passes over all labelled rows follow: each task goes on learning from all of its rows, and the
parameters of the tasks are averaged.  Two more networks, each learned without one half of the rows, score
that half: from these scores of all rows each language gets the threshold with the best F1; a language with
fewer than ``FEW`` toxic rows takes that of all rows.  Languages are told by their function words, so that
nothing but the text enters a score.  ``score`` is stretched so that the threshold of the text's language
comes to lie at ``cut``.

Defined cases: a null text is an empty one, has no words and scores like a text without toxic words; very long
texts are read whole; a label that is neither 0 nor 1 is not used, nor is one whose document is missing or has
no id; a document labelled twice counts twice; with labels of one class only every document gets that
class, with none the score 0; repeated rows are scored alike; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import binary_view, id_remainder, per_batch, table

SAMPLE, SAMPLE_WORDS, FEW = 2000, 4_000_000, 10
BROADCAST_LABELS = 2_000_000   # rows of eight bytes; more labels are joined by a shuffle
BITS, STEMS, DIM = 16, (0, 4, 6), 4   # rows of a table, bytes of a word that are hashed (0: all), coordinates
WIDTHS, FILTERS = (1, 2, 3), 8
PAD = 3
PIECE = 2_000_000
ROUNDS, LATER_RATE, BINS = 2, 0.003, 10_000   # passes over all rows after the sample, their step, steps of a score

# Frequent function words, by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with are was this from have not you which",
    "de": "der die das und ist nicht mit den von ein eine zu auf für sich dem auch als",
    "fr": "le la les et des est que une dans pour qui sur pas par avec ce du au",
    "es": "el los las que una del por con para se como más pero su al lo",
    "it": "il di che è per un della con non sono gli nel questo anche più",
    "pt": "o os um uma não com para por mais como dos da ao em são",
    "nl": "de het een van en dat niet met voor zijn op aan er maar ook",
}
LANGUAGES = ("other", *FUNCTION_WORDS)


# --- words as numbers ----------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _STEP), ("down", _BACK)):
            row = np.full(max(n, 1 << 16), base)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _lowered(body: np.ndarray) -> np.ndarray:
    out = body.copy()
    out[(body >= 65) & (body <= 90)] += 32
    after = np.flatnonzero(body[:-1] == 0xC3) + 1  # capital letters of Latin-1, but for the sign of multiplication
    second = body[after]
    out[after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    return out


def words_of(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (n words, one for each of STEMS), whole-word hashes, and the text of each word; texts are body[at[i]:at[i+1]]."""
    n = len(body)
    if not n:
        return np.zeros((0, len(STEMS)), np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _lowered(body)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128) | ((low >= 48) & (low <= 57))
    first = np.zeros(n + 1, bool)
    first[at] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    start = np.flatnonzero(letter & (~before | first[:-1]))
    end = np.flatnonzero(letter & (~after | first[1:])) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[:n], out=sums[1:])
    slots = np.empty((len(start), len(STEMS)), np.int32)
    whole = (sums[end] - sums[start]) * down[start]
    for k, stem in enumerate(STEMS):
        h = whole if not stem else (sums[np.minimum(end, start + stem)] - sums[start]) * down[start]
        slots[:, k] = (_mixed(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32)
    return slots, whole, np.searchsorted(at, start, side="right") - 1


def _known_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of function words and the languages that have them, as bits."""
    found: dict[int, int] = {}
    for i, listed in enumerate(FUNCTION_WORDS.values()):
        for w in listed.split():
            raw = np.frombuffer(w.encode(), np.uint8)
            h = int(words_of(raw, np.array([0, len(raw)]))[1][0])
            found[h] = found.get(h, 0) | 1 << i
    keys = sorted(found)
    return np.array(keys, np.uint64), np.array([found[k] for k in keys])


_KNOWN: list[tuple[np.ndarray, np.ndarray]] = []


def languages_of(whole: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the index in LANGUAGES of the language with most function words in it."""
    if not _KNOWN:
        _KNOWN.append(_known_words())
    keys, owners = _KNOWN[0]
    place = np.minimum(np.searchsorted(keys, whole), len(keys) - 1)
    hit = keys[place] == whole
    owner, text = owners[place[hit]], text[hit]
    counts = np.array([np.bincount(text[owner >> i & 1 == 1], minlength=n) for i in range(len(FUNCTION_WORDS))])
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0) + 1, 0)


# --- the network ---------------------------------------------------------------------------

def _padded(slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots with PAD rows of -1 behind each text, and where the texts start."""
    starts = np.concatenate([[0], np.cumsum(counts + PAD)])
    out = np.full((starts[-1], slots.shape[1]), -1, np.int32)
    out[np.arange(len(slots)) + PAD * np.repeat(np.arange(len(counts)), counts)] = slots
    return out, starts


@dataclass
class Network:
    """Embedding tables (STEMS, rows, DIM), filters by width (width, STEMS * DIM, FILTERS), biases, output."""

    tables: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float

    def dense(self) -> list[np.ndarray]:
        """All but the tables: the arrays themselves, and a copy of the bias."""
        return [*self.filters, *self.biases, self.weights, np.array([self.bias], np.float32)]

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIM numbers: the tables, then the rest, filled up with zeros."""
        rest = np.concatenate([p.ravel() for p in self.dense()])
        rest = np.append(rest, np.zeros(-len(rest) % DIM, np.float32))
        return np.concatenate([self.tables.reshape(-1, DIM), rest.reshape(-1, DIM)])

    def moved(self, change: np.ndarray) -> Network:
        """A network whose ``rows`` are these and ``change``."""
        rows = (self.rows() + change).astype(np.float32)
        n = len(STEMS) << BITS
        rest, at, parts = rows[n:].ravel(), 0, []
        for p in self.dense():
            parts.append(rest[at:at + p.size].reshape(p.shape).copy())
            at += p.size
        k = len(WIDTHS)
        return Network(rows[:n].reshape(self.tables.shape).copy(), parts[:k], parts[k:2 * k], parts[-2], float(parts[-1][0]))

    def embedded(self, slots: np.ndarray) -> np.ndarray:
        x = np.concatenate([t[s] for t, s in zip(self.tables, slots.T)], axis=1)
        x[slots[:, 0] < 0] = 0
        return x

    def responses(self, x: np.ndarray) -> np.ndarray:
        """All filters at every place (n, widths * FILTERS); x ends in PAD empty rows."""
        n, out = len(x), []
        for w, f in zip(WIDTHS, self.filters):
            z = x @ f[0]
            for k in range(1, w):
                z[:n - k] += x[k:] @ f[k]
            out.append(z)
        return np.concatenate(out, axis=1)

    def probabilities(self, slots: np.ndarray, counts: np.ndarray, rows: int = 100_000) -> np.ndarray:
        """Of texts with ``counts`` words; long ones are pooled in overlapping pieces."""
        pooled = np.full((len(counts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        ends = np.cumsum(counts)
        i = 0
        while i < len(counts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - counts[i] + rows, side="right")))
            first = ends[i] - counts[i]
            if j == i + 1 and counts[i] > rows:
                for at in range(0, counts[i], rows):
                    part = slots[first + at:first + min(at + rows + PAD - 1, counts[i])]
                    padded, _ = _padded(part, np.array([len(part)]))
                    pooled[i] = np.maximum(pooled[i], self.responses(self.embedded(padded))[:len(part) + 1].max(axis=0))
            else:
                padded, starts = _padded(slots[first:ends[j - 1]], counts[i:j])
                z = self.responses(self.embedded(padded))
                cuts = np.stack([starts[:-1], starts[:-1] + counts[i:j] + 1], axis=1).ravel()
                pooled[i:j] = np.maximum.reduceat(z, cuts, axis=0)[::2]
            i = j
        hidden = np.maximum(pooled + np.concatenate(self.biases), 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.bias, -30, 30).astype(float)))


def _fresh(odds: np.ndarray, seed: int) -> Network:
    r = np.random.default_rng(seed)
    tables = r.normal(0, 0.05, (len(STEMS), 1 << BITS, DIM)).astype(np.float32)
    tables[:, :, 0] = odds
    filters = []
    for w in WIDTHS:
        f = r.normal(0, 0.1, (w, len(STEMS) * DIM, FILTERS))
        f[0, ::DIM, :FILTERS // 2] += 0.3  # half of the filters start from the log-odds of one word
        filters.append(f.astype(np.float32))
    size = len(WIDTHS) * FILTERS
    return Network(tables, filters, [np.full(FILTERS, -0.3, np.float32) for _ in WIDTHS], np.full(size, 0.1, np.float32), -1.0)


class Training:
    """Adam on filters and output, plain steps on the embeddings that were the maximum of a filter; changes ``net``."""

    def __init__(self, net: Network, rate: float = 0.01, decay: float = 1e-4):
        self.net, self.rate, self.decay, self.steps = net, rate, decay, 0
        self.params = net.dense()
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def step(self, texts: list[np.ndarray], y: np.ndarray, importance: np.ndarray) -> None:
        """One batch of texts, their classes and what each weighs in the loss."""
        net, params = self.net, self.params
        counts = np.array([len(t) for t in texts])
        slots, starts = _padded(np.concatenate(texts), counts)
        x = net.embedded(slots)
        z = net.responses(x)
        best = np.array([s + z[s:s + n + 1].argmax(axis=0) for s, n in zip(starts, counts)])
        pooled = np.take_along_axis(z, best, axis=0) + np.concatenate(params[len(WIDTHS):2 * len(WIDTHS)])
        hidden = np.maximum(pooled, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[-2] + params[-1][0], -30, 30)))
        error = ((p - y) * importance / len(y)).astype(np.float32)
        grads = [np.zeros_like(q) for q in params]
        grads[-2], grads[-1] = hidden.T @ error, np.array([error.sum()], np.float32)
        back = np.outer(error, params[-2]) * (pooled > 0)
        for i, w in enumerate(WIDTHS):
            g, place = back[:, i * FILTERS:(i + 1) * FILTERS], best[:, i * FILTERS:(i + 1) * FILTERS]
            grads[len(WIDTHS) + i] = g.sum(axis=0)
            for k in range(w):
                at = np.minimum(place + k, len(x) - 1)
                grads[i][k] = np.einsum("bf,bfd->df", g, x[at])
                moved = np.einsum("bf,df->bfd", g, net.filters[i][k]).reshape(-1, len(STEMS), DIM)
                rows = slots[at.ravel()]
                for t in range(len(STEMS)):
                    real = rows[:, t] >= 0
                    np.add.at(net.tables[t], rows[real, t], -10 * self.rate * moved[real, t])
        self.steps += 1
        for q, g, a, c in zip(params, grads, self.m, self.v):
            g = g + self.decay * q
            a += 0.1 * (g - a)
            c += 0.001 * (g * g - c)
            q -= self.rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(c / (1 - 0.999**self.steps)) + 1e-8)
        net.bias = float(params[-1][0])


def _importance(y: np.ndarray, share: float) -> np.ndarray:
    """Both classes weigh the same in the loss, whatever the share of toxic texts."""
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


def fit_network(texts: list[np.ndarray], y: np.ndarray, odds: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 0) -> Network:
    """A network for texts that are at hand."""
    training, r = Training(_fresh(odds, seed)), np.random.default_rng(seed + 1)
    importance = _importance(y, y.mean())
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for b in range(0, len(order), batch):
            mine = order[b:b + batch]
            training.step([texts[i] for i in mine], y[mine], importance[mine])
    return training.net


# --- training data -------------------------------------------------------------------------

def _tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, words of each text and language of each text of a table."""
    body, at = binary_view(t["text"])
    slots, whole, text = words_of(body, at)
    return slots, np.bincount(text, minlength=t.num_rows), languages_of(whole, text, t.num_rows)


def _labelled(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, y, fold) of all labelled documents; texts stay where they are unless there are very many labels."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.join(marks, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))


def document_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by (fold, class, table, bucket) that hold the bucket, and documents by (fold, class)."""
    size = len(STEMS) << BITS

    def run(batches):
        sums, total = np.zeros((4, size), np.int64), np.zeros(4, np.int64)

        def add(t: pa.Table) -> None:
            slots, counts, _ = _tokens(t)
            group = t["fold"].to_numpy() * 2 + t["y"].to_numpy()
            total[:] += np.bincount(group, minlength=4)
            doc = np.repeat(np.arange(t.num_rows), counts)
            for k in range(len(STEMS)):
                once = np.unique(doc << BITS | slots[:, k])
                flat = group[once >> BITS] * size + (k << BITS) + (once & ((1 << BITS) - 1))
                sums.reshape(-1)[:] += np.bincount(flat, minlength=4 * size)

        for _ in per_batch(add, PIECE)(batches):
            pass
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), *[pa.array(np.append(s[seen], t)) for s, t in zip(sums, total)]], names=["slot", "c0", "c1", "c2", "c3"])

    columns = [f"c{i}" for i in range(4)]
    parts = labelled.select("text", "y", "fold").mapInArrow(run, "slot long, " + ", ".join(f"{c} long" for c in columns))
    summed = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # one row for each bucket at most
    slot, values = summed["slot"].to_numpy(), np.array([summed[c].to_numpy() for c in columns])
    out = np.zeros((4, size))
    out[:, slot[slot >= 0]] = values[:, slot >= 0]
    total = values[:, slot < 0].sum(axis=1).astype(float)
    return out.reshape(2, 2, len(STEMS), 1 << BITS), total.reshape(2, 2)


def log_odds(held: np.ndarray, total: np.ndarray, support: float = 4.0) -> np.ndarray:
    """Shrunken log-odds of each bucket from documents by (class, table, bucket) and by class."""
    rates = (held + 0.5) / (total[:, None, None] + 1)
    n = held.sum(axis=0)
    return (np.log(rates[1] / rates[0]) * n / (n + support) / 4).astype(np.float32)


def sample(labelled: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Slots, class, fold and language of the bounded sample."""

    def run(t: pa.Table) -> pa.Table:
        slots, counts, language = _tokens(t)
        cuts = np.cumsum(counts)[:-1]
        return pa.table({"rank": t["rank"], "y": t["y"], "fold": t["fold"], "language": pa.array(language, pa.int32()), "words": pa.array(counts, pa.int64()),
                         "slots": pa.array([s.tobytes() for s in np.split(slots, cuts)], pa.binary())})

    ranked = labelled.withColumn("rank", F.xxhash64("doc_id", F.lit("sample")))
    bound = [ranked.where(F.col("y") == k).select("rank").orderBy("rank").limit(SAMPLE).agg(F.max("rank")).first()[0] for k in (0, 1)]
    near = F.lit(False)
    for k, last in enumerate(bound):
        if last is not None:
            near = near | ((F.col("y") == k) & (F.col("rank") <= last))
    rows = ranked.where(near).select("text", "rank", "y", "fold").mapInArrow(
        per_batch(run, PIECE), "rank long, y int, fold int, language int, words long, slots binary")
    sizes = rows.select("rank", "y", "words").toPandas().sort_values(["rank", "y"])  # at most SAMPLE of each class, but for repeated ids
    sizes = sizes.groupby("y").head(SAMPLE)
    kept = sizes[sizes.groupby("y")["words"].cumsum() <= SAMPLE_WORDS // 2].groupby("y")["rank"].max().to_dict()
    near = F.lit(False)
    for k, last in kept.items():
        near = near | ((F.col("y") == int(k)) & (F.col("rank") <= int(last)))
    got = rows.where(near).toPandas().sort_values(["rank", "y"])
    texts = [np.frombuffer(s, np.int32).reshape(-1, len(STEMS)) for s in got["slots"]]
    return texts, got["y"].to_numpy(), got["fold"].to_numpy(), got["language"].to_numpy()


def best_cut(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold with the largest F1, in the middle of the widest such gap; ``y`` toxic ones of ``n`` (one each) at score ``p``."""
    order = np.argsort(-p, kind="stable")
    p, y, n = p[order], y[order], np.ones(len(p)) if n is None else n[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.cumsum(n) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal scores
    below = np.append(p[1:], 0.0)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = top[np.argmax(p[top] - below[top])]
    return float(np.clip((p[i] + below[i]) / 2, 0.01, 0.99))


def thresholds(p: np.ndarray, y: np.ndarray, language: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """A cut for each of LANGUAGES from scores, toxic ones of ``n`` and languages."""
    n = np.ones(len(p)) if n is None else n
    cuts = np.full(len(LANGUAGES), 0.5)
    if 0 < y.sum() < n.sum():
        cuts[:] = best_cut(p, y, n)
        for i in range(len(LANGUAGES)):
            own = language == i
            if y[own].sum() >= FEW and (n - y)[own].sum() >= FEW:
                cuts[i] = best_cut(p[own], y[own], n[own])
    return cuts


# --- learning from all rows ----------------------------------------------------------------

def _split(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of each text of a table, and its language."""
    slots, counts, language = _tokens(t)
    return np.split(slots, np.cumsum(counts)[:-1]), language


def one_round(labelled: DataFrame, networks: list[Network], share: list[float], batch: int = 32) -> list[Network]:
    """Each task goes on with all networks over its own rows; every row of parameters becomes the mean over the tasks that moved it.

    Network k < 2 leaves out fold k.  A task counts by its documents.  Parameters are bounded, so one row
    for each of them comes back, whatever the number of labelled documents.
    """
    names = ["net", "at", "docs", *[f"x{i}" for i in range(DIM)]]

    def run(batches):
        own = [Training(n.moved(np.zeros_like(n.rows())), LATER_RATE) for n in networks]
        docs = np.zeros(len(own))
        r = np.random.default_rng(1)

        def learn(t: pa.Table) -> None:
            texts, _ = _split(t)
            y, fold = t["y"].to_numpy(), t["fold"].to_numpy()
            order = r.permutation(len(texts))
            for k, training in enumerate(own):
                mine = order[fold[order] != k]
                docs[k] += len(mine)
                for b in range(0, len(mine), batch):
                    at = mine[b:b + batch]
                    training.step([texts[i] for i in at], y[at], _importance(y[at], share[k]))

        for _ in per_batch(learn, PIECE)(batches):
            pass
        for k, training in enumerate(own):
            change = training.net.rows().astype(float) - networks[k].rows()
            at = np.flatnonzero(change.any(axis=1))
            weight = np.full(len(at), docs[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(weight),
                                              *[pa.array(change[at, i] * weight) for i in range(DIM)]], names=names)

    parts = labelled.select("text", "y", "fold").mapInArrow(run, "net int, at long, docs double, " + ", ".join(f"x{i} double" for i in range(DIM)))
    summed = parts.groupBy("net", "at").agg(*[F.sum(c).alias(c) for c in names[2:]]).toArrow()  # one row for each parameter row at most
    net, at, docs = (summed[c].to_numpy() for c in names[:3])
    mean = np.array([summed[c].to_numpy() for c in names[3:]]).T.reshape(-1, DIM) / docs[:, None]
    out = []
    for k, n in enumerate(networks):
        change = np.zeros((len(n.rows()), DIM))
        change[at[net == k]] = mean[net == k]
        out.append(n.moved(change))
    return out


def crossed_counts(labelled: DataFrame, networks: list[Network]) -> tuple[np.ndarray, ...]:
    """(score, toxic documents, language, documents) of all rows, scored by the network that left them out, by steps of 1 / BINS."""

    def run(batches):
        sums = np.zeros((2, len(LANGUAGES) * BINS), np.int64)

        def add(t: pa.Table) -> None:
            texts, language = _split(t)
            y, fold = t["y"].to_numpy(), t["fold"].to_numpy()
            for k in (0, 1):
                mine = np.flatnonzero(fold == k)
                if len(mine):
                    p = networks[k].probabilities(np.concatenate([texts[i] for i in mine]), np.array([len(texts[i]) for i in mine]))
                    flat = language[mine] * BINS + np.minimum((p * BINS).astype(int), BINS - 1)
                    for c in (0, 1):
                        sums[c] += np.bincount(flat[y[mine] == c], minlength=sums.shape[1])

        for _ in per_batch(add, PIECE)(batches):
            pass
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["at", "c0", "c1"])

    summed = labelled.select("text", "y", "fold").mapInArrow(run, "at long, c0 long, c1 long").groupBy("at").agg(
        F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).orderBy("at").toArrow()  # one row for each language and step at most
    at, c0, c1 = (summed[c].to_numpy() for c in ("at", "c0", "c1"))
    return (at % BINS + 0.5) / BINS, c1.astype(float), at // BINS, (c0 + c1).astype(float)


@dataclass
class Model:
    """A network and a threshold for each of LANGUAGES; ``fixed`` where there is nothing to learn."""

    network: Network | None
    thresholds: np.ndarray
    fixed: float = 0.0

    def scores(self, t: pa.Table, cut: float) -> tuple[np.ndarray, np.ndarray]:
        if self.network is None:
            return np.full(t.num_rows, self.fixed), np.zeros(t.num_rows, int)
        slots, counts, language = _tokens(t)
        p, limit = self.network.probabilities(slots, counts), self.thresholds[language]
        stretched = np.where(p < limit, cut * p / limit, cut + (1 - cut) * (p - limit) / (1 - limit))
        return np.clip(stretched, 0, 1), language


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled documents of ``docs``."""
    labelled = _labelled(docs, labels)
    held, total = document_counts(labelled)
    if min(total.sum(axis=0)) < 1:
        return Model(None, np.full(len(LANGUAGES), 0.5), float(total[:, 1].sum() > 0))
    texts, y, fold, language = sample(labelled)
    whole = fit_network(texts, y, log_odds(held.sum(axis=0), total.sum(axis=0)))
    halves: list[Network | None] = []
    for k in (0, 1):
        other = np.flatnonzero(fold != k)
        halves.append(fit_network([texts[i] for i in other], y[other], log_odds(held[1 - k], total[1 - k])) if len(set(y[other])) == 2 else None)
    if len(y) < total.sum() and None not in halves:  # what was fitted so far is where learning from all rows starts
        networks = [*halves, whole]
        sums = [total[1], total[0], total.sum(axis=0)]
        for _ in range(ROUNDS):
            networks = one_round(labelled, networks, [float(t[1] / t.sum()) for t in sums])
        return Model(networks[2], thresholds(*crossed_counts(labelled, networks)))
    crossed = np.full(len(y), np.nan)
    for k in (0, 1):
        mine = np.flatnonzero(fold == k)
        if len(mine) and halves[k] is not None:
            crossed[mine] = halves[k].probabilities(np.concatenate([texts[i] for i in mine]), np.array([len(texts[i]) for i in mine]))
    known = ~np.isnan(crossed)
    return Model(whole, thresholds(crossed[known], y[known], language[known]))


def classify(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, language) of every row."""

    def run(t: pa.Table) -> pa.Table:
        score, language = model.scores(t, cut)
        return pa.table({"doc_id": t["doc_id"], "score": score, "predicted": pa.array((score >= cut).astype(np.int32)),
                         "language": pa.array([LANGUAGES[i] for i in language], pa.string())})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(per_batch(run, PIECE), "doc_id long, score double, predicted int, language string")


def query(spark, sf_dir) -> DataFrame:
    """op12: toxicity of every document, learnt from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return classify(docs, model, 0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted", "language")
