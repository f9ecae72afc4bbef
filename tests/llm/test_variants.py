"""Conversation trie, toxicity, spelling variants."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import prose
from marketlab.llm import prefixes, spelling, toxicity

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth long, part string"


# --- op11 ----------------------------------------------------------------------------------

def brute_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]} by comparing every prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for path, cs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaf = [p for p in below if not any(q[:-1] == p and q for q in members)]
        ends = sorted(c for c in cs if len(convs[c]) == len(path))
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        out[(min(cs), len(path))] = (min(members[path[:-1]]) if path else None, len(cs), len(children), len(leaf), saved,
                                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def as_turns(spark, convs):
    rows = [(c, i, r, t, 7, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS)


def nodes_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie_of_shared_beginnings(spark, monkeypatch):
    r = random.Random(5)
    convs = {}
    for c in range(60):
        base = convs[r.choice(list(convs))] if convs and r.random() < 0.7 else []
        kept = base[:r.randint(0, len(base))]
        convs[c * 3 - 30] = kept + [(r.choice("ua"), r.choice(["", "a", "bé", "ccc😀"])) for _ in range(r.randint(1, 12))]
    monkeypatch.setattr(prefixes, "SLICE", 2)   # sums are carried over slices
    monkeypatch.setattr(prefixes, "SPREAD", 1)
    monkeypatch.setattr(prefixes, "WIDTH", 3)
    assert nodes_of(prefixes.prefix_trie(as_turns(spark, convs))) == brute_trie(convs)


def test_trie_of_long_and_equal_conversations(spark):
    long_ = [("user", prose(i, 3)) for i in range(300)]
    convs = {1: long_, 2: long_, 5000: long_[:17], 9000: [("user", "other")], 9001: [("user", "other")]}
    assert nodes_of(prefixes.prefix_trie(as_turns(spark, convs))) == brute_trie(convs)


def test_trie_of_odd_turns(spark):
    rows = [(1, 2, "user", "b"), (1, None, None, None), (1, 2, "user", "a"), (1, 2, "user", "a"), (2, None, "", ""), (None, 0, "user", "nobody")]
    got = nodes_of(prefixes.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute_trie({1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], 2: [("", "")]})
    assert prefixes.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_shared_heads(spark):
    convs = {c: [("u", f"{c}-{i}") for i in range(n)] for c, n in {0: 3, 1: 4, 7: 1, 99: 9, 100: 1, 123: 7, 250: 4, 5: 2}.items()}
    want = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    assert any(not w for w in want.values()) or min(map(len, want.values())) < 2
    assert nodes_of(prefixes.trie(*prefixes.with_shared_heads(prefixes.positions(as_turns(spark, convs))))) == brute_trie(want)


# --- op13 ----------------------------------------------------------------------------------

def brute_variants(counts, factor=5):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        others = [(-m, x) for x, m in counts.items() if near(w, x)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= factor * n else None
        out[w] = [form, None, n, len(others), -best[0] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def variants_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("tile", [2, 1024])
def test_variants_against_all_pairs(spark, tile):
    r = random.Random(3)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(150)}
    for w in list(words)[:60]:
        i = r.randrange(len(w) + 1)
        words |= {w[:i] + r.choice("abcÀ") + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i + 1:]}
    words |= {"x" * 40_000, "x" * 39_999, "y" * 300 + "z", "y" * 300, "aaaaaa", "aaaaaaa", "aaaaaaaa"}
    counts = {w: 5 ** r.randint(1, 5) + r.randint(0, 2) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = variants_of(spelling.variants(df, tile=tile))
    assert got == brute_variants(counts)
    assert any(v[0] and v[0] != v[1] for v in got.values())


def brute_words(docs, spoil=None):
    counts = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + "\n":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run and spoil:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % spoil == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 5}


def test_words_of_documents(spark, make_docs, odd_docs):
    docs = [(i, f"Émile×÷ ÉMILEZ wörter Wörter {prose(i % 3, 200)} ĀabcdefgĀ it's") for i in range(40)] + [(None, "Wörter " * 9), (7, None), (8, "")]
    df = make_docs([t for _, t in docs], ids=[i for i, _ in docs])
    for spoil in (None, 3, 199):
        assert {r.word: r.n for r in spelling.word_counts(df, spoil=spoil).collect()} == brute_words(docs, spoil)
    odd = {r.word: r.n for r in spelling.word_counts(odd_docs, least=1).collect()}
    assert sum(odd.values()) == sum(spelling.word_counts(odd_docs.where("doc_id = 3"), least=1).agg(F.sum("n")).first()) + sum(
        len(w) >= 6 and w.isalpha() for r in odd_docs.collect() if r.doc_id != 3 for w in (r.text or "").split())
    assert spelling.variants(spelling.word_counts(odd_docs, least=1)).count() == len(odd)
    assert spelling.variants(spelling.word_counts(make_docs([]))).count() == 0


def test_variants_of_the_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    counts = brute_words(docs, 199)
    got = variants_of(spelling.query(spark, SF))
    assert {w: v[2] for w, v in got.items()} == counts
    some = sorted(counts)[::7]
    want = brute_variants(counts) if len(counts) < 1500 else None
    assert want is None or {w: got[w] for w in some} == {w: want[w] for w in some}


# --- op12 ----------------------------------------------------------------------------------

def test_words_as_numbers():
    texts = ["Ein Über-Wort", "", "über", "x", "ein", "überaus ×Ä ä"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    slots, whole, text = toxicity.words_of(np.frombuffer(b"".join(raw), np.uint8), at)
    assert text.tolist() == [0, 0, 0, 2, 3, 4, 5, 5, 5]
    assert whole[0] == whole[5] and whole[1] == whole[3] and len(set(whole.tolist())) == 7
    assert slots[1, 1] == slots[6, 1] and slots[1, 0] != slots[6, 0]  # one stem
    assert toxicity.words_of(np.zeros(0, np.uint8), np.array([0, 0]))[0].shape == (0, 3)
    assert [toxicity.LANGUAGES[i] for i in toxicity.languages_of(*toxicity.words_of(np.frombuffer(b"the of und der die la et les", np.uint8), np.array([0, 6, 17, 28]))[1:], 3)] == ["en", "de", "fr"]


def test_pooling_of_a_text_does_not_depend_on_its_place():
    r = np.random.default_rng(1)
    net = toxicity._fresh(r.normal(0, 1, (3, 1 << 16)).astype(np.float32), 3)
    texts = [r.integers(0, 1 << 16, (n, 3)).astype(np.int32) for n in (5, 0, 1, 2, 700, 3, 0)]
    counts = np.array([len(t) for t in texts])
    alone = [net.probabilities(t, np.array([len(t)]))[0] for t in texts]
    for rows in (10, 100, 10_000):
        assert np.allclose(net.probabilities(np.concatenate(texts), counts, rows), alone, atol=1e-5)
    x = [net.embedded(np.concatenate([t, np.full((3, 3), -1, np.int32)])) for t in texts]
    for t, e, p in zip(texts, x, alone):  # filter by filter, place by place
        pooled = []
        for w, f in zip(toxicity.WIDTHS, net.filters):
            z = [sum(e[i + k] @ f[k] for k in range(w)) for i in range(len(t) + 1)]
            pooled.append(np.max(z, axis=0))
        hidden = np.maximum(np.concatenate(pooled) + np.concatenate(net.biases), 0)
        assert abs(1 / (1 + np.exp(-(hidden @ net.weights + net.bias))) - p) < 1e-5


def test_best_cut():
    assert toxicity.best_cut(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == 0.5
    assert 0.3 < toxicity.best_cut(np.array([0.9, 0.3, 0.3, 0.4]), np.array([1, 0, 0, 1])) < 0.4


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items()) and len(got) == 1000
    own = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in own]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_of_odd_documents(spark, odd_docs, make_docs):
    docs = make_docs([prose(i, 60) + (" badword" if i % 3 == 0 else "") for i in range(60)])
    marks = [(i, int(i % 3 == 0)) for i in range(60)]
    labels = spark.createDataFrame(marks + [(0, 1), (1, None), (2, 7), (999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {r.doc_id: r.predicted for r in toxicity.classify(docs, model).collect()} == dict(marks)
    odd = toxicity.classify(odd_docs, model).collect()
    assert len(odd) == 12 and not any(r.predicted for r in odd)
    assert len({r.score for r in odd if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.classify(make_docs([]), model).count() == 0
    only = toxicity.train(docs, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.classify(docs, only).collect()} == {1.0}
    assert {r.score for r in toxicity.classify(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_rows_beyond_the_sample_are_learned_from(spark, make_docs, monkeypatch):
    """Two kinds of toxic texts, one of which the bounded part does not hold."""
    monkeypatch.setattr(toxicity, "SAMPLE", 6)
    r = random.Random(3)
    texts = [" ".join(r.choice(["plain", "word", "other", "thing"]) for _ in range(12)) for _ in range(400)]
    toxic = {i: ("vile" if i % 40 == 0 else "nasty brute") for i in range(0, 400, 4)}
    docs = make_docs([t + " " + toxic.get(i, "good") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int")
    read = []
    crossed = toxicity.crossed_counts
    monkeypatch.setattr(toxicity, "crossed_counts", lambda *a: read.append(crossed(*a)) or read[0])
    model = toxicity.train(docs, labels)
    assert read[0][3].sum() == 400 and read[0][1].sum() == len(toxic)  # all rows fix the thresholds
    part = toxicity.sample(toxicity._labelled(docs, labels))
    held, total = toxicity.document_counts(toxicity._labelled(docs, labels))
    start = toxicity.fit_network(part[0], part[1], toxicity.log_odds(held.sum(axis=0), total.sum(axis=0)))
    words = np.frombuffer(b"vile nasty brute", np.uint8)
    slots = toxicity.words_of(words, np.array([0, len(words)]))[0]
    assert all((model.network.tables[k][slots[:, k]] != start.tables[k][slots[:, k]]).any() for k in range(3))
    got = {x.doc_id: x.predicted for x in toxicity.classify(docs, model).collect()}
    assert got == {i: int(i in toxic) for i in range(400)}


def test_rows_of_parameters_come_back(spark):
    net = toxicity._fresh(np.zeros((3, 1 << 16), np.float32), 1)
    same = net.moved(np.zeros_like(net.rows()))
    assert np.array_equal(same.rows(), net.rows()) and same.bias == net.bias and same.tables is not net.tables
    assert toxicity.best_cut(np.array([0.9, 0.2]), np.array([2, 0]), np.array([2, 2])) == toxicity.best_cut(np.array([0.9, 0.9, 0.2, 0.2]), np.array([1, 1, 0, 0]))
