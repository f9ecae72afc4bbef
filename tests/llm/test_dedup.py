"""SimHash, suffix-array and embedding dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import prose
from marketlab.llm import passages, simhash, vectors
from marketlab.llm.components import components, forest


def roots(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    cut = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(c, 42) for c in cut]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, make_docs):
    texts = [prose(s, 400) for s in range(40)]
    texts += [t + " extra" for t in texts[:10]] + [texts[0], None, "", "one two"]
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    assert [got[i].component_id for i in range(len(texts))] == roots(len(texts), links)
    assert got[52].component_id == got[51].component_id == 51


@pytest.mark.parametrize("own", [True, False])
def test_tiles_lose_no_link(own):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in a], dtype=np.uint64)
    b = np.unique(np.concatenate([a ^ flips, a])) if own else a ^ flips
    x, y = (b, b) if own else (a, b)
    want = {(min(int(p), int(q)), max(int(p), int(q))) for p in x for q in y[np.bitwise_count(y ^ p) <= 4] if p != q}
    l, r = simhash.compare(b, None, 4, block=500) if own else simhash.compare(a, b, 4, block=500)
    got = list(zip(l.view(np.uint64).tolist(), r.view(np.uint64).tolist()))
    nodes = sorted({v for p in want for v in p})
    at = {v: i for i, v in enumerate(nodes)}
    assert roots(len(nodes), [(at[p], at[q]) for p, q in want]) == roots(len(nodes), [(at[p], at[q]) for p, q in got])


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 1, 3: 1, 9: 8}


def test_simhash_odd_rows(odd_docs, make_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == by[0] == 0 and by[5] == 4 and by[9] == 9
    by = {r.doc_id: r.component_id for r in simhash.similar_documents(odd_docs).collect()}
    assert by[1] == by[2] == by[0] == 0 and by[5] == by[6] == 4 and by[9] == 9
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [i for i in {v for v in by.values()} if i is not None] + [None]))
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_similar_documents(spark, make_docs):
    import random

    def jaccard(a, b):
        cut = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
        return len(cut[0] & cut[1]) / len(cut[0] | cut[1])

    r = random.Random(8)
    texts = [prose(700 + i, 300) for i in range(40)]
    for i in range(20):
        words = texts[i].split()
        for at in r.sample(range(300), 4 if i < 12 else 60):
            words[at] = "changed"
        texts.append(" ".join(words))
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(make_docs(texts)).collect()}
    for i in range(20):
        j = jaccard(texts[i], texts[40 + i])
        assert (j > 0.85) == (i < 12) and j < 0.3 or i < 12
        assert got[40 + i] == (i if i < 12 else 40 + i)
    assert all(got[i] == i for i in range(40))
    assert simhash.similar_documents(make_docs([])).count() == 0
    assert simhash.allowed_bits(0.8)[1] < 64


def removed(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + 200] for x in raw for i in range(len(x) - 199))
    out = []
    for x in raw:
        cover = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i:i + 200]] > 1:
                cover[i:i + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~cover]) if len(x) else b""
        out.append((len(x), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_stretches(spark, make_docs):
    p = prose(50, 60)  # over 200 bytes
    edge = "q" * 5 + p[:200]
    texts = [prose(i, 150) for i in range(6)]
    texts += [texts[0] + p, p + texts[1], texts[2][:100] + p[:200] + texts[3][:50], texts[4][:80] + p[:199] + "?",
              edge, edge[5:], "line again. " * 60, "line again. " * 33, "é" * 150, "é" * 130 + "a", None, "", texts[5], texts[5], p]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.digests(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)


def test_crowded_groups_are_cut_by_context(spark, make_docs, monkeypatch):
    monkeypatch.setattr(passages, "CROWD", 3)
    p = prose(51, 40)[:150]
    texts = [prose(100 + i, 40) + p + prose(200 + i % 5, 40) for i in range(30)] + [prose(100 + i, 40)[-80:] + p + "z" * i for i in range(9)]
    places = np.array([(0, 0)], passages._PLACE)
    group = passages._Group(1)
    gram = passages.GRAM
    for i, t in enumerate(texts):
        at = t.index(p)
        raw = t.encode()
        places["k8"], places["cp"] = i, max(0, at - passages.LEFT)
        group.add(raw[max(0, at - passages.LEFT):at + gram + passages.LEFT], min(at, passages.LEFT), places.tobytes())
    marks = passages._marks([group])
    cut = sorted(zip(*(marks[k].tolist() for k in ("k8", "lo", "hi"))))
    monkeypatch.setattr(passages, "CROWD", 10**9)
    assert cut == sorted(zip(*(passages._marks([group])[k].tolist() for k in ("k8", "lo", "hi")))) and cut


def test_windows_of_crowded_anchors_are_dealt_by_context(spark, make_docs, monkeypatch):
    p = prose(52, 60)
    texts = [prose(300 + i, 40) + p[:230 + i % 3] + prose(400 + i % 7, 40) for i in range(24)]
    texts += [prose(300 + i, 40)[-i:] + p[:150] + prose(400, 60) for i in range(1, 9)] + [p[20:200] + "é" * i for i in range(30)]
    texts += [prose(500, 30) + "line again. " * (30 + i) for i in range(4)] + [texts[0], p, None, ""]
    monkeypatch.setattr(passages, "SPREAD", 3)
    for batch in (passages.BATCH, 200):  # with the second, tasks hand over contexts in small lots
        monkeypatch.setattr(passages, "BATCH", batch)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.digests(make_docs(texts)).collect()}
        assert [got[i] for i in range(len(texts))] == removed(texts)


def test_a_crowded_context_is_transformed_in_bounded_batches(monkeypatch):
    r = np.random.default_rng(3)
    raw = [bytes(r.choice(np.frombuffer(b"ab", np.uint8), 336)) for _ in range(40)]
    middle = raw[0][100:240]
    windows = [w[:100] + middle + w[240:] for w in raw]
    windows += [windows[i][:100 - i % 5] + raw[i + 1][100 - i % 5:100] + windows[i][100:] for i in range(30)]
    keys = [(w, passages.LEFT) for w in windows]
    starts = Counter((s, w[s:s + 200]) for w, _ in keys for s in range(137))
    expected = [[s for s in range(137) if starts[(s, w[s:s + 200])] > 1] for w, _ in keys]
    sizes = []
    whole = passages.repeated_starts
    monkeypatch.setattr(passages, "repeated_starts", lambda w, *a, **k: sizes.append(sum(map(len, w))) or whole(w, *a, **k))
    monkeypatch.setattr(passages, "CROWD", 3)
    for batch in (10**6, 1500, 300):
        monkeypatch.setattr(passages, "BATCH", batch)
        sizes.clear()
        group = passages._Group(1)
        for i, (w, a) in enumerate(keys):
            group.add(w, a, np.array([(i, 0)], passages._PLACE).tobytes())
        marks = passages._marks([group])
        got = {k: (lo, hi) for k, lo, hi in zip(*(marks[x].tolist() for x in ("k8", "lo", "hi")))}
        assert got == {i: (s[0], s[-1] + 200) for i, s in enumerate(expected) if s} and got
        assert max(sizes, default=0) <= batch


def test_interleave_needs_no_shard_order():
    windows = [prose(i % 4, 60).encode()[:330] for i in range(12)]
    whole = passages.repeated_starts(windows, [1] * 12, [100] * 12, shard=10**9)
    cut = passages.repeated_starts(windows, [1] * 12, [100] * 12, shard=400)
    assert all((x == y).all() for x, y in zip(whole, cut)) and len(whole[0])


def test_stretches_odd_rows(odd_docs, make_docs):
    rows = passages.digests(odd_docs).collect()
    assert len(rows) == 12 and sum(r.n_bytes == 0 for r in rows) == 2
    left = passages.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == 12
    assert passages.digests(make_docs([])).count() == 0


def brute_vectors(rows):
    good = [(i, l, np.array(e, float) / np.abs(np.array(e, float)).max()) for i, (v, e, l) in enumerate(rows)
            if l is not None and e and None not in e and np.isfinite(e).all() and np.any(e) and len(e) == 6]
    links = [(a, b) for a, la, ea in good for b, lb, eb in good
             if a < b and la == lb and ea @ eb / np.linalg.norm(ea) / np.linalg.norm(eb) >= 0.93]
    n = Counter(x for p in links for x in p)
    return [n[i] for i in range(len(rows))], roots(len(rows), links)


def test_vector_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6))
    e = [*(base + 0), *(base[:30] + rng.normal(scale=0.05, size=(30, 6))), *(base[:10] + 0)]
    rows = [(i, x.tolist(), i % 3 % 2) for i, x in enumerate(e)]
    rows += [(100, None, 1), (101, [0.0] * 6, 1), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (103, [float("nan")] * 6, 1), (104, [float("inf")] * 6, 1),
             (105, base[0].tolist(), None), (106, [1.0, 2.0], 0), (107, [1e300] * 6, 0), (108, [1e-300] * 6, 0), (109, [], 0)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, n string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, recall=1.0).collect()}
    n, root = brute_vectors(rows)
    ids = [r[0] for r in rows]
    assert [got[i].n_links for i in ids] == n
    assert [got[i].component_id for i in ids] == [ids[x] for x in root]
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vector_recall_with_many_cells(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 16))
    e = np.concatenate([base, base[:200] + rng.normal(scale=0.1, size=(200, 16))])
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(e)], "vec_id long, embedding array<double>, label int")
    fit = vectors.fit
    vectors.fit = lambda c, s, r, n: fit(c, s, r, n, cell_rows=20)
    try:
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, part=50).collect()}
    finally:
        vectors.fit = fit
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    have = np.array([got[i] for i in range(len(e))])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()


def test_visits_follow_both_halves():
    rng = np.random.default_rng(7)
    index = vectors.MultiIndex(rng.normal(size=(9, 3)), rng.normal(size=(7, 3)))
    x = rng.normal(size=(50, 6))
    d = ((x[:, None, :3] - index.first) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - index.second) ** 2).sum(2)[:, None, :]
    want = np.argsort(d.reshape(50, -1), axis=1)[:, :12]
    assert (index.nearest(x, 12) == want).all()


def linked(rows, similarity=0.93):
    """Number of links and least reachable id of each vector, by brute force."""
    def close(a, b):
        if a[1] != b[1] or len(a[2]) != len(b[2]):
            return False
        x, y = np.array(a[2]), np.array(b[2])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= similarity

    near = {a[0]: [b[0] for b in rows if b is not a and close(a, b)] for a in rows}
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out[i] = (len(near[i]), min(seen))
    return out


def test_vectors_of_every_length_link_among_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 1, [1.0 + 0.01 * i, 2.0]) for i in range(3)] + [(10 + i, 1, [1.0, 2.0, 0.01 * i]) for i in range(4)] + [(20, 1, [5.0]), (21, 1, [2.0]), (22, 1, [-2.0])]
    rows += [(100 + i, 1 + i % 2, rng.normal(size=8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == linked(rows) and got[0][0] == 2 and got[21] == (1, 20)


def test_planted_links_over_several_cells(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    rows = [(i, int(i % 3), (base[i % 40] + 0.12 * rng.normal(size=16)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    want = linked(rows)
    classes = df.select("vec_id", "label", "embedding", F.col("vec_id").alias("node"))
    index = vectors.fit(classes, 0.93, cell_rows=10)
    assert index.cells >= 36 and index.recall >= 0.9999 and sum(n for n, _ in want.values()) > 500
    fit = vectors.fit
    try:
        vectors.fit = lambda c, s, r, n: fit(c, s, r, n, cell_rows=10)
        exact = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, exact=True).collect()}
        usual = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    finally:
        vectors.fit = fit
    assert exact == want
    assert sum(n for n, _ in usual.values()) >= 0.99 * sum(n for n, _ in want.values())
