"""Language, quality, chat, decontamination and language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import prose
from marketlab.llm import chat, decontaminate, katz, langid, quality

SF = "/root/testdata/sf0.001"


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_languages_of_held_out_documents(spark):
    got = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    own = [d for d in docs if held(d.doc_id, 5) == 0 and d.lang is not None]
    assert all(got[d.doc_id].held_out == (held(d.doc_id, 5) == 0) for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in own]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixtures_and_odd_texts(spark, make_docs, odd_docs):
    def text(seed, letters, n=80):
        r = random.Random(seed)
        return " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))

    learn = make_docs([text(i, "abcd") for i in range(5)] + [text(9 + i, "wxyz") for i in range(5)] + ["no language"], langs=["aa"] * 5 + ["zz"] * 5 + [None])
    names, log_p = langid.train(learn)
    assert names == ["aa", "zz"] and np.allclose(np.exp(log_p).sum(axis=0), 1, atol=1e-3)
    asked = make_docs([text(50, "abcd", 60) + " " + text(51, "wxyz", 20), text(52, "wxyz"), None, "", "12 34 !?", "²³"])
    got = {r.doc_id: r for r in langid.identify(asked, names, log_p).collect()}
    assert got[0].lang_pred == "aa" and sorted(got[0].langs) == ["aa", "zz"] and abs(got[0].score - 0.75) < 0.05
    assert got[1].langs == ["zz"] and got[1].score == 1.0
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2, 3, 4, 5))
    assert langid.identify(odd_docs, names, log_p).count() == 12
    nothing = langid.train(make_docs([]))
    assert [r.lang_pred for r in langid.identify(make_docs(["abc"]), *nothing).collect()] == ["und"]
    assert langid.identify(make_docs([]), names, log_p).count() == 0


def test_quality_of_held_out_documents(spark):
    got = {r.doc_id: r for r in quality.query(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    own = [i for i in labels if held(i, 3) == 1]
    assert all(got[i].held_out for i in own) and len(got) == 1000
    assert np.mean([got[i].predicted == labels[i] for i in own]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())


def test_quality_odd_rows(spark, odd_docs, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, x string")
    assert {r.score for r in quality.classify(odd_docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 0, "x") for i in (0, 2, 3, 4, 5, 6)], "doc_id long, quality int, x string")
    assert {r.predicted for r in quality.classify(odd_docs, one).collect()} == {0}
    mixed = spark.createDataFrame([(i, i % 2, "x") for i in range(10)] + [(3, None, ""), (4, 7, "")], "doc_id long, quality int, x string")
    rows = quality.classify(odd_docs, mixed).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(make_docs([]), mixed).count() == 0
    kept = quality.accepted(odd_docs, mixed)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_density_difference_is_the_discriminant():
    rng = np.random.default_rng(2)
    p = len(quality.NAMES)
    means, a = rng.normal(size=(2, p)), rng.normal(size=(2, p, p))
    cov = np.array([m @ m.T + np.eye(p) for m in a])
    roots = np.array([np.linalg.inv(np.linalg.cholesky(c)) for c in cov])
    model = quality.Discriminant(np.zeros(p), np.ones(p), means, roots, np.array([-0.5 * np.linalg.slogdet(c)[1] for c in cov]))
    x = rng.normal(size=(20, p))
    log = [[-0.5 * (v - m) @ np.linalg.solve(c, v - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(means, cov)] for v in x]
    assert np.allclose(model.score(x), [1 / (1 + math.exp(min(700, l[0] - l[1]))) for l in log])


def test_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}', '{"messages":[]}', '{"instruction":"i","input":"more","output":"o"}',
               '{"instruction":"i","output":"o","system":"s"}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}',
               '{"prompt":"p","completion":"c"}', '{"prompt":"p","response":2}', '{"question":"q","answer":"a"}', '{"x":1}', '[1]', None]
    df = spark.createDataFrame([(r, "mine") for r in records], "j string, layout string").select(F.try_parse_json("j").alias("record"), "layout")
    got = [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.format_records(df).collect()]
    assert got == [("messages", [("user", "a"), ("assistant", "")]), ("messages", []), ("instruction", [("user", "i\nmore"), ("assistant", "o")]),
                   ("instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]), ("from_value", [("user", "h"), ("assistant", "g")]),
                   ("prompt_completion", [("user", "p"), ("assistant", "c")]), ("prompt_response", [("user", "p"), ("assistant", "2")]),
                   ("question_answer", [("user", "q"), ("assistant", "a")]), (None, None), (None, None), (None, None)]


def test_round_trip(spark):
    r = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "/", "<", "[", "]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|", "\n", "$1", "ü", "𝄞", "a", ""]
    turns = [[(r.choice(["user", "assistant", "system", "to[INST]ol", ""]), "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(0, 6))] for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], f"i int, turns {chat.TURNS}").withColumn("f", chat.render(F.col("turns")))
    for row in df.withColumn("back", chat.read_back(F.col("f"))).collect():
        assert [(t.role, t.text) for t in row.back] == turns[row.i]
        assert [t.in_loss for t in row.back] == [role == "assistant" for role, _ in turns[row.i]]


def test_conversations_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "a"), (None, 0, "user", "x"), (2, None, "user", ""), (2, None, "user", "")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn int, role string, text string, record int, layout string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.format_records(chat.conversations_as_records(df)).collect()}
    assert got == {1: [("", "a"), ("user", ""), ("assistant", "b")], None: [("user", "x")], 2: [("user", ""), ("user", "")]}
    assert chat.conversations_as_records(df.limit(0)).count() == 0


ITEM = "A train leaves at 60 km from Paris and then Alice has 60 apples and 5 pears left over today"


def test_reparameterised_questions(spark, make_docs):
    items = spark.createDataFrame([(1, ITEM, 1), (2, "short one", 1), (3, None, 1), (4, ITEM.replace("60", "61"), 1), (5, "six words are one whole window", 1)],
                                  "item_id long, text string, key int")
    texts = ["Intro here. " + ITEM.replace("60", "72").replace("Paris", "Rome"), "Then: A train leaves at 72 km from Rome and then Bob has 73 apples and 9 pears left over today",
             "foo. " + ITEM + " bar", ITEM[:40], None, "", prose(1, 50_000), "He said six words are one whole window there.", prose(2, 40)]
    found = decontaminate.contaminated(make_docs(texts, ids=[*range(8), None]), items)
    got = {(r.doc_id, r.item_id): r.kind for r in found.collect()}
    assert got == {(0, 1): "reparameterised", (0, 4): "reparameterised", (2, 1): "verbatim", (2, 4): "verbatim", (7, 5): "verbatim"}
    docs = make_docs(texts, ids=[*range(8), None])
    rows = decontaminate.verdicts(docs, found).collect()
    assert len(rows) == 9 and sorted(r.doc_id for r in rows if r.contaminated) == [0, 2, 7]
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, items).collect()) == sorted(["1", "3", "4", "5", "6", "None"])
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(make_docs([]), items).count() == 0


def test_whole_items_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {d.doc_id for d in docs for i in items if i.text in d.text}
    got = {r.doc_id for r in decontaminate.query(spark, SF).collect() if r.contaminated}
    assert want and want <= got and len(got - want) <= 2


def counts_of(texts):
    words = [[*(t or "").encode().lower().split(), None] for t in texts]
    return words, Counter(w for ws in words for w in ws)


def test_base_scores(spark, make_docs):
    texts = [prose(i % 7, 30 + i) for i in range(30)] + [None, "", " \x1cA b\x0bc ", "É É"]
    docs = make_docs(texts)
    own = F.col("doc_id") % 4 == 0
    model = katz.train(docs.where(~own))
    got = {r.doc_id: r for r in katz.score(docs, model, own).collect()}
    words, c = counts_of([t for i, t in enumerate(texts) if i % 4])
    words = counts_of(texts)[0]
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    for i, ws in enumerate(words):
        assert (got[i].n_tokens, got[i].n_known) == (len(ws), sum(c[w] > 0 for w in ws))
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0


@pytest.mark.parametrize("texts", [[prose(i % 5, 200) for i in range(40)], ["a b a b a b a b"] * 9, ["a"], [None], []])
def test_probabilities_sum_to_one(spark, make_docs, texts):
    model = katz.train(make_docs(texts, ids=list(range(len(texts)))))
    pairs = {}
    for r in model.pairs.collect():
        pairs.update(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist()))
    classes = range(len(model.count))
    for u in [*classes, model.start]:
        keys = np.array([(u << 20) | w for w in classes], dtype=np.uint64)
        n = np.array([pairs.get(int(k), 0) for k in keys])
        with np.errstate(divide="ignore"):
            p = 10 ** np.where(n > 0, model.seen(keys, np.maximum(n, 1)), model.unseen(keys))
        assert math.isclose(p.sum(), 1, rel_tol=1e-9), u
    assert math.isclose(model.p.sum(), 1)


def test_entries_and_local_scores_agree(spark, make_docs, monkeypatch):
    docs = make_docs([prose(i % 9, 60) for i in range(60)])
    model = katz.train(docs)
    want = {r.doc_id: r.score for r in katz.score(docs, model, F.lit(False)).collect()}
    model.hot, model.hot_n = model.hot[:0], model.hot_n[:0]  # every pair is asked for
    got = {r.doc_id: r.score for r in katz.score(docs, model, F.lit(False)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_scores_odd_rows(odd_docs, make_docs):
    model = katz.train(odd_docs)
    rows = katz.score(odd_docs, model, F.lit(True)).collect()
    assert len(rows) == 12 and sum(r.doc_id == 9 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert katz.score(make_docs([]), model, F.lit(True)).count() == 0


def test_tokens_are_contract_words():
    text = "Ab  cD e\x1cf\tÉ\n"
    got = katz.tokenise(pa.chunked_array([pa.array([text, None])]))
    assert len(got.codes) == len(text.encode().lower().split()) + 2 and got.doc.tolist() == [0] * (len(got.codes) - 1) + [1]


def test_every_alignment_and_every_row_is_judged(spark, make_docs):
    item = "A farmer named Ann Miller has 12 red apples and gives 5 apples to her friend Bob so that 12 minus 5 apples are left for Ann Miller"
    clash = item.replace("12 minus", "40 minus")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = prose(8, 40)
    texts = [f"{clash} {other} {item}", f"{item} {other} {clash}", clash, item, other, item.replace("12", "31"), other, None, item]
    docs = make_docs(texts, ids=[0, 1, 2, None, None, 5, 6, 7, 6])
    found = decontaminate.contaminated(docs, items)
    got = decontaminate.verdicts(docs, found)
    assert sorted((str(r.doc_id), r.contaminated, r.kind) for r in got.collect()) == sorted([
        ("0", True, "verbatim"), ("1", True, "verbatim"), ("2", False, None), ("None", True, "verbatim"), ("None", False, None),
        ("5", True, "reparameterised"), ("6", False, None), ("7", False, None), ("6", True, "verbatim")])
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, items).collect()) == ["2", "6", "7", "None"]


def test_long_runs_of_numbers_and_names(spark, make_docs):
    item = "A farmer named Ann Miller has 12 red apples and gives 5 apples to her friend Bob so that 7 apples are left"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    numbers, names = "1.2" + ",3" * 50_000, "say, " + "Ab " * 50_000
    docs = make_docs([numbers, f"{names} and then. {item}", f"{numbers} {item}", item])
    got = {r.doc_id: r.kind for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: "verbatim", 2: "verbatim", 3: "verbatim"}
    one = docs.where("doc_id = 0").select(decontaminate.slot_values(F.col("text"))[decontaminate.NUMBER].alias("v")).first().v
    assert one == [numbers]


@pytest.mark.parametrize("share", [2.0**-17, 0.02, 0.2, 2.0])
def test_pairs_of_rare_words_count(spark, make_docs, monkeypatch, share):
    """Whatever share of the words is rare, a pair has the discounted share of its own count."""
    monkeypatch.setattr(katz, "SHARE", share)
    texts = ["x y z " * 3, "x y q", "q r s", "a b a b a c", "q r", "z z", None] * 3 + ["r s t u", "u u x"]
    docs = make_docs(texts)
    model = katz.train(docs)
    asked = make_docs([*texts, "x q new new y", "new", "s a t"])
    got = {r.doc_id: r.score for r in katz.score(asked, model, F.lit(True)).collect()}
    words, c = counts_of(texts)
    pairs = Counter(p for ws in words for p in zip(["start", *ws[:-1]], ws))
    n, ends = sum(c.values()), len(texts)
    rare = {w for w in c if w is not None and c[w] < max(1, n * share)}
    n_rare = sum(c[w] for w in rare)

    def single(w):
        if w is None:
            return (ends + 1) / (n + 2)
        return c[w] / (n + 2) if w in c and w not in rare else (n_rare + 1) / (n + 2) * (c[w] + 1) / (n_rare + len(rare) + 1)

    d = katz.discounts(np.array([sum(x == r for x in pairs.values()) for r in range(1, katz.K + 2)]))
    kept = {p: (d[x] if x <= katz.K else 1.0) * x for p, x in pairs.items()}

    def pair(u, w):
        mine = [p for p in pairs if p[0] == u]
        if not mine:
            return single(w)
        total, some = sum(pairs[p] for p in mine), sum(kept[p] for p in mine)
        total += total - some < 1e-9 * total
        return kept[u, w] / total if (u, w) in pairs else (1 - some / total) / (1 - sum(single(p[1]) for p in mine)) * single(w)

    for u in [*c, "start", b"new"]:
        assert u is None or math.isclose(sum(pair(u, w) for w in [*c, b"new"]), 1)
    for i, ws in enumerate(counts_of([*texts, "x q new new y", "new", "s a t"])[0]):
        assert math.isclose(got[i], sum(math.log10(pair(u, w)) for u, w in zip(["start", *ws[:-1]], ws)), rel_tol=1e-9), i


def test_turns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = katz.train(docs)
    one, three = ({r.doc_id: (r.score, r.base_score, r.n_known) for r in katz.score(docs, model, F.lit(True), n).collect()} for n in (1, 3))
    assert one.keys() == three.keys() and all(np.allclose(one[i], three[i], rtol=1e-9) for i in one)
