import random
import statistics

import pytest
from helpers import candidates, frame, rows_of, swaps

from marketlab import schemas
from marketlab.functions import ids
from marketlab.operators import metrics, ordering, quality, replay, verdict
from marketlab.operators.folds import Run, drawdown_and_streak
from marketlab.operators.quantiles import exact_quantiles

import numpy as np


def trades(spark, outcomes, **extra):
    return frame(spark, schemas.TRADE_RECORDS, [
        {"trade_id": f"{i:04d}", "candidate_id": f"c{i}", "strategy_id": "TIME_EXIT_NEW_TOKEN_5ms",
         "scenario_id": "realistic", "entry_signal_time": 1000 * i, "outcome": float(o),
         "outcome_class": "WIN" if o > 0 else "LOSS", **extra} for i, o in enumerate(outcomes)])


def known(spark, n):
    return candidates(spark, [{"candidate_id": f"c{i}", "mint": f"m{i}"} for i in range(n)])


def test_quantile_vector(spark):
    x = [0.10, -0.10, 0.30, 0, 0.20, -0.20, 0.40, 0.05, 0.25, 0.15]
    row = metrics.strategy_aggregates(trades(spark, x), known(spark, 10)).first()
    got = [row[f"outcome_{n}"] for n in ("p10", "p25", "median", "p75", "p90")]
    assert got == pytest.approx([-0.11, 0.0125, 0.125, 0.2375, 0.31])
    assert row["strategy_id"] == "TIME_EXIT" and row["total_trades"] == 10
    assert row["outcome_stddev"] == pytest.approx(statistics.stdev(x))
    assert row["outcome_realistic"] == row["outcome_mean"] and row["outcome_degraded"] is None


def test_drawdown_vector(spark):
    row = drawdown_and_streak(trades(spark, [0.10, 0.20, -0.15, -0.10, 0.05, -0.25]), ["scenario_id"]).first()
    assert row["max_drawdown"] == pytest.approx(0.45)
    assert row["max_consecutive_losses"] == 2


def test_single_trade(spark):
    row = metrics.strategy_aggregates(trades(spark, [-0.5]), known(spark, 1)).first()
    assert row["outcome_stddev"] == 0.0 and row["outcome_p10"] == -0.5
    assert row["max_drawdown"] == 0.5 and row["max_consecutive_losses"] == 1
    assert row["token_win_rate"] == 0.0


def test_token_rate_uses_the_mean_per_candidate(spark):
    t = trades(spark, [1.0, -0.5, -0.2, -0.1])
    t = t.replace({"c1": "c0", "c3": "c2"}, subset="candidate_id")
    row = metrics.strategy_aggregates(t, known(spark, 4)).first()
    assert (row["total_tokens"], row["token_win_rate"], row["win_rate"]) == (2, 0.5, 0.25)


def test_runs_combine_like_one_run():
    rnd = random.Random(3)
    x = np.array([rnd.choice([-1.0, -0.5, 0.0, 0.7, 1.2]) for _ in range(200)])
    for cut in (1, 50, 137, 199):
        a, b, whole = Run.of(x[:cut]), Run.of(x[cut:]), Run.of(x)
        joined = a.then(b)
        assert list(vars(joined).values()) == pytest.approx(list(vars(whole).values()))


def test_folds_equal_a_plain_loop(spark):
    rnd = random.Random(5)
    x = [rnd.choice([-0.3, -0.1, 0.0, 0.2, 0.25]) for _ in range(400)]
    cum = peak = dd = 0.0
    streak = best = 0
    for o in x:
        cum += o
        peak = max(peak, cum)
        dd = max(dd, peak - cum)
        streak = streak + 1 if o <= 0 else 0
        best = max(best, streak)
    # equal times are ordered by id
    t = trades(spark, x).selectExpr("* except (entry_signal_time)", "0L entry_signal_time").repartition(7)
    row = drawdown_and_streak(t, ["strategy_id", "scenario_id"]).first()
    assert row["max_drawdown"] == pytest.approx(dd) and row["max_consecutive_losses"] == best


def test_quantiles_with_a_hot_value(spark):
    rnd = random.Random(9)
    x = [0.5] * 300 + [rnd.gauss(0, 1) for _ in range(200)] + [1e9, -1e9]
    df = spark.createDataFrame([("g", v) for v in x], "g string, v double")
    probs = {"a": 0.0, "b": 0.01, "c": 0.33, "d": 0.5, "e": 0.9, "f": 1.0}
    row = exact_quantiles(df, ["g"], "v", probs).first()
    for n, p in probs.items():
        assert row[n] == pytest.approx(float(np.quantile(x, p)))


def test_missing_candidates(spark):
    assert rows_of(metrics.missing_candidates(trades(spark, [1, 2]), known(spark, 1)),
                   "candidate_id", "trades") == [("c1", 1)]


def aggregates(spark, rows):
    base = {n: 0.0 for n in schemas.STRATEGY_AGGREGATES.names}
    return frame(spark, schemas.STRATEGY_AGGREGATES, [
        {**base, "strategy_id": "TIME_EXIT", "entry_event_type": "NEW_TOKEN", "total_trades": 1,
         "total_tokens": 1, "wins": 1, "losses": 0, "max_consecutive_losses": 0,
         "token_win_rate": 0.6, "outcome_p25": 0.01, **r} for r in rows])


@pytest.mark.parametrize("real, pess, p25, rate, want", [
    (0.10, 0.06, 0.01, 0.6, "GO"), (0.10, 0.04, 0.01, 0.6, "NO-GO"), (0.10, -0.1, 0.01, 0.6, "NO-GO"),
    (0.10, 0.06, 0.00, 0.6, "NO-GO"), (0.10, 0.06, 0.01, 0.04, "NO-GO"), (0.0, 0.0, 0.01, 0.6, "NO-GO"),
    (0.10, 0.05, 0.01, 0.05, "GO"), (0.10, None, 0.01, 0.6, "INSUFFICIENT_DATA")])
def test_verdict(spark, real, pess, p25, rate, want):
    rows = [{"scenario_id": "realistic", "outcome_median": real, "outcome_p25": p25, "token_win_rate": rate}]
    if pess is not None:
        rows.append({"scenario_id": "pessimistic", "outcome_median": pess})
    a = aggregates(spark, rows)
    out = verdict.decide(verdict.decision_inputs(a))
    assert [r["verdict"] for r in out.collect()] == [want]
    if want == "GO":
        assert verdict.best_verdict(out, a).first()["verdict"] == "GO"
        nothing = spark.createDataFrame([], "strategy_id string, entry_event_type string")
        barred = verdict.decide(verdict.decision_inputs(a, nothing))
        assert barred.first()["verdict"] == "NO-GO"


def test_sensitivity_and_comparison(spark):
    a = aggregates(spark, [{"scenario_id": "realistic", "outcome_median": 0.2, "win_rate": 0.5},
                           {"scenario_id": "pessimistic", "outcome_median": 0.1}])
    s = metrics.scenario_sensitivity(a).first()
    assert (s["realistic_median"], s["optimistic_median"], s["degradation_pct"]) == (0.2, 0.0, 50.0)
    c = metrics.source_comparison(a).first()
    assert (c["new_token_win_rate"], c["active_token_win_rate"], c["delta_median"]) == (0.5, 0.0, 0.2)


def test_day_runs_and_gap(spark):
    day = 86_400_000
    df = spark.createDataFrame([(d * day + 5,) for d in (1, 2, 3, 3, 6, 7)], "ts long")
    assert rows_of(ordering.day_runs(df, "ts"), "first_day", "last_day", "days") == [(1, 3, 3), (6, 7, 2)]


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(i, i / 3) for i in range(50)], "a long, b double")
    digest = lambda x: quality.fingerprint(x, "t").first()["digest"]
    assert digest(df) == digest(df.orderBy(df.b.desc()).repartition(5))
    assert digest(df) != digest(df.where("a <> 7"))
    whole = quality.dataset_fingerprint({"t": df}).where("table_name = 'ALL'").first()["digest"]
    assert quality.require_fingerprint({"t": df}, whole) == whole
    with pytest.raises(quality.FingerprintMismatch):
        quality.require_fingerprint({"t": df}, "x")


def test_order_violations(spark):
    rows = [(0, 1, "a", 0), (1, 1, "b", 0), (2, 1, "b", 0), (3, 0, "z", 9), (2_000_000, 5, "a", 0)]
    df = spark.createDataFrame([("k", *r) for r in rows],
                               "k string, pos long, slot long, tx_signature string, event_index int")
    assert rows_of(ordering.order_violations(df, "pos", ["k"]), "pos") == [(2,), (3,)]


def test_quantiles_put_nan_last(spark):
    from marketlab.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([("a", v) for v in (1.0, float("nan"), 3.0, -2.0)], "k string, v double")
    r = exact_quantiles(df, ["k"], "v", {"lo": 0.0, "third": 2 / 3}).first()
    assert (r["lo"], r["third"]) == (-2.0, 3.0)


def test_positions_are_dense_over_all_parts(spark):
    import random

    from marketlab.operators import ordering
    r = random.Random(2)
    rows = [(r.randrange(40), r.choice("abc"), i) for i in range(500)] + [(None, "x", 500), (7, None, 501)]
    df = spark.createDataFrame(rows, "a int, b string, n int").repartition(5)
    got = ordering.with_position(df, ["a", "b"]).collect()
    assert sorted(g["position"] for g in got) == list(range(502))
    keys = [((g["a"] is not None, g["a"] or 0), (g["b"] is not None, g["b"] or "")) for g in sorted(got, key=lambda g: g["position"])]
    assert keys == sorted(keys) and {g["n"] for g in got} == set(range(502))
    assert ordering.with_position(df.limit(0), ["a"]).count() == 0


def test_states_of_many_slices_are_merged_in_order(spark, monkeypatch):
    from helpers import swaps
    from marketlab.operators import ordering, replay
    monkeypatch.setattr(replay, "FAN", 3)
    hour = 3_600_000
    ev = swaps(spark, [{"timestamp": (i * 7 % 50) * hour, "slot": i * 7 % 50, "candidate_id": c, "tx_signature": f"{c}{i}"} for c in "ab" for i in range(50)])
    merged = ordering.merged_events(ev, spark.createDataFrame([], __import__("marketlab.schemas").schemas.LIQUIDITY_EVENTS))
    step = lambda s, b: (s[0] + "".join(chr(65 + int(x)) for x in b["slot"]),)
    got = replay.replay_fold(merged, ("",), step, lambda a, b: (a[0] + b[0],), "seen string", ["slot"], hour)
    assert {r["candidate_id"]: r["seen"] for r in got.collect()} == dict.fromkeys("ab", "".join(chr(65 + x) for x in range(50)))


def test_ambiguous_positions_are_told_exactly(spark):
    from helpers import swaps
    from marketlab.operators import quality
    rows = [{"candidate_id": c, "slot": s, "tx_signature": t, "timestamp": 1} for c, s, t in
            (("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x"), ("b", 1, "x"), ("c", None, "x"), ("c", None, "x"), (None, 1, "x"), (None, 1, "x"))]
    assert sorted(r[0] for r in quality.ambiguous_ids(swaps(spark, rows)).collect()) == ["b", "c"]


def test_a_fold_calls_python_by_batch_and_keeps_candidates_apart(spark):
    hour = 3_600_000
    rows = [{"candidate_id": f"c{i % 300:03d}", "timestamp": (i // 300) * 300 * hour, "slot": i} for i in range(900)]
    merged = ordering.merged_events(swaps(spark, rows), frame(spark, schemas.LIQUIDITY_EVENTS, []))
    add = lambda state, batch: (state[0] + "".join(f"{x}," for x in batch["slot"]),)
    got = replay.replay_fold(merged, ("",), add, lambda a, b: (a[0] + b[0],), "seen string", ["slot"], hour)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # a call for each candidate
    assert rows_of(got, "candidate_id", "seen") == [(f"c{i:03d}", f"{i},{i + 300},{i + 600},") for i in range(300)]


def test_trade_ids_move_packed(spark):
    texts = ["ab" * 32, "AB" * 32, "", "t", "abc", "é", "0001", "zz" * 32, None]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.packed("t").alias("p")).select(
        "t", ids.unpacked("p").alias("u"), "p").collect()
    assert all(r.t == r.u for r in back) and len({bytes(r.p) for r in back if r.p is not None}) == 8
    assert len(back[0].p) == 33
    # equal times: the order is that of the ids as text, digits and letters mixed
    names = ["b0", "a1", "x", "0a", "Zz", "ff"]
    x = [-0.3, 0.2, 0.4, -0.1, 0.5, -0.6]
    t = frame(spark, schemas.TRADE_RECORDS, [
        {"trade_id": n, "candidate_id": f"c{i}", "strategy_id": "TIME_EXIT_NEW_TOKEN_5ms", "scenario_id": "realistic",
         "entry_signal_time": 7, "outcome": o, "outcome_class": "WIN"} for i, (n, o) in enumerate(zip(names, x))])
    run = Run.of(np.array([o for _, o in sorted(zip(names, x))]))
    seen = []
    row = metrics.strategy_aggregates(t, known(spark, 6), lambda df, name: seen.append(df.schema) or df).first()
    assert seen[0]["trade_id"].dataType.typeName() == "binary"
    assert row["max_drawdown"] == pytest.approx(max(0.0, run.fall, -run.lo)) and row["max_consecutive_losses"] == run.best
    assert metrics.data_summary(known(spark, 6), t.unionByName(t)).first()["total_trades"] == 6
