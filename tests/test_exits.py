import math
import random

import pytest
from helpers import candidates, liquidity, price, rows_of

from marketlab.functions import costs, ids
from marketlab.operators import exits

MIN = 60_000


def run(spark, rules, points, liq, entry, source="NEW_TOKEN"):
    c = candidates(spark, [{"discovered_at": entry, "source": source}])
    return exits.evaluate(c, price(spark, points), liquidity(spark, liq), rules)


def trail(pct, stop, hold):
    return [exits.rule(ids.TRAILING_STOP, "NEW_TOKEN", trail=pct, stop=stop, max_hold=hold)]


def test_initial_stop(spark):
    out = run(spark, trail(0.1, 0.1, 3600_000), [(1000, 1.0), (61000, 0.85)], [(1, 5)], 1000)
    assert rows_of(out, "exit_reason", "exit_signal_time", "exit_signal_price") == [
        ("INITIAL_STOP", 61000, 0.85)]


def test_trailing_stop_and_peak(spark):
    pts = [(1000 + i * MIN, p) for i, p in enumerate([1, 1.2, 1.3, 1.4, 1.25])]
    out = run(spark, trail(0.1, 0.1, 3600_000), pts, [(1, 5)], 1000)
    assert rows_of(out, "exit_reason", "peak_price", "exit_signal_price") == [("TRAILING_STOP", 1.4, 1.25)]


def test_max_duration(spark):
    pts = [(1000 + i * MIN, p) for i, p in enumerate([1, 1.05, 1.03, 1.04, 1.02])]
    out = run(spark, trail(0.1, 0.1, 120_000), pts, [(1, 5)], 1000)
    assert rows_of(out, "exit_reason", "exit_signal_time", "exit_signal_price") == [
        ("MAX_DURATION", 121000, 1.03)]


def test_time_exit(spark):
    rules = [exits.rule(ids.TIME_EXIT, "NEW_TOKEN", hold=300_000)]
    out = run(spark, rules, [(1000, 1.0), (200_000, 2.0), (400_000, 3.0)], [(1, 5)], 1000)
    assert rows_of(out, "strategy_id", "exit_signal_time", "exit_signal_price") == [
        ("TIME_EXIT_NEW_TOKEN_300000ms", 301_000, 2.0)]


def guard(drop, hold):
    return [exits.rule(ids.LIQUIDITY_GUARD, "NEW_TOKEN", drop=drop, max_hold=hold)]


def test_liquidity_drop(spark):
    pts = [(1000 + i * MIN, 1.0) for i in range(3)]
    liq = [(1000 + i * MIN, x) for i, x in enumerate([1000, 900, 600])]
    out = run(spark, guard(0.3, 3600_000), pts, liq, 1000)
    assert rows_of(out, "exit_reason", "min_liquidity", "exit_signal_time") == [
        ("LIQUIDITY_DROP", 600.0, 121_000)]


def test_guard_duration_uses_price_events(spark):
    pts = [(1_000_000 + i * 30_000, 1.0) for i in range(6)]
    out = run(spark, guard(0.3, 60_000), pts, [(1_000_000, 1000), (1_120_000, 1000)], 1_000_000)
    assert rows_of(out, "exit_reason", "exit_signal_time") == [("MAX_DURATION", 1_060_000)]


def test_rejections(spark):
    both = guard(0.3, 60_000) + [exits.rule(ids.TIME_EXIT, "NEW_TOKEN", hold=5)]
    out = run(spark, both, [(1000, 1.0)], [(5000, 10)], 2000)
    assert rows_of(exits.rejected(out), "reason") == [("entry liquidity cannot be determined",)]
    assert rows_of(exits.exits(out), "strategy_type") == [("TIME_EXIT",)]
    none = run(spark, both, [(1000, 1.0)], [], 2000)
    assert exits.exits(none).isEmpty()
    assert {r[0] for r in rows_of(none, "reason")} == {"no liquidity data available"}
    assert {r[0] for r in rows_of(run(spark, both, [], [(1, 1)], 2000), "reason")} == {
        "no price data available"}
    assert run(spark, both, [(1000, 1.0)], [(1, 1)], 2000, "ACTIVE_TOKEN").isEmpty()


def test_rule_validation(spark):
    rules = exits.rule_table(spark, [
        exits.rule("OTHER", "NEW_TOKEN"), exits.rule(ids.TIME_EXIT, "NEW_TOKEN"),
        exits.rule(ids.TRAILING_STOP, "NEW_TOKEN", trail=0.1, stop=0.1),
        exits.rule(ids.LIQUIDITY_GUARD, "NEW_TOKEN", drop=0.3, max_hold=5)])
    assert rows_of(exits.rejected_rules(rules), "rule_no", "reason") == [
        (0, "unknown strategy type"), (1, "TIME_EXIT requires hold_duration_ms"),
        (2, "TRAILING_STOP requires max_hold_duration_ms")]
    assert rows_of(exits.valid_rules(rules), "strategy_id") == [("LIQUIDITY_GUARD_NEW_TOKEN_drop30_5ms",)]
    grid = exits.rule_table(spark, exits.default_rules())
    assert "TRAILING_STOP_ACTIVE_TOKEN_trail10_stop10_3600000ms" in {
        r[0] for r in rows_of(grid, "strategy_id")}


# --- against the definition: the least of all times at which a rule may stop ----------------

def value_at(points, t):
    known = [p for ts, p in points if ts <= t]
    return known[-1] if known else points[0][1]


def defined_trailing(points, entry, pct, stop, hold):
    start = value_at(points, entry)
    after = [(t, p) for t, p in points if t > entry]
    peak = {t: max([start] + [p for u, p in after if u <= t]) for t, _ in after}
    stops = {
        "INITIAL_STOP": {t for t, p in after if p <= start * (1 - stop)},
        "TRAILING_STOP": {t for t, p in after if p <= peak[t] * (1 - pct)},
        "MAX_DURATION": {t for t, _ in after if t >= entry + hold}}
    every = set().union(*stops.values())
    if not every:
        return "MAX_DURATION", entry + hold, value_at(points, entry + hold), max([start] + [p for _, p in after])
    first = min(every)
    return next(r for r, times in stops.items() if first in times), first, value_at(points, first), peak[first]


def defined_guard(points, liq, entry, drop, hold):
    times = {t for t, _ in points + liq if t > entry}
    start = value_at(liq, entry)
    stops = {
        "LIQUIDITY_DROP": {t for t in times if value_at(liq, t) < start * (1 - drop)},
        "MAX_DURATION": {t for t in times if t >= entry + hold}}
    every = set().union(*stops.values())
    first = min(every) if every else entry + hold
    low = min([start] + [value_at(liq, t) for t in times if t <= first or not every])
    return next((r for r, ts in stops.items() if first in ts), "MAX_DURATION"), first, value_at(points, first), low


@pytest.mark.parametrize("scale", [MIN, 40 * MIN])
def test_set_form_equals_the_definition(spark, scale):
    rnd = random.Random(7)
    pf = lf = None  # one frame per series
    cands, data, hold = [], {}, 60 * scale
    for i in range(25):
        cid = f"c{i:02d}"
        t, pts, liq = 1000, [], []
        for _ in range(rnd.randint(1, 60)):
            t += rnd.randint(1, 3 * scale)
            pts.append((t, round(math.exp(rnd.gauss(0, 0.3)), 3)))
        t = 500
        for _ in range(rnd.randint(1, 30)):
            t += rnd.randint(1, 6 * scale)
            liq.append((t, float(rnd.randint(50, 150))))
        entry = liq[0][0] + rnd.choice([0, 1, 20 * scale])
        data[cid] = (pts, liq, entry)
        cands.append({"candidate_id": cid, "discovered_at": entry})
        p, q = price(spark, pts, cid), liquidity(spark, liq, cid)
        pf = p if pf is None else pf.union(p)
        lf = q if lf is None else lf.union(q)
    # two rules per family with their own periods must not disturb each other
    sets = {0: (0.4, 0.45, hold), 1: (0.2, 0.6, hold // 3), 2: (0.35, hold), 3: (0.2, hold // 4)}
    rules = trail(*sets[0]) + trail(*sets[1]) + guard(*sets[2]) + guard(*sets[3])
    out = exits.evaluate(candidates(spark, cands), pf, lf, rules).collect()
    seen = set()
    for r in out:
        pts, liq, entry = data[r["candidate_id"]]
        if r["strategy_type"] == ids.TRAILING_STOP:
            want = defined_trailing(pts, entry, *sets[r["rule_no"]])
            got = (r["exit_reason"], r["exit_signal_time"], r["exit_signal_price"], r["peak_price"])
        else:
            want = defined_guard(pts, liq, entry, *sets[r["rule_no"]])
            got = (r["exit_reason"], r["exit_signal_time"], r["exit_signal_price"], r["min_liquidity"])
        assert got == want, r["candidate_id"]
        seen.add((r["strategy_type"], r["exit_reason"]))
    assert len(out) == 100 and len(seen) >= 4


def test_costs(spark):
    rules = [exits.rule(ids.TIME_EXIT, "NEW_TOKEN", hold=300_000)]
    found = exits.exits(run(spark, rules, [(1000, 1.0), (200_000, 2.0)], [(1, 5)], 1000))
    t = {r["scenario_id"]: r for r in costs.trade_columns(found, costs.scenarios(spark)).collect()}
    r = t["realistic"]
    entry, out = 1.0 * (1 + 2.0 / 200), 2.0 * (1 - 2.0 / 200)
    cost = 2 * (0.00001 + 0.0001) + entry * (1.0 / 100)
    assert len(t) == 4
    assert r["entry_actual_price"] == entry and r["exit_actual_price"] == out
    assert r["outcome"] == pytest.approx((out - entry) / entry - cost / entry)
    assert r["outcome_class"] == "WIN" and r["hold_duration_ms"] == 300_000
    assert r["entry_actual_time"] == 1500


def test_a_sweep_over_slices_and_gaps_equals_the_definition(spark):
    """Many rules at once; prices that fall only later in an hour whose low already lies below its high."""
    rnd, hour = random.Random(11), 3_600_000
    cands, data, ps, ls = [], {}, [], []
    for i in range(12):
        cid = f"c{i:02d}"
        pts = sorted({rnd.randrange(1, 30 * hour // (1 + i % 3)): round(math.exp(rnd.gauss(0, 0.4)), 3) for _ in range(rnd.choice([2, 40, 150]))}.items())
        liq = sorted({rnd.randrange(0, 30 * hour): float(rnd.randint(20, 150)) for _ in range(25)}.items())
        entry = max(liq[0][0], rnd.choice([1, pts[0][0], pts[0][0] + hour // 2]))
        data[cid] = (pts, liq, entry)
        cands.append({"candidate_id": cid, "discovered_at": entry})
        ps += [(cid, t, t, p, 1.0, 1) for t, p in pts]
        ls += [(cid, t, t, x, x, x) for t, x in liq]
    from marketlab import schemas
    sets = [(p, s, h * hour) for p in (0.05, 0.3, 0.6) for s in (0.1, 0.5) for h in (0, 1, 9)]
    guards = [(p, h * hour) for p in (0.1, 0.4) for h in (0, 2, 12)]
    rules = [r for x in sets for r in trail(*x)] + [r for x in guards for r in guard(*x)]
    out = exits.evaluate(candidates(spark, cands), spark.createDataFrame(ps, schemas.PRICE_TIMESERIES),
                         spark.createDataFrame(ls, schemas.LIQUIDITY_TIMESERIES), rules).collect()
    assert len(out) == 12 * len(rules)
    for r in out:
        pts, liq, entry = data[r["candidate_id"]]
        n = r["rule_no"]
        if n < len(sets):
            want = defined_trailing(pts, entry, *sets[n])
            assert (r["exit_reason"], r["exit_signal_time"], r["exit_signal_price"], r["peak_price"]) == want, (r["candidate_id"], sets[n])
        else:
            want = defined_guard(pts, liq, entry, *guards[n - len(sets)])
            assert (r["exit_reason"], r["exit_signal_time"], r["exit_signal_price"], r["min_liquidity"]) == want, (r["candidate_id"], guards[n - len(sets)])
