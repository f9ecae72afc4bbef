import pytest
from helpers import liquidity, price, rows_of, swaps

from marketlab.operators import asof, features, series

HOUR = 3_600_000


def test_bucket_alignment(spark):
    df = swaps(spark, [{"timestamp": 60001, "amount_out": 10.0}, {"timestamp": 119999, "amount_out": 20.0},
                       {"timestamp": 120000, "amount_out": 30.0}])
    out = series.volume_timeseries(df).where("interval_seconds = 60")
    assert rows_of(out, "timestamp_ms", "volume", "swap_count") == [(60000, 30.0, 2), (120000, 30.0, 1)]


def test_sides(spark):
    df = swaps(spark, [{"timestamp": 60000, "amount_out": 10.0, "side": "buy"},
                       {"timestamp": 60001, "amount_out": 20.0, "side": "sell"},
                       {"timestamp": 60002, "amount_out": 30.0, "side": "buy"}])
    out = series.volume_timeseries(df).where("interval_seconds = 60")
    assert rows_of(out, "volume", "buy_volume", "sell_volume") == [(60.0, 40.0, 20.0)]
    wide = series.volume_timeseries(df)
    assert wide.count() == 3


def test_last_price_in_event_order(spark):
    df = swaps(spark, [{"timestamp": 5, "slot": 2, "price": 7.0}, {"timestamp": 5, "slot": 1, "price": 9.0},
                       {"timestamp": 5, "slot": 2, "tx_signature": "zz", "price": 8.0}])
    out = series.price_timeseries(df)
    assert rows_of(out, "price", "slot", "volume", "swap_count") == [(8.0, 2, 3.0, 3)]


def test_derivatives(spark):
    out = features.derived_features(price(spark, [(1000, 1), (2000, 2), (3000, 4)]), liquidity(spark, []))
    assert rows_of(out, "timestamp_ms", "price_delta", "price_velocity", "price_acceleration") == [
        (1000, None, None, None), (2000, 1.0, 0.001, None), (3000, 2.0, 0.002, 1e-6)]


def test_repeated_time_has_no_velocity(spark):
    out = features.derived_features(price(spark, [(1000, 1), (1000, 2)]), liquidity(spark, []))
    assert [r[0] for r in rows_of(out, "price_velocity")] == [None, None]


def test_lifetime_and_interval(spark):
    out = features.derived_features(price(spark, [(1000, 1), (5000, 1), (10000, 1)]), liquidity(spark, []))
    assert rows_of(out, "token_lifetime_ms", "last_swap_interval_ms") == [
        (0, None), (4000, 4000), (9000, 5000)]


def test_earlier_liquidity_is_strict(spark):
    p = price(spark, [(1000, 1), (5000, 1), (10000, 1)])
    q = liquidity(spark, [(500, 1), (2000, 2), (3000, 3), (8000, 4)])
    out = features.derived_features(p, q)
    assert rows_of(out, "timestamp_ms", "last_liq_event_interval_ms", "liquidity_delta") == [
        (1000, 500, None), (5000, 2000, None), (10000, 2000, None)]


def test_exact_liquidity_match(spark):
    p, q = price(spark, [(1000, 1), (3000, 1)]), liquidity(spark, [(1000, 10), (2000, 15), (3000, 30)])
    any_, exact = (features.derived_features(p, q, m) for m in ("any", "exact"))
    want = [(1000, None, None), (3000, 15.0, 0.015)]
    assert rows_of(any_, "timestamp_ms", "liquidity_delta", "liquidity_velocity") == want
    assert rows_of(exact, "timestamp_ms", "last_liq_event_interval_ms") == [(1000, None), (3000, 1000)]


def _loop_features(points):
    out, prev, prev_v = [], None, None
    for t, p in points:
        delta = vel = acc = None
        if prev is not None:
            delta = p - prev[1]
            if t > prev[0]:
                vel = delta / (t - prev[0])
                if prev_v is not None:
                    acc = (vel - prev_v) / (t - prev[0])
                prev_v = vel
        prev = (t, p)
        out.append((t, delta, vel, acc))
    return out


@pytest.mark.parametrize("step", [HOUR // 3, HOUR, 5 * HOUR])
def test_features_across_slices_equal_a_plain_loop(spark, step):
    points = [(1000 + i * step + (i * i * 7919) % 1000, float((i * 37) % 11)) for i in range(25)]
    out = features.derived_features(price(spark, points), liquidity(spark, [(1, 1)]))
    got = rows_of(out, "timestamp_ms", "price_delta", "price_velocity", "price_acceleration")
    assert got == _loop_features(points)
    view = features.price_acceleration(price(spark, points))
    assert rows_of(view, "timestamp_ms", "price_delta", "price_velocity", "price_acceleration") == got
    assert features.feature_validation(price(spark, points)).where(
        "velocity_valid and first_row_valid").count() == 25


def test_price_and_liquidity_lookup(spark):
    probes = spark.createDataFrame([("c1", t) for t in (100, 1000, 1500, 9 * HOUR)] + [("none", 5)],
                                   "candidate_id string, at long")
    p = asof.price_at(probes, price(spark, [(1000, 1), (2000, 2), (4 * HOUR, 3)]), "at")
    assert rows_of(p, "candidate_id", "at", "price_at") == [
        ("c1", 100, 1.0), ("c1", 1000, 1.0), ("c1", 1500, 1.0), ("c1", 9 * HOUR, 3.0), ("none", 5, None)]
    q = asof.liquidity_at(probes, liquidity(spark, [(1000, 1), (4 * HOUR, 3)]), "at")
    assert rows_of(q, "at", "liquidity_at", "has_liquidity") == [
        (5, None, False), (100, None, True), (1000, 1.0, True), (1500, 1.0, True), (9 * HOUR, 3.0, True)]


def test_previous_event_is_strict(spark):
    probes = spark.createDataFrame([("c1", t) for t in (100, 500, 750, 1000, 2000)],
                                   "candidate_id string, at long")
    out = asof.previous_event_time(probes, liquidity(spark, [(500, 1), (1000, 1), (1500, 1)]), "at")
    assert rows_of(out, "at", "previous_ts") == [
        (100, None), (500, None), (750, 500), (1000, 500), (2000, 1500)]


def test_forward_lookup(spark):
    probes = spark.createDataFrame([("c1", t) for t in (0, 1000, 1001, 3 * HOUR, 8 * HOUR)],
                                   "candidate_id string, at long")
    out = asof.asof(probes, price(spark, [(1000, 1), (6 * HOUR, 2)]), ["price"], "at", forward=True)
    assert rows_of(out, "at", "prev_ts", "next_ts", "first_ts") == [
        (0, None, 1000, 1000), (1000, 1000, 1000, 1000), (1001, 1000, 6 * HOUR, 1000),
        (3 * HOUR, 1000, 6 * HOUR, 1000), (8 * HOUR, 6 * HOUR, None, 1000)]


def test_normalise_only_missing(spark):
    df = swaps(spark, [{"timestamp": 1}, {"timestamp": 2, "candidate_id": "c2"}])
    done = price(spark, [(1, 1)])
    assert rows_of(series.only_missing(df, done), "candidate_id") == [("c2",)]
    assert series.only_missing(df, done, "recompute").count() == 2


def test_known_candidates_are_not_broadcast_in_copies(spark):
    ev = swaps(spark, [{"timestamp": 1}, {"timestamp": 2, "candidate_id": "c2"}])
    left = series.only_missing(ev, spark.range(2, 3).selectExpr("'c' || id AS candidate_id"))
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
    assert [r["candidate_id"] for r in left.collect()] == ["c1"]
