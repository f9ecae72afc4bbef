import hashlib

from helpers import candidates, frame, rows_of, swap_events

from marketlab import schemas
from marketlab.operators import discovery

HOUR, DAY = 3_600_000, 86_400_000


def spike(mint="m1", base=0):
    rows = [{"mint": mint, "timestamp": base + h * HOUR, "amount_out": 10.0, "slot": h,
             "tx_signature": f"{mint}-{h:02d}"} for h in range(24)]
    return rows + [{"mint": mint, "timestamp": base + DAY - 1000, "amount_out": 100.0, "slot": 999,
                    "event_index": 5, "tx_signature": "txTrigger", "pool": "Pool123"}]


def test_candidate_id_text(spark):
    out = discovery.new_tokens(swap_events(spark, [{"timestamp": 7, "slot": 3}]))
    text = "m1||NEW_TOKEN|tx0000|0|3"
    assert rows_of(out, "candidate_id", "source", "discovered_at") == [
        (hashlib.sha256(text.encode()).hexdigest(), "NEW_TOKEN", 7)]


def test_first_swap_and_known_mints(spark):
    ev = swap_events(spark, [{"timestamp": 1, "slot": 9}, {"timestamp": 5, "slot": 2},
                             {"timestamp": 6, "slot": 3, "mint": "m2"}])
    known = candidates(spark, [{"mint": "m2"}])
    assert rows_of(discovery.new_tokens(ev, known), "mint", "slot", "discovered_at") == [("m1", 2, 5)]


def test_spike_and_its_trigger(spark):
    out = discovery.active_tokens(swap_events(spark, spike()), DAY)
    assert rows_of(out, "source", "tx_signature", "event_index", "slot", "pool", "discovered_at") == [
        ("ACTIVE_TOKEN", "txTrigger", 5, 999, "Pool123", DAY - 1000)]


def test_window_bounds(spark):
    ev = swap_events(spark, [{"timestamp": 2 * DAY, "amount_out": 1000.0}, {"timestamp": DAY}])
    assert discovery.active_tokens(ev, 2 * DAY).isEmpty()


def test_known_mint_is_not_active(spark):
    assert discovery.active_tokens(swap_events(spark, spike()), DAY, candidates(spark, [{}])).isEmpty()


def test_short_history_gives_nothing(spark):
    ev = swap_events(spark, [{"timestamp": DAY - HOUR // 2, "amount_out": 1000.0}])
    assert discovery.active_tokens(ev, DAY).isEmpty()


def test_exact_threshold_does_not_fire(spark):
    # 3 in the last hour of 3 hours: 3 > 3 * (3 / 3) is false
    ev = swap_events(spark, [{"timestamp": DAY - 3 * HOUR, "amount_out": 0.0},
                             {"timestamp": DAY - 1, "amount_out": 3.0}])
    assert discovery.active_tokens(ev, DAY).isEmpty()


def test_liquidity_spike(spark):
    ev = swap_events(spark, [{"timestamp": h * HOUR} for h in range(24)])
    q = frame(spark, schemas.LIQUIDITY_EVENTS, [
        {"mint": "m1", "tx_signature": f"l{h}", "event_index": 0, "slot": h, "timestamp": h * HOUR,
         "event_type": "remove", "amount_quote": 10.0 if h < 23 else 500.0} for h in range(24)])
    assert discovery.active_tokens(ev, DAY).isEmpty()
    out = discovery.active_tokens(ev, DAY, None, q)
    assert rows_of(out, "mint", "tx_signature", "pool") == [("m1", "l23", "")]


def test_replay_new_suppresses_active(spark):
    ev = swap_events(spark, spike("mint0") + spike("mint1"))
    out = discovery.replay_discovery(ev)
    assert rows_of(out, "mint", "source") == [("mint0", "NEW_TOKEN"), ("mint1", "NEW_TOKEN")]
    ev = swap_events(spark, spike("mint1") + [{"mint": "mint2", "timestamp": 5}])
    seeded = discovery.replay_discovery(ev, seed=candidates(spark, [{"mint": "mint1"}]))
    assert rows_of(seeded, "mint", "source") == [("mint2", "NEW_TOKEN")]


def test_trailing_windows_equal_brute_force(spark):
    rows = []
    for i in range(160):  # one mint holds most rows, some times repeat
        mint = "hot" if i % 4 else f"m{i % 3}"
        rows.append({"mint": mint, "timestamp": (i // 2) * 1_234_567 + (i % 3) * HOUR,
                     "amount_out": float(i % 17)})
    out = discovery.trailing_windows(swap_events(spark, rows))
    want = set()
    for m, t in {(r["mint"], r["timestamp"]) for r in rows}:
        def part(width):
            return [r for r in rows if r["mint"] == m and t - width <= r["timestamp"] < t]
        h, d = part(HOUR), part(DAY)
        want.add((m, t, sum(r["amount_out"] for r in h), len(h), sum(r["amount_out"] for r in d), len(d),
                  min((r["timestamp"] for r in d), default=None)))
    got = {tuple(r) for r in out.select("mint", "timestamp", "volume_1h", "swaps_1h", "volume_24h",
                                        "swaps_24h", "first_24h").collect()}
    assert got == want


def test_reconcile_and_determinism(spark):
    ev = swap_events(spark, spike())
    run = lambda: discovery.new_tokens(ev)
    assert discovery.reconcile(run(), run()).isEmpty()
    assert discovery.is_deterministic(run)
