import pytest
from helpers import candidates, frame, rows_of, swap_events

from marketlab import schemas
from marketlab.operators import discovery, replay
from marketlab.operators.ordering import merged_events
from marketlab.sources import tables
from marketlab.streaming import live

HOUR, DAY = 3_600_000, 86_400_000


@pytest.fixture
def store(spark, tmp_path):
    return tables.TableStore(spark, str(tmp_path / "tables"))


def drop(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return live.table_stream(spark, str(folder), schemas.SWAP_EVENTS, 1)


def test_stream_equals_batch_and_restarts(spark, store, tmp_path):
    first = swap_events(spark, [{"timestamp": 5, "slot": 5, "mint": m} for m in ("a", "b", "a")])
    more = swap_events(spark, [{"timestamp": 9, "slot": 9, "mint": m, "tx_signature": f"n{m}"}
                               for m in ("b", "c")])
    pipe = live.LivePipeline(store)
    for part in (first, more):
        drop(part, tmp_path / "in")
        pipe.run(stream(spark, tmp_path / "in"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = rows_of(store.read("token_candidates"), *schemas.TOKEN_CANDIDATES.names)
    want = rows_of(discovery.new_tokens(first.union(more)), *schemas.TOKEN_CANDIDATES.names)
    assert got == want and store.read("swap_events").count() == 5


def test_duplicates_in_the_stream_are_silent(spark, store):
    ev = swap_events(spark, [{"timestamp": 5}, {"timestamp": 6}])
    pipe = live.LivePipeline(store)
    pipe.on_swaps(ev.union(ev), 0)
    pipe.on_swaps(ev, 1)
    pipe.on_swaps(ev, 1)  # a retried micro-batch
    assert store.read("swap_events").count() == 2 and store.read("token_candidates").count() == 1


def events_at(spark, *slots):
    return swap_events(spark, [{"timestamp": s, "slot": s, "tx_signature": f"t{s}"} for s in slots])


def slots_of(df):
    return sorted(r["slot"] for r in df.select("slot").collect())


def test_slot_buffer_late_retry_and_restart(spark, tmp_path):
    make = lambda run: live.SlotBuffer(spark, str(tmp_path / "p"), schemas.SWAP_EVENTS, lag=3, run=run)
    buf = make("a")
    assert slots_of(buf.release(events_at(spark, 10, 8), 0)) == []
    assert slots_of(buf.release(events_at(spark, 9, 12), 1)) == [8, 9]
    assert slots_of(buf.release(events_at(spark, 5), 2)) == [5]       # late: released at once
    assert slots_of(buf.release(events_at(spark, 5), 2)) == [5]       # retried batch gives the same
    assert slots_of(buf.release(events_at(spark, 9, 12), 1)) == [8, 9]
    # another run, with a new checkpoint and batch numbers from 0, goes on with what is pending
    other = make("b")
    assert slots_of(other.drain()) == [10, 12]
    assert slots_of(other.release(events_at(spark, 14), 0)) == [10]
    assert slots_of(make("c").drain()) == [12, 14]


def test_slot_buffer_is_drained_when_the_stream_ends(spark, store, tmp_path):
    for part in ((1, 2, 9), (3, 2, 11)):
        drop(events_at(spark, *part), tmp_path / "in")
    pipe = live.LivePipeline(store, live.SlotBuffer(spark, str(tmp_path / "q"), live.RAW_EVENTS, 3))
    pipe.on_swaps(events_at(spark, 1, 2, 9), 0)
    assert slots_of(store.read("swap_events")) == [1, 2]
    # the process ends here; a new one starts with nothing in memory
    again = live.LivePipeline(store, live.SlotBuffer(spark, str(tmp_path / "q"), live.RAW_EVENTS, 3))
    again.run(stream(spark, tmp_path / "in"), str(tmp_path / "cp"), once=True)
    assert slots_of(store.read("swap_events")) == [1, 2, 3, 9, 11]


def test_late_swaps_add_to_their_bucket_and_retries_do_not(spark, store, tmp_path):
    from helpers import swaps
    make = lambda *ts: swaps(spark, [{"timestamp": t, "slot": t, "candidate_id": "a", "tx_signature": f"s{t}",
                                      "amount_out": 1.0, "side": "buy"} for t in ts])
    volumes = live.VolumeParts(spark, str(tmp_path / "v"), run="r")
    pipe = live.LivePipeline(store, volumes=volumes)
    pipe.on_candidate_swaps(make(10, 100_000, 100 * HOUR), 0)
    pipe.on_candidate_swaps(make(20, 10), 1)           # late, and one repeated
    pipe.on_candidate_swaps(make(20, 10), 1)           # retried
    read = lambda: {(r["interval_seconds"], r["timestamp_ms"]): r["volume"] for r in volumes.read().collect()}
    want = {(60, 0): 2.0, (60, 60_000): 1.0, (300, 0): 3.0, (3600, 0): 3.0} | {(w, 100 * HOUR): 1.0 for w in (60, 300, 3600)}
    assert read() == want
    volumes.compact()
    pipe.on_candidate_swaps(make(30), 2)
    assert read() == want | {(60, 0): 3.0, (300, 0): 4.0, (3600, 0): 4.0}


def test_liquidity_finds_its_candidate_at_arrival_or_later(spark, store):
    from marketlab.plans import pipeline
    rows = [{"mint": "m1", "tx_signature": f"l{t}", "event_index": 0, "timestamp": t, "slot": t, "event_type": "add",
             "liquidity_after": 1.0 * t} for t in (1, 7)]
    q = frame(spark, schemas.LIQUIDITY_EVENTS, rows)
    pipe = live.LivePipeline(store)
    pipe.on_liquidity(q.where("timestamp = 1"))
    pipe.handle_swaps(swap_events(spark, [{"timestamp": 5, "slot": 5, "mint": "m1"}]))
    pipe.on_liquidity(q.where("timestamp = 7"))
    assert [r[0] is None for r in rows_of(store.read("liquidity_events").orderBy("timestamp"), "candidate_id")].count(True) == 1
    pipeline.normalise(store)
    assert sorted(r["timestamp_ms"] for r in store.read("liquidity_timeseries").collect()) == [1, 7]


def test_spikes_are_looked_for_in_every_period(spark, store):
    pipe = live.LivePipeline(store, spikes_every_ms=HOUR)
    calls = []
    pipe.detect_active = lambda: calls.append(1)
    for t in (5, 10, HOUR + 1, HOUR + 2, 3 * HOUR):
        pipe.handle_swaps(swap_events(spark, [{"timestamp": t, "slot": t, "tx_signature": f"x{t}"}]))
    assert len(calls) == 3


def test_active_detection_uses_event_time(spark, store):
    pipe = live.LivePipeline(store)
    assert pipe.detect_active() == {"stored": 0, "duplicates": 0}
    rows = [{"timestamp": h * HOUR, "amount_out": 10.0, "slot": h} for h in range(24)]
    rows += [{"timestamp": DAY - 1000, "amount_out": 100.0, "slot": 99, "tx_signature": "spike"},
             {"timestamp": DAY, "slot": 100, "tx_signature": "now"}]
    store.append_unique(swap_events(spark, rows), "swap_events")
    assert pipe.detect_active()["stored"] == 1
    assert rows_of(store.read("token_candidates"), "source", "tx_signature") == [("ACTIVE_TOKEN", "spike")]
    assert pipe.detect_active()["stored"] == 0


def test_backfill_counts(spark, store):
    ev = swap_events(spark, [{"timestamp": t} for t in (1, 2, 3)])
    q = frame(spark, schemas.LIQUIDITY_EVENTS, [
        {"mint": "m1", "tx_signature": "l", "event_index": 0, "timestamp": 2, "event_type": "add"}])
    assert live.backfill(store, ev, q, 1, 3) == {
        "swap_events": 2, "candidates": 1, "duplicates": 0, "liquidity_events": 1}
    assert live.backfill(store, ev, q, 1, 4) == {
        "swap_events": 1, "candidates": 0, "duplicates": 3, "liquidity_events": 0}


def replayed(spark, slice_ms):
    from helpers import swaps
    s = swaps(spark, [{"timestamp": t, "slot": t, "candidate_id": c, "tx_signature": f"{c}{t}"}
                      for c in ("a", "b", "c") for t in range(0, 10 * HOUR, HOUR // 2)])
    q = frame(spark, schemas.LIQUIDITY_EVENTS, [
        {"candidate_id": "a", "tx_signature": "l", "event_index": 0, "slot": 0, "timestamp": 0,
         "event_type": "add"}])
    merged = merged_events(s, q)

    def positions(candidate, batches):
        n = 0
        for b in batches:
            for slot in b["slot"]:
                yield candidate, n, int(slot)
                n += 1
    return merged, replay.replay_apply(merged, positions, "candidate_id string, n long, slot long",
                                       ["slot"], slice_ms)


def test_replay_order(spark):
    merged, whole = replayed(spark, None)
    rows = rows_of(whole, "candidate_id", "n", "slot")
    assert [r[1] for r in rows if r[0] == "b"] == list(range(20))
    assert all(x[2] <= y[2] for x, y in zip(rows, rows[1:]) if x[0] == y[0])
    assert len([r for r in rows if r[0] == "a"]) == 21
    _, sliced = replayed(spark, HOUR)
    assert max(r[0] for r in rows_of(sliced, "n")) == 2 and sliced.count() == 61
    stats = replay.replay_statistics(merged)
    assert rows_of(stats, "candidate_id", "events", "liquidity_events", "last_ts") == [
        ("a", 21, 1, 19 * HOUR // 2), ("b", 20, 0, 19 * HOUR // 2), ("c", 20, 0, 19 * HOUR // 2)]
    hits = replay.replay_apply(merged, replay.signals_when(lambda b: b["timestamp"] >= 9 * HOUR, "late"),
                               replay.SIGNALS, ["timestamp"])
    assert hits.count() == 6


def test_first_event_wins_a_tie_with_liquidity_first(spark):
    merged, _ = replayed(spark, None)
    top = merged.where("candidate_id = 'a'").orderBy("slot", "tie").first()
    assert top["kind"] == "liquidity" and top["swap"] is None


def test_fold_carries_state_over_slices(spark):
    merged, _ = replayed(spark, None)
    last = lambda state, b: (state[0] + len(b["slot"]), int(b["slot"][-1]))
    got = replay.replay_fold(merged, (0, -1), last, lambda a, b: (a[0] + b[0], b[1]), "n long, last long", ["slot"], HOUR)
    assert rows_of(got, "candidate_id", "n", "last") == [
        ("a", 21, 19 * HOUR // 2), ("b", 20, 19 * HOUR // 2), ("c", 20, 19 * HOUR // 2)]


def test_counts_with_time_zero():
    batches = [{"kind": __import__("numpy").array(["swap"]), "timestamp": __import__("numpy").array([t])} for t in (0, 5)]
    assert list(replay.count_events("a", iter(batches))) == [("a", 2, 2, 0, 0, 5)]


# --- logs of several nodes, keyed state, shutdown, derived parts ---------------------------

def curve_logs(spark, n, start=0, mint="M"):
    from marketlab.sources import decode
    return frame(spark, schemas.TX_LOGS, [
        {"tx_signature": f"{mint}{i}", "slot": i, "block_time_s": i, "account_keys": [],
         "logs": [f"Program {decode.CURVE_PROGRAM} invoke [1]", f"mint={mint}{i % 3}", "Program log: Instruction: Buy",
                  "Program log: Instruction: Create"]} for i in range(start, start + n)])


def text_logs(spark, n, start=0):
    return frame(spark, schemas.TX_LOGS, [
        {"tx_signature": f"x{i}", "slot": i, "block_time_s": i, "account_keys": [],
         "logs": [f"Program Own1 says Program log: Swap mint=Own{i % 2}"]} for i in range(start, start + n)])


def test_logs_of_several_nodes_equal_the_batch_decoders(spark, store, tmp_path, monkeypatch):
    from marketlab.sources import decode
    monkeypatch.setattr(decode, "DECODERS", dict(decode.DECODERS))
    decode.register_decoder("Own1", decode.LogDecoder(lambda: decode.F.transform("logs", lambda line, i: decode._event(
        "swap", i, mint=decode.F.regexp_extract(line, decode.SWAP_TEXT, 1), amount=decode.F.lit(0.0))), "Own1"))
    for start in range(0, 20, 5):  # four batches; the second node repeats transactions of the first
        drop(curve_logs(spark, 5, start), tmp_path / "one")
        drop(text_logs(spark, 5, start).union(curve_logs(spark, 2, start)), tmp_path / "two")
    both = [live.table_stream(spark, str(tmp_path / n), schemas.TX_LOGS, 1) for n in ("one", "two")]
    pipe = live.LivePipeline(store, live.SlotBuffer(spark, str(tmp_path / "p"), live.RAW_EVENTS))
    pipe.run_logs(both, str(tmp_path / "cp"), once=True)
    whole = curve_logs(spark, 20).union(text_logs(spark, 20))
    for table, want in (("swap_events", decode.swap_events(whole)), ("liquidity_events", decode.liquidity_events(whole))):
        names = [c for c in want.columns if c != "candidate_id"]
        assert rows_of(store.read(table), *names) == rows_of(want, *names) != []
    assert sorted(r[0] for r in rows_of(store.read("token_candidates"), "mint")) == ["M0", "M1", "M2", "Own0", "Own1"]


def test_new_candidates_get_their_metadata(spark, store):
    import base64
    mint = bytes(36) + (500).to_bytes(8, "little") + bytes([2]) + bytes(37)
    mints = frame(spark, schemas.ACCOUNTS, [{"pubkey": "m1", "data": base64.b64encode(mint).decode(), "fetched_at": 4}])
    names = spark.createDataFrame([], "mint string, data string")
    pipe = live.LivePipeline(store, metadata=(mints, names))
    pipe.handle_swaps(swap_events(spark, [{"timestamp": 1}, {"timestamp": 2, "mint": "m2"}]))
    pipe.handle_swaps(swap_events(spark, [{"timestamp": 3, "tx_signature": "later"}]))
    assert rows_of(store.read("token_metadata"), "mint", "supply", "fetched_at") == [("m1", 5.0, 4)]
    assert store.read("token_candidates").count() == 2


def test_first_seen_state_restarts_and_keeps_the_first_to_come(spark, store, tmp_path):
    store.append_unique(candidates(spark, [{"candidate_id": "old", "mint": "known"}]), "token_candidates")
    pipe = live.LivePipeline(store)
    go = lambda: pipe.run_first_seen(stream(spark, tmp_path / "in"), str(tmp_path / "cp"), once=True)
    make = lambda **slots: swap_events(spark, [{"timestamp": t, "slot": t, "mint": m, "tx_signature": f"{m}{t}"}
                                               for m, ts in slots.items() for t in ts])
    found = lambda: rows_of(store.read("token_candidates").where("candidate_id <> 'old'"), "mint", "slot")
    drop(make(a=(9, 7, 8), known=(1,)), tmp_path / "in")
    go()
    assert found() == [("a", 7)]
    drop(make(a=(2,), b=(5, 4)), tmp_path / "in")  # late: a is known by now
    drop(make(b=(1,), known=(6,), c=(3,)), tmp_path / "in")
    go()
    assert found() == [("a", 7), ("b", 4), ("c", 3)] and store.read("token_candidates").count() == 4


@pytest.mark.parametrize("by_query", [False, True])
def test_a_run_that_is_stopped_loses_nothing(spark, store, tmp_path, monkeypatch, by_query):
    monkeypatch.setattr(live, "FLUSH_SECONDS", 1)
    drop(events_at(spark, 1, 2, 9), tmp_path / "in")
    drop(events_at(spark, 3, 11), tmp_path / "in")
    pipe = live.LivePipeline(store, live.SlotBuffer(spark, str(tmp_path / "q"), live.RAW_EVENTS, 3))
    run = pipe.run(stream(spark, tmp_path / "in"), str(tmp_path / "cp"))
    run.processAllAvailable()
    assert slots_of(store.read("swap_events")) == [1, 2, 3] and run.isActive
    (run.query if by_query else run).stop()
    assert run.drained.wait(60) and not run.isActive
    assert slots_of(store.read("swap_events")) == [1, 2, 3, 9, 11]


def candidate_swaps(spark, *ts):
    from helpers import swaps
    return swaps(spark, [{"timestamp": t, "slot": t, "candidate_id": "a", "tx_signature": f"s{t}", "amount_out": 2.0, "side": "sell"} for t in ts])


def total(volumes):
    return {(r["volume"], r["swap_count"]) for r in volumes.read((60,)).where("timestamp_ms = 0").collect()}


def test_volumes_survive_crashes_and_new_checkpoints(spark, store, tmp_path, monkeypatch):
    make = lambda run: live.LivePipeline(store, volumes=live.VolumeParts(spark, str(tmp_path / "v"), run=run))
    first = make("one")
    monkeypatch.setattr(first.volumes, "catch_up", lambda: 1 / 0)  # the process ends after the swaps are stored
    with pytest.raises(ZeroDivisionError):
        first.on_candidate_swaps(candidate_swaps(spark, 1, 2, 3), 0)
    again = make("two")  # another checkpoint: batches count from 0, and the same swaps come again
    again.on_candidate_swaps(candidate_swaps(spark, 1, 2, 3), 0)
    assert total(again.volumes) == {(6.0, 3)}
    again.on_candidate_swaps(candidate_swaps(spark, 3, 4), 1)
    assert total(again.volumes) == {(8.0, 4)}


def test_compaction_of_volumes_survives_a_crash(spark, store, tmp_path, monkeypatch):
    from marketlab.streaming import parts
    pipe = live.LivePipeline(store, volumes=live.VolumeParts(spark, str(tmp_path / "v")))
    for i, t in enumerate((1, 2, 3)):
        pipe.on_candidate_swaps(candidate_swaps(spark, t), i)
    for broken in ("move_path", "delete_path"):  # before the sum is there, before its parts are gone
        monkeypatch.setattr(parts, broken, lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipe.volumes.compact()
        monkeypatch.undo()
        assert total(pipe.volumes) == {(6.0, 3)}
    pipe.on_candidate_swaps(candidate_swaps(spark, 4), 3)
    pipe.volumes.compact()
    assert total(pipe.volumes) == {(8.0, 4)} and len(pipe.volumes._visible()[0]) == 1
    pipe.on_candidate_swaps(candidate_swaps(spark, 5), 4)
    store.compact("swaps")  # all writes are one now: its part takes the place of the others
    assert total(pipe.volumes) == {(10.0, 5)} and pipe.volumes.catch_up() == 0


def test_hour_sums_give_the_spikes_of_the_events(spark, tmp_path):
    import random
    r = random.Random(8)
    rows = [{"mint": f"m{i % 7}", "timestamp": r.randrange(0, 2 * DAY), "amount_out": r.choice([1.0, 50.0]), "slot": i, "tx_signature": f"t{i}"}
            for i in range(400)]
    rows += [{"mint": "m3", "timestamp": 2 * DAY + r.randrange(HOUR), "amount_out": 99.0, "slot": 500 + i, "tx_signature": f"u{i}"} for i in range(30)]
    found = []
    for name, hours in (("plain", None), ("hours", live.HourParts(spark, str(tmp_path / "h")))):
        own = tables.TableStore(spark, str(tmp_path / name))
        pipe = live.LivePipeline(own, hours=hours, spikes_every_ms=DAY // 4, first_seen=False)
        for at in range(0, len(rows), 110):
            pipe.handle_swaps(swap_events(spark, rows[at:at + 110]))
        for at in (2 * DAY, 2 * DAY + HOUR // 2, DAY + 12345):
            if hours is not None:
                events = own.read("swap_events")
                a, b = (discovery.active_tokens(x, at) for x in (events, hours.window(at)))
                assert rows_of(a, *a.columns) == rows_of(b, *b.columns)
        pipe.detect_active()
        found.append(rows_of(own.read("token_candidates"), *schemas.TOKEN_CANDIDATES.names))
        if hours is not None:
            hours.compact()
            assert hours.rows().groupBy().sum("n").first()[0] == len(rows)
    assert found[0] == found[1] != []


def test_decoded_logs_are_stored_once_before_their_tables(spark, store, tmp_path, monkeypatch):
    from marketlab.sources import decode, tables
    names, stage = [], live.materialize

    def noted(df, name):
        names.append(name)
        return stage(df, name)
    for module in (live, decode, tables):
        monkeypatch.setattr(module, "materialize", noted)
    buffer = live.SlotBuffer(spark, str(tmp_path / "p"), live.RAW_EVENTS)
    pipe = live.LivePipeline(store, buffer, first_seen=False)
    accounts = frame(spark, schemas.ACCOUNTS, [{"pubkey": "none", "data": ""}])
    for n, start in enumerate((0, 15)):
        pipe.on_logs(curve_logs(spark, 20, start), n, accounts)
    assert names == ["decoded", "filled"] * 2  # the second one holds only events that met the accounts
    pipe.drain()
    assert store.read("swap_events").count() == store.read("liquidity_events").count() == 35
    released = buffer.release(live.raw_events(swap_events(spark, [{"timestamp": 1}]), None), 9)
    assert "Join" not in released._jdf.queryExecution().optimizedPlan().toString()
