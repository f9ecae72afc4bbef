import csv
import glob
import json

import pytest
from helpers import candidates, frame, rows_of, swap_events
from pyspark.sql import functions as F

from marketlab import schemas
from marketlab.operators import exits, joins, verify
from marketlab.sources import tables
from test_exits import guard, run


DAY = 86_400_000


def files_read(df):
    """Number of files that a scan opens once its folders are pruned."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.fixture
def store(spark, tmp_path):
    return tables.TableStore(spark, str(tmp_path / "tables"))


def test_duplicate_in_batch_or_table_fails_the_batch(spark, store):
    a = swap_events(spark, [{"timestamp": 1}, {"timestamp": 2}])
    assert store.append_unique(a, "swap_events") == {"stored": 2, "duplicates": 0}
    with pytest.raises(tables.DuplicateKey):
        store.append_unique(swap_events(spark, [{"timestamp": 9}]), "swap_events")
    new = swap_events(spark, [{"timestamp": 9, "tx_signature": "n"}])
    with pytest.raises(tables.DuplicateKey):
        store.append_unique(new.union(new), "swap_events")
    assert store.read("swap_events").count() == 2


def test_skipping_duplicates_counts_them(spark, store):
    a = swap_events(spark, [{"timestamp": 1}, {"timestamp": 2}])
    assert store.append_unique(a.union(a), "swap_events", "skip") == {"stored": 2, "duplicates": 2}
    b = swap_events(spark, [{"timestamp": 1}, {"timestamp": 2}, {"timestamp": 3}])
    assert store.append_unique(b, "swap_events", "skip") == {"stored": 1, "duplicates": 2}
    assert store.append_unique(b, "swap_events", "skip") == {"stored": 0, "duplicates": 3}


def test_liquidity_key_falls_back_to_the_pool(spark, store):
    row = {"tx_signature": "t", "event_index": 0, "slot": 1, "timestamp": 1, "event_type": "add"}
    df = frame(spark, schemas.LIQUIDITY_EVENTS, [{**row, "mint": "m"}, {**row, "pool": "p"}, row])
    assert store.append_unique(df, "liquidity_events")["stored"] == 3
    with pytest.raises(tables.DuplicateKey):
        store.append_unique(frame(spark, schemas.LIQUIDITY_EVENTS, [{**row, "pool": "p"}]),
                            "liquidity_events")


def test_enumerations_are_checked(spark, store):
    with pytest.raises(tables.InvalidRows):
        store.append_unique(candidates(spark, [{"source": "OTHER"}]), "token_candidates")
    assert rows_of(schemas.check_enums(candidates(spark, [{"source": "OTHER"}, {}]), "token_candidates"),
                   "reason") == [("source",)]


def test_range_bounds(spark):
    df = swap_events(spark, [{"timestamp": t} for t in (1, 2, 3)])
    assert tables.between(df, "timestamp", 1, 3).count() == 3
    assert tables.half_open(df, "timestamp", 1, 3).count() == 2
    assert rows_of(tables.time_range(df, "timestamp"), "min_ts", "max_ts") == [(1, 3)]
    assert rows_of(tables.time_range(df.limit(0), "timestamp"), "min_ts", "max_ts") == [(0, 0)]


def test_scans_by_key_and_attribute(spark):
    c = candidates(spark, [{"candidate_id": "a"}, {"candidate_id": "b", "source": "ACTIVE_TOKEN"}])
    assert rows_of(tables.by_key(c, "b", order=("discovered_at",)), "source") == [("ACTIVE_TOKEN",)]
    assert rows_of(tables.with_values(c, source="NEW_TOKEN", mint="m1"), "candidate_id") == [("a",)]


def test_latest_and_newest(spark):
    m = frame(spark, schemas.TOKEN_METADATA, [
        {"candidate_id": "a", "mint": "m", "fetched_at": 1, "symbol": "OLD"},
        {"candidate_id": "b", "mint": "m", "fetched_at": 5, "symbol": "NEW"}])
    assert rows_of(tables.latest_metadata(m), "mint", "symbol") == [("m", "NEW")]
    v = spark.createDataFrame([("k", 1, 10), ("k", 2, 20)], "k string, v int, created_at int")
    assert rows_of(tables.newest_version(v, ["k"]), "v") == [(2,)]


def test_mint_resolution(spark):
    c = candidates(spark, [{"candidate_id": "z", "discovered_at": 1}, {"candidate_id": "b", "discovered_at": 1},
                           {"candidate_id": "a", "discovered_at": 9}])
    ev = frame(spark, schemas.LIQUIDITY_EVENTS, [
        {"mint": "m1", "tx_signature": "1"}, {"mint": "m1", "tx_signature": "2", "candidate_id": "own"},
        {"mint": "other", "tx_signature": "3"}])
    assert rows_of(joins.resolve_candidates(ev, c), "tx_signature", "candidate_id") == [
        ("1", "b"), ("2", "own"), ("3", None)]


def test_csv_sink(spark, tmp_path):
    out = str(tmp_path / "csv")
    df = frame(spark, schemas.TRADE_RECORDS, [
        {"trade_id": 'a"b', "candidate_id": "c", "outcome": 0.5, "entry_signal_time": 7}])
    tables.write_csv(df.coalesce(1), out, schemas.TRADE_RECORDS.names)
    text = open(glob.glob(out + "/*.csv")[0]).read()
    head, line = text.splitlines()
    assert head == ",".join(schemas.TRADE_RECORDS.names) and len(head.split(",")) == 27
    row = dict(zip(head.split(","), next(csv.reader([line]))))
    assert row["trade_id"] == 'a"b' and row["outcome"] == "0.500000"
    assert row["peak_price"] == "" and row["entry_signal_time"] == "7"
    assert line.startswith('"a""b","c",,')
    tables.write_json(df.coalesce(1).select("trade_id"), str(tmp_path / "json"))
    assert json.loads(open(glob.glob(str(tmp_path / "json/*.json"))[0]).read()) == {"trade_id": 'a"b'}


def test_scans_open_only_the_folders_of_their_days(spark, store):
    for day in range(6):
        store.append_unique(swap_events(spark, [{"timestamp": day * DAY + t, "tx_signature": f"{day}-{t}"} for t in (0, DAY - 1)]), "swap_events")
    got = store.read("swap_events", 2 * DAY, 4 * DAY)
    assert rows_of(got, "timestamp") == [(2 * DAY,), (3 * DAY - 1,), (3 * DAY,), (4 * DAY - 1,)]
    every = files_read(store.read("swap_events"))
    assert files_read(got) * 3 == every
    assert store.last_time("swap_events") == 6 * DAY - 1
    assert store.read("liquidity_events", 0, 5).isEmpty() and store.last_time("liquidity_events") is None


def test_appends_check_only_the_days_of_their_batch(spark, store):
    points = lambda day: frame(spark, schemas.PRICE_TIMESERIES, [
        {"candidate_id": "hot", "timestamp_ms": day * DAY + t, "slot": 1, "price": 1.0, "volume": 1.0, "swap_count": 1} for t in range(5)])
    for day in range(4):
        store.append_unique(points(day), "price_timeseries")
    near = store._overlap(points(2), "price_timeseries")
    assert files_read(near) * 4 == files_read(store.read("price_timeseries")) and near.count() == 5  # a hot key has a folder for each day
    with pytest.raises(tables.DuplicateKey):
        store.append_unique(points(2), "price_timeseries")
    assert store.append_unique(points(2).union(points(9)), "price_timeseries", "skip") == {"stored": 5, "duplicates": 5}


def test_compaction_leaves_one_version_of_replaced_rows(spark, store):
    def points(version):
        return frame(spark, schemas.PRICE_TIMESERIES, [
            {"candidate_id": c, "timestamp_ms": t * DAY, "slot": version, "price": 1.0, "volume": 1.0, "swap_count": 1}
            for c in ("a", "b") for t in range(3)])

    for version in range(10):
        store.replace(points(version), "price_timeseries")
    stored = lambda: store._stored("price_timeseries").count()
    assert stored() == 60 and store.read("price_timeseries").count() == 6
    before = store.read("price_timeseries")
    store.compact("price_timeseries")
    assert stored() == 6 and {r[0] for r in rows_of(store.read("price_timeseries"), "slot")} == {9}
    assert before.count() == 6  # readers that are under way keep their generation
    assert store.replace(points(11).where("candidate_id = 'a'"), "price_timeseries") == 11
    assert rows_of(store.read("price_timeseries").groupBy("candidate_id", "slot").count(), "candidate_id", "slot", "count") == [("a", 11, 3), ("b", 9, 3)]
    assert store.append_unique(points(12), "price_timeseries", "skip") == {"stored": 0, "duplicates": 6}
    store.compact("price_timeseries")
    assert stored() == 6 and len(store._generations("price_timeseries")) == 2


def test_writes_that_break_off_stay_invisible(spark, store, monkeypatch):
    row = lambda c, p: frame(spark, schemas.PRICE_TIMESERIES, [{"candidate_id": c, "timestamp_ms": 1, "slot": 1, "price": p, "volume": 1.0, "swap_count": 1}])
    read = lambda: rows_of(store.read("price_timeseries"), "candidate_id", "price")
    store.append_unique(row("a", 1.0).union(row("b", 1.0)), "price_timeseries")

    def break_off(at):
        calls = []

        def move(*args):
            calls.append(1)
            if len(calls) == at:
                raise OSError("lost")
            return move_path(*args)
        move_path = session.move_path
        monkeypatch.setattr(tables, "move_path", move)

    from marketlab import session
    for at in (1, 2):  # before the rows are there, before their marks are there
        break_off(at)
        with pytest.raises(OSError):
            store.replace(row("a", 7.0), "price_timeseries")
        monkeypatch.undo()
        assert read() == [("a", 1.0), ("b", 1.0)]
    assert store.replace(row("b", 2.0), "price_timeseries") == 2  # does not bring the broken rows of "a" to light
    assert read() == [("a", 1.0), ("b", 2.0)]
    break_off(1)
    with pytest.raises(OSError):
        store.compact("price_timeseries")
    monkeypatch.undo()
    assert read() == [("a", 1.0), ("b", 2.0)]
    store.compact("price_timeseries")
    assert read() == [("a", 1.0), ("b", 2.0)] and store._stored("price_timeseries").count() == 2


def _stored(spark):
    found = exits.exits(run(spark, guard(0.3, 60_000), [(1000, 1.0)], [(1, 10)], 2000))
    from marketlab.functions import costs
    return costs.trade_columns(found, costs.scenarios(spark))


def test_trade_comparison_tolerance_and_nulls(spark):
    t = _stored(spark)
    assert verify.trade_diff(t, t).isEmpty()
    near = t.selectExpr("* except (outcome)", "outcome + 5e-8 outcome")
    assert verify.trade_diff(t, near.select(t.columns)).isEmpty()
    far = t.selectExpr("* except (outcome, min_liquidity)", "outcome + 2e-7 outcome",
                       "cast(null as double) min_liquidity").select(t.columns)
    assert {r["field"] for r in verify.trade_diff(t, far).collect()} == {"outcome", "min_liquidity"}


def test_replay_verification(spark):
    from helpers import liquidity, price
    t = _stored(spark)
    orphan = t.where("scenario_id = 'realistic'").selectExpr(
        "* except (trade_id, candidate_id)", "'x' trade_id", "'nobody' candidate_id").select(t.columns)
    stored = t.unionByName(orphan)
    c = candidates(spark, [{"discovered_at": 2000}])
    div = verify.verify(stored, c, price(spark, [(1000, 1.0)]), liquidity(spark, [(1, 10)]),
                        guard(0.3, 60_000))
    assert rows_of(div, "trade_id", "field", "replayed") == [("x", "Error", "candidate not found")]
    assert rows_of(verify.verification_summary(stored, div), "total_trades", "matched_trades",
                   "divergent_trades") == [(5, 4, 1)]


def test_intermediate_tables_are_discarded(spark, store, tmp_path):
    from marketlab import session
    mark = session.intermediates_mark()
    df = session.materialize(swap_events(spark, [{"timestamp": 1}]), "t")
    assert session.intermediates_mark() == mark + 1 and df.count() == 1
    store.append_unique(df, "swap_events")  # its own staging is gone, ours is not
    assert session.intermediates_mark() == mark + 1 and df.count() == 1
    assert session.discard_intermediates(spark, mark) == 1


def test_seen_mints_and_run_statistics(spark):
    from marketlab.operators import metrics
    seen = spark.createDataFrame([("m1",)], "mint string")
    ev = swap_events(spark, [{"timestamp": 1}, {"timestamp": 2, "mint": "m2"}])
    assert rows_of(tables.seen_mints(seen, ev), "mint") == [("m2",)]
    c = candidates(spark, [{}])
    assert metrics.run_statistics(c, c, c, c.limit(0)).first().asDict() == {
        "candidates": 1, "trades": 1, "aggregates": 1, "errors": 0}


def test_known_keys_are_found_at_other_slots(spark, tmp_path):
    from helpers import swap_events
    store = tables.TableStore(spark, str(tmp_path / "k"))
    store.append_unique(swap_events(spark, [{"timestamp": 1, "slot": 5}]), "swap_events")
    again = swap_events(spark, [{"timestamp": 1, "slot": 6}])
    assert store.append_unique(again, "swap_events", "skip") == {"stored": 0, "duplicates": 1}
    with pytest.raises(tables.DuplicateKey):
        store.append_unique(again, "swap_events")


def test_replaced_groups_show_their_newest_rows(spark, tmp_path):
    from helpers import frame
    store = tables.TableStore(spark, str(tmp_path / "r"))
    make = lambda **rows: frame(spark, schemas.PRICE_TIMESERIES, [
        {"candidate_id": c, "timestamp_ms": t, "slot": 1, "price": p, "volume": 1.0, "swap_count": 1}
        for c, points in rows.items() for t, p in points])
    read = lambda: sorted((r["candidate_id"], r["timestamp_ms"], r["price"]) for r in store.read("price_timeseries").collect())
    store.append_unique(make(a=[(1, 1.0), (2, 2.0)], b=[(1, 5.0)]), "price_timeseries")
    assert store.replace(make(a=[(1, 9.0)]), "price_timeseries") == 1
    assert read() == [("a", 1, 9.0), ("b", 1, 5.0)]
    assert store.append_unique(make(a=[(1, 7.0), (2, 4.0)]), "price_timeseries", "skip") == {"stored": 1, "duplicates": 1}
    assert read() == [("a", 1, 9.0), ("a", 2, 4.0), ("b", 1, 5.0)]
    assert store.replace(make(a=[(3, 3.0)]), "price_timeseries", make(b=[(0, 0.0)])) == 2
    assert read() == [("a", 3, 3.0)]
    assert store.read("price_timeseries").columns == schemas.PRICE_TIMESERIES.names
    with pytest.raises(tables.DuplicateKey):
        store.replace(make(a=[(1, 1.0), (1, 2.0)]), "price_timeseries")


def test_copies_of_a_salted_lookup_are_not_broadcast(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    joined = joins.salted_join(rows, lookup, "k", "id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000
    assert joined.where("x is null").select("k").distinct().count() == 2


def test_rows_of_a_salted_join_are_not_sorted(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    lookup = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    for how, n in (("left", 1000), ("left_semi", 715), ("left_anti", 285), ("inner", 715)):
        joined = joins.salted_join(rows, lookup, "k", "id", how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
        assert joined.count() == n


def test_rows_are_written_once_and_checked_there(spark, store, monkeypatch):
    row = lambda c: frame(spark, schemas.PRICE_TIMESERIES, [{"candidate_id": c, "timestamp_ms": 1, "slot": 1, "price": 1.0, "volume": 1.0, "swap_count": 1}])
    monkeypatch.setattr(tables, "materialize", lambda *_: pytest.fail("written twice"))
    store.append_unique(row("a"), "price_timeseries")
    store.replace(row("b"), "price_timeseries")
    for write in (store.replace, store.append_unique):
        with pytest.raises(tables.DuplicateKey):
            write(row("c").union(row("c")), "price_timeseries")
    assert rows_of(store.read("price_timeseries"), "candidate_id") == [("a",), ("b",)]
    assert not [n for n in tables.list_names(spark, store.path("price_timeseries")) if n.startswith("_")]
