import glob
import os

import pytest
from helpers import candidates

from marketlab.functions.timecols import DAY_MS
from marketlab.operators import exits
from marketlab.plans import oracles, pipeline, queries, views
from marketlab.sources import tables
from marketlab.sources.adapters import Dataset

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


def load(spark, root):
    d, store = Dataset(spark, SMALL), tables.TableStore(spark, str(root))
    store.ingest(d.token_candidates(), "token_candidates")
    store.ingest(d.swaps(), "swaps", 0, 2**50)
    store.ingest(d.liquidity_events(), "liquidity_events")
    return store


def test_pipeline_end_to_end(spark, tmp_path):
    store = load(spark, tmp_path / "a")
    out = pipeline.run(store, queries.demo_rules(), str(tmp_path / "report"))
    n = store.read("token_candidates").count()
    trades = store.read("trade_records")
    assert trades.count() == n * 3 * 4
    assert out.aggregates.count() == 3 * 4 * 2 and out.decisions.count() == 6
    summary = out.summary.first()
    assert summary["overall"] == "INSUFFICIENT_DATA"  # far below 300 candidates
    assert out.missing.isEmpty() and out.checks.count() == 7
    lines = sum(len(open(f).read().splitlines()) - 1
                for f in glob.glob(str(tmp_path / "report/trade_records/*.csv")))
    assert lines == trades.count()
    # running again changes nothing
    digest = lambda s: {r["table_name"]: r["digest"] for r in pipeline.fingerprint(s).collect()}
    first = digest(store)
    pipeline.normalise(store)
    pipeline.evaluate(store, queries.demo_rules())
    pipeline.aggregate(store)
    assert store.read("trade_records").count() == trades.count()
    other = load(spark, tmp_path / "b")
    pipeline.normalise(other)
    assert digest(store) == first == digest(other)


def test_recompute_and_fresh_aggregates(spark, tmp_path):
    d, store = Dataset(spark, SMALL), tables.TableStore(spark, str(tmp_path / "t"))
    store.ingest(d.token_candidates(), "token_candidates")
    store.append_unique(d.liquidity_events(), "liquidity_events")
    store.append_unique(d.swaps().where("slot % 2 = 0"), "swaps")
    first = pipeline.run(store, queries.demo_rules()[:3], str(tmp_path / "r1"))
    n = first.aggregates.agg({"total_trades": "sum"}).first()[0]
    store.append_unique(d.swaps().where("slot % 2 = 1"), "swaps")
    custom = exits.rule("ALL_OUT", "NEW_TOKEN", hold=1)
    exits.register_exit_rule("ALL_OUT", lambda c, p, q, rules: exits.exit_rule("TIME_EXIT")(
        c, p, q, [("TIME_EXIT", *r[1:]) for r in rules]))
    bad = exits.rule("MOON_SHOT", "NEW_TOKEN", hold=1)
    second = pipeline.run(store, queries.demo_rules() + [custom, bad], str(tmp_path / "r2"), mode="recompute")
    fresh = tables.TableStore(spark, str(tmp_path / "u"))
    fresh.ingest(d.token_candidates(), "token_candidates")
    fresh.append_unique(d.liquidity_events(), "liquidity_events")
    fresh.append_unique(d.swaps(), "swaps")
    pipeline.normalise(fresh)
    for name in ("price_timeseries", "liquidity_timeseries", "volume_timeseries", "derived_features"):
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, fresh.read(name).collect())), name
    assert [r["reason"] for r in second.rejected_rules.collect()] == ["unknown strategy type"]
    after = second.aggregates
    assert after.agg({"total_trades": "sum"}).first()[0] == store.read("trade_records").count() > n
    assert after.groupBy("strategy_id", "scenario_id", "entry_event_type").count().where("count > 1").isEmpty()
    assert second.statistics.first()["trades"] == store.read("trade_records").count()


def test_views_have_the_fixed_columns(spark):
    d = Dataset(spark, SMALL)
    views.create_feature_views(queries.price_of(d), queries.liquidity_of(d))
    names = views.create_discovery_views(d.swaps(), queries.meta_of(d), queries.stored_of(d))
    assert spark.table("v_derived_features_computed").columns == [
        "candidate_id", "timestamp_ms", "price_delta", "price_velocity", "price_acceleration",
        "liquidity_delta", "liquidity_velocity", "token_lifetime_ms", "last_swap_interval_ms",
        "last_liq_event_interval_ms"]
    assert spark.table("v_token_lifecycle").columns == [
        "candidate_id", "first_swap_ts", "last_swap_ts", "total_lifetime_ms", "total_swaps"]
    assert "v_discovery_validation" in names
    assert spark.sql("SELECT * FROM v_all_discovery_candidates").columns == [
        "candidate_id", "source", "mint", "pool", "tx_signature", "event_index", "slot", "timestamp"]


def test_every_query_has_sql():
    assert set(oracles.oracle_sql()) == set(queries.queries())


def test_discovery_times_are_after_the_data_starts(spark):
    d = Dataset(spark, SMALL)
    assert d.token_candidates().where(f"discovered_at < {5 * DAY_MS}").isEmpty()
    assert candidates(spark, [{}]).columns == d.token_candidates().columns
