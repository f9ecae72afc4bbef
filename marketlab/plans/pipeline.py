"""The batch pipeline: stored events to verdict and report files."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.functions import costs
from marketlab.operators import exits, features, metrics, quality, series, verdict
from marketlab.operators.joins import resolve_candidates, salted_join
from marketlab.schemas import TRADE_RECORDS
from marketlab.session import discard_intermediates, intermediates_mark, materialize
from marketlab.sources.tables import (
    AGGREGATE_CSV, SCENARIO_CSV, TableStore, all_aggregates, all_trades, scenario_outcomes,
    write_csv, write_json)


@dataclass
class Results:
    """Lazy reports over the stored tables; nothing is computed until it is read."""

    checks: DataFrame
    aggregates: DataFrame
    sensitivity: DataFrame
    comparison: DataFrame
    decisions: DataFrame
    summary: DataFrame
    missing: DataFrame
    errors: DataFrame
    rejected_rules: DataFrame | None = None
    rejected_jobs: DataFrame | None = None
    statistics: DataFrame | None = None


def normalise(store: TableStore, mode: str = "skip") -> None:
    """Series and features of all candidates in one job each.

    ``skip`` leaves candidates alone that have a series; ``recompute`` builds all again from the
    events stored by now and puts them in the place of the old ones.  Liquidity events that came
    before their candidate find it here.
    """
    candidates = store.read("token_candidates")
    known = candidates.select("candidate_id").distinct()
    done = store.read("price_timeseries")

    def pending(events: DataFrame) -> DataFrame:
        rows = salted_join(events, known, "candidate_id", "tx_signature", "left_semi")
        return series.only_missing(rows, done, mode)

    swaps = pending(store.read("swaps"))
    raw = pending(resolve_candidates(store.read("liquidity_events"), candidates))
    price = materialize(series.price_timeseries(swaps), "fresh-price")
    liquidity = materialize(series.liquidity_timeseries(raw), "fresh-liquidity")

    def put(rows: DataFrame, table: str) -> None:
        if mode == "recompute":
            store.replace(rows, table, known)
        else:
            store.append_unique(rows, table, "skip")

    put(liquidity, "liquidity_timeseries")
    put(series.volume_timeseries(swaps), "volume_timeseries")
    put(features.derived_features(price, liquidity), "derived_features")
    # last: this table marks a candidate as done
    put(price, "price_timeseries")


def evaluate(store: TableStore, rules: list[tuple], scenario_rows=None, mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Store the trades of all candidates; returns the rules and jobs that were rejected.

    Families with a function of their own (``register_exit_rule``) take part like the built-in ones.
    """
    candidates, price = store.read("token_candidates"), store.read("price_timeseries")
    liquidity = store.read("liquidity_timeseries")
    done = exits.evaluate(candidates, price, liquidity, exits.built_in_rules(rules))
    found = exits.exits(done)
    for family in exits.custom_families(rules):
        own = [r for r in rules if r[0] == family]
        found = found.unionByName(exits.exit_rule(family)(candidates, price, liquidity, own), allowMissingColumns=True).select(found.columns)
    trades = costs.trade_columns(found, costs.scenarios(store.spark, scenario_rows))
    if mode == "recompute":
        store.replace(trades, "trade_records", candidates.select("candidate_id").distinct())
    else:
        store.append_unique(trades, "trade_records", "skip")
    refused = exits.rejected_rules(exits.rule_table(store.spark, rules), exits.custom_families(rules))
    return refused, exits.rejected(done)


def aggregate(store: TableStore) -> None:
    """Aggregates over all trades stored by now; older versions of a group give way."""
    store.replace(
        metrics.strategy_aggregates(store.read("trade_records"), store.read("token_candidates")),
        "strategy_aggregates")


def report(store: TableStore, implementable: DataFrame | None = None) -> Results:
    candidates, trades = store.read("token_candidates"), store.read("trade_records")
    swaps, liquidity_events = store.read("swaps"), store.read("liquidity_events")
    price, liquidity = store.read("price_timeseries"), store.read("liquidity_timeseries")
    aggregates = store.read("strategy_aggregates")
    missing = metrics.missing_candidates(trades, candidates)
    lost = missing.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(7).alias("check_no"), F.lit("Trades without a candidate").alias("name"),
        F.lit("= 0").alias("threshold"), F.col("n").cast("double").alias("actual"),
        (F.col("n") == 0).alias("pass"))
    checks = quality.sufficiency(candidates, swaps, liquidity_events, price, liquidity).unionByName(lost)
    decided = verdict.decide(verdict.decision_inputs(aggregates, implementable))
    return Results(
        checks=checks, aggregates=all_aggregates(aggregates),
        sensitivity=metrics.scenario_sensitivity(aggregates),
        comparison=metrics.source_comparison(aggregates), decisions=decided,
        summary=verdict.executive_summary(decided, aggregates, checks,
                                          metrics.data_summary(candidates, trades)),
        missing=missing,
        errors=quality.integrity_errors(candidates, swaps, liquidity_events, price))


def write_report(store: TableStore, results: Results, folder: str) -> None:
    """CSV and JSON report files, plus the fingerprint of the data behind them."""
    write_csv(results.aggregates, os.path.join(folder, "strategy_aggregates"), AGGREGATE_CSV)
    write_csv(all_trades(store.read("trade_records")), os.path.join(folder, "trade_records"),
              TRADE_RECORDS.names)
    write_csv(scenario_outcomes(results.sensitivity).orderBy("strategy_id", "entry_event_type"),
              os.path.join(folder, "scenario_outcomes"), SCENARIO_CSV)
    write_json(results.summary, os.path.join(folder, "summary"))
    write_json(results.checks, os.path.join(folder, "checks"))
    write_json(results.decisions, os.path.join(folder, "decisions"))
    write_json(fingerprint(store), os.path.join(folder, "fingerprint"))


def fingerprint(store: TableStore) -> DataFrame:
    """Digest of candidates and series; of metrics and trades when there is no series."""
    names = ["token_candidates", "price_timeseries", "liquidity_timeseries"]
    if not any(store.exists(n) for n in names):
        names = ["strategy_aggregates", "trade_records"]
    return quality.dataset_fingerprint({n: store.read(n) for n in names})


def run(store: TableStore, rules: list[tuple], folder: str, scenario_rows=None,
        implementable: DataFrame | None = None, mode: str = "skip") -> Results:
    """Normalise, evaluate, aggregate and report; refused rules and jobs are part of the results."""
    mark = intermediates_mark()
    try:
        normalise(store, mode)
        refused, rejected = evaluate(store, rules, scenario_rows, mode)
        refused_at, rejected_at = (os.path.join(folder, n) for n in ("rejected_rules", "rejected_jobs"))
        write_json(refused, refused_at)
        write_json(rejected, rejected_at)
        aggregate(store)
        results = report(store, implementable)
        results.rejected_rules = store.spark.read.schema(refused.schema).json(refused_at)
        results.rejected_jobs = store.spark.read.schema(rejected.schema).json(rejected_at)
        candidates, trades = store.read("token_candidates"), store.read("trade_records")
        results.statistics = metrics.run_statistics(candidates, trades, results.aggregates, results.rejected_jobs)
        write_report(store, results, folder)
        return results
    finally:
        discard_intermediates(store.spark, mark)  # the reports read stored tables only
