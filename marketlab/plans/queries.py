"""Every operator as a named query over one folder of tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions import costs, ids
from marketlab.functions.timecols import DAY_MS
from marketlab.operators import (
    asof, discovery, exits, features, joins, metrics, ordering, quality, replay, series, verdict,
    verify)
from marketlab.plans import pipeline, views
from marketlab.schemas import TABLES, TX_LOGS, check_enums
from marketlab.session import materialize, shared_dir
from marketlab.sources import decode, tables
from marketlab.sources.adapters import Dataset
from marketlab.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn):
        _QUERIES[name] = lambda spark, path: fn(Dataset(spark, path))
        return fn
    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Sums of doubles depend on the order of addition: round them in reports."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def price_of(d: Dataset, coarse: bool = False) -> DataFrame:
    return series.price_timeseries(d.swaps(coarse))


def liquidity_of(d: Dataset, coarse: bool = False) -> DataFrame:
    return series.liquidity_timeseries(d.liquidity_events(coarse))


# --- time series and features -------------------------------------------------------------

@query("price_timeseries")
def q_price(d):
    return rounded(price_of(d), 6, "volume")


@query("price_timeseries_coarse")
def q_price_coarse(d):
    return rounded(price_of(d, True), 6, "volume")


@query("price_timeseries_wide")
def q_price_wide(d):
    return rounded(series.price_timeseries(d.swaps_wide()), 6, "volume")


@query("liquidity_timeseries")
def q_liq(d):
    return liquidity_of(d)


@query("liquidity_timeseries_coarse")
def q_liq_coarse(d):
    return liquidity_of(d, True)


@query("volume_timeseries")
def q_volume(d):
    return rounded(series.volume_timeseries(d.swaps()), 6, "volume", "buy_volume", "sell_volume")


@query("price_derivatives")
def q_price_derivatives(d):
    return rounded(features.price_derivatives(price_of(d)), 6, "volume")


@query("price_acceleration")
def q_price_acceleration(d):
    return features.price_acceleration(price_of(d))


@query("liquidity_derivatives")
def q_liquidity_derivatives(d):
    return features.liquidity_derivatives(liquidity_of(d))


@query("last_swap_interval")
def q_last_swap_interval(d):
    return features.last_swap_interval(price_of(d))


@query("last_liq_event_interval")
def q_last_liq_interval(d):
    return features.last_liq_event_interval(liquidity_of(d))


@query("feature_validation")
def q_feature_validation(d):
    return features.feature_validation(price_of(d))


@query("derived_features_go")
def q_features(d):
    return features.derived_features(price_of(d), liquidity_of(d))


@query("derived_features_go_coarse")
def q_features_coarse(d):
    return features.derived_features(price_of(d, True), liquidity_of(d, True))


@query("derived_features_sql")
def q_features_sql(d):
    return features.derived_features(price_of(d, True), liquidity_of(d, True), "exact")


@query("token_lifecycle")
def q_lifecycle(d):
    return series.lifecycle(price_of(d))


@query("token_lifecycle_liquidity")
def q_lifecycle_liq(d):
    return series.lifecycle(liquidity_of(d))


def hot(d: Dataset) -> Dataset:
    """The same tables with a third of the users merged into one key."""
    return Dataset(d.spark, d.path, hot=True)


@query("derived_features_hot")
def q_features_hot(d):
    return features.derived_features(price_of(hot(d)), liquidity_of(hot(d)))


@query("trailing_windows_hot")
def q_windows_hot(d):
    return rounded(discovery.trailing_windows(hot(d).swap_events()), 6, "volume_1h", "volume_24h")


@query("active_token_hot")
def q_active_hot(d):
    return discovery.active_tokens(hot(d).swap_events(), EVAL_AT)


# --- as-of lookups ------------------------------------------------------------------------

def probes_of(d: Dataset) -> DataFrame:
    """Daily probe times around every candidate, some before the first point."""
    return d.token_candidates().select(
        "candidate_id",
        F.explode(F.transform(F.sequence(F.lit(-6), F.lit(29)),
                              lambda k: F.col("discovered_at") + k.cast("long") * F.lit(DAY_MS))).alias("at_ms"))


@query("price_at")
def q_price_at(d):
    return asof.price_at(probes_of(d), price_of(d), "at_ms")


@query("liquidity_at")
def q_liquidity_at(d):
    return asof.liquidity_at(probes_of(d), liquidity_of(d), "at_ms")


@query("previous_liquidity_event")
def q_previous_liquidity(d):
    return asof.previous_event_time(
        price_of(d).select("candidate_id", "timestamp_ms"), liquidity_of(d), "timestamp_ms")


@query("price_liquidity_exact")
def q_exact(d):
    return asof.exact_time(price_of(d, True).select("candidate_id", "timestamp_ms", "price"),
                           liquidity_of(d, True))


# --- discovery ----------------------------------------------------------------------------

EVAL_AT = 1704067200000 + 20 * DAY_MS  # day 20 of the data
LAST_DAY = 1704067200000 + 29 * DAY_MS


def meta_of(d: Dataset) -> DataFrame:
    """One metadata row per candidate; the mint is the candidate's own name."""
    return d.token_candidates().select("candidate_id", F.concat(F.lit("m"), "mint").alias("mint"))


def stored_of(d: Dataset) -> DataFrame:
    """Stored candidates: the active ones only, so that some mints stay undiscovered."""
    return d.token_candidates().where(F.col("source") == "ACTIVE_TOKEN")


@query("new_token")
def q_new(d):
    return discovery.new_tokens(d.swap_events())


@query("new_token_unseen")
def q_new_unseen(d):
    return discovery.new_tokens(d.swap_events(), stored_of(d))


@query("active_token_at")
def q_active_at(d):
    return discovery.active_tokens(d.swap_events(), EVAL_AT, stored_of(d))


@query("liquidity_spike")
def q_liquidity_spike(d):
    return discovery.active_tokens(d.swap_events(), EVAL_AT, None, d.liquidity_events())


@query("active_token_sql")
def q_active_sql(d):
    return rounded(discovery.spike_report(d.swaps(), meta_of(d)), 6,
                   "volume_1h", "volume_24h_avg", "swaps_24h_avg")


@query("all_discovery")
def q_all_discovery(d):
    return discovery.all_discovery(d.swaps(), meta_of(d), stored_of(d))


@query("discovery_validation")
def q_validation(d):
    return discovery.discovery_validation(d.token_candidates(), meta_of(d), d.swaps())


@query("trailing_windows")
def q_windows(d):
    return rounded(discovery.trailing_windows(d.swap_events()), 6, "volume_1h", "volume_24h")


@query("active_token_per_event")
def q_per_event(d):
    return discovery.first_spikes(d.swap_events(), stored_of(d))


@query("replay_discovery")
def q_replay_discovery(d):
    return discovery.replay_discovery(d.swap_events(), None, EVAL_AT, stored_of(d))


@query("candidate_reconcile")
def q_reconcile(d):
    replayed = discovery.new_tokens(d.swap_events())
    stored = replayed.withColumn("candidate_id", F.when(
        F.col("slot") % 3 == 0, F.concat(F.lit("other-"), "candidate_id")).otherwise(F.col("candidate_id")))
    return discovery.reconcile(replayed, stored)


# --- exit rules ---------------------------------------------------------------------------

def demo_rules() -> list[tuple]:
    """Holding periods of days: the test events are about eleven hours apart."""
    return [r for e in ("NEW_TOKEN", "ACTIVE_TOKEN") for r in (
        exits.rule(ids.TIME_EXIT, e, hold=5 * DAY_MS),
        exits.rule(ids.TRAILING_STOP, e, trail=0.90, stop=0.95, max_hold=5 * DAY_MS),
        exits.rule(ids.LIQUIDITY_GUARD, e, drop=0.80, max_hold=3 * DAY_MS))]


def stored_series(d: Dataset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates and both series as stored tables, the way the rules find them."""
    return (materialize(d.token_candidates(), "token_candidates"),
            materialize(price_of(d), "price_timeseries"),
            materialize(liquidity_of(d), "liquidity_timeseries"))


def grid_of(d: Dataset) -> DataFrame:
    return exits.evaluate(*stored_series(d), demo_rules())


def family_exits(d: Dataset, family: str) -> DataFrame:
    run = exits.exit_rule(family)
    return run(*stored_series(d), demo_rules()).drop(
        "rule_no", "strategy_type", "source")


@query("time_exit")
def q_time_exit(d):
    return family_exits(d, ids.TIME_EXIT).drop("peak_price", "min_liquidity")


@query("trailing_stop")
def q_trailing(d):
    return family_exits(d, ids.TRAILING_STOP).drop("min_liquidity")


@query("liquidity_guard")
def q_guard(d):
    return family_exits(d, ids.LIQUIDITY_GUARD).drop("peak_price")


def trades_of(d: Dataset) -> DataFrame:
    return exits.trade_records(*stored_series(d), demo_rules())


@query("trade_records")
def q_trades(d):
    return trades_of(d)


@query("exits_hot")
def q_exits_hot(d):
    """The default and the swept rules where one candidate has a third of all points."""
    h = hot(d)
    entries = h.events().groupBy(F.col("key").alias("candidate_id")).agg((F.min("timestamp") + 5 * DAY_MS).alias("discovered_at"))
    entries = materialize(entries.withColumn("source", F.lit("NEW_TOKEN")), "entries")
    return exits.exits(exits.evaluate(entries, materialize(price_of(h), "price"), materialize(liquidity_of(h), "liquidity"), demo_rules())).drop("rule_no")


@query("parameter_sweep")
def q_sweep(d):
    """All 22 rules of the sweep with hours instead of minutes."""
    found = exits.exits(exits.evaluate(*stored_series(d), exits.sweep_rules(60_000)))
    return found.select("candidate_id", "strategy_id", "exit_signal_time", "exit_signal_price",
                        "exit_reason", "peak_price", "min_liquidity")


@query("sql_views")
def q_views(d):
    """The combined-features view through SQL, next to the lifecycle views."""
    views.create_feature_views(price_of(d, True), liquidity_of(d, True))
    return d.spark.sql("""
        SELECT f.candidate_id, f.timestamp_ms, f.price_delta, f.liquidity_delta,
               f.last_liq_event_interval_ms, l.total_swaps, q.total_liq_events
        FROM v_derived_features_computed f JOIN v_token_lifecycle l USING (candidate_id)
        LEFT JOIN v_token_lifecycle_liquidity q USING (candidate_id)""")


@query("rejected_jobs")
def q_rejected(d):
    """Entries before the first liquidity event: the guard has nothing to guard."""
    candidates, price, liquidity = stored_series(d)
    early = candidates.withColumn("discovered_at", F.col("discovered_at") - 5 * DAY_MS)
    return exits.rejected(exits.evaluate(early, price, liquidity, demo_rules()))


# --- metrics and reports ------------------------------------------------------------------

METRICS = ["win_rate", "token_win_rate", "outcome_mean", "outcome_median", "outcome_p10",
           "outcome_p25", "outcome_p75", "outcome_p90", "outcome_min", "outcome_max",
           "outcome_stddev", "max_drawdown", "outcome_realistic", "outcome_pessimistic",
           "outcome_degraded"]


def wide_trades(d: Dataset) -> DataFrame:
    """One synthetic trade per line item: large groups for the outcome metrics.

    The outcome is the relative deviation of the line's unit price from a fixed level.
    """
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    outcome = (unit - 1400.0) / 1400.0
    return d.table("lineitem").select(
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]), 256).alias("trade_id"),
        F.col("l_partkey").cast("string").alias("candidate_id"),
        F.concat(F.element_at(F.array(*[F.lit(x) for x in ids.RULE_TYPES]),
                              (F.col("l_suppkey") % 3 + 1).cast("int")), F.lit("_X"))
        .alias("strategy_id"),
        F.element_at(F.array(*[F.lit(x) for x in metrics.SCENARIO_IDS]),
                     (F.col("l_orderkey") % 4 + 1).cast("int")).alias("scenario_id"),
        F.expr("cast(unix_date(cast(l_shipdate as date)) as long) * 86400000")
        .alias("entry_signal_time"),
        outcome.alias("outcome"), F.when(outcome > 0, "WIN").otherwise("LOSS").alias("outcome_class"))


def wide_candidates(d: Dataset) -> DataFrame:
    """The parts that have a candidate; every seventh part is missing."""
    return d.table("part").where("p_partkey % 7 <> 0").select(
        F.col("p_partkey").cast("string").alias("candidate_id"),
        F.when(F.col("p_partkey") % 3 == 0, "ACTIVE_TOKEN").otherwise("NEW_TOKEN").alias("source"))


def aggregates_of(d: Dataset) -> DataFrame:
    return metrics.strategy_aggregates(wide_trades(d), wide_candidates(d))


def stored_aggregates(d: Dataset) -> DataFrame:
    """The aggregate table as reports read it."""
    return rounded(materialize(aggregates_of(d), "aggregates"), 6, *METRICS)


@query("strategy_aggregates")
def q_aggregates(d):
    return rounded(aggregates_of(d), 6, *METRICS)


@query("strategy_aggregates_exits")
def q_aggregates_exits(d):
    candidates, price, liquidity = stored_series(d)
    trades = exits.trade_records(candidates, price, liquidity, demo_rules())
    return rounded(metrics.strategy_aggregates(trades, candidates), 6, *METRICS)


@query("missing_candidates")
def q_missing(d):
    return metrics.missing_candidates(wide_trades(d), wide_candidates(d))


@query("grouping_levels")
def q_grouping(d):
    return rounded(metrics.grouping_levels(wide_trades(d), wide_candidates(d)), 6,
                   "win_rate", "outcome_mean")


@query("trade_metrics")
def q_trade_metrics(d):
    return rounded(metrics.trade_metrics(wide_trades(d)), 6, "win_rate", "outcome_mean",
                   "outcome_min", "outcome_max", "outcome_stddev", "p10", "p25", "p50", "p75", "p90")


@query("scenario_pivot")
def q_pivot(d):
    return rounded(metrics.scenario_sensitivity(stored_aggregates(d)), 4, "degradation_pct")


@query("source_comparison")
def q_comparison(d):
    return rounded(metrics.source_comparison(stored_aggregates(d)), 6, "delta_win_rate",
                   "delta_median")


@query("metric_matrix")
def q_matrix(d):
    return metrics.metric_matrix(stored_aggregates(d))


@query("strategy_rank")
def q_rank(d):
    return metrics.strategy_rank(stored_aggregates(d))


@query("best_strategies")
def q_best(d):
    return metrics.best_strategies(stored_aggregates(d)).select(
        "strategy_id", "entry_event_type", "outcome_median", "win_rate")


@query("scenario_gap")
def q_gap(d):
    return metrics.scenario_gap(stored_aggregates(d))


@query("strategy_counts")
def q_counts(d):
    return metrics.strategy_counts(stored_aggregates(d))


@query("replay_references")
def q_references(d):
    return metrics.replay_references(stored_aggregates(d), wide_trades(d))


@query("data_summary")
def q_summary(d):
    return metrics.data_summary(d.token_candidates(), wide_trades(d))


@query("drawdown_and_streak")
def q_drawdown(d):
    return rounded(metrics.drawdown_and_streak(
        wide_trades(d), ["strategy_id", "scenario_id"]), 6, "max_drawdown")


# --- data quality and verdict -------------------------------------------------------------

def checks_of(d: Dataset) -> DataFrame:
    return rounded(quality.sufficiency(d.token_candidates(), d.swaps(), d.liquidity_events(),
                                       price_of(d), liquidity_of(d)), 6, "actual")


@query("sufficiency")
def q_sufficiency(d):
    return checks_of(d)


@query("integrity_errors")
def q_errors(d):
    """Some candidates have their events under another id."""
    def moved(df, n):
        strange = F.col("candidate_id").cast("long") % n == 0
        return df.withColumn("candidate_id", F.when(strange, F.concat(F.lit("x"), "candidate_id")).otherwise(F.col("candidate_id")))

    return quality.integrity_errors(d.token_candidates(), moved(d.swaps(), 5),
                                    moved(d.liquidity_events(), 7), moved(price_of(d), 11))


@query("decision")
def q_decision(d):
    decided = verdict.decide(verdict.decision_inputs(stored_aggregates(d)))
    return rounded(decided, 4, "positive_outcome_pct")


@query("decision_criteria")
def q_criteria(d):
    return verdict.criteria_rows(verdict.decide(verdict.decision_inputs(stored_aggregates(d))))


@query("executive_summary")
def q_executive(d):
    agg = stored_aggregates(d)
    decided = verdict.decide(verdict.decision_inputs(agg))
    return verdict.executive_summary(
        decided, agg, checks_of(d), metrics.data_summary(d.token_candidates(), wide_trades(d)))


@query("day_runs")
def q_days(d):
    """Two empty days after every five."""
    shifted = F.col("timestamp") + F.expr(f"(timestamp div {5 * DAY_MS}) * {2 * DAY_MS}")
    return ordering.day_runs(d.events().withColumn("timestamp", shifted), "timestamp")


@query("dataset_fingerprint")
def q_fingerprint(d):
    return quality.dataset_fingerprint({
        "candidates": d.token_candidates(),
        "price": price_of(d),
        "liquidity": liquidity_of(d)})


# --- order, merge, replay -----------------------------------------------------------------

def merged_of(d: Dataset) -> DataFrame:
    return ordering.merged_events(d.swaps(), d.liquidity_events())


@query("merged_events")
def q_merged(d):
    return merged_of(d).select("candidate_id", "slot", "tx_signature", "event_index", "timestamp",
                               "kind", "tie", "swap.price", "liquidity.liquidity_after")


@query("ordering_check")
def q_ordering(d):
    """Line items listed by (part, ship time): many repeat an order position backwards."""
    return ordering.order_violations(
        d.swaps_wide().withColumn("day", F.expr("timestamp div 86400000"))
        .withColumn("line", (F.col("slot") * 10 + F.col("event_index")) * 100000 + F.col("day"))
        .withColumn("slot", F.col("day")), "line", ["candidate_id"]).select(
        "candidate_id", "line", F.col("prev.slot").alias("prev_slot"), "ev.slot")


@query("event_statistics")
def q_event_statistics(d):
    return ordering.event_statistics(merged_of(d))


@query("replay_apply")
def q_replay(d):
    return replay.replay_statistics(merged_of(d))


# --- verification -------------------------------------------------------------------------

def shifted_trades(d: Dataset) -> tuple[DataFrame, DataFrame]:
    """Stored trades with known damage, and the correct ones."""
    good = materialize(trades_of(d), "trades")
    n = F.col("candidate_id").cast("long")
    bad = good.withColumns({
        "outcome": F.when(n % 5 == 0, F.col("outcome") + 1e-3).otherwise(F.col("outcome") + 1e-9),
        "peak_price": F.when(n % 7 == 0, F.lit(None)).otherwise(F.col("peak_price")),
        "exit_reason": F.when(n % 11 == 0, "OTHER").otherwise(F.col("exit_reason"))})
    return bad, good


@query("trade_diff")
def q_diff(d):
    """Differing fields with both values; numbers to six digits, the rest as text."""
    number = lambda c: F.round(F.col(c).try_cast("double"), 6)
    text = lambda c: F.when(F.col(c).try_cast("double").isNull(), F.col(c))
    return verify.trade_diff(*shifted_trades(d)).select(
        "trade_id", "field", *[f(c).alias(f"{c}_{n}") for c in ("stored", "replayed") for n, f in (("number", number), ("text", text))])


@query("verification_summary")
def q_verification(d):
    candidates, price, liquidity = stored_series(d)
    stored, _ = shifted_trades(d)
    unknown = stored.where("cast(candidate_id as long) % 13 = 0").withColumn(
        "scenario_id", F.lit("other"))
    stored = stored.where("cast(candidate_id as long) % 13 <> 0").unionByName(unknown)
    stored = materialize(stored, "stored-trades")
    found = materialize(verify.verify(stored, candidates, price, liquidity, demo_rules()), "found")
    return verify.verification_summary(stored, found)


# --- tables -------------------------------------------------------------------------------

@query("latest_metadata")
def q_metadata(d):
    return tables.latest_metadata(d.token_metadata())


@query("append_unique_skip")
def q_append(d):
    """Two halves that overlap, one of them doubled."""
    ev = d.swap_events()
    first = ev.where(F.col("timestamp") < EVAL_AT)
    second = ev.where(F.col("timestamp") >= EVAL_AT - 5 * DAY_MS)
    keys = tables.UNIQUE_KEYS["swap_events"]
    return tables.new_rows(second.unionByName(second), first, keys)


@query("repeated_keys")
def q_repeated(d):
    return tables.repeated_keys(d.swaps_wide(), ["candidate_id", "timestamp"]).select(
        F.col("_k0").alias("candidate_id"), F.col("_k1").alias("timestamp"), "n")


@query("active_mints")
def q_mints(d):
    return tables.active_mints(d.swap_events(), EVAL_AT - DAY_MS, EVAL_AT)


@query("time_range")
def q_range(d):
    return tables.time_range(price_of(d))


@query("range_scans")
def q_scans(d):
    """Rows in the closed and the half-open range that ends at the last event of a day."""
    ev = d.swaps(coarse=True)
    a, b = EVAL_AT - 2 * DAY_MS, EVAL_AT
    return tables.between(ev, "timestamp", a, b).agg(F.count(F.lit(1)).alias("closed")).crossJoin(
        tables.half_open(ev, "timestamp", a, b).agg(F.count(F.lit(1)).alias("half_open")))


@query("resolve_candidates")
def q_resolve(d):
    events = d.liquidity_events().withColumn(
        "candidate_id", F.when(F.col("slot") % 2 == 0, F.col("candidate_id")))
    known = d.token_candidates().where("source = 'ACTIVE_TOKEN'").withColumn(
        "candidate_id", F.concat(F.lit("c"), "mint"))
    return joins.resolve_candidates(events, known).select(
        "candidate_id", "mint", "tx_signature", "event_index", "slot")


@query("csv_text")
def q_csv(d):
    return tables.csv_text(stored_aggregates(d), tables.AGGREGATE_CSV)


# --- decoding -----------------------------------------------------------------------------

def tx_logs_of(d: Dataset) -> DataFrame:
    """Transactions whose logs describe the swap events; every seventh one failed."""
    line = F.concat(F.lit("Program log: Swap mint="), "mint", F.lit(" pool=P"), "mint")
    ev = d.swap_events()
    little = F.concat(*[F.substring(F.lpad(F.hex(F.col("slot")), 16, "0"), 2 * i + 1, 2)
                        for i in reversed(range(8))])
    body = F.unhex(F.concat(
        F.when(F.col("slot") % 3 == 0, "03").when(F.col("slot") % 3 == 1, "04").otherwise("05"),
        little, little))
    binary = F.concat(F.lit("Program log: ray_log: "), F.base64(body))
    return ev.select(
        "tx_signature", "slot", F.expr("timestamp div 1000").alias("block_time_s"),
        F.when(F.col("slot") % 7 == 0, "failed").alias("err"),
        F.array(F.lit("Program start"), line, binary).alias("logs"),
        F.array(*[F.lit("short")] * 3, *[F.rpad(F.concat(F.lit("M"), "mint"), 32, "1")] * 3)
        .alias("account_keys"))


@query("decode_swaps")
def q_decode_swaps(d):
    return decode.text_swaps(decode.usable(tx_logs_of(d), 0, EVAL_AT))


@query("decode_liquidity")
def q_decode_liquidity(d):
    return decode.amm_liquidity(decode.usable(tx_logs_of(d)))


def program_logs_of(d: Dataset) -> DataFrame:
    """Transactions with the binary and the bonding-curve log formats side by side.

    The traded key is 31 zero bytes and one byte that depends on the mint; the account list
    names another key for curve trades without a mint in the log.
    """
    ev = d.swap_events()
    little = F.concat(*[F.substring(F.lpad(F.hex(F.col("slot")), 16, "0"), 2 * i + 1, 2)
                        for i in reversed(range(8))])
    key_byte = F.lpad(F.hex(F.col("mint").cast("long") % 57 + 1), 2, "0")
    swap = F.unhex(F.concat(F.lit("09" + "00" * 32 + decode._NATIVE_HEX + "00" * 31), key_byte,
                            F.lit("00" * 8), little))
    odd = F.col("slot") % 2 == 1
    own_mint = F.concat(F.lit("Program log: mint="), F.concat(F.lit("T"), "mint"),
                        F.lit(" amount: "), F.col("slot").cast("string"))
    account = F.rpad(F.concat(F.lit("K"), F.translate("mint", "0", "z")), 40, "1")
    keys = [F.lit(f"key{i}") for i in range(18)]
    keys[2], keys[7] = account, F.lit(decode.TOKEN_PROGRAM)
    return ev.select(
        "tx_signature", "slot", F.expr("timestamp div 1000").alias("block_time_s"),
        F.lit(None).cast("string").alias("err"),
        F.array(
            F.concat(F.lit("Program log: ray_log: "), F.translate(F.base64(swap), "\r\n", "")),
            F.lit(f"Program {decode.CURVE_PROGRAM} invoke [1]"),
            F.when(odd, own_mint).otherwise("Program log: nothing"),
            F.lit("Program log: Instruction: Buy"),
            F.when(F.col("slot") % 5 == 0, "Program log: Instruction: Create")
            .otherwise("Program log: Instruction: Migrate"),
            F.lit(f"Program {decode.CURVE_PROGRAM} success"),
            F.lit("Program log: Instruction: Sell"),
            F.concat(F.lit("Trade of MINT: "), account)).alias("logs"),
        F.array(*keys).alias("account_keys"))


@query("decode_amm_swaps")
def q_decode_amm(d):
    return decode.amm_swaps(decode.usable(program_logs_of(d)))


@query("decode_curve_swaps")
def q_decode_curve(d):
    return decode.curve_swaps(decode.usable(program_logs_of(d)))


@query("decode_curve_liquidity")
def q_decode_curve_liquidity(d):
    return decode.curve_liquidity(decode.usable(program_logs_of(d)))


@query("decoded_liquidity_events")
def q_decoded_liquidity(d):
    """Liquidity events of all registered programs from one table of logs."""
    return decode.liquidity_events(program_logs_of(d)).select(
        "mint", "tx_signature", "event_index", "slot", "timestamp", "event_type")


@query("decode_generic_swaps")
def q_decode_generic(d):
    return decode.generic_swaps(decode.usable(program_logs_of(d))).select(
        "mint", "tx_signature", "event_index")


@query("decode_inferred_mints")
def q_decode_inferred(d):
    """Curve trades without a mint, filled from snapshots of two token accounts."""
    line = F.array(F.lit(f"Program {decode.AMM_PROGRAM} invoke [1]"),
                   F.lit(f"Program {decode.CURVE_PROGRAM} invoke [1]"),
                   F.lit("Program log: Instruction: Sell"))
    tx = d.swap_events().select(
        "tx_signature", "slot", F.expr("timestamp div 1000").alias("block_time_s"),
        F.lit(None).cast("string").alias("err"), line.alias("logs"),
        F.array(F.lit("a"), F.concat(F.lit("pool"), "mint"), F.lit("b"), F.lit("c"), F.lit("d"),
                F.lit("native"), F.concat(F.lit("acct"), "mint")).alias("account_keys"))
    byte = F.lpad(F.hex(F.col("mint").cast("long") % 57 + 1), 2, "0")
    accounts = d.swap_events().select("mint").distinct().select(
        F.concat(F.lit("acct"), "mint").alias("pubkey"),
        F.base64(F.unhex(F.concat(F.lit("00" * 31), byte, F.lit("00" * 40)))).alias("data"))
    native = d.spark.range(1).select(F.lit("native").alias("pubkey"), F.base64(F.unhex(F.lit(
        decode._NATIVE_HEX))).alias("data"))
    return decode.swap_events(tx, accounts.unionByName(native))


# --- more table operations ----------------------------------------------------------------

@query("scan_by_key")
def q_scan(d):
    return tables.by_key(d.swaps(), "7", order=("timestamp",))


@query("ingested_range")
def q_ingested(d):
    """A range of swaps taken into a table, twice."""
    store, _ = live_store(d, "ingest")
    for _ in range(2):
        store.ingest(d.swaps(), "swaps", EVAL_AT - 3 * DAY_MS, EVAL_AT, on_conflict="skip")
    return store.read("swaps")


@query("scan_by_attribute")
def q_attribute(d):
    return tables.with_values(d.token_candidates(), source="ACTIVE_TOKEN")


@query("trades_of_family")
def q_family(d):
    return tables.trades_of_family(wide_trades(d), "TIME_EXIT", "realistic")


@query("newest_version")
def q_newest(d):
    orders = d.table("orders").select(
        "o_custkey", F.col("o_orderkey").alias("created_at"), "o_orderstatus", "o_totalprice")
    return tables.newest_version(orders, ["o_custkey"])


@query("seen_mints")
def q_seen(d):
    return tables.seen_mints(stored_of(d).select("mint"), d.swap_events())


@query("enum_check")
def q_enum(d):
    broken = d.swaps().withColumn("side", F.when(F.col("slot") % 10 == 0, "hold")
                                  .when(F.col("slot") % 11 == 0, None).otherwise(F.col("side")))
    return check_enums(broken, "swaps").select("tx_signature", "side", "reason")


@query("run_statistics")
def q_statistics(d):
    candidates, price, liquidity = stored_series(d)
    evaluated = materialize(exits.evaluate(candidates, price, liquidity, demo_rules()), "evaluated")
    trades = costs.trade_columns(exits.exits(evaluated), costs.scenarios(d.spark))
    groups = metrics.classified(trades, candidates).select(*metrics.KEYS).distinct()
    return metrics.run_statistics(candidates, trades, groups, exits.rejected(evaluated))


@query("csv_text_trades")
def q_csv_trades(d):
    """Trade report lines with all 27 columns; the last two digits are left out, since the last one can be a tie."""
    lines = tables.csv_text(trades_of(d), TABLES["trade_records"].names)
    doubles = [f.name for f in TABLES["trade_records"].fields if f.dataType.typeName() == "double"]
    return lines.withColumns({c: F.regexp_replace(c, r"^(-?[0-9]+[.][0-9]{4})[0-9]{2}$", "$1..") for c in doubles})


@query("csv_text_scenarios")
def q_csv_scenarios(d):
    """Scenario outcomes with their six columns."""
    return tables.csv_text(tables.scenario_outcomes(metrics.scenario_sensitivity(stored_aggregates(d))), tables.SCENARIO_CSV)


@query("ordered_trades")
def q_ordered_trades(d):
    """All trades in report order, with their position in it."""
    return ordering.with_position(trades_of(d), ["entry_signal_time", "trade_id"]).select("position", "trade_id", "entry_signal_time")


@query("ordered_events")
def q_ordered_events(d):
    """All events of a day-grain table in canonical order, with their position."""
    rows = d.swaps_wide().select("candidate_id", "tx_signature", "event_index", "slot")
    return ordering.canonical_sort(rows, "candidate_id")  # several rows share a position in this table


@query("json_report")
def q_json(d):
    """The metadata report as JSON files, read back."""
    path = os.path.join(fresh_folder(d, "json"), "metadata")
    tables.write_json(tables.latest_metadata(d.token_metadata()), path)
    return d.spark.read.schema(TABLES["token_metadata"]).json(path)


@query("token_metadata_decoded")
def q_token_metadata(d):
    """Metadata from the bytes of mint and name accounts; every fifth name is longer than its account."""
    ev = d.swap_events().groupBy("mint").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("fetched_at"))

    def little(c, size):
        h = F.lpad(F.hex(c), 2 * size, "0")
        return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])

    def counted(text):
        return F.concat(little(F.octet_length(text).cast("long"), 4), F.hex(text))

    decimals = F.col("mint").cast("long") % 10
    mint = F.concat(F.lit("00" * 36), little(F.col("n"), 8), F.lpad(F.hex(decimals), 2, "0"), F.lit("00" * 37))
    name, symbol = F.concat(F.lit("Token "), "mint"), F.concat(F.lit("T"), "mint")
    named = F.when(F.col("mint").cast("long") % 5 == 0, F.concat(F.lit("FFFFFFFF"), F.lit("41" * 40))).otherwise(
        F.concat(counted(name), counted(symbol), F.lit("00" * 40)))
    body = lambda c: F.base64(F.unhex(c)).alias("data")
    return decode.token_metadata(
        ev.select(F.col("mint").alias("pubkey"), body(mint), "fetched_at"),
        ev.select("mint", body(F.concat(F.lit("04" + "00" * 64), named))), d.token_candidates())


@query("replay_determinism")
def q_determinism(d):
    """Rows of two discovery replays that only one of them has: none, of as many as there are candidates."""
    run = lambda: discovery.replay_discovery(d.swap_events())
    first, again = run(), run()
    lost = first.exceptAll(again).unionByName(again.exceptAll(first))
    return first.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(lost.agg(F.count(F.lit(1)).alias("different")))


@query("required_fingerprint")
def q_required(d):
    """The digest that a report must have: asked for once more, and refused when the data are others."""
    now = {"price": price_of(d), "liquidity": liquidity_of(d)}
    wanted = quality.dataset_fingerprint(now).where("table_name = 'ALL'").first()["digest"]
    same = quality.require_fingerprint(now, wanted) == wanted
    try:
        quality.require_fingerprint({**now, "liquidity": liquidity_of(d).where("slot % 7 > 0")}, wanted)
        refused = False
    except quality.FingerprintMismatch:
        refused = True
    rows = sum(df.count() for df in now.values())
    return d.spark.range(1).select(F.lit(rows).cast("long").alias("rows"), F.lit(same).alias("accepted"), F.lit(refused).alias("refused"))


@query("custom_exit_rule")
def q_custom_rule(d):
    """A family of one's own beside a built-in one in the grid: exit at the highest price within the period."""
    def at_top(candidates, price, liquidity, rules):
        table = exits.rule_table(d.spark, rules).where("strategy_type = 'AT_TOP'")
        c = candidates.join(F.broadcast(table), candidates["source"] == table["entry_event_type"])
        met = c.join(price.withColumnRenamed("slot", "at_slot"), "candidate_id").where(
            "timestamp_ms >= discovered_at and timestamp_ms < discovered_at + hold_duration_ms")
        top = F.struct(F.col("price"), -F.col("timestamp_ms"))
        return met.groupBy("candidate_id", "source", "rule_no", "strategy_type", "strategy_id", "discovered_at").agg(
            F.min_by("price", "timestamp_ms").alias("entry_signal_price"), F.max_by("timestamp_ms", top).alias("exit_signal_time"),
            F.max("price").alias("exit_signal_price")).select(
            "*", F.col("discovered_at").alias("entry_signal_time"), F.lit(None).cast("double").alias("entry_liquidity"),
            F.lit("TOP").alias("exit_reason"))

    exits.register_exit_rule("AT_TOP", at_top)
    rules = [exits.rule("AT_TOP", "NEW_TOKEN", hold=5 * DAY_MS), exits.rule(ids.TIME_EXIT, "NEW_TOKEN", hold=5 * DAY_MS)]
    return exits.trade_records(*stored_series(d), rules).where("scenario_id = 'realistic'").select(
        "candidate_id", "exit_reason", "exit_signal_time", "exit_signal_price")


@query("registered_decoder")
def q_registered_decoder(d):
    """A program of one's own takes the place of the others."""
    own = decode.LogDecoder(lambda: F.filter(F.transform("logs", lambda line, i: decode._event(
        "swap", i, mint=F.regexp_extract(line, decode.SWAP_TEXT, 1), pool=F.regexp_extract(line, decode.SWAP_TEXT, 2), amount=F.lit(0.0))),
        lambda e: e["mint"] != ""), "Program log: Swap")
    return decode.swap_events(tx_logs_of(d), decoders={"own": own}, start_ms=0, end_ms=EVAL_AT)


@query("replay_fold_hot")
def q_replay_fold(d):
    """State carried over the hours of all candidates, one of which has a third of the events."""
    h = hot(d)
    merged = ordering.merged_events(h.swaps(), h.liquidity_events())

    def step(state, batch):
        values = batch["slot"]
        steps = abs(int(values[0]) - state[2]) if state[0] else 0
        return (state[0] + len(values), state[1] if state[0] else int(values[0]), int(values[-1]),
                state[3] + steps + int(abs(values[1:] - values[:-1]).sum()))

    def merge(a, b):
        return a[0] + b[0], a[1], b[2], a[3] + b[3] + abs(int(b[1]) - int(a[2]))

    return replay.replay_fold(merged, (0, 0, 0, 0), step, merge, "events long, first_slot long, last_slot long, moved long", ["slot"])


# --- streaming ----------------------------------------------------------------------------

FILES = 12  # of a block of transactions, so that no single task writes or reads all of it


def fresh_folder(d: Dataset, name: str) -> str:
    return os.path.join(shared_dir(d.spark), f"{name}-{uuid.uuid4().hex}")


def micro_batches(d: Dataset, events: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The events as a stream of n micro-batches.

    Blocks of slots go to the batches in turn, so most events come late, and every batch but the
    first repeats some events of the first.
    """
    root = fresh_folder(d, name)
    batch = F.expr(f"(slot div 50) % {n}")
    for k in range(n):
        part = events.where(batch == k)
        if k:
            part = part.unionByName(events.where((batch == 0) & (F.col("slot") % 7 == k)))
        part.coalesce(1).write.mode("append").parquet(root)
    return live.table_stream(d.spark, root, events.schema, 1)


def live_store(d: Dataset, name: str) -> tuple[tables.TableStore, str]:
    root = fresh_folder(d, name)
    return tables.TableStore(d.spark, f"{root}/tables"), root


@query("stream_volume")
def q_stream_volume(d):
    """Buckets of all widths from a stream with late and repeated swaps."""
    store, root = live_store(d, "stream-volume")
    volumes = live.VolumeParts(d.spark, f"{root}/volumes")
    live.LivePipeline(store, volumes=volumes).run_candidate_swaps(
        micro_batches(d, d.swaps(), "volume-in"), f"{root}/checkpoint", once=True)
    return rounded(volumes.read(), 6, "volume", "buy_volume", "sell_volume")


@query("stream_new_token")
def q_stream_new(d):
    """Swaps of a stream and the candidates they make."""
    store, root = live_store(d, "stream-new")
    stream = live.table_stream(d.spark, time_ordered(d, d.swap_events(), "new-in"), d.swap_events().schema, 1)
    live.LivePipeline(store).run(stream, f"{root}/checkpoint", once=True)
    return store.read("token_candidates")


@query("stream_first_seen")
def q_stream_first_seen(d):
    """Candidates of a stream by keyed state that starts from stored ones; the run is restarted halfway."""
    store, root = live_store(d, "stream-seen")
    store.append_unique(d.token_candidates().where("source = 'ACTIVE_TOKEN'"), "token_candidates")
    events = d.swap_events()
    folder = time_ordered(d, events.where("slot % 2 = 0"), "seen-in", 2)
    for more in (None, events.where("slot % 2 = 1")):
        if more is not None:  # late ones, of mints that are known by now or not
            more.coalesce(1).write.mode("append").parquet(folder)
        live.LivePipeline(store).run_first_seen(
            live.table_stream(d.spark, folder, events.schema, 1), f"{root}/checkpoint", once=True)
    return store.read("token_candidates").where("source = 'NEW_TOKEN'")


def time_ordered(d: Dataset, events: DataFrame, name: str, n: int = 4, files: int = 1) -> str:
    """The events in n blocks that follow each other in time, each written as that many files side by side."""
    root = fresh_folder(d, name)
    top = events.agg(F.max("slot")).first()[0] + 1
    for k in range(n):
        inside = (F.col("slot") * n >= k * top) & (F.col("slot") * n < (k + 1) * top)
        block = events.where(inside)
        (block.coalesce(1) if files == 1 else block.repartition(files)).write.mode("append").parquet(root)
    return root


@query("stream_slot_buffer")
def q_stream_buffer(d):
    """All events pass the slot buffer: final ones, late ones, and the head when the run ends."""
    store, root = live_store(d, "stream-buffer")
    buffer = live.SlotBuffer(d.spark, f"{root}/pending", live.RAW_EVENTS)
    live.LivePipeline(store, buffer).run(
        micro_batches(d, d.swap_events(), "buffer-in"), f"{root}/checkpoint", once=True)
    return store.read("swap_events")


@query("live_liquidity_series")
def q_live_liquidity(d):
    """Swaps and liquidity events without ids share one buffer; the series has all that resolves."""
    store, root = live_store(d, "live-series")
    unknown = d.liquidity_events().withColumn("candidate_id", F.lit(None).cast("string"))
    swaps = live.table_stream(d.spark, time_ordered(d, d.swap_events(), "live-swaps"), d.swap_events().schema, 1)
    liquidity = live.table_stream(d.spark, time_ordered(d, unknown, "live-liquidity"), unknown.schema, 1)
    buffer = live.SlotBuffer(d.spark, f"{root}/pending", live.RAW_EVENTS)
    live.LivePipeline(store, buffer).run(swaps, f"{root}/checkpoint", once=True, liquidity=liquidity)
    pipeline.normalise(store)
    return store.read("liquidity_timeseries")


@query("recomputed_series")
def q_recomputed(d):
    """Series of half of the swaps, then all of them: more swaps come at times already stored."""
    store, _ = live_store(d, "recompute")
    store.append_unique(d.token_candidates(), "token_candidates")
    swaps = d.swaps(True)
    half = F.col("slot") % 2 == 0
    store.append_unique(swaps.where(half), "swaps")
    pipeline.normalise(store)
    store.append_unique(swaps.where(~half), "swaps")
    pipeline.normalise(store, "recompute")
    return rounded(store.read("price_timeseries"), 6, "volume")


@query("append_known_keys")
def q_append_known(d):
    """Keys that come again at another slot are found all the same."""
    store, _ = live_store(d, "append-known")
    store.append_unique(d.swap_events().where(F.col("timestamp") < EVAL_AT), "swap_events", "skip")
    store.append_unique(d.swap_events().withColumn("slot", F.col("slot") + 5), "swap_events", "skip")
    return store.read("swap_events")


@query("backfill")
def q_backfill(d):
    """Two overlapping ranges: what is stored of swaps, liquidity events and candidates."""
    store, _ = live_store(d, "backfill")
    live.backfill(store, d.swap_events(), d.liquidity_events(), 0, EVAL_AT)
    live.backfill(store, d.swap_events(), d.liquidity_events(), EVAL_AT - 3 * DAY_MS,
                  EVAL_AT + 3 * DAY_MS)
    none = F.lit(None).cast("string")
    swaps = store.read("swap_events").select(
        F.lit("swap").alias("kind"), none.alias("candidate_id"), "mint", "tx_signature", "event_index",
        "slot", "timestamp", none.alias("what"), F.col("amount_out").alias("amount"))
    liquidity = store.read("liquidity_events").select(
        F.lit("liquidity").alias("kind"), "candidate_id", "mint", "tx_signature", "event_index", "slot",
        "timestamp", F.col("event_type").alias("what"), F.col("amount_quote").alias("amount"))
    found = store.read("token_candidates").select(
        F.lit("candidate").alias("kind"), "candidate_id", "mint", "tx_signature", "event_index", "slot",
        F.col("discovered_at").alias("timestamp"), F.col("source").alias("what"), F.lit(None).cast("double").alias("amount"))
    return swaps.unionByName(liquidity).unionByName(found)


@query("stream_enriched")
def q_stream_enriched(d):
    """Liquidity events get the candidate that their mint has when they arrive."""
    store, root = live_store(d, "stream-enriched")
    store.append_unique(d.token_candidates().where("source = 'ACTIVE_TOKEN'").withColumn(
        "candidate_id", F.concat(F.lit("c"), "mint")), "token_candidates")
    unknown = d.liquidity_events().withColumn("candidate_id", F.lit(None).cast("string"))
    live.LivePipeline(store).run_liquidity(
        micro_batches(d, unknown, "enriched-in"), f"{root}/checkpoint", once=True)
    return store.read("liquidity_events").select("candidate_id", "mint", "tx_signature")


@query("stream_active_token")
def q_stream_active(d):
    """Spikes of four periods of a stream, each at its last event, measured against sums by hour."""
    store, root = live_store(d, "stream-active")
    hours = live.HourParts(d.spark, f"{root}/hours")
    pipe = live.LivePipeline(store, hours=hours, spikes_every_ms=DAY_MS, first_seen=False)
    stream = live.table_stream(d.spark, time_ordered(d, d.swap_events(), "active-in"), d.swap_events().schema, 1)
    pipe.run(stream, f"{root}/checkpoint", once=True)
    return store.read("token_candidates")


def node_logs_of(d: Dataset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What two nodes deliver, and the accounts behind it.

    The first one: AMM swaps of all four discriminators, every third with the native token last,
    and deposits or withdrawals in the same transaction.  The second one: curve trades, every fourth
    without a mint, in transactions that name the AMM program; and every ninth transaction of the first.
    """
    ev = d.swap_events()
    little = F.concat(*[F.substring(F.lpad(F.hex(F.col("slot")), 16, "0"), 2 * i + 1, 2) for i in reversed(range(8))])
    mint = F.concat(F.lit("00" * 31), F.lpad(F.hex(F.col("mint").cast("long") % 57 + 1), 2, "0"))
    native = F.lit(decode._NATIVE_HEX)
    disc = F.element_at(F.array(*[F.lit(x) for x in decode.SWAP_BYTES]), (F.col("slot") % 4 + 1).cast("int"))
    pair = F.when(F.col("slot") % 3 == 0, F.concat(mint, native)).otherwise(F.concat(native, mint))

    def ray(body):
        return F.concat(F.lit("Program log: ray_log: "), F.translate(F.base64(F.unhex(body)), "\r\n", ""))

    change = F.concat(F.when(F.col("slot") % 2 == 0, decode.ADD_BYTE).otherwise(decode.REMOVE_BYTE), little, little)
    common = ["slot", F.expr("timestamp div 1000").alias("block_time_s"), F.lit(None).cast("string").alias("err")]
    keys = [F.lit(f"key{i}") for i in range(18)]
    keys[1] = F.concat(F.lit("pool"), "mint")
    first = ev.select(
        F.concat(F.lit("a"), "tx_signature").alias("tx_signature"), *common,
        F.array(ray(F.concat(disc, F.lit("00" * 32), pair, F.lit("00" * 8), little)), F.lit("noise"), ray(change)).alias("logs"),
        F.array(*keys).alias("account_keys"))
    keys[5], keys[6] = F.lit("native"), F.concat(F.lit("acct"), "mint")
    own = F.when(F.col("slot") % 4 > 0, F.concat(F.lit("Program log: mint=T"), "mint")).otherwise(F.lit("Program log: nothing"))
    second = ev.select(
        F.concat(F.lit("b"), "tx_signature").alias("tx_signature"), *common,
        F.array(F.lit(f"Program {decode.AMM_PROGRAM} invoke [1]"), F.lit(f"Program {decode.CURVE_PROGRAM} invoke [2]"), own,
                F.lit("Program log: Instruction: Sell"), F.lit("Program log: Instruction: Migrate")).alias("logs"),
        F.array(*keys[:7]).alias("account_keys"))
    accounts = ev.select("mint").distinct().select(
        F.concat(F.lit("acct"), "mint").alias("pubkey"),
        F.base64(F.unhex(F.concat(mint, F.lit("00" * 40)))).alias("data"), F.lit(0).cast("long").alias("fetched_at"))
    wrapped = d.spark.range(1).select(F.lit("native").alias("pubkey"), F.base64(F.unhex(native)).alias("data"),
                                      F.lit(0).cast("long").alias("fetched_at"))
    return first, second.unionByName(first.where("slot % 9 = 0")), accounts.unionByName(wrapped)


def all_decoded(swaps: DataFrame, liquidity: DataFrame) -> DataFrame:
    common = ["mint", "pool", "tx_signature", "event_index", "slot", "timestamp"]
    none = F.lit(None).cast("string")
    return swaps.select(*common, none.alias("event_type"), F.col("amount_out").alias("amount")).unionByName(
        liquidity.select(*common, "event_type", F.col("amount_quote").alias("amount")))


@query("stream_decoded")
def q_stream_decoded(d):
    """Logs of two nodes in five micro-batches, decoded in one pass each, through the slot buffer."""
    store, root = live_store(d, "stream-decoded")
    first, second, accounts = node_logs_of(d)
    streams = [live.table_stream(d.spark, time_ordered(d, tx, f"node{i}", 5, FILES), TX_LOGS, FILES) for i, tx in enumerate((first, second))]
    buffer = live.SlotBuffer(d.spark, f"{root}/pending", live.RAW_EVENTS)
    live.LivePipeline(store, buffer, first_seen=False).run_logs(streams, f"{root}/checkpoint", once=True, accounts=accounts)
    return all_decoded(store.read("swap_events"), store.read("liquidity_events"))


@query("decoded_events")
def q_decoded_events(d):
    """The same logs as one table: both kinds of events from one scan."""
    first, second, accounts = node_logs_of(d)
    decoded = decode.events(first.unionByName(second.where("tx_signature like 'b%'")), accounts)
    return all_decoded(decode.complete_swaps(decoded), decode.complete_liquidity(decoded))


@query("compacted_series")
def q_compacted(d):
    """Series that were built three times, after compaction has dropped the older versions."""
    store, _ = live_store(d, "compacted")
    store.append_unique(d.token_candidates(), "token_candidates")
    store.append_unique(d.swaps(True), "swaps")
    for mode in ("skip", "recompute", "recompute"):
        pipeline.normalise(store, mode)
    store.compact("price_timeseries")
    store.compact("swaps")
    series_now = rounded(store.read("price_timeseries"), 6, "volume").withColumn("swaps", F.lit(None).cast("long"))
    swaps = store.read("swaps").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("swaps"))
    return series_now.unionByName(swaps, allowMissingColumns=True)


@query("stream_deduplicated")
def q_stream_dedupe(d):
    """Repeated events are dropped by key, late ones kept."""
    store, root = live_store(d, "stream-dedupe")
    live.LivePipeline(store).run(
        micro_batches(d, d.swap_events(), "dedupe-in"), f"{root}/checkpoint", once=True)
    return store.read("swap_events")


@query("rejected_rules")
def q_rejected_rules(d):
    """Rules that cannot run are named with the reason, one for each candidate of their source."""
    rules = demo_rules() + [exits.rule("MOON_SHOT", "NEW_TOKEN", hold=1), exits.rule(ids.TIME_EXIT, "ACTIVE_TOKEN"),
                            exits.rule(ids.TRAILING_STOP, "NEW_TOKEN", trail=0.1, max_hold=5)]
    refused = exits.rejected_rules(exits.rule_table(d.spark, rules))
    n = d.token_candidates().groupBy(F.col("source").alias("entry_event_type")).agg(F.count("*").alias("candidates"))
    return refused.join(n, "entry_event_type").select("rule_no", "entry_event_type", "strategy_type", "reason", "candidates")
