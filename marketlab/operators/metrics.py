"""Outcome metrics per (rule family, scenario, entry type) and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions import ids
from marketlab.functions.costs import SCENARIO_IDS
from marketlab.operators.folds import drawdown_and_streak
from marketlab.operators.quantiles import exact_quantiles
from marketlab.schemas import ACTIVE_TOKEN, NEW_TOKEN, STRATEGY_AGGREGATES
from marketlab.session import materialize

KEYS = ["strategy_id", "scenario_id", "entry_event_type"]
PROBS = {"outcome_p10": 0.10, "outcome_p25": 0.25, "outcome_median": 0.50,
         "outcome_p75": 0.75, "outcome_p90": 0.90}


def with_source(trades: DataFrame, candidates: DataFrame) -> DataFrame:
    """Trades with the source of their candidate; NULL where the candidate is missing."""
    return trades.join(
        candidates.select("candidate_id", F.col("source").alias("entry_event_type")),
        "candidate_id", "left")


def missing_candidates(trades: DataFrame, candidates: DataFrame) -> DataFrame:
    """Trades that no stored candidate explains, counted per candidate id."""
    return trades.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("trades")).join(
        candidates.select("candidate_id"), "candidate_id", "left_anti")


def classified(trades: DataFrame, candidates: DataFrame) -> DataFrame:
    """Trades ready for grouping: canonical family, scenario, entry type."""
    return (
        with_source(trades, candidates).where("entry_event_type is not null")
        .withColumn("strategy_id", ids.canonical_type())
        .select(*KEYS, "candidate_id", "trade_id", "entry_signal_time", "outcome",
                "outcome_class")
    )


def token_outcomes(grouped: DataFrame) -> DataFrame:
    """Per (group, candidate): count, sums and extremes; the unit of token-level rates."""
    x = F.col("outcome")
    return grouped.groupBy(*KEYS, "candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome_class") == "WIN").alias("wins"),
        F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"),
        F.min(x).alias("low"), F.max(x).alias("high"))


def basic_metrics(grouped: DataFrame) -> DataFrame:
    """Counts, rates, mean, extremes and sample deviation, in one pass over the trades.

    Deviations are merged from per-token parts (mean and variance), which is exact and
    needs no second pass over the trades.
    """
    t = token_outcomes(grouped)
    n, c = F.sum("n"), F.col
    merged = t.groupBy(*KEYS).agg(
        n.alias("total_trades"), F.count(F.lit(1)).alias("total_tokens"),
        F.sum("wins").alias("wins"), F.count_if(c("mean") > 0).alias("good"),
        (F.sum("total") / n).alias("outcome_mean"), F.min("low").alias("outcome_min"),
        F.max("high").alias("outcome_max"),
        F.sum(c("n") * c("var")).alias("within"),
        F.sum(c("n") * c("mean")).alias("m1"), F.sum(c("n") * c("mean") * c("mean")).alias("m2"))
    between = c("m2") - c("m1") * c("m1") / c("total_trades")
    ss = F.greatest(c("within") + between, F.lit(0.0))
    return merged.select(
        *KEYS, "total_trades", "total_tokens", "wins",
        (c("total_trades") - c("wins")).alias("losses"),
        (c("wins") / c("total_trades")).alias("win_rate"),
        (c("good") / c("total_tokens")).alias("token_win_rate"),
        "outcome_mean", "outcome_min", "outcome_max",
        F.when(c("total_trades") > 1, F.sqrt(ss / (c("total_trades") - 1))).otherwise(0.0)
        .alias("outcome_stddev"))


def strategy_aggregates(trades: DataFrame, candidates: DataFrame, stage=materialize) -> DataFrame:
    """The full aggregate table.

    The narrow classified trades are staged once and read by three aggregations: token-level
    sums, rank selection, and the ordered fold.  Trade ids are most of their bytes and move packed.
    """
    grouped = stage(classified(trades.withColumn("trade_id", ids.packed("trade_id")), candidates), "classified-trades")
    out = (
        basic_metrics(grouped)
        .join(exact_quantiles(grouped, KEYS, "outcome", PROBS), KEYS)
        .join(drawdown_and_streak(grouped, KEYS), KEYS)
    )

    def own(scenario: str) -> Column:
        return F.when(F.col("scenario_id") == scenario, F.col("outcome_mean"))

    return out.withColumns({
        "outcome_realistic": own("realistic"), "outcome_pessimistic": own("pessimistic"),
        "outcome_degraded": own("degraded"),
    }).select(*STRATEGY_AGGREGATES.names)


# --- reports over the aggregate table (a few rows per rule family) ------------------------

def scenario_sensitivity(aggregates: DataFrame) -> DataFrame:
    """Medians side by side per scenario; loss of the median from realistic to pessimistic."""
    wide = (
        aggregates.groupBy("strategy_id", "entry_event_type").pivot("scenario_id", SCENARIO_IDS)
        .agg(F.first("outcome_median"))
    )
    med = {s: F.coalesce(F.col(s), F.lit(0.0)) for s in SCENARIO_IDS}
    return wide.select(
        "strategy_id", "entry_event_type", *[med[s].alias(f"{s}_median") for s in SCENARIO_IDS],
        F.when(med["realistic"] != 0,
               (med["realistic"] - med["pessimistic"]) / med["realistic"] * 100)
        .otherwise(0.0).alias("degradation_pct"))


def source_comparison(aggregates: DataFrame) -> DataFrame:
    """New against active candidates under the realistic scenario."""
    def of(source: str, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("entry_event_type") == source, F.col(col))),
                          F.lit(0.0))

    return (
        aggregates.where(F.col("scenario_id") == "realistic").groupBy("strategy_id", "scenario_id")
        .agg(of(NEW_TOKEN, "win_rate").alias("new_token_win_rate"),
             of(ACTIVE_TOKEN, "win_rate").alias("active_token_win_rate"),
             of(NEW_TOKEN, "outcome_median").alias("new_token_median"),
             of(ACTIVE_TOKEN, "outcome_median").alias("active_token_median"))
        .withColumn("delta_win_rate", F.col("new_token_win_rate") - F.col("active_token_win_rate"))
        .withColumn("delta_median", F.col("new_token_median") - F.col("active_token_median"))
    )


def data_summary(candidates: DataFrame, trades: DataFrame) -> DataFrame:
    """One row: candidates by source, distinct trades, range of discovery times."""
    def of(source: str) -> Column:
        return F.count_if(F.col("source") == source)

    known = candidates.where(F.col("source").isin(NEW_TOKEN, ACTIVE_TOKEN)).agg(
        F.count(F.lit(1)).alias("total_candidates"), of(NEW_TOKEN).alias("new_token_candidates"),
        of(ACTIVE_TOKEN).alias("active_token_candidates"),
        F.coalesce(F.min("discovered_at"), F.lit(0)).alias("date_range_start"),
        F.coalesce(F.max("discovered_at"), F.lit(0)).alias("date_range_end"))
    n = trades.select(ids.packed("trade_id").alias("trade_id")).distinct().agg(F.count(F.lit(1)).alias("total_trades"))
    return known.crossJoin(F.broadcast(n))  # one row each


def strategy_counts(aggregates: DataFrame) -> DataFrame:
    return aggregates.agg(F.countDistinct("strategy_id").alias("strategies"),
                          F.countDistinct("scenario_id").alias("scenarios"))


def replay_references(aggregates: DataFrame, trades: DataFrame) -> DataFrame:
    """Candidates behind every aggregate; trades are matched by their rule family."""
    pairs = aggregates.select("strategy_id", "scenario_id").distinct()
    t = trades.select(ids.canonical_type().alias("strategy_id"), "scenario_id",
                      "candidate_id").distinct()
    return t.join(pairs, ["strategy_id", "scenario_id"])


def grouping_levels(trades: DataFrame, candidates: DataFrame) -> DataFrame:
    """Trade counts, win rate and mean on three levels of the grouping hierarchy.

    The finest level is aggregated first; the coarser ones are sums over that small table.
    """
    fine = classified(trades, candidates).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome_class") == "WIN").alias("w"),
        F.sum("outcome").alias("s"))
    spec = [[F.col(k) for k in KEYS[:i]] for i in (3, 2, 1)]
    return fine.groupingSets(spec, *KEYS).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("total_trades"),
        (F.sum("w") / F.sum("n")).alias("win_rate"), (F.sum("s") / F.sum("n")).alias("outcome_mean"))


def metric_matrix(aggregates: DataFrame, metrics=("win_rate", "outcome_mean", "outcome_median",
                                                  "max_drawdown")) -> DataFrame:
    """One row per (rule family, entry type, metric) with a column per scenario."""
    long = aggregates.select(*KEYS, *metrics).unpivot(KEYS, list(metrics), "metric", "value")
    return long.groupBy("strategy_id", "entry_event_type", "metric").pivot(
        "scenario_id", SCENARIO_IDS).agg(F.first("value"))


def strategy_rank(aggregates: DataFrame) -> DataFrame:
    """Rank per entry type under the realistic scenario: median, win rate, drawdown."""
    w = Window.partitionBy("entry_event_type").orderBy(
        F.desc("outcome_median"), F.desc("win_rate"), F.asc("max_drawdown"), "strategy_id")
    return (
        aggregates.where(F.col("scenario_id") == "realistic")
        .withColumn("rank", F.row_number().over(w))
        .select("entry_event_type", "rank", "strategy_id", "outcome_median", "win_rate",
                "max_drawdown")
    )


def best_strategies(aggregates: DataFrame, n: int = 10) -> DataFrame:
    """The top realistic families by median outcome."""
    return (
        aggregates.where(F.col("scenario_id") == "realistic")
        .orderBy(F.desc("outcome_median"), "strategy_id", "entry_event_type").limit(n)
    )


def scenario_gap(aggregates: DataFrame) -> DataFrame:
    """Realistic and pessimistic rows side by side."""
    r = aggregates.where(F.col("scenario_id") == "realistic").select(
        "strategy_id", "entry_event_type", F.col("outcome_mean").alias("realistic_mean"),
        F.col("outcome_median").alias("realistic_median"))
    p = aggregates.where(F.col("scenario_id") == "pessimistic").select(
        "strategy_id", "entry_event_type", F.col("outcome_mean").alias("pessimistic_mean"),
        F.col("outcome_median").alias("pessimistic_median"))
    return r.join(p, ["strategy_id", "entry_event_type"])


def trade_metrics(trades: DataFrame, keys=("strategy_id", "scenario_id")) -> DataFrame:
    """Win rate and outcome distribution straight from the trades, per exact strategy id."""
    keys = list(keys)
    probs = {"p10": 0.10, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.90}
    x, n = F.col("outcome"), F.count(F.lit(1))
    m = trades.groupBy(*keys).agg(
        n.alias("trades"), F.count_if(x > 0).alias("wins"),
        (F.count_if(x > 0) / n).alias("win_rate"), F.avg(x).alias("outcome_mean"),
        F.min(x).alias("outcome_min"), F.max(x).alias("outcome_max"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("outcome_stddev"))
    return m.join(exact_quantiles(trades, keys, "outcome", probs), keys)


def run_statistics(candidates: DataFrame, trades: DataFrame, aggregates: DataFrame,
                   rejected: DataFrame) -> DataFrame:
    """One row with the sizes of all stages."""
    out = None
    for name, df in (("candidates", candidates), ("trades", trades),
                     ("aggregates", aggregates), ("errors", rejected)):
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out
