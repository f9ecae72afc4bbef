"""GO / NO-GO verdicts from the aggregate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.operators.metrics import best_strategies
from marketlab.operators.quality import all_pass

GO, NO_GO, INSUFFICIENT = "GO", "NO-GO", "INSUFFICIENT_DATA"


def decision_inputs(aggregates: DataFrame, implementable: DataFrame | None = None) -> DataFrame:
    """One row per (rule family, entry type) that has a realistic aggregate.

    ``implementable(strategy_id, entry_event_type)`` lists what can really be traded; by
    default every family that produced trades.  A missing pessimistic row stays NULL.
    """
    keys = ["strategy_id", "entry_event_type"]

    def of(scenario: str, col: str) -> Column:
        return F.max(F.when(F.col("scenario_id") == scenario, F.col(col)))

    names = ["outcome_p10", "outcome_p25", "outcome_p75", "outcome_p90"]
    rows = aggregates.groupBy(*keys).agg(
        (of("realistic", "token_win_rate") * 100).alias("positive_outcome_pct"),
        of("realistic", "outcome_mean").alias("realistic_mean"),
        of("realistic", "outcome_median").alias("realistic_median"),
        of("pessimistic", "outcome_mean").alias("pessimistic_mean"),
        of("pessimistic", "outcome_median").alias("pessimistic_median"),
        F.coalesce(of("degraded", "outcome_mean"), F.lit(0.0)).alias("degraded_mean"),
        *[of("realistic", n).alias(n) for n in names],
    ).where("realistic_median is not null")
    if implementable is None:
        return rows.withColumn("implementable", F.lit(True))
    marks = implementable.select(*keys).distinct().withColumn("implementable", F.lit(True))
    return rows.join(marks, keys, "left").withColumn(
        "implementable", F.coalesce("implementable", F.lit(False)))


def invalid_inputs(inputs: DataFrame) -> DataFrame:
    pct = F.col("positive_outcome_pct")
    reason = (
        F.when(F.col("strategy_id") == "", "strategy_id is empty")
        .when(pct < 0, "positive_outcome_pct cannot be negative")
        .when(pct > 100, "positive_outcome_pct cannot exceed 100")
    )
    return inputs.withColumn("reason", reason).where("reason is not null")


def decide(inputs: DataFrame) -> DataFrame:
    """Five criteria that must all hold, four triggers of which none may fire."""
    pct, med = F.col("positive_outcome_pct"), F.col("realistic_median")
    pess, p25, can = F.col("pessimistic_median"), F.col("outcome_p25"), F.col("implementable")
    checks = {
        "go_positive": pct >= 5.0,
        "go_median": med > 0,
        "go_stable": F.when(med > 0, (pess > 0) & (pess / med >= 0.5)).otherwise(False),
        "go_not_outliers": p25 > 0,
        "go_implementable": can,
        "nogo_low_positive": pct < 5.0,
        "nogo_median": med <= 0,
        "nogo_edge_gone": (med > 0) & (pess <= 0),
        "nogo_not_implementable": ~can,
    }
    flags = {n: F.coalesce(e, F.lit(False)) for n, e in checks.items()}
    passed, fired = F.lit(True), F.lit(False)
    for n in flags:
        if n.startswith("go_"):
            passed = passed & F.col(n)
        else:
            fired = fired | F.col(n)
    return inputs.withColumns(flags).withColumn(
        "verdict", F.when(pess.isNull(), INSUFFICIENT).when(passed & ~fired, GO).otherwise(NO_GO))


def criteria_rows(decided: DataFrame) -> DataFrame:
    """One row per criterion or trigger, ``pass`` meaning met (or not fired)."""
    names = [c for c in decided.columns if c.startswith(("go_", "nogo_"))]
    return decided.unpivot(["strategy_id", "entry_event_type"], names, "criterion", "flag").select(
        "strategy_id", "entry_event_type", "criterion",
        F.when(F.col("criterion").startswith("nogo_"), ~F.col("flag")).otherwise(F.col("flag"))
        .alias("pass"))


def best_verdict(decided: DataFrame, aggregates: DataFrame) -> DataFrame:
    """The verdict of the best realistic family."""
    top = best_strategies(aggregates, 1).select("strategy_id", "entry_event_type",
                                                "outcome_median", "win_rate")
    return top.join(decided.select("strategy_id", "entry_event_type", "verdict"),
                    ["strategy_id", "entry_event_type"])


def executive_summary(decided: DataFrame, aggregates: DataFrame, checks: DataFrame,
                      summary: DataFrame) -> DataFrame:
    """One row: data size, state of the checks, best family and overall verdict.

    Failed checks, or any family without its pessimistic aggregate, override the verdict.
    """
    best = best_verdict(decided, aggregates)
    gaps = decided.agg(F.coalesce(F.bool_or(F.col("verdict") == INSUFFICIENT), F.lit(True))
                       .alias("incomplete"))
    return (
        summary.crossJoin(F.broadcast(all_pass(checks))).crossJoin(F.broadcast(gaps))
        .join(F.broadcast(best), F.lit(True), "left")
        .withColumn("overall", F.when(~F.col("all_pass") | F.col("incomplete"), INSUFFICIENT)
                    .otherwise(F.col("verdict")))
        .drop("incomplete")
    )
