"""Stored trades against recomputed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions import costs
from marketlab.operators import exits
from marketlab.schemas import TRADE_RECORDS
from marketlab.session import materialize

TOLERANCE = 1e-7  # fixed tolerance for doubles


def _differs(field, a: Column, b: Column) -> Column:
    if field.dataType.typeName() == "double":
        both = a.isNotNull() & b.isNotNull()
        return F.when(both, F.abs(a - b) > TOLERANCE).otherwise(a.isNull() != b.isNull())
    return ~a.eqNullSafe(b)


def trade_diff(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """One row per differing field of trades present on both sides; NULL equals NULL only."""
    fields = [f for f in TRADE_RECORDS.fields if f.name != "trade_id"]
    both = stored.select("trade_id", F.struct(*[f.name for f in fields]).alias("s")).join(
        replayed.select("trade_id", F.struct(*[f.name for f in fields]).alias("r")), "trade_id")
    marks = F.array_compact(F.array(*[
        F.when(_differs(f, F.col(f"s.{f.name}"), F.col(f"r.{f.name}")), F.struct(
            F.lit(f.name).alias("field"), F.col(f"s.{f.name}").cast("string").alias("stored"),
            F.col(f"r.{f.name}").cast("string").alias("replayed"))) for f in fields]))
    return both.select("trade_id", F.explode(marks).alias("d")).select("trade_id", "d.*")


def error_rows(stored: DataFrame, candidates: DataFrame, evaluated: DataFrame,
               rules: DataFrame, scenario_table: DataFrame) -> DataFrame:
    """Stored trades that cannot be recomputed, with the reason."""
    known = F.broadcast(rules.select("strategy_id", F.col("entry_event_type").alias("wanted")))
    scen = F.broadcast(scenario_table.select("scenario_id", F.lit(True).alias("has_scenario")))
    why = evaluated.select("candidate_id", "strategy_id", "reason")
    reason = (
        F.when(F.col("source").isNull(), "candidate not found")
        .when(F.col("wanted").isNull(), F.concat(F.lit("unknown strategy ID: "), "strategy_id"))
        .when((F.col("wanted") != "") & (F.col("wanted") != F.col("source")),
              "candidate source does not match strategy entry type")
        .when(F.col("has_scenario").isNull(), F.concat(F.lit("unknown scenario ID: "), "scenario_id"))
        .otherwise(F.col("reason"))
    )
    return (
        stored.select("trade_id", "candidate_id", "strategy_id", "scenario_id")
        .join(candidates.select("candidate_id", "source"), "candidate_id", "left")
        .join(known, "strategy_id", "left").join(scen, "scenario_id", "left")
        .join(why, ["candidate_id", "strategy_id"], "left")
        .select("trade_id", reason.alias("error")).where("error is not null")
    )


def verify(stored: DataFrame, candidates: DataFrame, price: DataFrame, liquidity: DataFrame,
           rules: list[tuple], scenario_rows=None) -> DataFrame:
    """Recompute every stored trade and list the divergences (field ``Error`` if impossible)."""
    spark = stored.sparkSession
    asked = stored.select("candidate_id").distinct()
    known = candidates.join(asked, "candidate_id", "left_semi")
    evaluated = materialize(exits.evaluate(known, price, liquidity, rules), "verify-exits")
    scen = costs.scenarios(spark, scenario_rows)
    replayed = costs.trade_columns(exits.exits(evaluated), scen)
    errors = error_rows(stored, candidates, evaluated, exits.rule_table(spark, rules), scen)
    return trade_diff(stored, replayed).unionByName(
        errors.select("trade_id", F.lit("Error").alias("field"),
                      F.lit(None).cast("string").alias("stored"), F.col("error").alias("replayed")))


def verification_summary(stored: DataFrame, divergences: DataFrame) -> DataFrame:
    total = stored.agg(F.count(F.lit(1)).alias("total_trades"))
    bad = divergences.select("trade_id").distinct().agg(F.count(F.lit(1)).alias("divergent_trades"))
    return total.crossJoin(F.broadcast(bad)).select(
        "total_trades", (F.col("total_trades") - F.col("divergent_trades")).alias("matched_trades"),
        "divergent_trades")
