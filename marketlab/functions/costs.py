"""Execution-cost scenarios and the trade columns they produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions import ids
from marketlab.schemas import TRADE_RECORDS

# Fixed scenario values: id, delay ms, slippage %, fee, priority fee, MEV penalty %.
SCENARIOS = [
    ("optimistic", 100, 0.5, 0.000005, 0.0, 0.0),
    ("realistic", 500, 2.0, 0.00001, 0.0001, 1.0),
    ("pessimistic", 2000, 5.0, 0.0001, 0.001, 3.0),
    ("degraded", 5000, 10.0, 0.001, 0.01, 5.0),
]
SCENARIO_IDS = [s[0] for s in SCENARIOS]
_COLUMNS = ["scenario_id", "delay_ms", "slippage_pct", "fee_sol", "priority_fee_sol",
            "mev_penalty_pct"]


def inline_table(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A literal relation whose size the optimizer knows, so it is broadcast by itself."""
    def lit(v, kind: str) -> str:
        return f"CAST({'NULL' if v is None else repr(v)} AS {kind})"

    values = ", ".join(
        "(" + ", ".join(lit(v, k) for v, k in zip(r, columns.values())) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def scenarios(spark: SparkSession, rows=None) -> DataFrame:
    kinds = ["string", "bigint", "double", "double", "double", "double"]
    return inline_table(spark, dict(zip(_COLUMNS, kinds)), rows or SCENARIOS)


def trade_columns(exits: DataFrame, scenario_table: DataFrame) -> DataFrame:
    """Trade records: every exit under every scenario.

    Both legs pay fee and priority fee, the price moves by half the slippage per leg, and
    the MEV penalty is a share of the position value.
    """
    one = F.lit(1.0)
    c = F.col

    def with_actual(df: DataFrame, leg: str, sign: int) -> DataFrame:
        half = c("slippage_pct") / 200
        price: Column = c(f"{leg}_signal_price") * ((1 + half) if sign > 0 else (1 - half))
        return (
            df.withColumn(f"{leg}_actual_time", c(f"{leg}_signal_time") + c("delay_ms"))
            .withColumn(f"{leg}_actual_price", price)
            .withColumn(f"{leg}_cost_sol", c("fee_sol") + c("priority_fee_sol"))
        )

    out = exits.crossJoin(scenario_table)
    out = with_actual(with_actual(out, "entry", 1), "exit", -1)
    out = (
        out.withColumn("position_size", one)
        .withColumn("position_value", c("entry_actual_price") * one)
        .withColumn("mev_cost_sol", c("position_value") * (c("mev_penalty_pct") / 100))
        .withColumn("total_cost_sol", c("entry_cost_sol") + c("exit_cost_sol") + c("mev_cost_sol"))
        .withColumn("total_cost_pct", c("total_cost_sol") / c("position_value"))
        .withColumn("gross_return", (c("exit_actual_price") - c("entry_actual_price"))
                    / c("entry_actual_price"))
        .withColumn("outcome", c("gross_return") - c("total_cost_pct"))
        .withColumn("outcome_class", F.when(c("outcome") > 0, "WIN").otherwise("LOSS"))
        .withColumn("hold_duration_ms", c("exit_actual_time") - c("entry_actual_time"))
        .withColumn("trade_id", ids.trade_id())
    )
    return out.select(*TRADE_RECORDS.names)
