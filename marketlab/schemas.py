"""Fixed relation schemas, unique keys and enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(),
          "double": DoubleType(), "array<string>": ArrayType(StringType())}


def _struct(ddl: str) -> StructType:
    """Schema from "name type" pairs, usable before a session exists."""
    pairs = [p.split() for p in ddl.split(",")]
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in pairs])


SWAP_EVENTS = _struct(
    "mint string, pool string, tx_signature string, event_index int, slot long, "
    "timestamp long, amount_out double"
)
SWAPS = _struct(
    "candidate_id string, tx_signature string, event_index int, slot long, timestamp long, "
    "side string, amount_in double, amount_out double, price double"
)
LIQUIDITY_EVENTS = _struct(
    "candidate_id string, pool string, mint string, tx_signature string, event_index int, "
    "slot long, timestamp long, event_type string, amount_token double, amount_quote double, "
    "liquidity_after double"
)
TOKEN_CANDIDATES = _struct(
    "candidate_id string, source string, mint string, pool string, tx_signature string, "
    "event_index int, slot long, discovered_at long"
)
TOKEN_METADATA = _struct(
    "candidate_id string, mint string, name string, symbol string, decimals int, "
    "supply double, fetched_at long"
)
PRICE_TIMESERIES = _struct(
    "candidate_id string, timestamp_ms long, slot long, price double, volume double, swap_count long"
)
LIQUIDITY_TIMESERIES = _struct(
    "candidate_id string, timestamp_ms long, slot long, liquidity double, "
    "liquidity_token double, liquidity_quote double"
)
VOLUME_TIMESERIES = _struct(
    "candidate_id string, timestamp_ms long, interval_seconds int, volume double, "
    "swap_count long, buy_volume double, sell_volume double"
)
DERIVED_FEATURES = _struct(
    "candidate_id string, timestamp_ms long, price_delta double, price_velocity double, "
    "price_acceleration double, liquidity_delta double, liquidity_velocity double, "
    "token_lifetime_ms long, last_swap_interval_ms long, last_liq_event_interval_ms long"
)
TRADE_RECORDS = _struct(
    "trade_id string, candidate_id string, strategy_id string, scenario_id string, "
    "entry_signal_time long, entry_signal_price double, entry_actual_time long, "
    "entry_actual_price double, entry_liquidity double, position_size double, "
    "position_value double, exit_signal_time long, exit_signal_price double, "
    "exit_actual_time long, exit_actual_price double, exit_reason string, "
    "entry_cost_sol double, exit_cost_sol double, mev_cost_sol double, total_cost_sol double, "
    "total_cost_pct double, gross_return double, outcome double, outcome_class string, "
    "hold_duration_ms long, peak_price double, min_liquidity double"
)
STRATEGY_AGGREGATES = _struct(
    "strategy_id string, scenario_id string, entry_event_type string, total_trades long, "
    "total_tokens long, wins long, losses long, win_rate double, token_win_rate double, "
    "outcome_mean double, outcome_median double, outcome_p10 double, outcome_p25 double, "
    "outcome_p75 double, outcome_p90 double, outcome_min double, outcome_max double, "
    "outcome_stddev double, max_drawdown double, max_consecutive_losses long, "
    "outcome_realistic double, outcome_pessimistic double, outcome_degraded double"
)
TX_LOGS = _struct(
    "tx_signature string, slot long, block_time_s long, err string, logs array<string>, "
    "account_keys array<string>"
)
ACCOUNTS = _struct("pubkey string, data string, fetched_at long")

# Unique key of every table; a key part may be an expression.
UNIQUE_KEYS = {
    "swap_events": ["mint", "tx_signature", "event_index"],
    "swaps": ["tx_signature", "candidate_id", "event_index"],
    "liquidity_events": ["tx_signature", "event_index", "coalesce(mint, pool, '')"],
    "token_candidates": ["candidate_id"],
    "token_metadata": ["candidate_id"],
    "price_timeseries": ["candidate_id", "timestamp_ms"],
    "liquidity_timeseries": ["candidate_id", "timestamp_ms"],
    "volume_timeseries": ["candidate_id", "interval_seconds", "timestamp_ms"],
    "derived_features": ["candidate_id", "timestamp_ms"],
    "trade_records": ["trade_id"],
    "strategy_aggregates": ["strategy_id", "scenario_id", "entry_event_type"],
}

# A column that equal keys always share, used to prune the stored table when a batch is
# checked against it: part of the key, or hashed into it.  Slots are neither: the same
# transaction may be reported at another slot, and its key must still be found.
PRUNE_BY = {
    "price_timeseries": "timestamp_ms", "liquidity_timeseries": "timestamp_ms",
    "volume_timeseries": "timestamp_ms", "derived_features": "timestamp_ms",
    "trade_records": "entry_signal_time",
}

# The time of a table's rows in milliseconds: folders are named by its days.
TIME_OF = {
    "swap_events": "timestamp", "swaps": "timestamp", "liquidity_events": "timestamp",
    "token_candidates": "discovered_at", "token_metadata": "fetched_at", **PRUNE_BY,
}

# Columns whose rows are replaced together when a derived table is computed again.
REPLACED_BY = {
    "price_timeseries": ["candidate_id"], "liquidity_timeseries": ["candidate_id"],
    "volume_timeseries": ["candidate_id"], "derived_features": ["candidate_id"],
    "trade_records": ["candidate_id"],
    "strategy_aggregates": ["strategy_id", "scenario_id", "entry_event_type"],
}

EVENT_ORDER = ["slot", "tx_signature", "event_index"]

# Fixed enumeration values.
NEW_TOKEN = "NEW_TOKEN"
ACTIVE_TOKEN = "ACTIVE_TOKEN"
ALLOWED_VALUES = {
    ("token_candidates", "source"): [NEW_TOKEN, ACTIVE_TOKEN],
    ("swaps", "side"): ["buy", "sell"],
    ("liquidity_events", "event_type"): ["add", "remove"],
    ("trade_records", "outcome_class"): ["WIN", "LOSS"],
}

TABLES = {
    "swap_events": SWAP_EVENTS,
    "swaps": SWAPS,
    "liquidity_events": LIQUIDITY_EVENTS,
    "token_candidates": TOKEN_CANDIDATES,
    "token_metadata": TOKEN_METADATA,
    "price_timeseries": PRICE_TIMESERIES,
    "liquidity_timeseries": LIQUIDITY_TIMESERIES,
    "volume_timeseries": VOLUME_TIMESERIES,
    "derived_features": DERIVED_FEATURES,
    "trade_records": TRADE_RECORDS,
    "strategy_aggregates": STRATEGY_AGGREGATES,
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project to the schema: known columns cast, missing ones NULL, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def check_enums(df: DataFrame, table: str) -> DataFrame:
    """Rows that break an enumeration constraint, with the offending column named."""
    rules = [(c, vals) for (t, c), vals in ALLOWED_VALUES.items() if t == table]
    reason = F.coalesce(
        *[F.when(~F.coalesce(F.col(c).isin(vals), F.lit(False)), F.lit(c)) for c, vals in rules],
        F.lit(None).cast("string"),
    )
    return df.withColumn("reason", reason).where("reason is not null")
