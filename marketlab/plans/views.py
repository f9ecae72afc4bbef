"""Temporary SQL views with the fixed names and columns of the analytics schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.operators import discovery, features, series


def create_feature_views(price: DataFrame, liquidity: DataFrame) -> list[str]:
    """Views over the two series; every view is a lazy definition."""
    life = series.lifecycle(price).select(
        "candidate_id", F.col("first_ts").alias("first_swap_ts"),
        F.col("last_ts").alias("last_swap_ts"), "total_lifetime_ms",
        F.col("total_points").alias("total_swaps"))
    liq_life = series.lifecycle(liquidity).select(
        "candidate_id", F.col("first_ts").alias("first_liq_event_ts"),
        F.col("last_ts").alias("last_liq_event_ts"),
        F.col("total_points").alias("total_liq_events"))
    return _create({
        "price_timeseries": price,
        "liquidity_timeseries": liquidity,
        "v_price_derivatives": features.price_derivatives(price),
        "v_price_acceleration": features.price_acceleration(price),
        "v_liquidity_derivatives": features.liquidity_derivatives(liquidity),
        "v_token_lifecycle": life,
        "v_token_lifecycle_liquidity": liq_life,
        "v_last_swap_interval": features.last_swap_interval(price),
        "v_last_liq_event_interval": features.last_liq_event_interval(liquidity),
        "v_derived_features_computed": features.derived_features(price, liquidity, "exact"),
        "v_feature_validation": features.feature_validation(price),
    })


def create_discovery_views(swaps: DataFrame, metadata: DataFrame, candidates: DataFrame) -> list[str]:
    spikes = discovery.spike_report(swaps, metadata)
    return _create({
        "swaps": swaps,
        "token_metadata": metadata,
        "token_candidates": candidates,
        "v_new_token_candidates": discovery.new_tokens_by_metadata(swaps, metadata),
        "v_active_token_spike_detection": spikes,
        "v_active_token_candidates": discovery.undiscovered(spikes, candidates, metadata),
        "v_all_discovery_candidates": discovery.all_discovery(swaps, metadata, candidates),
        "v_discovery_validation": discovery.discovery_validation(candidates, metadata, swaps),
    })


def create_result_views(trades: DataFrame, aggregates: DataFrame) -> list[str]:
    """Trades and aggregates for ad-hoc metric SQL."""
    return _create({"trade_records": trades, "strategy_aggregates": aggregates})


def _create(named: dict[str, DataFrame]) -> list[str]:
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return list(named)
