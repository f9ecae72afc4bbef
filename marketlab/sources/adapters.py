"""Domain relations over the generic test tables (`events`, `lineitem`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions.timecols import DAY_MS, epoch_ms


class Dataset:
    """Domain relations read from one folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str, hot: bool = False):
        """With ``hot`` a third of the users are one and the same key."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.hot = hot

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def events(self, coarse: bool = False) -> DataFrame:
        ms = epoch_ms("ts")
        if coarse:
            ms = F.floor(ms / DAY_MS) * DAY_MS
        key = F.col("user_id").cast("string")
        if self.hot:
            key = F.when(F.col("user_id") % 3 == 0, "hot").otherwise(key)
        return self.table("events").select(
            key.alias("key"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("tx_signature"),
            F.lit(0).alias("event_index"),
            F.col("event_id").alias("slot"),
            ms.cast("long").alias("timestamp"),
            "event_type",
            "value",
            "user_id",
        )

    def swap_events(self) -> DataFrame:
        return self.events().select(
            F.col("key").alias("mint"), F.lit(None).cast("string").alias("pool"),
            "tx_signature", "event_index", "slot", "timestamp", F.col("value").alias("amount_out"))

    def swaps(self, coarse: bool = False) -> DataFrame:
        return (
            self.events(coarse)
            .where(F.col("event_type").isin("click", "view", "purchase"))
            .select(
                F.col("key").alias("candidate_id"), "tx_signature", "event_index", "slot",
                "timestamp",
                F.when(F.col("event_type") == "view", "sell").otherwise("buy").alias("side"),
                F.lit(1.0).alias("amount_in"), F.col("value").alias("amount_out"),
                F.col("value").alias("price"))
        )

    def swaps_wide(self) -> DataFrame:
        """Day-grain swaps with many equal timestamps, from `lineitem`."""
        return self.table("lineitem").select(
            F.col("l_partkey").cast("string").alias("candidate_id"),
            F.col("l_orderkey").cast("string").alias("tx_signature"),
            F.col("l_linenumber").cast("int").alias("event_index"),
            F.col("l_orderkey").alias("slot"),
            F.expr("cast(unix_date(cast(l_shipdate as date)) as long)"
                   f" * {DAY_MS}").alias("timestamp"),
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
            F.lit(1.0).alias("amount_in"),
            F.col("l_quantity").cast("double").alias("amount_out"),
            (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double"))
            .alias("price"))

    def liquidity_events(self, coarse: bool = False) -> DataFrame:
        return (
            self.events(coarse)
            .where(F.col("event_type").isin("signup", "error"))
            .select(
                F.col("key").alias("candidate_id"), F.lit(None).cast("string").alias("pool"),
                F.col("key").alias("mint"), "tx_signature", "event_index", "slot", "timestamp",
                F.when(F.col("event_type") == "signup", "add").otherwise("remove")
                .alias("event_type"),
                F.col("value").alias("amount_token"), F.col("value").alias("amount_quote"),
                F.col("value").alias("liquidity_after"))
        )

    def token_candidates(self) -> DataFrame:
        """One per user; discovered five days after its first event."""
        first = (
            self.events().groupBy("user_id", "key")
            .agg(F.min("timestamp").alias("first_ms"), F.min("slot").alias("slot"))
        )
        return first.select(
            F.col("key").alias("candidate_id"),
            F.when(F.col("user_id") % 3 == 0, "ACTIVE_TOKEN").otherwise("NEW_TOKEN")
            .alias("source"),
            F.col("key").alias("mint"), F.lit(None).cast("string").alias("pool"),
            F.lpad(F.col("slot").cast("string"), 12, "0").alias("tx_signature"),
            F.lit(0).alias("event_index"), "slot",
            (F.col("first_ms") + 5 * DAY_MS).alias("discovered_at"))

    def token_metadata(self) -> DataFrame:
        """One row per user and event day: repeated snapshots of the same mint."""
        return (
            self.events(coarse=True).groupBy("key", "timestamp")
            .agg(F.count("*").alias("n"), F.max("value").alias("supply"))
            .select(
                F.concat_ws("-", "key", F.col("timestamp").cast("string")).alias("candidate_id"),
                F.col("key").alias("mint"), F.concat(F.lit("Token "), "key").alias("name"),
                F.concat(F.lit("T"), "key").alias("symbol"),
                F.col("n").cast("int").alias("decimals"), "supply",
                F.col("timestamp").alias("fetched_at"))
        )
