"""Candidate discovery: first-seen mints and activity spikes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions import ids
from marketlab.functions.timecols import DAY_MS, HOUR_MS, slice_no
from marketlab.operators.joins import salted_join
from marketlab.operators.slices import SLICE, before, slice_window, upto
from marketlab.schemas import ACTIVE_TOKEN, EVENT_ORDER, NEW_TOKEN

CANDIDATE_COLUMNS = ["candidate_id", "source", "mint", "pool", "tx_signature", "event_index",
                     "slot", "discovered_at"]


@dataclass(frozen=True)
class SpikeRule:
    """Fixed spike thresholds: the last hour against the hourly average of the last day."""

    volume: float = 3.0
    swaps: float = 5.0
    liquidity: float = 2.0


def as_candidates(trigger: DataFrame, source: str) -> DataFrame:
    """Candidate rows from trigger events (mint, pool, event order columns, timestamp)."""
    return trigger.withColumn("source", F.lit(source)).select(
        ids.candidate_id().alias("candidate_id"), "source", "mint", "pool", "tx_signature",
        "event_index", "slot", F.col("timestamp").alias("discovered_at"))


def unseen(df: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Rows whose mint has no candidate yet."""
    if candidates is None:
        return df
    return df.join(candidates.select("mint").distinct(), "mint", "left_anti")


def first_swaps(events: DataFrame) -> DataFrame:
    """The first event of every mint in event order, reduced before the shuffle."""
    order = F.struct(*EVENT_ORDER)
    return (
        events.groupBy("mint")
        .agg(F.min_by(F.struct("pool", *EVENT_ORDER, "timestamp"), order).alias("e"))
        .select("mint", "e.*")
    )


def new_tokens(events: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    return as_candidates(unseen(first_swaps(events), candidates), NEW_TOKEN)


def _trigger(cond: Column) -> Column:
    """Latest event under the condition; equal times go to the smallest event order."""
    order = F.struct((-F.col("timestamp")).alias("t"), *EVENT_ORDER)
    return F.min_by(F.struct("pool", *EVENT_ORDER, "timestamp"), F.when(cond, order))


def _hours(history_ms: Column) -> Column:
    """Observed history in hours, at most a day; NULL below one hour."""
    capped = F.least(history_ms, F.lit(DAY_MS))
    return F.when(capped >= HOUR_MS, capped / F.lit(float(HOUR_MS)))


def active_tokens(events: DataFrame, at: Column | int, candidates: DataFrame | None = None,
                  liquidity: DataFrame | None = None, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Spikes at one evaluation time over [at - 24h, at).

    The baseline is the hourly average over the history actually seen in the window.  With
    ``liquidity`` a jump in moved quote amounts counts as well; a swap trigger wins over a
    liquidity trigger.  Only mints with swaps in the window are evaluated.  A row with a column
    ``n`` stands for n events, its timestamp for their first.
    """
    t = F.col("timestamp")
    at = F.lit(at) if isinstance(at, int) else at
    recent = t >= at - HOUR_MS

    def window(df: DataFrame, amount: Column) -> DataFrame:
        n = F.col("n") if "n" in df.columns else F.lit(1)
        return (
            df.where((t >= at - DAY_MS) & (t < at)).groupBy("mint")
            .agg(
                F.sum(amount).alias("v24"), F.sum(F.when(recent, amount)).alias("v1"),
                F.sum(n).alias("n24"), F.coalesce(F.sum(F.when(recent, n)), F.lit(0)).alias("n1"),
                F.first(at).alias("eval"), F.min("timestamp").alias("t0"),
                _trigger(recent).alias("e"))
            .withColumn("hours", _hours(F.col("eval") - F.col("t0")))
        )

    # known mints are removed after the aggregation: one row per mint reaches the join
    s = unseen(window(events, F.col("amount_out")), candidates).withColumn(
        "spike", (F.col("v1") > rule.volume * (F.col("v24") / F.col("hours")))
        | (F.col("n1") > rule.swaps * (F.col("n24") / F.col("hours"))))
    hit = s.select("mint", F.when(F.col("spike"), F.col("e")).alias("e"))
    if liquidity is not None:
        q = window(liquidity.where("mint <> ''"), F.abs("amount_quote")).where(
            F.col("v1") > rule.liquidity * (F.col("v24") / F.col("hours"))
        ).withColumn("e", F.struct(F.coalesce("e.pool", F.lit("")).alias("pool"),
                                   *[f"e.{c}" for c in EVENT_ORDER], "e.timestamp"))
        hit = hit.join(q.select("mint", F.col("e").alias("q")), "mint", "left").select(
            "mint", F.coalesce("e", "q").alias("e"))
    return as_candidates(hit.where("e is not null").select("mint", "e.*"), ACTIVE_TOKEN)


def spike_report(swaps: DataFrame, metadata: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Spike report relative to the latest swap, with a fixed 24-hour divisor.

    The trigger is the last swap by (time, event index).
    """
    now = swaps.agg(F.max("timestamp")).scalar()  # a subquery: the filters reach the scan
    t = F.col("timestamp")
    recent = t >= now - HOUR_MS
    # reduced to one row per candidate before the join with the metadata
    per_candidate = (
        swaps.where((t >= now - DAY_MS) & (t < now))
        .groupBy("candidate_id")
        .agg(
            F.sum(F.when(recent, F.col("amount_out"))).alias("v1"), F.count_if(recent).alias("n1"),
            F.sum("amount_out").alias("v24"), F.count(F.lit(1)).alias("n24"),
            F.max(F.when(recent, F.struct("timestamp", "event_index", "slot", "tx_signature")))
            .alias("e"))
    )
    stats = (
        per_candidate.join(metadata.select("candidate_id", "mint"), "candidate_id")
        .groupBy("mint")
        .agg(
            F.sum("v1").alias("volume_1h"), F.sum("n1").alias("swaps_1h"),
            (F.sum("v24") / 24.0).alias("volume_24h_avg"),
            (F.sum("n24") / 24.0).alias("swaps_24h_avg"), F.max("e").alias("e"))
        .withColumn("volume_spike", F.col("volume_1h") > rule.volume * F.col("volume_24h_avg"))
        .withColumn("swaps_spike", F.col("swaps_1h") > rule.swaps * F.col("swaps_24h_avg"))
        .where("volume_spike or swaps_spike")
    )
    return (
        stats.select("*", "e.*").withColumn("source", F.lit(ACTIVE_TOKEN))
        .withColumn("pool", F.lit(None).cast("string"))
        .select(ids.candidate_id().alias("candidate_id"), "source", "mint", "pool",
                "tx_signature", "event_index", "slot", "timestamp", "volume_1h", "swaps_1h",
                "volume_24h_avg", "swaps_24h_avg", "volume_spike", "swaps_spike")
    )


def new_tokens_by_metadata(swaps: DataFrame, metadata: DataFrame) -> DataFrame:
    """First swap per mint where the mint comes from the metadata table.

    Reduced to one swap per candidate before the join, so the join never sees a hot key.
    """
    order = F.struct(*EVENT_ORDER)
    e = F.struct(*EVENT_ORDER, "timestamp")
    per_candidate = swaps.groupBy("candidate_id").agg(F.min_by(e, order).alias("e"))
    return (
        per_candidate.join(metadata.select("candidate_id", "mint"), "candidate_id")
        .select("mint", "e.*").groupBy("mint").agg(F.min_by(e, order).alias("e"))
        .select("mint", "e.*")
        .withColumn("source", F.lit(NEW_TOKEN)).withColumn("pool", F.lit(None).cast("string"))
        .select(ids.candidate_id().alias("candidate_id"), "source", "mint", "pool",
                "tx_signature", "event_index", "slot", "timestamp")
    )


def undiscovered(spikes: DataFrame, candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Spikes of mints that no stored candidate covers."""
    covered = candidates.select("candidate_id").join(
        metadata.select("candidate_id", "mint"), "candidate_id").select("mint").distinct()
    return spikes.join(covered, "mint", "left_anti").select(
        "candidate_id", "source", "mint", "pool", "tx_signature", "event_index", "slot",
        "timestamp")


def all_discovery(swaps: DataFrame, metadata: DataFrame, candidates: DataFrame) -> DataFrame:
    return new_tokens_by_metadata(swaps, metadata).unionByName(
        undiscovered(spike_report(swaps, metadata), candidates, metadata))


def discovery_validation(candidates: DataFrame, metadata: DataFrame, swaps: DataFrame) -> DataFrame:
    """Recompute every stored candidate id from the first swap of the candidate."""
    order = F.struct(*EVENT_ORDER)
    first = swaps.groupBy("candidate_id").agg(F.min_by(order, order).alias("f"))
    stored = (
        candidates.select("candidate_id", "source", "pool", "slot")
        .join(metadata.select("candidate_id", "mint"), "candidate_id")
        .join(first, "candidate_id", "left")
    )
    computed = ids.candidate_id(tx=F.col("f.tx_signature"), index=F.col("f.event_index"))
    return stored.select(
        F.col("candidate_id").alias("stored_id"), "source", "mint", "pool", "f.tx_signature",
        "f.event_index", "slot", computed.alias("computed_id"),
        (F.col("candidate_id") == computed).alias("id_matches"))


def trailing_windows(events: DataFrame) -> DataFrame:
    """Per event: volume and count over the last hour and day, and the first time of the day.

    Both windows are half open, [t - width, t).  With hour slices, [t - kh, t) is: the part
    of the current slice before t, the k - 1 whole slices before it, and the tail of slice
    -k from t - kh on.  Tails are found by probes sorted among the rows of that slice.  No
    sliding frame is rescanned, no sum is taken as a difference, and no task holds more
    than one slice of a mint.
    """
    keys = ["mint"]
    moments = events.groupBy("mint", F.col("timestamp").alias("t")).agg(
        F.sum("amount_out").alias("v"), F.count(F.lit(1)).alias("n"))
    shifts = F.explode(F.array(F.lit(0), F.lit(1), F.lit(24))).alias("back")
    rows = (
        moments.select("mint", "t", "v", "n", shifts)
        .withColumn("at", F.col("t") - F.col("back") * F.lit(HOUR_MS).cast("long"))
        .withColumn("real", F.col("back") == 0)
        .withColumn("v", F.when(F.col("real"), F.col("v")))
        .withColumn("n", F.when(F.col("real"), F.col("n")))
        .withColumn(SLICE, slice_no("at"))
    )
    own = F.when(F.col("real"), F.col("at"))
    ahead = slice_window(keys, "at", "real")  # probes before rows of the same time
    tail = upto(slice_window(keys, F.col("at").desc(), F.col("real").desc()))
    parts = rows.select(
        "mint", "t", "back", SLICE,
        F.sum("v").over(before(ahead)).alias("hv"), F.sum("n").over(before(ahead)).alias("hn"),
        F.min(own).over(before(ahead)).alias("ht"),
        F.sum("v").over(tail).alias("tv"), F.sum("n").over(tail).alias("tn"),
        F.min(own).over(tail).alias("tt"))

    def pick(back: int, col: str) -> Column:
        return F.max(F.when(F.col("back") == back, F.col(col)))

    edge = parts.groupBy("mint", "t").agg(
        *[pick(0, c).alias(c) for c in ("hv", "hn", "ht")],
        *[pick(1, c).alias(f"{c}1") for c in ("tv", "tn")],
        *[pick(24, c).alias(f"{c}24") for c in ("tv", "tn", "tt")],
    ).withColumn(SLICE, slice_no("t"))
    hours = moments.groupBy("mint", slice_no("t").alias(SLICE)).agg(
        F.sum("v").alias("v"), F.sum("n").alias("n"), F.min("t").alias("t0"))
    day = Window.partitionBy("mint").orderBy(SLICE).rangeBetween(-23, -1)
    whole = hours.select(
        "mint", SLICE, F.sum("v").over(day).alias("wv"), F.sum("n").over(day).alias("wn"),
        F.min("t0").over(day).alias("wt"))

    def total(*cols: str) -> Column:
        zero = F.lit(0)
        out = F.coalesce(F.col(cols[0]), zero)
        for c in cols[1:]:
            out = out + F.coalesce(F.col(c), zero)
        return out

    return edge.join(whole, ["mint", SLICE], "left").select(
        "mint", F.col("t").alias("timestamp"),
        total("hv", "tv1").cast("double").alias("volume_1h"), total("hn", "tn1").alias("swaps_1h"),
        total("hv", "wv", "tv24").cast("double").alias("volume_24h"),
        total("hn", "wn", "tn24").alias("swaps_24h"),
        F.least("ht", "wt", "tt24").alias("first_24h"))


def spike_times(events: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Every event time at which its mint spikes."""
    hours = _hours(F.col("timestamp") - F.col("first_24h"))
    return trailing_windows(events).withColumn("hours", hours).where(
        (F.col("volume_1h") > rule.volume * (F.col("volume_24h") / F.col("hours")))
        | (F.col("swaps_1h") > rule.swaps * (F.col("swaps_24h") / F.col("hours"))))


def first_spikes(events: DataFrame, candidates: DataFrame | None = None,
                 rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Evaluate at every event and keep the first spike per mint, with its trigger event.

    Events of known mints are left out before any window is computed; the join is salted.
    """
    if candidates is not None:
        known = candidates.select("mint").distinct()
        events = salted_join(events, known, "mint", "tx_signature", "left_anti")
    hit = spike_times(events, rule).where("swaps_1h > 0").groupBy("mint").agg(
        F.min("timestamp").alias("eval"))
    t = F.col("timestamp")
    # one hour of each mint: (mint, hour) keys keep the join free of hot keys
    probe = hit.withColumn("_h", F.explode(F.array(
        slice_no("eval") - 1, slice_no("eval"))))
    trigger = (
        events.withColumn("_h", slice_no("timestamp")).join(probe, ["mint", "_h"])
        .where((t >= F.col("eval") - HOUR_MS) & (t < F.col("eval")))
        .groupBy("mint").agg(_trigger(F.lit(True)).alias("e"))
    )
    return as_candidates(trigger.select("mint", "e.*"), ACTIVE_TOKEN)


def replay_discovery(events: DataFrame, start: int | None = None, end: int | None = None,
                     seed: DataFrame | None = None) -> DataFrame:
    """Discovery over [start, end) with known candidates.

    A mint found as new is never reported as active too, and every mint of the range is either
    known from the seed or new in it, so what is reported is what is seen first.
    """
    if start is not None:
        events = events.where(F.col("timestamp") >= start)
    if end is not None:
        events = events.where(F.col("timestamp") < end)
    return new_tokens(events, seed)


def reconcile(replayed: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates present on one side only; empty when the replay reproduces the store."""
    a = replayed.select("candidate_id", F.col("source").alias("replayed_source"))
    b = stored.select("candidate_id", F.col("source").alias("stored_source"))
    return a.join(b, "candidate_id", "full_outer").where(
        "replayed_source is null or stored_source is null")


def is_deterministic(run) -> bool:
    """Run a DataFrame-returning job twice and compare the two results row by row."""
    one, two = run(), run()
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
