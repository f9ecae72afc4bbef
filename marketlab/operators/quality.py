"""Data sufficiency checks and dataset fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions.timecols import DAY_MS
from marketlab.operators import ordering
from marketlab.schemas import ACTIVE_TOKEN, NEW_TOKEN

# Fixed thresholds of the checks.
MIN_NEW_CANDIDATES = 300
MIN_RUN_DAYS = 7
MIN_COVERAGE_DAYS = 14


def _check(df: DataFrame, no: int, name: str, threshold: str, actual: Column,
           ok: Column) -> DataFrame:
    return df.select(F.lit(no).alias("check_no"), F.lit(name).alias("name"),
                     F.lit(threshold).alias("threshold"), actual.alias("actual"),
                     F.coalesce(ok, F.lit(False)).alias("pass"))


def _known(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("source").isin(NEW_TOKEN, ACTIVE_TOKEN))


def new_candidates(candidates: DataFrame) -> DataFrame:
    n = candidates.agg(F.count_if(F.col("source") == NEW_TOKEN).alias("n"))
    return _check(n, 1, "Unique NEW_TOKEN candidates", f">= {MIN_NEW_CANDIDATES}",
                  F.col("n").cast("double"), F.col("n") >= MIN_NEW_CANDIDATES)


def discovery_days(candidates: DataFrame) -> DataFrame:
    """Longest run of consecutive days with a discovery."""
    best = ordering.day_runs(_known(candidates), "discovered_at").agg(
        F.coalesce(F.max("days"), F.lit(0)).alias("n"))
    return _check(best, 2, "Discovery uptime", f">= {MIN_RUN_DAYS} days (continuous)",
                  F.col("n").cast("double"), F.col("n") >= MIN_RUN_DAYS)


def event_summary(events: DataFrame) -> DataFrame:
    """One row per candidate: times of its first and last event, and whether two share a position.

    One pass over the events, combined before the shuffle by position, so no task holds a
    candidate; all checks of raw events read this.
    """
    at = events.groupBy("candidate_id", *ordering.EVENT_ORDER).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return at.groupBy("candidate_id").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max("n") > 1).alias("ambiguous"))


def series_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("candidate_id").agg(
        F.min("timestamp_ms").alias("lo"), F.max("timestamp_ms").alias("hi"))


def coverage(price: DataFrame, liquidity: DataFrame, swaps: DataFrame,
             liquidity_events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Days covered by the series; the raw events of candidates where there are none."""
    return _coverage(series_summary(price), series_summary(liquidity), event_summary(swaps),
                     event_summary(liquidity_events), candidates)


def _coverage(price: DataFrame, liquidity: DataFrame, swaps: DataFrame, liquidity_events: DataFrame,
              candidates: DataFrame) -> DataFrame:
    ids = candidates.select("candidate_id").distinct()

    def both(parts: list[DataFrame], prefix: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).agg(
            F.min("lo").alias(f"{prefix}_lo"), F.max("hi").alias(f"{prefix}_hi"))

    def span(part: DataFrame) -> DataFrame:
        return part.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("hi > 0")

    series = both([span(price), span(liquidity)], "s")
    # one row per candidate: no hot key reaches the join
    events = both([e.join(ids, "candidate_id", "left_semi").select("lo", "hi")
                   for e in (swaps, liquidity_events)], "e")
    days = F.coalesce(F.col("s_hi") - F.col("s_lo"), F.col("e_hi") - F.col("e_lo"), F.lit(0)) / DAY_MS
    return _check(series.crossJoin(F.broadcast(events)), 3, "Backtest data coverage",
                  f">= {MIN_COVERAGE_DAYS} days", days, days >= MIN_COVERAGE_DAYS)


def duplicate_ids(candidates: DataFrame) -> DataFrame:
    """Candidate ids stored more than once."""
    return _known(candidates).groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicates(candidates: DataFrame) -> DataFrame:
    n = duplicate_ids(candidates).agg(F.count(F.lit(1)).alias("n"))
    return _check(n, 4, "Duplicate candidate_id count", "= 0", F.col("n").cast("double"),
                  F.col("n") == 0)


def missing_events(candidates: DataFrame, swaps: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Candidates without any swap, and without any liquidity event."""
    return _missing_events(candidates, *(e.select("candidate_id").distinct() for e in (swaps, liquidity)))


def _missing_events(candidates: DataFrame, swaps: DataFrame, liquidity: DataFrame) -> DataFrame:
    c = _known(candidates).select("candidate_id")

    def without(have: DataFrame, kind: str) -> DataFrame:
        return c.join(have, "candidate_id", "left_anti").withColumn("missing", F.lit(kind))

    return without(swaps, "swaps").unionByName(without(liquidity, "liquidity"))


def event_presence(candidates: DataFrame, swaps: DataFrame, liquidity: DataFrame) -> DataFrame:
    return _event_presence(missing_events(candidates, swaps, liquidity))


def _event_presence(missing: DataFrame) -> DataFrame:
    n = missing.agg(F.count(F.lit(1)).alias("n"))
    return _check(n, 5, "Missing events count", "= 0", F.col("n").cast("double"), F.col("n") == 0)


def unreplayable(candidates: DataFrame, swaps: DataFrame, liquidity: DataFrame,
                 price: DataFrame) -> DataFrame:
    """Candidates whose events are ambiguous in order or that have no price series."""
    return _unreplayable(candidates, event_summary(swaps), event_summary(liquidity), series_summary(price))


def _unreplayable(candidates: DataFrame, swaps: DataFrame, liquidity: DataFrame,
                  price: DataFrame) -> DataFrame:
    ambiguous = swaps.where("ambiguous").select("candidate_id").unionByName(
        liquidity.where("ambiguous").select("candidate_id"))
    c = _known(candidates).select("candidate_id").distinct()
    return c.join(ambiguous, "candidate_id", "left_semi").union(
        c.join(price, "candidate_id", "left_anti")).distinct()


def replayability(candidates: DataFrame, swaps: DataFrame, liquidity: DataFrame,
                  price: DataFrame) -> DataFrame:
    return _replayability(candidates, unreplayable(candidates, swaps, liquidity, price))


def _replayability(candidates: DataFrame, offending: DataFrame) -> DataFrame:
    bad = offending.agg(F.count(F.lit(1)).alias("bad"))
    total = _known(candidates).agg(F.count(F.lit(1)).alias("total"))
    pct = F.when(F.col("total") == 0, 100.0).otherwise(
        (F.col("total") - F.col("bad")) / F.col("total") * 100)
    return _check(total.crossJoin(F.broadcast(bad)), 6, "Replayable tokens", "= 100%", pct,
                  F.col("bad") == 0)


def ambiguous_ids(events: DataFrame) -> DataFrame:
    """Candidates with two events at one position.

    Positions are compared as 64-bit hashes first, so eight bytes of an event move; only events whose
    hash comes twice are grouped by the position itself.
    """
    at = ["candidate_id", *ordering.EVENT_ORDER]
    h = F.xxhash64(*at)
    twice = events.where("candidate_id is not null").groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return events.withColumn("h", h).join(twice, "h", "left_semi").groupBy(*at).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("candidate_id").distinct()


def sufficiency(candidates: DataFrame, swaps: DataFrame, liquidity_events: DataFrame,
                price: DataFrame, liquidity: DataFrame) -> DataFrame:
    """All six checks, one row each.

    Candidates, events and series are counted side by side in one aggregation by candidate, combined
    before the shuffle; its sums over all candidates are one row, from which five of the checks follow.
    """
    def rows(df: DataFrame, kind: str, time: str, new: Column = F.lit(False)) -> DataFrame:
        return df.select("candidate_id", F.lit(kind).alias("kind"), F.col(time).alias("t"), new.alias("new"))

    kind, t = F.col("kind"), F.col("t")
    every = reduce(DataFrame.unionByName, [
        rows(candidates, "candidate", "discovered_at", F.col("source") == NEW_TOKEN),
        rows(swaps, "swap", "timestamp"), rows(liquidity_events, "change", "timestamp"),
        rows(price, "price", "timestamp_ms"), rows(liquidity, "liquidity", "timestamp_ms")])
    series, raw = ("price", "liquidity"), ("swap", "change")
    each = every.groupBy("candidate_id").agg(
        F.count_if("new").alias("new"), *[F.count_if(kind == k).alias(k) for k in ("candidate", "swap", "change", "price")],
        *[f(F.when(kind == k, t)).alias(f"{k}_{n}") for k in series for n, f in (("lo", F.min), ("hi", F.max))],
        *[f(F.when(kind.isin(*raw), t)).alias(f"raw_{n}") for n, f in (("lo", F.min), ("hi", F.max))])
    ambiguous = ambiguous_ids(swaps).union(ambiguous_ids(liquidity_events)).distinct().withColumn("ambiguous", F.lit(True))
    each = each.join(ambiguous, "candidate_id", "left").join(
        _known(candidates).select("candidate_id").distinct().withColumn("known", F.lit(True)), "candidate_id", "left")
    known, n = F.coalesce("known", F.lit(False)), F.col("candidate")
    bad = known & (F.coalesce("ambiguous", F.lit(False)) | (F.col("price") == 0))
    own = F.col("candidate_id").isNotNull() & (n > 0)
    one = each.agg(
        F.sum("new").alias("new"), *[f(f"{k}_{e}").alias(f"{k}_{e}") for k in series for e, f in (("lo", F.min), ("hi", F.max))],
        F.min(F.when(own, F.col("raw_lo"))).alias("raw_lo"), F.max(F.when(own, F.col("raw_hi"))).alias("raw_hi"),
        F.count_if(known & (n > 1)).alias("twice"),
        F.sum(F.when(known, F.when(F.col("swap") == 0, n).otherwise(0) + F.when(F.col("change") == 0, n).otherwise(0))).alias("missing"),
        F.sum(F.when(known, n)).alias("total"), F.count_if(bad).alias("bad"))
    one = one.select("*", *[F.coalesce(c, F.lit(0)).alias(f"{c}_n") for c in ("new", "missing", "total")])
    ends = [F.when(F.col(f"{k}_hi") > 0, F.col(f"{k}_{e}")) for e in ("lo", "hi") for k in series]
    days = F.coalesce(F.greatest(*ends[2:]) - F.least(*ends[:2]), F.col("raw_hi") - F.col("raw_lo"), F.lit(0)) / DAY_MS
    pct = F.when(F.col("total_n") == 0, 100.0).otherwise((F.col("total_n") - F.col("bad")) / F.col("total_n") * 100)

    def check(number: int, name: str, threshold: str, actual: Column, passed: Column) -> Column:
        return F.struct(F.lit(number).alias("check_no"), F.lit(name).alias("name"), F.lit(threshold).alias("threshold"),
                        actual.cast("double").alias("actual"), passed.alias("pass"))

    found = one.select(F.inline(F.array(
        check(1, "Unique NEW_TOKEN candidates", f">= {MIN_NEW_CANDIDATES}", F.col("new_n"), F.col("new_n") >= MIN_NEW_CANDIDATES),
        check(3, "Backtest data coverage", f">= {MIN_COVERAGE_DAYS} days", days, days >= MIN_COVERAGE_DAYS),
        check(4, "Duplicate candidate_id count", "= 0", F.col("twice"), F.col("twice") == 0),
        check(5, "Missing events count", "= 0", F.col("missing_n"), F.col("missing_n") == 0),
        check(6, "Replayable tokens", "= 100%", pct, F.col("bad") == 0))))
    return found.unionByName(discovery_days(candidates))


def all_pass(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("pass").alias("all_pass"), F.count_if(~F.col("pass")).alias("failed"))


def integrity_errors(candidates: DataFrame, swaps: DataFrame, liquidity_events: DataFrame,
                     price: DataFrame) -> DataFrame:
    """One line per offending candidate."""
    def lines(df: DataFrame, text: Column) -> DataFrame:
        return df.select("candidate_id", text.alias("error"))

    return (
        lines(duplicate_ids(candidates), F.concat(
            F.lit("duplicate candidate_id (count="), F.col("n").cast("string"), F.lit(")")))
        .unionByName(lines(missing_events(candidates, swaps, liquidity_events),
                           F.concat(F.lit("no "), "missing")))
        .unionByName(lines(unreplayable(candidates, swaps, liquidity_events, price),
                           F.lit("not replayable")))
    )


# --- fingerprints -------------------------------------------------------------------------

def line_of(df: DataFrame, digits: int = 8) -> Column:
    """All columns of a row as one text line; doubles with a fixed number of digits.

    Separators inside a value are escaped, and NULL is told from the empty text.
    """
    parts = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "double":
            c = F.format_string(f"%.{digits}f", c)
        text = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
        parts.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("|", *parts)


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and digest of a table, independent of row order and partitioning.

    Each row is hashed; the hashes are cut into four 60-bit numbers which are summed, and
    the sums hashed again.  Sums merge in any order and need no sort of the whole table.
    """
    h = F.sha2(line_of(df), 256)
    parts = df.select(*[
        F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"p{i}")
        for i in range(4)])
    sums = parts.agg(F.count(F.lit(1)).alias("rows"), *[
        F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"s{i}")
        for i in range(4)])
    return sums.select(
        F.lit(name).alias("table_name"), "rows",
        F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "s0", "s1", "s2", "s3"), 256)
        .alias("digest"))


def dataset_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table plus one for all of them together."""
    each = reduce(DataFrame.unionByName, [fingerprint(df, n) for n, df in sorted(tables.items())])
    # one row per table: a handful of rows in the list
    whole = each.agg(
        F.lit("ALL").alias("table_name"), F.sum("rows").alias("rows"),
        F.sha2(F.concat_ws("|", F.transform(
            F.sort_array(F.collect_list(F.struct("table_name", "digest"))),
            lambda r: r["digest"])), 256).alias("digest"))
    return each.unionByName(whole)


class FingerprintMismatch(Exception):
    pass


def require_fingerprint(tables: dict[str, DataFrame], expected: str) -> str:
    """Raise unless the combined digest is the expected one."""
    got = dataset_fingerprint(tables).where("table_name = 'ALL'").first()["digest"]
    if got != expected:
        raise FingerprintMismatch(f"expected {expected}, got {got}")
    return got
