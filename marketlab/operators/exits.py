"""Exit rules as set operations over the price and liquidity series.

An exit depends on the candidate and the rule, not on the cost scenario: it is found once
per (candidate, rule) and then crossed with the scenarios.

All rules of a candidate share its entry, so the series meet the entries, not the jobs, and the
rules are columns.  What is known at fixed times (the entry and the end of each holding period)
and the first fall below a fixed threshold are conditional minima and maxima, for all rules in one
aggregation that is combined before the shuffle: nothing is sorted, and a hot candidate sends a
few rows from each task.  The trailing stop compares with the running peak.  It is searched through an
index of hour slices: from the lowest and highest price of each slice and the peak carried into it
follows which slices can hold a stop of any rule, and only their points are read again and sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlab.functions import costs, ids
from marketlab.functions.timecols import HOUR_MS, slice_no
from marketlab.operators.joins import salted_join
from marketlab.operators.slices import before, upto
from marketlab.schemas import ACTIVE_TOKEN, NEW_TOKEN
from marketlab.session import materialize

RULE_COLUMNS = {
    "strategy_type": "string", "entry_event_type": "string", "hold_duration_ms": "bigint",
    "trail_pct": "double", "initial_stop_pct": "double", "liquidity_drop_pct": "double",
    "max_hold_duration_ms": "bigint",
}
# Parameters every rule family needs.
REQUIRED = {
    ids.TIME_EXIT: ["hold_duration_ms"],
    ids.TRAILING_STOP: ["trail_pct", "initial_stop_pct", "max_hold_duration_ms"],
    ids.LIQUIDITY_GUARD: ["liquidity_drop_pct", "max_hold_duration_ms"],
}
# Fixed exit reasons.
INITIAL_STOP, MAX_DURATION, LIQUIDITY_DROP = "INITIAL_STOP", "MAX_DURATION", "LIQUIDITY_DROP"
ENTRY = ["candidate_id", "source", "entry_signal_time"]


def rule(kind: str, entry: str, hold=None, trail=None, stop=None, drop=None, max_hold=None):
    return (kind, entry, hold, trail, stop, drop, max_hold)


def default_rules() -> list[tuple]:
    """Fixed default grid: three families for both entry types."""
    return [r for e in (NEW_TOKEN, ACTIVE_TOKEN) for r in (
        rule(ids.TIME_EXIT, e, hold=300_000),
        rule(ids.TRAILING_STOP, e, trail=0.10, stop=0.10, max_hold=3_600_000),
        rule(ids.LIQUIDITY_GUARD, e, drop=0.30, max_hold=1_800_000))]


def sweep_rules(unit_ms: int = 1000) -> list[tuple]:
    """Fixed parameter sweep of the rule catalogue, for both entry types.

    Holding periods are given in seconds; ``unit_ms`` stretches them.
    """
    out = []
    for e in (NEW_TOKEN, ACTIVE_TOKEN):
        out += [rule(ids.TIME_EXIT, e, hold=s * unit_ms) for s in (60, 300, 600, 1800)]
        out += [rule(ids.TRAILING_STOP, e, trail=p, stop=0.10, max_hold=3600 * unit_ms)
                for p in (0.05, 0.10, 0.15, 0.20)]
        out += [rule(ids.LIQUIDITY_GUARD, e, drop=p, max_hold=1800 * unit_ms)
                for p in (0.20, 0.30, 0.50)]
    return out


def rule_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Numbered rules with their parameterised ids; a small literal relation."""
    cols = {"rule_no": "int", **RULE_COLUMNS}
    table = costs.inline_table(spark, cols, [(i, *r) for i, r in enumerate(rows)])
    return table.withColumn("strategy_id", ids.strategy_id())


def rejected_rules(rules: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """Rules of an unknown family or without a required parameter, with the reason."""
    kind = F.col("strategy_type")
    reason = F.when(~F.coalesce(kind.isin([*REQUIRED, *custom]), F.lit(False)), F.lit("unknown strategy type"))
    for family, needed in REQUIRED.items():
        for name in needed:
            reason = reason.when((kind == family) & F.col(name).isNull(),
                                 F.lit(f"{family} requires {name}"))
    return rules.withColumn("reason", reason).where("reason is not null")


def valid_rules(rules: DataFrame) -> DataFrame:
    kind = F.col("strategy_type")
    ok = F.lit(False)
    for family, needed in REQUIRED.items():
        has = F.lit(True)
        for name in needed:
            has = has & F.col(name).isNotNull()
        ok = ok | ((kind == family) & has)
    return rules.where(ok)


def _has_all(rule: tuple) -> bool:
    """Whether a rule is of a known family and has its parameters."""
    given = dict(zip(RULE_COLUMNS, rule))
    return rule[0] in REQUIRED and all(given[name] is not None for name in REQUIRED[rule[0]])


class _Facts:
    """Distinct parameters of a list of rules, and where each rule finds its own in the arrays of facts."""

    def __init__(self, rules: list[tuple]):
        self.rules = [(i, dict(zip(RULE_COLUMNS, r))) for i, r in enumerate(rules) if _has_all(r)]
        self.ends = sorted({self._end(r) for _, r in self.rules})
        self.guard_ends = sorted({self._end(r) for _, r in self._of(ids.LIQUIDITY_GUARD)})
        self.guards = sorted({self._guard(r) for _, r in self._of(ids.LIQUIDITY_GUARD)})
        self.trails = sorted({self._trail(r) for _, r in self._of(ids.TRAILING_STOP)})

    def _of(self, family: str):
        return [(i, r) for i, r in self.rules if r["strategy_type"] == family]

    @staticmethod
    def _end(r: dict) -> int:
        """Time from the entry to the end; points at the entry time itself never count."""
        return r["hold_duration_ms"] if r["strategy_type"] == ids.TIME_EXIT else max(r["max_hold_duration_ms"], 1)

    @staticmethod
    def _guard(r: dict) -> tuple:
        return r["liquidity_drop_pct"], r["max_hold_duration_ms"]

    @staticmethod
    def _trail(r: dict) -> tuple:
        return r["trail_pct"], r["initial_stop_pct"], r["max_hold_duration_ms"]

    def places(self, spark: SparkSession) -> DataFrame:
        """Positions (from 1) in the arrays, by rule; a literal relation."""
        rows = []
        for i, r in self.rules:
            kind = r["strategy_type"]
            guard = kind == ids.LIQUIDITY_GUARD
            rows.append((i, self.ends.index(self._end(r)) + 1, self.guard_ends.index(self._end(r)) + 1 if guard else None,
                         self.guards.index(self._guard(r)) + 1 if guard else None,
                         self.trails.index(self._trail(r)) + 1 if kind == ids.TRAILING_STOP else None))
        return costs.inline_table(spark, {"rule_no": "int", "at_end": "int", "at_guard_end": "int", "at_guard": "int", "at_trail": "int"}, rows)


def _met(series: DataFrame, value: str, entries: DataFrame) -> DataFrame:
    """Points (_t, _x) with the entries of their candidate; a hot candidate is spread by time."""
    points = series.select("candidate_id", F.col("timestamp_ms").alias("_t"), F.col(value).alias("_x"))
    return salted_join(points, entries, "candidate_id", "_t", "inner")


def _listed(columns: list[Column], kind: str) -> Column:
    return F.array(*columns) if columns else F.array().cast(f"array<{kind}>")


def known_around(entries: DataFrame, series: DataFrame, value: str, ends: list[int]) -> DataFrame:
    """Per entry: the series' first value, the one known at the entry, and by end: the one known
    there, and time and value of the first point at or after it."""
    t, x, at = F.col("_t"), F.col("_x"), F.col("entry_signal_time")
    known = [F.max_by(x, F.when(t <= at + e, t)) for e in ends]
    later = [F.when(t >= at + e, t) for e in ends]
    return _met(series, value, entries).groupBy(*ENTRY).agg(
        F.min_by(x, t).alias(f"{value}_first"), F.max_by(x, F.when(t <= at, t)).alias(f"{value}_entry"),
        _listed(known, "double").alias(f"{value}_ends"), _listed([F.min(u) for u in later], "long").alias(f"{value}_next_ts"),
        _listed([F.min_by(x, u) for u in later], "double").alias(f"{value}_next"))


def guard_hits(entries: DataFrame, liquidity: DataFrame, guards: list[tuple]) -> DataFrame:
    """Per entry and guard: the first drop below its threshold inside the period, and the lowest liquidity there."""
    t, x, at = F.col("_t"), F.col("_x"), F.col("entry_signal_time")
    inside = (t > at) & (t < at + max(g[1] for g in guards))
    hits, lows = [], []
    for drop, hold in guards:
        hits.append(F.when((t < at + hold) & (x < F.col("liquidity_entry") * (1 - F.lit(drop))), t))
        lows.append(F.min(F.when(t < at + hold, x)))
    return _met(liquidity, "liquidity", entries.select(*ENTRY, "liquidity_entry")).where(inside).groupBy(*ENTRY).agg(
        F.array(*[F.min(h) for h in hits]).alias("drop_ts"), F.array(*[F.min_by(x, h) for h in hits]).alias("drop_liquidity"),
        F.array(*lows).alias("min_held"))


def prices_inside(entries: DataFrame, price: DataFrame, facts: _Facts) -> DataFrame:
    """Per entry: the last price up to each drop, and the highest price inside each trailing period."""
    t, x, at = F.col("_t"), F.col("_x"), F.col("entry_signal_time")
    until = max([g[1] for g in facts.guards] + [r[2] for r in facts.trails])
    drops = [F.max_by(x, F.when(t <= F.col("drop_ts")[i], t)) for i in range(len(facts.guards))]
    tops = [F.max(F.when(t < at + r[2], x)) for r in facts.trails]
    return _met(price, "price", entries.select(*ENTRY, "drop_ts")).where((t > at) & (t < at + until)).groupBy(*ENTRY).agg(
        _listed(drops, "double").alias("drop_price"), _listed(tops, "double").alias("max_held"))


def trailing_hits(entries: DataFrame, price: DataFrame, trails: list[tuple]) -> DataFrame:
    """Per entry and trailing rule: time, price and peak of the first stop inside the period."""
    t, x, at, entry = F.col("_t"), F.col("_x"), F.col("entry_signal_time"), F.col("price_entry")
    inside = (t > at) & (t < at + max(r[2] for r in trails))
    hour = slice_no("_t", HOUR_MS)
    met = _met(price, "price", entries.select(*ENTRY, "price_entry")).where(inside).withColumn("_hour", hour)
    slices = met.groupBy(*ENTRY, "price_entry", "_hour").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    earlier = before(Window.partitionBy(*ENTRY).orderBy("_hour"))
    slices = slices.withColumn("_carried", F.greatest("price_entry", F.max("_high").over(earlier)))
    top, low = F.greatest("_carried", "_high"), F.col("_low")
    possible = F.lit(False)
    for trail, stop, _ in trails:
        possible = possible | (low <= entry * (1 - F.lit(stop))) | (low <= top * (1 - F.lit(trail)))
    slices = slices.where(possible).select(*ENTRY, "price_entry", "_hour", "_carried")
    # only the points of those hours move, each hour of a hot candidate on its own
    points = price.select("candidate_id", F.col("timestamp_ms").alias("_t"), F.col("price").alias("_x"),
                          slice_no("timestamp_ms", HOUR_MS).alias("_hour"))
    rows = points.join(slices, ["candidate_id", "_hour"]).where(inside)
    peak = F.greatest("_carried", F.max(x).over(upto(Window.partitionBy(*ENTRY, "_hour").orderBy("_t"))))
    rows = rows.withColumn("_peak", peak)
    stops = [F.when((t < at + hold) & ((x <= entry * (1 - F.lit(stop))) | (x <= F.col("_peak") * (1 - F.lit(trail)))), t)
             for trail, stop, hold in trails]
    return rows.groupBy(*ENTRY).agg(
        F.array(*[F.min(u) for u in stops]).alias("stop_ts"), F.array(*[F.min_by(x, u) for u in stops]).alias("stop_price"),
        F.array(*[F.min_by("_peak", u) for u in stops]).alias("stop_peak"))


def _rejection() -> Column:
    c = F.col
    return (
        F.when(c("candidate_id") == "", "candidate_id is empty")
        .when(c("entry_signal_price").isNull(), "no price data available")
        .when(~c("has_liquidity"), "no liquidity data available")
        .when(c("entry_signal_time") <= 0, "entry_signal_time must be positive")
        .when(c("entry_signal_price") <= 0, "entry_signal_price must be positive")
        .when((c("strategy_type") == ids.LIQUIDITY_GUARD) & c("entry_liquidity").isNull(),
              "entry liquidity cannot be determined")
    )


def evaluate(candidates: DataFrame, price: DataFrame, liquidity: DataFrame,
             rules: list[tuple] | None = None, stage=materialize) -> DataFrame:
    """One row per (candidate, rule): the exit, or the reason why there is none.

    The narrow table of entries is staged between the passes over the series, so that no pass is
    planned or run twice; ``stage`` can be replaced, e.g. by a function that does nothing.
    """
    spark = candidates.sparkSession
    rules = default_rules() if rules is None else rules
    facts = _Facts(rules)
    entries = candidates.where("candidate_id is not null and discovered_at is not null").select(
        "candidate_id", "source", F.col("discovered_at").alias("entry_signal_time")).where(
        F.col("source").isin(sorted({r["entry_event_type"] for _, r in facts.rules if r["entry_event_type"]}))).distinct()
    known = entries.join(known_around(entries, liquidity, "liquidity", facts.guard_ends), ENTRY, "left").join(
        known_around(entries, price, "price", facts.ends), ENTRY, "left")
    known = known.withColumn("price_entry", F.coalesce("price_entry", "price_first"))
    known = stage(known, "entries")
    if facts.guards:
        drops = guard_hits(known.where("liquidity_entry is not null"), liquidity, facts.guards)
        known = stage(known.join(drops, ENTRY, "left"), "entries-drops")
    else:
        known = known.withColumns({"drop_ts": F.lit(None).cast("array<long>"), **{
            c: F.lit(None).cast("array<double>") for c in ("drop_liquidity", "min_held")}})
    if facts.guards or facts.trails:
        known = known.join(prices_inside(known, price, facts), ENTRY, "left")
    else:
        known = known.withColumns({c: F.lit(None).cast("array<double>") for c in ("drop_price", "max_held")})
    if facts.trails:
        known = known.join(trailing_hits(known.select(*ENTRY, "price_entry").where("price_entry is not null"), price, facts.trails), ENTRY, "left")
    else:
        known = known.withColumns({"stop_ts": F.lit(None).cast("array<long>"), **{
            c: F.lit(None).cast("array<double>") for c in ("stop_price", "stop_peak")}})
    return _decide(_jobs(known, rule_table(spark, rules).join(F.broadcast(facts.places(spark)), "rule_no")))


def _jobs(known: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries with the rules of their source, each with its own facts; the rule table is a short literal."""
    def at(facts: str, place: str) -> Column:
        return F.try_element_at(facts, F.col(place))

    r = F.broadcast(rules)
    jobs = known.join(r, known["source"] == r["entry_event_type"])
    return jobs.select(
        *ENTRY, *[F.col(c) for c in rules.columns if not c.startswith("at_")],
        (F.col("entry_signal_time") + F.coalesce("hold_duration_ms", "max_hold_duration_ms")).alias("end_time"),
        F.col("liquidity_ends").isNotNull().alias("has_liquidity"), F.col("liquidity_entry").alias("entry_liquidity"),
        at("liquidity_ends", "at_guard_end").alias("end_liquidity"), at("liquidity_next_ts", "at_guard_end").alias("next_liq_ts"),
        at("liquidity_next", "at_guard_end").alias("next_liquidity"),
        F.col("price_entry").alias("entry_signal_price"), F.coalesce(at("price_ends", "at_end"), "price_first").alias("end_price"),
        at("price_next_ts", "at_end").alias("next_price_ts"), at("price_next", "at_end").alias("next_price"),
        at("drop_ts", "at_guard").alias("drop_ts"), at("drop_liquidity", "at_guard").alias("drop_liquidity"),
        at("min_held", "at_guard").alias("min_held"), F.coalesce(at("drop_price", "at_guard"), "price_entry").alias("drop_price"),
        at("stop_ts", "at_trail").alias("stop_ts"), at("stop_price", "at_trail").alias("stop_price"),
        at("stop_peak", "at_trail").alias("stop_peak"), at("max_held", "at_trail").alias("max_held"))


def _decide(jobs: DataFrame) -> DataFrame:
    c = F.col
    none = F.lit(None)
    entry = c("entry_signal_price")

    # trailing stop: inside the period, on the first point after it, or at its end
    top = F.greatest(entry, c("max_held"))
    next_top = F.greatest(top, c("next_price"))
    floor = entry * (1 - c("initial_stop_pct"))
    t_price = F.coalesce("stop_price", "next_price")
    t_peak = F.coalesce("stop_peak", next_top, top)
    t_reason = (
        F.when(t_price <= floor, INITIAL_STOP)
        .when(t_price <= t_peak * (1 - c("trail_pct")), "TRAILING_STOP")
        .otherwise(MAX_DURATION)
    )

    # liquidity guard: a drop inside the period, the first event after it, or its end
    over = F.least("next_price_ts", "next_liq_ts")
    on_liq = c("next_liq_ts") == over
    over_liq = F.when(on_liq, c("next_liquidity")).otherwise(c("end_liquidity"))
    over_price = F.when(c("next_price_ts") == over, c("next_price")).otherwise(c("end_price"))
    threshold = c("entry_liquidity") * (1 - c("liquidity_drop_pct"))
    dropped = c("drop_ts").isNotNull()
    g_reason = F.when(dropped | (over.isNotNull() & on_liq & (over_liq < threshold)),
                      LIQUIDITY_DROP).otherwise(MAX_DURATION)
    g_min = F.when(dropped, F.least("entry_liquidity", "drop_liquidity")).otherwise(
        F.least(c("entry_liquidity"), c("min_held"), F.when(over.isNotNull(), over_liq)))

    def by_family(time_exit, trailing, guard):
        return (
            F.when(c("strategy_type") == ids.TIME_EXIT, time_exit)
            .when(c("strategy_type") == ids.TRAILING_STOP, trailing).otherwise(guard)
        )

    return jobs.select(
        "candidate_id", "source", "rule_no", "strategy_type", "strategy_id", "entry_signal_time",
        "entry_signal_price", "entry_liquidity",
        by_family(c("end_time"), F.coalesce("stop_ts", "next_price_ts", "end_time"),
                  F.coalesce(c("drop_ts"), over, c("end_time"))).alias("exit_signal_time"),
        by_family(c("end_price"), F.coalesce(t_price, c("end_price")),
                  F.when(dropped, c("drop_price")).when(over.isNotNull(), over_price)
                  .otherwise(c("end_price"))).alias("exit_signal_price"),
        by_family(F.lit(ids.TIME_EXIT),
                  F.when(t_price.isNull(), MAX_DURATION).otherwise(t_reason),
                  g_reason).alias("exit_reason"),
        by_family(none, t_peak, none).cast("double").alias("peak_price"),
        by_family(none, none, g_min).cast("double").alias("min_liquidity"),
        _rejection().alias("reason"))


def exits(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("reason is null").drop("reason")


def rejected(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("reason is not null").select(
        "candidate_id", "source", "strategy_id", "reason")


def trade_records(candidates: DataFrame, price: DataFrame, liquidity: DataFrame,
                  rules: list[tuple] | None = None, scenario_rows=None) -> DataFrame:
    """The full grid: candidates x rules of their source x cost scenarios.

    Registered families of one's own are part of the grid.
    """
    spark, rules = candidates.sparkSession, default_rules() if rules is None else rules
    found = exits(evaluate(candidates, price, liquidity, built_in_rules(rules)))
    for family in custom_families(rules):
        own = exit_rule(family)(candidates, price, liquidity, [r for r in rules if r[0] == family])
        found = found.unionByName(own, allowMissingColumns=True).select(found.columns)
    return costs.trade_columns(found, costs.scenarios(spark, scenario_rows))


# Rule families by name: functions from (candidates, price, liquidity, rules) to exits.
ExitRule = Callable[[DataFrame, DataFrame, DataFrame, list[tuple]], DataFrame]
_FAMILIES: dict[str, ExitRule] = {}


def register_exit_rule(family: str, fn: ExitRule) -> None:
    """Add a rule family of one's own; it stays a DataFrame job."""
    _FAMILIES[family] = fn


def exit_rule(family: str) -> ExitRule:
    return _FAMILIES[family]


def custom_families(rules: list[tuple]) -> tuple[str, ...]:
    """Families among the rules that were registered and are not built in."""
    return tuple(sorted({r[0] for r in rules if r[0] in _FAMILIES and r[0] not in REQUIRED}))


def built_in_rules(rules: list[tuple]) -> list[tuple]:
    """All other rules; unknown ones are left to ``rejected_rules``."""
    return [r for r in rules if r[0] not in custom_families(rules)]


def _built_in(family: str) -> ExitRule:
    def run(candidates, price, liquidity, rules):
        own = [r for r in rules if r[0] == family]
        return exits(evaluate(candidates, price, liquidity, own))
    return run


for _family in REQUIRED:
    register_exit_rule(_family, _built_in(_family))
