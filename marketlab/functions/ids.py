"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed rule-family names.
TIME_EXIT = "TIME_EXIT"
TRAILING_STOP = "TRAILING_STOP"
LIQUIDITY_GUARD = "LIQUIDITY_GUARD"
RULE_TYPES = [TIME_EXIT, TRAILING_STOP, LIQUIDITY_GUARD]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def candidate_id(mint="mint", pool="pool", source="source", tx="tx_signature",
                 index="event_index", slot="slot") -> Column:
    """Lower-hex SHA-256 of mint|pool|source|tx|index|slot; a NULL pool counts as empty."""
    parts = [_c(mint), F.coalesce(_c(pool), F.lit("")), _c(source), _c(tx),
             _c(index).cast("string"), _c(slot).cast("string")]
    return F.sha2(F.concat(*[p for q in parts for p in (q, F.lit("|"))][:-1]), 256)


def trade_id(candidate="candidate_id", strategy="strategy_id", scenario="scenario_id",
             entry_time="entry_signal_time") -> Column:
    """Lower-hex SHA-256 of candidate|strategy|scenario|entry time."""
    return F.sha2(F.concat_ws("|", _c(candidate), _c(strategy), _c(scenario),
                              _c(entry_time).cast("string")), 256)


def packed(text: str | Column) -> Column:
    """Any text as bytes: lower-hex digits take half their room behind a byte 01, other texts follow a byte 00."""
    t = _c(text)
    raw = F.unhex(t)
    return F.when(F.lower(F.hex(raw)) == t, F.concat(F.unhex(F.lit("01")), raw)).otherwise(
        F.concat(F.unhex(F.lit("00")), F.encode(t, "UTF-8")))


def unpacked(data: str | Column) -> Column:
    """The text that ``packed`` was given."""
    d = _c(data)
    rest = F.substring(d, 2, 2**31 - 1)
    return F.when(F.hex(F.substring(d, 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def strategy_id() -> Column:
    """Parameterised rule id from the columns of a rule table."""
    kind, entry = F.col("strategy_type"), F.col("entry_event_type")

    def pct(name: str) -> Column:
        # bround = half-even on exact ties, the printing rule of the ids
        return F.bround(F.col(name) * 100, 0).cast("long").cast("string")

    def ms(name: str) -> Column:
        return F.concat(F.col(name).cast("string"), F.lit("ms"))

    return (
        F.when(kind == TIME_EXIT, F.concat_ws("_", kind, entry, ms("hold_duration_ms")))
        .when(kind == TRAILING_STOP, F.concat_ws(
            "_", kind, entry, F.concat(F.lit("trail"), pct("trail_pct")),
            F.concat(F.lit("stop"), pct("initial_stop_pct")), ms("max_hold_duration_ms")))
        .when(kind == LIQUIDITY_GUARD, F.concat_ws(
            "_", kind, entry, F.concat(F.lit("drop"), pct("liquidity_drop_pct")),
            ms("max_hold_duration_ms")))
    )


def canonical_type(strategy="strategy_id") -> Column:
    """Rule family by prefix; anything else unchanged."""
    s = _c(strategy)
    out = s
    for kind in reversed(RULE_TYPES):
        out = F.when(s.startswith(kind), F.lit(kind)).otherwise(out)
    return out
