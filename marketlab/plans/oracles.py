"""The registered queries as plain SQL over the same tables, for cross-checking."""

from __future__ import annotations

DAY = 86400000
HOUR = 3600000


def _events(coarse: bool = False, hot: bool = False) -> str:
    ms = "epoch_us(ts) // 1000"
    if coarse:
        ms = f"(epoch_us(ts) // 1000 // {DAY}) * {DAY}"
    key = "CAST(user_id AS VARCHAR)"
    if hot:
        key = f"CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE {key} END"
    return f"""
    SELECT {key} AS key, lpad(CAST(event_id AS VARCHAR), 12, '0') AS tx_signature,
           0 AS event_index, event_id AS slot, {ms} AS timestamp, event_type, value, user_id
    FROM events"""


def _base(coarse: bool = False) -> dict[str, str]:
    """Named subqueries shared by all oracles."""
    return {
        "ev": _events(coarse),
        "ev0": _events(False),
        "swap_events": """
    SELECT key AS mint, CAST(NULL AS VARCHAR) AS pool, tx_signature, event_index, slot,
           timestamp, value AS amount_out FROM ev""",
        "swaps": """
    SELECT key AS candidate_id, tx_signature, event_index, slot, timestamp,
           CASE WHEN event_type = 'view' THEN 'sell' ELSE 'buy' END AS side,
           CAST(1.0 AS DOUBLE) AS amount_in, value AS amount_out, value AS price
    FROM ev WHERE event_type IN ('click', 'view', 'purchase')""",
        "swaps_wide": f"""
    SELECT CAST(l_partkey AS VARCHAR) AS candidate_id, CAST(l_orderkey AS VARCHAR) AS tx_signature,
           l_linenumber AS event_index, l_orderkey AS slot,
           (epoch_us(l_shipdate) // 1000 // {DAY}) * {DAY} AS timestamp,
           CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
           CAST(1.0 AS DOUBLE) AS amount_in, CAST(l_quantity AS DOUBLE) AS amount_out,
           CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS price
    FROM lineitem""",
        "liquidity_events": """
    SELECT key AS candidate_id, CAST(NULL AS VARCHAR) AS pool, key AS mint, tx_signature,
           event_index, slot, timestamp,
           CASE WHEN event_type = 'signup' THEN 'add' ELSE 'remove' END AS event_type,
           value AS amount_token, value AS amount_quote, value AS liquidity_after
    FROM ev WHERE event_type IN ('signup', 'error')""",
        "token_candidates": f"""
    SELECT key AS candidate_id,
           CASE WHEN user_id % 3 = 0 THEN 'ACTIVE_TOKEN' ELSE 'NEW_TOKEN' END AS source,
           key AS mint, CAST(NULL AS VARCHAR) AS pool,
           lpad(CAST(min(slot) AS VARCHAR), 12, '0') AS tx_signature, 0 AS event_index,
           min(slot) AS slot, min(timestamp) + {5 * DAY} AS discovered_at
    FROM ev0 GROUP BY user_id, key""",
        "price": """
    SELECT candidate_id, timestamp AS timestamp_ms,
           arg_max(slot, (slot, tx_signature, event_index)) AS slot,
           arg_max(price, (slot, tx_signature, event_index)) AS price,
           sum(amount_out) AS volume, count(*) AS swap_count
    FROM swaps GROUP BY candidate_id, timestamp""",
        "liq": """
    SELECT candidate_id, timestamp AS timestamp_ms,
           arg_max(slot, (slot, tx_signature, event_index)) AS slot,
           arg_max(liquidity_after, (slot, tx_signature, event_index)) AS liquidity,
           arg_max(amount_token, (slot, tx_signature, event_index)) AS liquidity_token,
           arg_max(amount_quote, (slot, tx_signature, event_index)) AS liquidity_quote
    FROM liquidity_events GROUP BY candidate_id, timestamp""",
    }


def _with(body: str, coarse: bool = False, **extra: str) -> str:
    """Prefix a query with the subqueries it needs."""
    parts = {**_base(coarse), **extra}
    used: list[str] = []

    def need(text: str) -> None:
        import re
        for name in parts:
            if name not in used and re.search(rf"(\b(FROM|JOIN)|,)\s+{name}\b", text):
                need(parts[name])
                if name not in used:
                    used.append(name)

    need(body)
    return "WITH " + ",\n".join(f"{n} AS ({parts[n]})" for n in used) + "\n" + body


DERIV = """
    SELECT *, lag(timestamp_ms) OVER w AS prev_timestamp_ms, lag(price) OVER w AS prev_price,
           price - lag(price) OVER w AS price_delta,
           timestamp_ms - lag(timestamp_ms) OVER w AS time_delta_ms,
           (price - lag(price) OVER w) / (timestamp_ms - lag(timestamp_ms) OVER w) AS price_velocity
    FROM price WINDOW w AS (PARTITION BY candidate_id ORDER BY timestamp_ms)"""

ACCEL = """
    SELECT *, (price_velocity - lag(price_velocity) OVER w) / time_delta_ms AS price_acceleration
    FROM deriv WINDOW w AS (PARTITION BY candidate_id ORDER BY timestamp_ms)"""

LIQ_DERIV = """
    SELECT *, lag(timestamp_ms) OVER w AS prev_timestamp_ms, lag(liquidity) OVER w AS prev_liquidity,
           liquidity - lag(liquidity) OVER w AS liquidity_delta,
           timestamp_ms - lag(timestamp_ms) OVER w AS time_delta_ms,
           (liquidity - lag(liquidity) OVER w) / (timestamp_ms - lag(timestamp_ms) OVER w)
             AS liquidity_velocity
    FROM liq WINDOW w AS (PARTITION BY candidate_id ORDER BY timestamp_ms)"""

_FEATURES = dict(deriv=DERIV, accel=ACCEL, liq_deriv=LIQ_DERIV)


def _features(interval: str) -> str:
    return f"""
    SELECT p.candidate_id, p.timestamp_ms, p.price_delta, p.price_velocity, a.price_acceleration,
           l.liquidity_delta, l.liquidity_velocity,
           p.timestamp_ms - min(p.timestamp_ms) OVER (PARTITION BY p.candidate_id) AS token_lifetime_ms,
           p.time_delta_ms AS last_swap_interval_ms, {interval} AS last_liq_event_interval_ms
    FROM deriv p
    JOIN accel a USING (candidate_id, timestamp_ms)
    LEFT JOIN liq_deriv l USING (candidate_id, timestamp_ms)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, coarse in (("", False), ("_coarse", True)):
        out[f"price_timeseries{name}"] = _with(
            "SELECT candidate_id, timestamp_ms, slot, price, round(volume, 6) AS volume, swap_count "
            "FROM price", coarse)
        out[f"liquidity_timeseries{name}"] = _with("SELECT * FROM liq", coarse)
        out[f"derived_features_go{name}"] = _with(_features(
            "(SELECT p.timestamp_ms - max(q.timestamp_ms) FROM liq q WHERE "
            "q.candidate_id = p.candidate_id AND q.timestamp_ms < p.timestamp_ms)"),
            coarse, **_FEATURES)
    hot = {"ev": _events(hot=True)}
    out["derived_features_hot"] = _with(_features(
        "(SELECT p.timestamp_ms - max(q.timestamp_ms) FROM liq q WHERE "
        "q.candidate_id = p.candidate_id AND q.timestamp_ms < p.timestamp_ms)"), **_FEATURES, **hot)
    out["price_timeseries_wide"] = _with(
        "SELECT candidate_id, timestamp_ms, slot, price, round(volume, 6) AS volume, swap_count "
        "FROM wprice", wprice=_base()["price"].replace("FROM swaps ", "FROM swaps_wide "))
    out["volume_timeseries"] = _with("""
    SELECT candidate_id, (timestamp // (w * 1000)) * (w * 1000) AS timestamp_ms,
           CAST(w AS INTEGER) AS interval_seconds, round(sum(amount_out), 6) AS volume,
           count(*) AS swap_count,
           round(coalesce(sum(amount_out) FILTER (side = 'buy'), 0), 6) AS buy_volume,
           round(coalesce(sum(amount_out) FILTER (side = 'sell'), 0), 6) AS sell_volume
    FROM swaps, (VALUES (60), (300), (3600)) v(w) GROUP BY 1, 2, 3""")
    out["stream_volume"] = out["volume_timeseries"]
    out["price_derivatives"] = _with("""
    SELECT candidate_id, timestamp_ms, slot, price, round(volume, 6) AS volume, swap_count,
           prev_timestamp_ms, prev_price, price_delta, time_delta_ms, price_velocity
    FROM deriv""", **_FEATURES)
    out["price_acceleration"] = _with("""
    SELECT candidate_id, timestamp_ms, price, price_delta, price_velocity, time_delta_ms,
           price_acceleration FROM accel""", **_FEATURES)
    out["liquidity_derivatives"] = _with("SELECT * FROM liq_deriv", **_FEATURES)
    out["last_swap_interval"] = _with(
        "SELECT candidate_id, timestamp_ms, time_delta_ms AS last_swap_interval_ms FROM deriv",
        **_FEATURES)
    out["last_liq_event_interval"] = _with(
        "SELECT candidate_id, timestamp_ms, time_delta_ms AS last_liq_event_interval_ms "
        "FROM liq_deriv", **_FEATURES)
    out["derived_features_sql"] = _with(_features("l.time_delta_ms"), True, **_FEATURES)
    out["sql_views"] = _with(f"""
    SELECT f.candidate_id, f.timestamp_ms, f.price_delta, f.liquidity_delta,
           f.last_liq_event_interval_ms, l.n AS total_swaps, q.n AS total_liq_events
    FROM ({_features("l.time_delta_ms")}) f
    JOIN (SELECT candidate_id, count(*) AS n FROM price GROUP BY 1) l USING (candidate_id)
    LEFT JOIN (SELECT candidate_id, count(*) AS n FROM liq GROUP BY 1) q USING (candidate_id)""",
        True, **_FEATURES)
    out["feature_validation"] = _with("""
    SELECT candidate_id, timestamp_ms, price_delta, price_velocity,
           CASE WHEN price_velocity IS NOT NULL
                THEN abs(price_velocity * time_delta_ms - price_delta) < 0.0001 ELSE true END
             AS velocity_valid,
           CASE WHEN prev_timestamp_ms IS NULL
                THEN price_delta IS NULL AND price_velocity IS NULL ELSE true END AS first_row_valid
    FROM deriv""", **_FEATURES)
    life = """
    SELECT candidate_id, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts,
           max(timestamp_ms) - min(timestamp_ms) AS total_lifetime_ms, count(*) AS total_points
    FROM {} GROUP BY candidate_id"""
    out["token_lifecycle"] = _with(life.format("price"))
    out["token_lifecycle_liquidity"] = _with(life.format("liq"))
    probe_sql = (f"SELECT candidate_id, discovered_at + k * {DAY} AS at_ms FROM token_candidates, "
                 "range(-6, 30) r(k)")
    out["price_at"] = _with("""
    SELECT candidate_id, at_ms, coalesce(
      (SELECT arg_max(price, timestamp_ms) FROM price x
        WHERE x.candidate_id = p.candidate_id AND x.timestamp_ms <= p.at_ms),
      (SELECT arg_min(price, timestamp_ms) FROM price x WHERE x.candidate_id = p.candidate_id))
      AS price_at FROM probes p""", probes=probe_sql)
    out["liquidity_at"] = _with("""
    SELECT candidate_id, at_ms,
      (SELECT arg_max(liquidity, timestamp_ms) FROM liq x
        WHERE x.candidate_id = p.candidate_id AND x.timestamp_ms <= p.at_ms) AS liquidity_at,
      EXISTS (SELECT 1 FROM liq x WHERE x.candidate_id = p.candidate_id) AS has_liquidity
    FROM probes p""", probes=probe_sql)
    out["previous_liquidity_event"] = _with("""
    SELECT candidate_id, timestamp_ms,
      (SELECT max(timestamp_ms) FROM liq x
        WHERE x.candidate_id = p.candidate_id AND x.timestamp_ms < p.timestamp_ms) AS previous_ts
    FROM price p""")
    out["price_liquidity_exact"] = _with("""
    SELECT p.candidate_id, p.timestamp_ms, p.price, l.liquidity, l.liquidity_token, l.liquidity_quote
    FROM price p LEFT JOIN liq l USING (candidate_id, timestamp_ms)""", True)
    out.update(_discovery())
    out.update(_exits())
    out.update(_metrics())
    out.update(_quality())
    out.update(_tables())
    return out


EVAL_AT = 1704067200000 + 20 * DAY


def _cid(source: str, pool: str = "pool", mint: str = "mint") -> str:
    return (f"sha256({mint} || '|' || coalesce({pool}, '') || '|' || {source} || '|' || "
            "tx_signature || '|' || CAST(event_index AS VARCHAR) || '|' || CAST(slot AS VARCHAR))")


_CAND = "source, mint, pool, tx_signature, event_index, slot, timestamp AS discovered_at"


def _new(where: str) -> str:
    return f"""
    SELECT {_cid("'NEW_TOKEN'")} AS candidate_id, {_CAND} FROM (
      SELECT *, 'NEW_TOKEN' AS source, row_number() OVER (
        PARTITION BY mint ORDER BY slot, tx_signature, event_index) AS rn
      FROM swap_events WHERE {where}) WHERE rn = 1"""


SEED = "SELECT mint FROM token_candidates WHERE source = 'ACTIVE_TOKEN'"
UNSEEN = f"mint NOT IN ({SEED})"


def _window(table: str, amount: str, where: str) -> str:
    return f"""
    SELECT mint, sum({amount}) AS v24, sum({amount}) FILTER (timestamp >= {EVAL_AT - HOUR}) AS v1,
           count(*) AS n24, count(*) FILTER (timestamp >= {EVAL_AT - HOUR}) AS n1,
           CASE WHEN {EVAL_AT} - min(timestamp) >= {HOUR}
                THEN ({EVAL_AT} - min(timestamp)) / CAST({HOUR} AS DOUBLE) END AS hours
    FROM {table} WHERE timestamp >= {EVAL_AT - DAY} AND timestamp < {EVAL_AT} AND {where}
    GROUP BY mint"""


def _last(table: str) -> str:
    return f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mint
        ORDER BY timestamp DESC, slot, tx_signature, event_index) AS rn
      FROM {table} WHERE timestamp >= {EVAL_AT - HOUR} AND timestamp < {EVAL_AT}) WHERE rn = 1"""


def _discovery() -> dict[str, str]:
    out = {
        "new_token": _with(_new("true")),
        "new_token_unseen": _with(_new(UNSEEN)),
    }
    spike = "(v1 > 3.0 * (v24 / hours) OR n1 > 5.0 * (n24 / hours))"
    out["active_token_at"] = _with(f"""
    SELECT {_cid("'ACTIVE_TOKEN'")} AS candidate_id, 'ACTIVE_TOKEN' AS source, {_CAND[8:]}
    FROM win JOIN last USING (mint) WHERE {spike}""",
        win=_window("swap_events", "amount_out", UNSEEN), last=_last("swap_events"))
    out["liquidity_spike"] = _with(f"""
    SELECT {_cid("'ACTIVE_TOKEN'")} AS candidate_id, 'ACTIVE_TOKEN' AS source, {_CAND[8:]}
    FROM (SELECT w.mint, l.pool, l.tx_signature, l.event_index, l.slot, l.timestamp
          FROM win w JOIN last l USING (mint) WHERE {spike}
          UNION ALL
          SELECT q.mint, '' AS pool, l.tx_signature, l.event_index, l.slot, l.timestamp
          FROM qwin q JOIN qlast l USING (mint) JOIN win w USING (mint)
          WHERE q.v1 > 2.0 * (q.v24 / q.hours)
            AND NOT coalesce((w.v1 > 3.0 * (w.v24 / w.hours) OR w.n1 > 5.0 * (w.n24 / w.hours)), false))""",
        win=_window("swap_events", "amount_out", "true"), last=_last("swap_events"),
        qwin=_window("liquidity_events", "abs(amount_quote)", "true"),
        qlast=_last("liquidity_events"))
    meta = "SELECT candidate_id, 'm' || mint AS mint FROM token_candidates"
    spikes = f"""
    SELECT {_cid("'ACTIVE_TOKEN'", "NULL")} AS candidate_id, 'ACTIVE_TOKEN' AS source, mint,
           CAST(NULL AS VARCHAR) AS pool, tx_signature, event_index, slot, timestamp,
           round(volume_1h, 6) AS volume_1h, swaps_1h, round(volume_24h_avg, 6) AS volume_24h_avg,
           round(swaps_24h_avg, 6) AS swaps_24h_avg,
           volume_1h > 3.0 * volume_24h_avg AS volume_spike,
           swaps_1h > 5.0 * swaps_24h_avg AS swaps_spike
    FROM (SELECT mint, sum(amount_out) AS volume_1h, count(*) AS swaps_1h,
                 arg_max(tx_signature, (timestamp, event_index)) AS tx_signature,
                 arg_max(event_index, (timestamp, event_index)) AS event_index,
                 arg_max(slot, (timestamp, event_index)) AS slot, max(timestamp) AS timestamp
          FROM swaps JOIN meta USING (candidate_id)
          WHERE timestamp >= (SELECT max(timestamp) FROM swaps) - {HOUR}
            AND timestamp < (SELECT max(timestamp) FROM swaps) GROUP BY mint) h
    JOIN (SELECT mint, sum(amount_out) / CAST(24 AS DOUBLE) AS volume_24h_avg,
                 count(*) / CAST(24 AS DOUBLE) AS swaps_24h_avg
          FROM swaps JOIN meta USING (candidate_id)
          WHERE timestamp >= (SELECT max(timestamp) FROM swaps) - {DAY}
            AND timestamp < (SELECT max(timestamp) FROM swaps) GROUP BY mint) d USING (mint)
    WHERE volume_1h > 3.0 * volume_24h_avg OR swaps_1h > 5.0 * swaps_24h_avg"""
    out["active_token_sql"] = _with("SELECT * FROM spikes", meta=meta, spikes=spikes)
    cols = "candidate_id, source, mint, pool, tx_signature, event_index, slot, timestamp"
    out["all_discovery"] = _with(f"""
    SELECT {_cid("'NEW_TOKEN'", "NULL")} AS candidate_id, 'NEW_TOKEN' AS source, mint,
           CAST(NULL AS VARCHAR) AS pool, tx_signature, event_index, slot, timestamp FROM (
      SELECT *, row_number() OVER (PARTITION BY mint ORDER BY slot, tx_signature, event_index) AS rn
      FROM swaps JOIN meta USING (candidate_id)) WHERE rn = 1
    UNION ALL
    SELECT {cols} FROM spikes WHERE mint NOT IN (
      SELECT m.mint FROM token_candidates c JOIN meta m USING (candidate_id)
      WHERE c.source = 'ACTIVE_TOKEN')""", meta=meta, spikes=spikes)
    out["discovery_validation"] = _with(f"""
    SELECT *, stored_id = computed_id AS id_matches FROM (
      SELECT stored_id, source, mint, pool, tx_signature, event_index, slot,
             {_cid("source")} AS computed_id
      FROM (SELECT c.candidate_id AS stored_id, c.source, m.mint, c.pool, f.tx_signature,
                   f.event_index, c.slot
            FROM token_candidates c JOIN meta m USING (candidate_id) LEFT JOIN (
              SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
                ORDER BY slot, tx_signature, event_index) AS rn FROM swaps) WHERE rn = 1) f
            ON f.candidate_id = c.candidate_id))""", meta=meta)
    windows = f"""
    SELECT a.mint, a.timestamp,
           coalesce(sum(b.amount_out) FILTER (b.timestamp >= a.timestamp - {HOUR}), 0) AS volume_1h,
           count(b.timestamp) FILTER (b.timestamp >= a.timestamp - {HOUR}) AS swaps_1h,
           coalesce(sum(b.amount_out), 0) AS volume_24h, count(b.timestamp) AS swaps_24h,
           min(b.timestamp) AS first_24h
    FROM swap_events a LEFT JOIN swap_events b
      ON a.mint = b.mint AND b.timestamp >= a.timestamp - {DAY} AND b.timestamp < a.timestamp
    GROUP BY a.mint, a.timestamp"""
    out["trailing_windows"] = _with("""
    SELECT mint, timestamp, round(volume_1h, 6) AS volume_1h, swaps_1h,
           round(volume_24h, 6) AS volume_24h, swaps_24h, first_24h FROM windows""",
        windows=windows)
    hot = {"ev": _events(hot=True)}
    out["trailing_windows_hot"] = out["trailing_windows"].replace(_events(), _events(hot=True))
    out["active_token_hot"] = _with(f"""
    SELECT {_cid("'ACTIVE_TOKEN'")} AS candidate_id, 'ACTIVE_TOKEN' AS source, {_CAND[8:]}
    FROM win JOIN last USING (mint) WHERE {spike}""", **hot,
        win=_window("swap_events", "amount_out", "true"), last=_last("swap_events"))
    per_event = f"""
    SELECT {_cid("'ACTIVE_TOKEN'")} AS candidate_id, 'ACTIVE_TOKEN' AS source, {_CAND[8:]} FROM (
      SELECT s.*, row_number() OVER (PARTITION BY s.mint
          ORDER BY s.timestamp DESC, s.slot, s.tx_signature, s.event_index) AS rn
      FROM (SELECT mint, min(timestamp) AS eval FROM windows,
              LATERAL (SELECT (timestamp - first_24h) / CAST({HOUR} AS DOUBLE) AS hours)
            WHERE timestamp - first_24h >= {HOUR} AND swaps_1h > 0
              AND (volume_1h > 3.0 * (volume_24h / hours) OR swaps_1h > 5.0 * (swaps_24h / hours))
            GROUP BY mint) h
      JOIN swap_events s ON s.mint = h.mint AND s.timestamp < h.eval AND s.timestamp >= h.eval - {HOUR})
    WHERE rn = 1"""
    out["active_token_per_event"] = _with(
        f"SELECT * FROM ({per_event}) WHERE {UNSEEN}", windows=windows)
    out["replay_discovery"] = _with(_new(f"{UNSEEN} AND timestamp < {EVAL_AT}"))
    out["candidate_reconcile"] = _with("""
    SELECT candidate_id, a.source AS replayed_source, b.source AS stored_source
    FROM a FULL JOIN b USING (candidate_id) WHERE a.source IS NULL OR b.source IS NULL""",
        a=_new("true"), stored=_new("true"), b="""
    SELECT CASE WHEN slot % 3 = 0 THEN 'other-' || candidate_id ELSE candidate_id END AS candidate_id, source
    FROM stored""")
    return out


def _at(alias: str, t: str) -> str:
    """Price at or before a time, else the first price."""
    return f"""coalesce(
      (SELECT arg_max(price, timestamp_ms) FROM price x
        WHERE x.candidate_id = {alias}.candidate_id AND x.timestamp_ms <= {t}),
      (SELECT arg_min(price, timestamp_ms) FROM price x WHERE x.candidate_id = {alias}.candidate_id))"""


def _entry(days: int = 0) -> str:
    e = f"(c.discovered_at - {days * DAY})"
    return f"""
    SELECT c.candidate_id, c.source, {e} AS entry_signal_time, {_at('c', e)} AS entry_signal_price,
      (SELECT arg_max(liquidity, timestamp_ms) FROM liq x WHERE x.candidate_id = c.candidate_id
         AND x.timestamp_ms <= {e}) AS entry_liquidity
    FROM token_candidates c WHERE EXISTS (SELECT 1 FROM liq x WHERE x.candidate_id = c.candidate_id)
      AND EXISTS (SELECT 1 FROM price x WHERE x.candidate_id = c.candidate_id)"""


_ENTRY_COLS = "candidate_id, entry_signal_time, entry_signal_price, entry_liquidity"

TIME_EXIT = f"""
    SELECT {_ENTRY_COLS}, 'TIME_EXIT_' || source || '_{5 * DAY}ms' AS strategy_id,
           entry_signal_time + {5 * DAY} AS exit_signal_time,
           {_at('e', f'e.entry_signal_time + {5 * DAY}')} AS exit_signal_price,
           'TIME_EXIT' AS exit_reason, source FROM entry e"""

TRAILING = f"""
    SELECT e.candidate_id, e.entry_signal_time, e.entry_signal_price, e.entry_liquidity,
           'TRAILING_STOP_' || e.source || '_trail90_stop95_{5 * DAY}ms' AS strategy_id,
           coalesce(h.ts, e.entry_signal_time + {5 * DAY}) AS exit_signal_time,
           coalesce(h.price, {_at('e', f'e.entry_signal_time + {5 * DAY}')}) AS exit_signal_price,
           coalesce(h.reason, 'MAX_DURATION') AS exit_reason,
           coalesce(h.peak, greatest(e.entry_signal_price, a.top)) AS peak_price, e.source
    FROM entry e
    LEFT JOIN (SELECT candidate_id, max(peak) AS top FROM trail GROUP BY 1) a USING (candidate_id)
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ts) AS rn FROM trail
               WHERE reason IS NOT NULL) h ON h.candidate_id = e.candidate_id AND h.rn = 1"""

TRAIL_ROWS = f"""
    SELECT *, CASE WHEN price <= entry_price * (1 - CAST(0.95 AS DOUBLE)) THEN 'INITIAL_STOP'
                   WHEN price <= peak * (1 - CAST(0.90 AS DOUBLE)) THEN 'TRAILING_STOP'
                   WHEN ts - entry_time >= {5 * DAY} THEN 'MAX_DURATION' END AS reason
    FROM (SELECT p.candidate_id, p.timestamp_ms AS ts, p.price, e.entry_signal_price AS entry_price,
                 e.entry_signal_time AS entry_time,
                 greatest(e.entry_signal_price, max(p.price) OVER (
                   PARTITION BY p.candidate_id ORDER BY p.timestamp_ms)) AS peak
          FROM price p JOIN entry e USING (candidate_id) WHERE p.timestamp_ms > e.entry_signal_time)"""

GUARD_ROWS = f"""
    SELECT *, min(liquidity) OVER (PARTITION BY candidate_id ORDER BY ts) AS low,
           CASE WHEN liquidity < entry_liquidity * (1 - CAST(0.80 AS DOUBLE)) THEN 'LIQUIDITY_DROP'
                WHEN ts - entry_time >= {3 * DAY} THEN 'MAX_DURATION' END AS reason
    FROM (SELECT t.candidate_id, t.ts, e.entry_signal_time AS entry_time, e.entry_liquidity,
                 (SELECT arg_max(x.liquidity, x.timestamp_ms) FROM liq x
                   WHERE x.candidate_id = t.candidate_id AND x.timestamp_ms <= t.ts) AS liquidity
          FROM (SELECT candidate_id, timestamp_ms AS ts FROM price
                UNION SELECT candidate_id, timestamp_ms FROM liq) t
          JOIN entry e USING (candidate_id) WHERE t.ts > e.entry_signal_time)"""

GUARD = f"""
    SELECT e.candidate_id, e.entry_signal_time, e.entry_signal_price, e.entry_liquidity,
           'LIQUIDITY_GUARD_' || e.source || '_drop80_{3 * DAY}ms' AS strategy_id,
           coalesce(h.ts, e.entry_signal_time + {3 * DAY}) AS exit_signal_time,
           {_at('e', f'coalesce(h.ts, e.entry_signal_time + {3 * DAY})')} AS exit_signal_price,
           coalesce(h.reason, 'MAX_DURATION') AS exit_reason,
           least(e.entry_liquidity, coalesce(h.low, a.low)) AS min_liquidity, e.source
    FROM entry e
    LEFT JOIN (SELECT candidate_id, min(liquidity) AS low FROM guard_rows GROUP BY 1) a
      USING (candidate_id)
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ts) AS rn
               FROM guard_rows WHERE reason IS NOT NULL) h
      ON h.candidate_id = e.candidate_id AND h.rn = 1
    WHERE e.entry_liquidity IS NOT NULL"""

SCENARIOS = """
    SELECT scenario_id, CAST(d AS BIGINT) AS delay_ms, CAST(s AS DOUBLE) AS slip,
           CAST(f AS DOUBLE) AS fee, CAST(p AS DOUBLE) AS prio, CAST(m AS DOUBLE) AS mev
    FROM (VALUES ('optimistic', 100, 0.5, 0.000005, 0.0, 0.0),
                 ('realistic', 500, 2.0, 0.00001, 0.0001, 1.0),
                 ('pessimistic', 2000, 5.0, 0.0001, 0.001, 3.0),
                 ('degraded', 5000, 10.0, 0.001, 0.01, 5.0)) v(scenario_id, d, s, f, p, m)"""

TRADES = """
    SELECT sha256(candidate_id || '|' || strategy_id || '|' || scenario_id || '|' ||
                  CAST(entry_signal_time AS VARCHAR)) AS trade_id,
           candidate_id, strategy_id, scenario_id, entry_signal_time, entry_signal_price,
           entry_actual_time, entry_actual_price, entry_liquidity, CAST(1 AS DOUBLE) AS position_size,
           position_value, exit_signal_time, exit_signal_price, exit_actual_time, exit_actual_price,
           exit_reason, entry_cost_sol, exit_cost_sol, mev_cost_sol, total_cost_sol, total_cost_pct,
           gross_return, gross_return - total_cost_pct AS outcome,
           CASE WHEN gross_return - total_cost_pct > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome_class,
           exit_actual_time - entry_actual_time AS hold_duration_ms, peak_price, min_liquidity
    FROM (SELECT *, entry_cost_sol + exit_cost_sol + mev_cost_sol AS total_cost_sol,
                 (entry_cost_sol + exit_cost_sol + mev_cost_sol) / position_value AS total_cost_pct,
                 (exit_actual_price - entry_actual_price) / entry_actual_price AS gross_return
          FROM (SELECT *, entry_signal_time + delay_ms AS entry_actual_time,
                       entry_signal_price * (1 + slip / 200) AS entry_actual_price,
                       entry_signal_price * (1 + slip / 200) AS position_value,
                       exit_signal_time + delay_ms AS exit_actual_time,
                       exit_signal_price * (1 - slip / 200) AS exit_actual_price,
                       fee + prio AS entry_cost_sol, fee + prio AS exit_cost_sol,
                       entry_signal_price * (1 + slip / 200) * (mev / 100) AS mev_cost_sol
                FROM (SELECT *, NULL::DOUBLE AS peak_price, NULL::DOUBLE AS min_liquidity FROM time_exit
                      UNION ALL BY NAME SELECT *, NULL::DOUBLE AS min_liquidity FROM trailing_exit
                      UNION ALL BY NAME SELECT *, NULL::DOUBLE AS peak_price FROM guard), scenarios))"""

_EXITS = dict(entry=_entry(), time_exit=TIME_EXIT, trail=TRAIL_ROWS, trailing_exit=TRAILING,
              guard_rows=GUARD_ROWS, guard=GUARD, scenarios=SCENARIOS, trades=TRADES)


S_RULES = """
    SELECT kind, CAST(a AS DOUBLE) AS a, CAST(hold AS BIGINT) * 60000 AS hold
    FROM (VALUES ('TIME_EXIT', 0, 60), ('TIME_EXIT', 0, 300), ('TIME_EXIT', 0, 600), ('TIME_EXIT', 0, 1800),
                 ('TRAILING_STOP', 0.05, 3600), ('TRAILING_STOP', 0.10, 3600), ('TRAILING_STOP', 0.15, 3600),
                 ('TRAILING_STOP', 0.20, 3600), ('LIQUIDITY_GUARD', 0.20, 1800),
                 ('LIQUIDITY_GUARD', 0.30, 1800), ('LIQUIDITY_GUARD', 0.50, 1800)) v(kind, a, hold)"""

S_JOBS = """
    SELECT e.*, r.*, row_number() OVER (ORDER BY candidate_id, kind, a, hold) AS job,
           kind || '_' || source || CASE kind
             WHEN 'TIME_EXIT' THEN '' WHEN 'TRAILING_STOP' THEN '_trail' || CAST(round(a * 100) AS INT) || '_stop10'
             ELSE '_drop' || CAST(round(a * 100) AS INT) END || '_' || hold || 'ms' AS strategy_id
    FROM entry e, s_rules r WHERE kind <> 'LIQUIDITY_GUARD' OR entry_liquidity IS NOT NULL"""

S_TRAIL = """
    SELECT *, CASE WHEN price <= entry_signal_price * (1 - CAST(0.10 AS DOUBLE)) THEN 'INITIAL_STOP'
                   WHEN price <= peak * (1 - a) THEN 'TRAILING_STOP'
                   WHEN ts - entry_signal_time >= hold THEN 'MAX_DURATION' END AS reason
    FROM (SELECT j.*, p.timestamp_ms AS ts, p.price, greatest(j.entry_signal_price,
                   max(p.price) OVER (PARTITION BY job ORDER BY p.timestamp_ms)) AS peak
          FROM s_jobs j JOIN price p USING (candidate_id)
          WHERE kind = 'TRAILING_STOP' AND p.timestamp_ms > entry_signal_time)"""

S_GUARD = """
    SELECT *, min(liquidity) OVER (PARTITION BY job ORDER BY ts) AS low,
           CASE WHEN liquidity < entry_liquidity * (1 - a) THEN 'LIQUIDITY_DROP'
                WHEN ts - entry_signal_time >= hold THEN 'MAX_DURATION' END AS reason
    FROM (SELECT j.*, t.ts, t.liquidity
          FROM (SELECT u.candidate_id, u.ts, (SELECT arg_max(x.liquidity, x.timestamp_ms) FROM liq x
                   WHERE x.candidate_id = u.candidate_id AND x.timestamp_ms <= u.ts) AS liquidity
                FROM (SELECT candidate_id, timestamp_ms AS ts FROM price
                      UNION SELECT candidate_id, timestamp_ms FROM liq) u) t
          JOIN s_jobs j USING (candidate_id) WHERE kind = 'LIQUIDITY_GUARD' AND t.ts > entry_signal_time)"""

S_HITS = """
    SELECT job, arg_min(reason, ts) AS reason, min(ts) AS ts, arg_min(price, ts) AS price,
           arg_min(peak, ts) AS peak, CAST(NULL AS DOUBLE) AS low
    FROM s_trail WHERE reason IS NOT NULL GROUP BY job
    UNION ALL
    SELECT job, arg_min(reason, ts), min(ts), NULL, NULL, arg_min(low, ts)
    FROM s_guard WHERE reason IS NOT NULL GROUP BY job"""

S_ENDS = """
    SELECT job, max(peak) AS top, CAST(NULL AS DOUBLE) AS bottom FROM s_trail GROUP BY job
    UNION ALL SELECT job, NULL, min(low) FROM s_guard GROUP BY job"""

SWEEP = f"""
    SELECT candidate_id, strategy_id, exit_signal_time,
           {_at('z', 'z.exit_signal_time')} AS exit_signal_price, exit_reason, peak_price, min_liquidity
    FROM (SELECT j.candidate_id, j.strategy_id, coalesce(h.ts, j.entry_signal_time + j.hold) AS exit_signal_time,
                 coalesce(h.reason, CASE kind WHEN 'TIME_EXIT' THEN kind ELSE 'MAX_DURATION' END) AS exit_reason,
                 CASE WHEN kind = 'TRAILING_STOP' THEN
                   coalesce(h.peak, greatest(j.entry_signal_price, e.top)) END AS peak_price,
                 CASE WHEN kind = 'LIQUIDITY_GUARD' THEN
                   least(j.entry_liquidity, coalesce(h.low, e.bottom)) END AS min_liquidity
          FROM s_jobs j LEFT JOIN s_hits h USING (job) LEFT JOIN s_ends e USING (job)) z"""


def _exits() -> dict[str, str]:
    return {
        "parameter_sweep": _with(
            SWEEP, entry=_entry(), s_rules=S_RULES, s_jobs=S_JOBS, s_trail=S_TRAIL, s_guard=S_GUARD,
            s_hits=S_HITS, s_ends=S_ENDS),
        "time_exit": _with("SELECT * EXCLUDE (source) FROM time_exit", **_EXITS),
        "trailing_stop": _with("SELECT * EXCLUDE (source) FROM trailing_exit", **_EXITS),
        "liquidity_guard": _with("SELECT * EXCLUDE (source) FROM guard", **_EXITS),
        "trade_records": _with("SELECT * FROM trades", **_EXITS),
        "exits_hot": _with("""
    SELECT candidate_id, source, 'TIME_EXIT' AS strategy_type, * EXCLUDE (candidate_id, source), CAST(NULL AS DOUBLE) AS peak_price, CAST(NULL AS DOUBLE) AS min_liquidity FROM time_exit
    UNION ALL BY NAME SELECT *, 'TRAILING_STOP' AS strategy_type, CAST(NULL AS DOUBLE) AS min_liquidity FROM trailing_exit
    UNION ALL BY NAME SELECT *, 'LIQUIDITY_GUARD' AS strategy_type, CAST(NULL AS DOUBLE) AS peak_price FROM guard""",
            **_EXITS, ev=_events(hot=True), ev0=_events(hot=True), token_candidates=f"""
    SELECT key AS candidate_id, 'NEW_TOKEN' AS source, min(timestamp) + {5 * DAY} AS discovered_at FROM ev0 GROUP BY key"""),
        "rejected_jobs": _with(f"""
    SELECT candidate_id, source, 'LIQUIDITY_GUARD_' || source || '_drop80_{3 * DAY}ms' AS strategy_id,
           'entry liquidity cannot be determined' AS reason
    FROM entry WHERE entry_liquidity IS NULL""", entry=_entry(5)),
    }


# --- metrics and reports ------------------------------------------------------------------

WTRADES = f"""
    SELECT sha256(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' ||
                  CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) AS trade_id,
           CAST(l_partkey AS VARCHAR) AS candidate_id,
           ['TIME_EXIT', 'TRAILING_STOP', 'LIQUIDITY_GUARD'][l_suppkey % 3 + 1] || '_X' AS strategy_id,
           ['optimistic', 'realistic', 'pessimistic', 'degraded'][l_orderkey % 4 + 1] AS scenario_id,
           (epoch_us(l_shipdate) // 1000 // {DAY}) * {DAY} AS entry_signal_time, outcome,
           CASE WHEN outcome > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome_class
    FROM (SELECT *, (l_extendedprice / l_quantity - CAST(1400 AS DOUBLE)) / CAST(1400 AS DOUBLE)
            AS outcome FROM lineitem)"""

WCAND = """
    SELECT CAST(p_partkey AS VARCHAR) AS candidate_id,
           CASE WHEN p_partkey % 3 = 0 THEN 'ACTIVE_TOKEN' ELSE 'NEW_TOKEN' END AS source
    FROM part WHERE p_partkey % 7 <> 0"""

CANON = """CASE WHEN strategy_id LIKE 'TIME_EXIT%' THEN 'TIME_EXIT'
      WHEN strategy_id LIKE 'TRAILING_STOP%' THEN 'TRAILING_STOP'
      WHEN strategy_id LIKE 'LIQUIDITY_GUARD%' THEN 'LIQUIDITY_GUARD' ELSE strategy_id END"""


def _grouped(trades: str, candidates: str) -> str:
    return f"""
    SELECT t.* REPLACE ({CANON.replace("strategy_id", "t.strategy_id")} AS strategy_id),
           c.source AS entry_event_type
    FROM {trades} t JOIN {candidates} c USING (candidate_id)"""


K = "strategy_id, scenario_id, entry_event_type"

STEPS = f"""
    SELECT *, sum(outcome) OVER w AS cum,
           sum(CASE WHEN outcome > 0 THEN 1 ELSE 0 END) OVER w AS island
    FROM grouped WINDOW w AS (PARTITION BY {K} ORDER BY entry_signal_time, trade_id)"""

FALLS = f"""
    SELECT {K}, max(greatest(0, peak) - cum) AS dd FROM (
      SELECT *, max(cum) OVER (PARTITION BY {K} ORDER BY entry_signal_time, trade_id) AS peak
      FROM steps) GROUP BY {K}"""

STREAKS = f"""
    SELECT {K}, max(n) AS streak FROM (
      SELECT {K}, island, count(*) FILTER (outcome <= 0) AS n FROM steps GROUP BY {K}, island)
    GROUP BY {K}"""

TOKENS = f"""
    SELECT {K}, count(*) AS total_tokens, count(*) FILTER (m > 0) / CAST(count(*) AS DOUBLE) AS token_win_rate
    FROM (SELECT {K}, candidate_id, avg(outcome) AS m FROM grouped GROUP BY {K}, candidate_id)
    GROUP BY {K}"""


def _q(p: str) -> str:
    return f"round(quantile_cont(outcome, CAST({p} AS DOUBLE)), 6)"


def _own(s: str) -> str:
    return f"CASE WHEN scenario_id = '{s}' THEN round(avg(outcome), 6) END"


AGG = f"""
    SELECT {K}, count(*) AS total_trades, any_value(total_tokens) AS total_tokens,
           count(*) FILTER (outcome_class = 'WIN') AS wins,
           count(*) FILTER (outcome_class <> 'WIN') AS losses,
           round(count(*) FILTER (outcome_class = 'WIN') / CAST(count(*) AS DOUBLE), 6) AS win_rate,
           round(any_value(token_win_rate), 6) AS token_win_rate,
           round(avg(outcome), 6) AS outcome_mean, {_q('0.5')} AS outcome_median,
           {_q('0.1')} AS outcome_p10, {_q('0.25')} AS outcome_p25, {_q('0.75')} AS outcome_p75,
           {_q('0.9')} AS outcome_p90, round(min(outcome), 6) AS outcome_min,
           round(max(outcome), 6) AS outcome_max,
           round(coalesce(stddev_samp(outcome), 0), 6) AS outcome_stddev,
           round(any_value(dd), 6) AS max_drawdown, any_value(streak) AS max_consecutive_losses,
           {_own('realistic')} AS outcome_realistic, {_own('pessimistic')} AS outcome_pessimistic,
           {_own('degraded')} AS outcome_degraded
    FROM grouped JOIN falls USING ({K}) JOIN streaks USING ({K}) JOIN tokens USING ({K})
    GROUP BY {K}"""

_WIDE = dict(wtrades=WTRADES, wcand=WCAND, grouped=_grouped("wtrades", "wcand"), steps=STEPS,
             falls=FALLS, streaks=STREAKS, tokens=TOKENS, agg=AGG)

DECIDED = """
    SELECT *, CASE WHEN pessimistic_median IS NULL THEN 'INSUFFICIENT_DATA'
                   WHEN go_positive AND go_median AND go_stable AND go_not_outliers
                     AND go_implementable AND NOT (nogo_low_positive OR nogo_median
                       OR nogo_edge_gone OR nogo_not_implementable) THEN 'GO'
                   ELSE 'NO-GO' END AS verdict
    FROM (SELECT *, positive_outcome_pct >= 5 AS go_positive, realistic_median > 0 AS go_median,
                 coalesce(realistic_median > 0 AND pessimistic_median > 0
                   AND pessimistic_median / realistic_median >= CAST(0.5 AS DOUBLE), false) AS go_stable,
                 outcome_p25 > 0 AS go_not_outliers, implementable AS go_implementable,
                 positive_outcome_pct < 5 AS nogo_low_positive, realistic_median <= 0 AS nogo_median,
                 coalesce(realistic_median > 0 AND pessimistic_median <= 0, false) AS nogo_edge_gone,
                 NOT implementable AS nogo_not_implementable
          FROM (SELECT r.strategy_id, r.entry_event_type,
                       round(r.token_win_rate * 100, 4) AS positive_outcome_pct,
                       r.outcome_mean AS realistic_mean, r.outcome_median AS realistic_median,
                       p.outcome_mean AS pessimistic_mean, p.outcome_median AS pessimistic_median,
                       coalesce(d.outcome_mean, 0) AS degraded_mean, r.outcome_p10, r.outcome_p25,
                       r.outcome_p75, r.outcome_p90, true AS implementable
                FROM (SELECT * FROM agg WHERE scenario_id = 'realistic') r
                LEFT JOIN (SELECT * FROM agg WHERE scenario_id = 'pessimistic') p
                  USING (strategy_id, entry_event_type)
                LEFT JOIN (SELECT * FROM agg WHERE scenario_id = 'degraded') d
                  USING (strategy_id, entry_event_type)))"""

SUMMARY = f"""
    SELECT count(*) AS total_candidates,
           count(*) FILTER (source = 'NEW_TOKEN') AS new_token_candidates,
           count(*) FILTER (source = 'ACTIVE_TOKEN') AS active_token_candidates,
           min(discovered_at) AS date_range_start, max(discovered_at) AS date_range_end,
           (SELECT count(DISTINCT trade_id) FROM wtrades) AS total_trades
    FROM token_candidates"""


def _metrics() -> dict[str, str]:
    ex = {**_EXITS, "grouped": _grouped("trades", "token_candidates"), "steps": STEPS,
          "falls": FALLS, "streaks": STREAKS, "tokens": TOKENS, "agg": AGG}
    out = {
        "strategy_aggregates": _with("SELECT * FROM agg", **_WIDE),
        "strategy_aggregates_exits": _with("SELECT * FROM agg", **ex),
        "missing_candidates": _with("""
    SELECT candidate_id, count(*) AS trades FROM wtrades
    WHERE candidate_id NOT IN (SELECT candidate_id FROM wcand) GROUP BY 1""", **_WIDE),
        "grouping_levels": _with(f"""
    SELECT strategy_id, scenario_id, entry_event_type,
           CAST(grouping(strategy_id, scenario_id, entry_event_type) AS INTEGER) AS level,
           count(*) AS total_trades,
           round(count(*) FILTER (outcome_class = 'WIN') / CAST(count(*) AS DOUBLE), 6) AS win_rate,
           round(avg(outcome), 6) AS outcome_mean
    FROM grouped GROUP BY GROUPING SETS
      ((strategy_id, scenario_id, entry_event_type), (strategy_id, scenario_id), (strategy_id))""",
            **_WIDE),
        "trade_metrics": _with(f"""
    SELECT strategy_id, scenario_id, count(*) AS trades,
           round(count(*) FILTER (outcome_class = 'WIN') / CAST(count(*) AS DOUBLE), 6) AS win_rate,
           count(*) FILTER (outcome > 0) AS wins, round(avg(outcome), 6) AS outcome_mean,
           round(min(outcome), 6) AS outcome_min, round(max(outcome), 6) AS outcome_max,
           round(coalesce(stddev_samp(outcome), 0), 6) AS outcome_stddev, {_q('0.1')} AS p10,
           {_q('0.25')} AS p25, {_q('0.5')} AS p50, {_q('0.75')} AS p75, {_q('0.9')} AS p90
    FROM wtrades GROUP BY 1, 2""", **_WIDE),
    }
    med = {s: f"coalesce(max(outcome_median) FILTER (scenario_id = '{s}'), 0)"
           for s in ("optimistic", "realistic", "pessimistic", "degraded")}
    out["scenario_pivot"] = _with(f"""
    SELECT *, CASE WHEN realistic_median <> 0 THEN
             round((realistic_median - pessimistic_median) / realistic_median * 100, 4)
             ELSE CAST(0 AS DOUBLE) END AS degradation_pct
    FROM (SELECT strategy_id, entry_event_type,
                 {', '.join(f'{e} AS {s}_median' for s, e in med.items())}
          FROM agg GROUP BY 1, 2)""", **_WIDE)

    def src(t: str, c: str) -> str:
        return f"coalesce(max({c}) FILTER (entry_event_type = '{t}'), 0)"

    out["source_comparison"] = _with(f"""
    SELECT *, round(new_token_win_rate - active_token_win_rate, 6) AS delta_win_rate,
           round(new_token_median - active_token_median, 6) AS delta_median
    FROM (SELECT strategy_id, scenario_id,
                 {src('NEW_TOKEN', 'win_rate')} AS new_token_win_rate,
                 {src('ACTIVE_TOKEN', 'win_rate')} AS active_token_win_rate,
                 {src('NEW_TOKEN', 'outcome_median')} AS new_token_median,
                 {src('ACTIVE_TOKEN', 'outcome_median')} AS active_token_median
          FROM agg WHERE scenario_id = 'realistic' GROUP BY 1, 2)""", **_WIDE)
    cells = ", ".join(f"max(value) FILTER (scenario_id = '{s}') AS {s}"
                      for s in ("optimistic", "realistic", "pessimistic", "degraded"))
    rows = " UNION ALL ".join(f"SELECT {K}, '{m}' AS metric, {m} AS value FROM agg"
                              for m in ("win_rate", "outcome_mean", "outcome_median", "max_drawdown"))
    out["metric_matrix"] = _with(f"""
    SELECT strategy_id, entry_event_type, metric, {cells} FROM ({rows}) GROUP BY 1, 2, 3""", **_WIDE)
    out["strategy_rank"] = _with("""
    SELECT entry_event_type, CAST(row_number() OVER (PARTITION BY entry_event_type
             ORDER BY outcome_median DESC, win_rate DESC, max_drawdown, strategy_id) AS INTEGER) AS rank,
           strategy_id, outcome_median, win_rate, max_drawdown
    FROM agg WHERE scenario_id = 'realistic'""", **_WIDE)
    out["best_strategies"] = _with("""
    SELECT strategy_id, entry_event_type, outcome_median, win_rate FROM agg
    WHERE scenario_id = 'realistic'
    ORDER BY outcome_median DESC, strategy_id, entry_event_type LIMIT 10""", **_WIDE)
    out["scenario_gap"] = _with("""
    SELECT r.strategy_id, r.entry_event_type, r.outcome_mean AS realistic_mean,
           r.outcome_median AS realistic_median, p.outcome_mean AS pessimistic_mean,
           p.outcome_median AS pessimistic_median
    FROM agg r JOIN agg p USING (strategy_id, entry_event_type)
    WHERE r.scenario_id = 'realistic' AND p.scenario_id = 'pessimistic'""", **_WIDE)
    out["strategy_counts"] = _with("""
    SELECT count(DISTINCT strategy_id) AS strategies, count(DISTINCT scenario_id) AS scenarios
    FROM agg""", **_WIDE)
    out["replay_references"] = _with(f"""
    SELECT DISTINCT {CANON} AS strategy_id, scenario_id, candidate_id FROM wtrades
    WHERE ({CANON}, scenario_id) IN (SELECT (strategy_id, scenario_id) FROM agg)""", **_WIDE)
    out["data_summary"] = _with("SELECT * FROM summary", summary=SUMMARY, **_WIDE)
    out["drawdown_and_streak"] = _with(f"""
    SELECT strategy_id, scenario_id, round(max(greatest(0, peak) - cum), 6) AS max_drawdown,
           any_value(streak) AS max_consecutive_losses
    FROM (SELECT *, max(cum) OVER w AS peak
          FROM (SELECT *, sum(outcome) OVER w AS cum FROM wtrades
                WINDOW w AS (PARTITION BY strategy_id, scenario_id ORDER BY entry_signal_time, trade_id))
          WINDOW w AS (PARTITION BY strategy_id, scenario_id ORDER BY entry_signal_time, trade_id))
    JOIN (SELECT strategy_id, scenario_id, max(n) AS streak FROM (
            SELECT strategy_id, scenario_id, island, count(*) FILTER (outcome <= 0) AS n
            FROM (SELECT *, sum(CASE WHEN outcome > 0 THEN 1 ELSE 0 END) OVER (
                    PARTITION BY strategy_id, scenario_id ORDER BY entry_signal_time, trade_id) AS island
                  FROM wtrades) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (strategy_id, scenario_id)
    GROUP BY 1, 2""", **_WIDE)
    return out


RUNS = """
    SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days
    FROM (SELECT day, day - row_number() OVER (ORDER BY day) AS island FROM days) GROUP BY island"""

CHECKS = f"""
    SELECT 1 AS check_no, 'Unique NEW_TOKEN candidates' AS name, '>= 300' AS threshold,
           CAST(count(*) AS DOUBLE) AS actual, count(*) >= 300 AS pass
    FROM token_candidates WHERE source = 'NEW_TOKEN'
    UNION ALL
    SELECT 2, 'Discovery uptime', '>= 7 days (continuous)', CAST(max(days) AS DOUBLE), max(days) >= 7
    FROM day_runs
    UNION ALL
    SELECT 3, 'Backtest data coverage', '>= 14 days',
           round((max(timestamp_ms) - min(timestamp_ms)) / CAST({DAY} AS DOUBLE), 6),
           max(timestamp_ms) - min(timestamp_ms) >= 14 * {DAY}
    FROM (SELECT timestamp_ms FROM price UNION ALL SELECT timestamp_ms FROM liq)
    UNION ALL
    SELECT 4, 'Duplicate candidate_id count', '= 0', CAST(count(*) AS DOUBLE), count(*) = 0
    FROM (SELECT candidate_id FROM token_candidates GROUP BY 1 HAVING count(*) > 1)
    UNION ALL
    SELECT 5, 'Missing events count', '= 0', CAST(a + b AS DOUBLE), a + b = 0
    FROM (SELECT (SELECT count(*) FROM token_candidates WHERE candidate_id NOT IN
                    (SELECT candidate_id FROM swaps)) AS a,
                 (SELECT count(*) FROM token_candidates WHERE candidate_id NOT IN
                    (SELECT candidate_id FROM liquidity_events)) AS b)
    UNION ALL
    SELECT 6, 'Replayable tokens', '= 100%',
           round((count(*) - count(*) FILTER (candidate_id NOT IN (SELECT candidate_id FROM price)))
                 / CAST(count(*) AS DOUBLE) * 100, 6),
           count(*) FILTER (candidate_id NOT IN (SELECT candidate_id FROM price)) = 0
    FROM token_candidates"""


def _digest(name: str, line: str, table: str) -> str:
    part = ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS UBIGINT)), 0)"
                     f" AS VARCHAR) AS s{i}" for i in range(4))
    return f"""
    SELECT '{name}' AS table_name, n AS rows,
           sha256(CAST(n AS VARCHAR) || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS digest
    FROM (SELECT count(*) AS n, {part} FROM (SELECT sha256({line}) AS h FROM {table}))"""


def _line(*cols: str) -> str:
    return " || '|' || ".join(
        f"coalesce(replace(replace({c}, chr(92), chr(92) || chr(92)), '|', chr(92) || 'p'), chr(92) || 'N')"
        for c in cols)


def _quality() -> dict[str, str]:
    checks = dict(day_runs=RUNS, checks=CHECKS,
                  days=f"SELECT DISTINCT discovered_at // {DAY} AS day FROM token_candidates")
    decided = {**_WIDE, "decided": DECIDED}
    out = {
        "sufficiency": _with("SELECT * FROM checks", **checks),
        "day_runs": _with("SELECT * FROM runs", runs=RUNS,
                          days=f"SELECT DISTINCT (timestamp + (timestamp // {5 * DAY}) * {2 * DAY}) // {DAY} AS day FROM ev"),
        "integrity_errors": _with("""
    SELECT candidate_id, 'no swaps' AS error FROM token_candidates WHERE candidate_id NOT IN (
      SELECT candidate_id FROM swaps WHERE CAST(candidate_id AS BIGINT) % 5 <> 0)
    UNION ALL
    SELECT candidate_id, 'no liquidity' FROM token_candidates WHERE candidate_id NOT IN (
      SELECT candidate_id FROM liquidity_events WHERE CAST(candidate_id AS BIGINT) % 7 <> 0)
    UNION ALL
    SELECT candidate_id, 'not replayable' FROM token_candidates WHERE candidate_id NOT IN (
      SELECT candidate_id FROM price WHERE CAST(candidate_id AS BIGINT) % 11 <> 0)"""),
        "decision": _with("SELECT * FROM decided", **decided),
        "decision_criteria": _with("""
    SELECT strategy_id, entry_event_type, criterion,
           CASE WHEN criterion LIKE 'nogo_%' THEN NOT flag ELSE flag END AS pass
    FROM (UNPIVOT (SELECT strategy_id, entry_event_type, COLUMNS('^(go|nogo)_.*') FROM decided)
          ON COLUMNS('^(go|nogo)_.*') INTO NAME criterion VALUE flag)""", **decided),
        "executive_summary": _with("""
    SELECT s.*, c.all_pass, c.failed, b.strategy_id, b.entry_event_type, b.outcome_median, b.win_rate,
           b.verdict, CASE WHEN NOT all_pass OR verdict IS NULL THEN 'INSUFFICIENT_DATA'
                           ELSE verdict END AS overall
    FROM summary s, (SELECT bool_and(pass) AS all_pass, count(*) FILTER (NOT pass) AS failed FROM checks) c,
         (SELECT a.strategy_id, a.entry_event_type, a.outcome_median, a.win_rate, d.verdict
          FROM agg a JOIN decided d USING (strategy_id, entry_event_type)
          WHERE a.scenario_id = 'realistic'
          ORDER BY a.outcome_median DESC, a.strategy_id, a.entry_event_type LIMIT 1) b""",
            summary=SUMMARY, **checks, **decided),
    }
    t = "CAST({} AS VARCHAR)".format
    f = "printf('%.8f', {})".format
    each = " UNION ALL ".join([
        _digest("candidates", _line("candidate_id", "source", "mint", "pool", "tx_signature",
                                    t("event_index"), t("slot"), t("discovered_at")), "token_candidates"),
        _digest("liquidity", _line("candidate_id", t("timestamp_ms"), t("slot"), f("liquidity"),
                                   f("liquidity_token"), f("liquidity_quote")), "liq"),
        _digest("price", _line("candidate_id", t("timestamp_ms"), t("slot"), f("price"), f("volume"),
                               t("swap_count")), "price")])
    out["dataset_fingerprint"] = _with("""
    SELECT table_name, rows, digest FROM each
    UNION ALL
    SELECT 'ALL', CAST(sum(rows) AS BIGINT), sha256(string_agg(digest, '|' ORDER BY table_name))
    FROM each""", each=each)
    return out


_LATEST = f"""
    SELECT candidate_id, mint, name, symbol, decimals, supply, fetched_at FROM (
      SELECT CAST(user_id AS VARCHAR) || '-' || CAST(day AS VARCHAR) AS candidate_id,
             CAST(user_id AS VARCHAR) AS mint, 'Token ' || user_id AS name, 'T' || user_id AS symbol,
             CAST(count(*) AS INTEGER) AS decimals, max(value) AS supply, day AS fetched_at,
             row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn
      FROM (SELECT *, (epoch_us(ts) // 1000 // {DAY}) * {DAY} AS day FROM events) GROUP BY user_id, day)
    WHERE rn = 1"""


def _tables() -> dict[str, str]:
    base = "candidate_id, slot, tx_signature, event_index, timestamp"
    stats = """
    SELECT candidate_id, count(*) AS events, count(*) FILTER (kind = 'swap') AS swaps,
           count(*) FILTER (kind = 'liquidity') AS liquidity_events, min(timestamp) AS first_ts,
           max(timestamp) AS last_ts FROM merged GROUP BY 1"""
    merged = f"""
    SELECT {base}, 'swap' AS kind, 1 AS tie, price, CAST(NULL AS DOUBLE) AS liquidity_after FROM swaps
    UNION ALL
    SELECT {base}, 'liquidity', 0, NULL, liquidity_after FROM liquidity_events"""
    diff = """
    SELECT trade_id, 'outcome' AS field, round(outcome + 1e-3, 6) AS stored_number, CAST(NULL AS VARCHAR) AS stored_text,
           round(outcome, 6) AS replayed_number, CAST(NULL AS VARCHAR) AS replayed_text FROM trades WHERE CAST(candidate_id AS BIGINT) % 5 = 0
    UNION ALL
    SELECT trade_id, 'peak_price', NULL, NULL, round(peak_price, 6), NULL FROM trades
    WHERE CAST(candidate_id AS BIGINT) % 7 = 0 AND peak_price IS NOT NULL
    UNION ALL
    SELECT trade_id, 'exit_reason', NULL, 'OTHER', NULL, exit_reason FROM trades WHERE CAST(candidate_id AS BIGINT) % 11 = 0"""
    out = {
        "merged_events": _with("SELECT * FROM merged", merged=merged),
        "event_statistics": _with(stats, merged=merged),
        "replay_apply": _with(stats, merged=merged),
        "ordering_check": _with(f"""
    SELECT candidate_id, line, prev_slot, slot FROM (
      SELECT candidate_id, line, slot, tx_signature, event_index, lag(slot) OVER w AS prev_slot,
             lag(tx_signature) OVER w AS prev_tx, lag(event_index) OVER w AS prev_index
      FROM (SELECT candidate_id, tx_signature, event_index, (slot * 10 + event_index) * 100000 + timestamp // {DAY} AS line,
                   timestamp // {DAY} AS slot FROM swaps_wide)
      WINDOW w AS (PARTITION BY candidate_id ORDER BY line))
    WHERE prev_slot IS NOT NULL
      AND NOT ((prev_slot, prev_tx, prev_index) < (slot, tx_signature, event_index))"""),
        "trade_diff": _with(diff, **_EXITS),
        "verification_summary": _with("""
    SELECT count(*) AS total_trades, count(*) FILTER (NOT bad) AS matched_trades,
           count(*) FILTER (bad) AS divergent_trades
    FROM (SELECT n % 5 = 0 OR n % 11 = 0 OR n % 13 = 0 OR (n % 7 = 0 AND peak_price IS NOT NULL) AS bad
          FROM (SELECT *, CAST(candidate_id AS BIGINT) AS n FROM trades))""", **_EXITS),
        "append_unique_skip": _with(f"SELECT * FROM swap_events WHERE timestamp >= {EVAL_AT}"),
        "repeated_keys": _with("""
    SELECT candidate_id, timestamp, count(*) AS n FROM swaps_wide GROUP BY 1, 2 HAVING count(*) > 1"""),
        "active_mints": _with(f"""
    SELECT DISTINCT mint FROM swap_events
    WHERE timestamp >= {EVAL_AT - DAY} AND timestamp < {EVAL_AT}"""),
        "time_range": _with("SELECT min(timestamp_ms) AS min_ts, max(timestamp_ms) AS max_ts FROM price"),
        "range_scans": _with(f"""
    SELECT count(*) FILTER (timestamp BETWEEN {EVAL_AT - 2 * DAY} AND {EVAL_AT}) AS closed,
           count(*) FILTER (timestamp >= {EVAL_AT - 2 * DAY} AND timestamp < {EVAL_AT}) AS half_open
    FROM swaps""", True),
        "resolve_candidates": _with("""
    SELECT CASE WHEN slot % 2 = 0 THEN candidate_id WHEN CAST(mint AS BIGINT) % 3 = 0 THEN 'c' || mint
                END AS candidate_id, mint, tx_signature, event_index, slot FROM liquidity_events"""),
        "latest_metadata": _LATEST,
        "decode_swaps": _with(f"""
    SELECT mint, 'P' || mint AS pool, tx_signature, 1 AS event_index, slot,
           (timestamp // 1000) * 1000 AS timestamp, CAST(0 AS DOUBLE) AS amount_out
    FROM swap_events WHERE slot % 7 <> 0 AND timestamp // 1000 < {EVAL_AT} // 1000"""),
        "decode_liquidity": _with("""
    SELECT 'short' AS pool, rpad('M' || mint, 32, '1') AS mint,
           CASE slot % 3 WHEN 0 THEN 'add' ELSE 'remove' END AS event_type,
           CAST(slot AS DOUBLE) AS amount_token, CAST(slot AS DOUBLE) AS amount_quote, tx_signature,
           2 AS event_index, slot, (timestamp // 1000) * 1000 AS timestamp
    FROM swap_events WHERE slot % 7 <> 0 AND slot % 3 < 2"""),
        "stream_new_token": _with(_new("true")),
        "stream_first_seen": _with("""
    SELECT * FROM even UNION ALL SELECT * FROM odd WHERE mint NOT IN (SELECT mint FROM even)""",
            even=_new(f"{UNSEEN} AND slot % 2 = 0"), odd=_new(f"{UNSEEN} AND slot % 2 = 1")),
        "stream_slot_buffer": _with("SELECT * FROM swap_events"),
        "stream_enriched": _with("""
    SELECT CASE WHEN CAST(mint AS BIGINT) % 3 = 0 THEN 'c' || mint END AS candidate_id, mint,
           tx_signature FROM liquidity_events"""),
        "backfill": _with(f"""
    SELECT 'swap' AS kind, CAST(NULL AS VARCHAR) AS candidate_id, mint, tx_signature, event_index, slot,
           timestamp, CAST(NULL AS VARCHAR) AS what, amount_out AS amount
    FROM swap_events WHERE timestamp < {EVAL_AT + 3 * DAY}
    UNION ALL
    SELECT 'liquidity', candidate_id, mint, tx_signature, event_index, slot, timestamp, event_type, amount_quote
    FROM liquidity_events WHERE timestamp < {EVAL_AT + 3 * DAY}
    UNION ALL
    SELECT 'candidate', candidate_id, mint, tx_signature, event_index, slot, discovered_at, source, NULL
    FROM fresh""", fresh=_new(f"timestamp < {EVAL_AT + 3 * DAY}")),
        "live_liquidity_series": _with("""
    SELECT c.candidate_id, l.timestamp_ms, l.slot, l.liquidity, l.liquidity_token, l.liquidity_quote
    FROM liq l JOIN fresh c ON c.mint = l.candidate_id""", fresh=_new("true")),
        "append_known_keys": _with(f"""
    SELECT mint, pool, tx_signature, event_index,
           CASE WHEN timestamp < {EVAL_AT} THEN slot ELSE slot + 5 END AS slot, timestamp, amount_out
    FROM swap_events"""),
        "rejected_rules": _with("""
    SELECT r.rule_no, r.source AS entry_event_type, r.strategy_type, r.reason, count(*) AS candidates
    FROM token_candidates JOIN refused r USING (source) GROUP BY 1, 2, 3, 4""", refused="""
    SELECT CAST(6 AS INTEGER) AS rule_no, 'NEW_TOKEN' AS source, 'MOON_SHOT' AS strategy_type, 'unknown strategy type' AS reason
    UNION ALL SELECT 7, 'ACTIVE_TOKEN', 'TIME_EXIT', 'TIME_EXIT requires hold_duration_ms'
    UNION ALL SELECT 8, 'NEW_TOKEN', 'TRAILING_STOP', 'TRAILING_STOP requires initial_stop_pct'"""),
    }
    out.update(_programs())
    out.update(_more_tables())
    out["recomputed_series"] = _with(
        "SELECT candidate_id, timestamp_ms, slot, price, round(volume, 6) AS volume, swap_count FROM price", True)
    d6 = "printf('%.6f', {})".format
    names = ["win_rate", "outcome_mean", "outcome_median", "outcome_p10", "outcome_p25",
             "outcome_p75", "outcome_p90", "outcome_min", "outcome_max", "outcome_stddev",
             "max_drawdown"]
    quoted = ", ".join(f"'\"' || {c} || '\"' AS {c}" for c in K.split(", "))
    whole = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in
                      ("total_trades", "wins", "losses", "max_consecutive_losses"))
    out["csv_text"] = _with(
        f"SELECT {quoted}, {whole}, {', '.join(f'{d6(c)} AS {c}' for c in names)} FROM agg", **_WIDE)
    return out


B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


# Columns of the trade report by kind.
TRADE_TEXT = ("trade_id", "candidate_id", "strategy_id", "scenario_id", "exit_reason", "outcome_class")
TRADE_WHOLE = ("entry_signal_time", "entry_actual_time", "exit_signal_time", "exit_actual_time", "hold_duration_ms")
TRADE_DOUBLE = (
    "entry_signal_price", "entry_actual_price", "entry_liquidity", "position_size", "position_value", "exit_signal_price",
    "exit_actual_price", "entry_cost_sol", "exit_cost_sol", "mev_cost_sol", "total_cost_sol", "total_cost_pct", "gross_return",
    "outcome", "peak_price", "min_liquidity")


def _programs() -> dict[str, str]:
    key = f"repeat('1', 31) || substr('{B58}', CAST(CAST(mint AS BIGINT) % 57 + 2 AS INTEGER), 1)"
    account = "rpad('K' || replace(mint, '0', 'z'), 40, '1')"
    second = "(timestamp // 1000) * 1000 AS timestamp"
    none = "CAST(NULL AS VARCHAR) AS pool"
    decoded = f"""
    SELECT {key} AS mint, 'pool' || mint AS pool, 'a' || tx_signature AS tx_signature, 0 AS event_index, slot, {second},
           CAST(NULL AS VARCHAR) AS event_type, CAST(slot AS DOUBLE) AS amount FROM swap_events
    UNION ALL
    SELECT '', 'pool' || mint, 'a' || tx_signature, 2, slot, {second},
           CASE WHEN slot % 2 = 0 THEN 'add' ELSE 'remove' END, CAST(slot AS DOUBLE) FROM swap_events
    UNION ALL
    SELECT CASE WHEN slot % 4 > 0 THEN 'T' || mint ELSE {key} END, CASE WHEN slot % 4 = 0 THEN 'pool' || mint END,
           'b' || tx_signature, 3, slot, {second}, NULL, 0 FROM swap_events
    UNION ALL
    SELECT CASE WHEN slot % 4 > 0 THEN 'T' || mint ELSE {key} END, 'pool' || mint,
           'b' || tx_signature, 0, slot, {second}, 'remove', 0 FROM swap_events"""
    return {
        "decode_amm_swaps": _with(f"""
    SELECT {key} AS mint, 'key1' AS pool, tx_signature, 0 AS event_index, slot, {second},
           CAST(slot AS DOUBLE) AS amount_out FROM swap_events"""),
        "decode_curve_swaps": _with(f"""
    SELECT CASE WHEN slot % 2 = 1 THEN 'T' || mint ELSE {account} END AS mint, {none}, tx_signature,
           3 AS event_index, slot, {second},
           CASE WHEN slot % 2 = 1 THEN CAST(slot AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS amount_out
    FROM swap_events"""),
        "decode_curve_liquidity": _with(f"""
    SELECT '' AS pool, CASE WHEN slot % 2 = 1 THEN 'T' || mint ELSE '' END AS mint,
           CASE WHEN slot % 5 = 0 THEN 'add' ELSE 'remove' END AS event_type,
           CAST(0 AS DOUBLE) AS amount_token, CAST(0 AS DOUBLE) AS amount_quote, tx_signature,
           0 AS event_index, slot, {second} FROM swap_events"""),
        "decoded_liquidity_events": _with(f"""
    SELECT 'T' || mint AS mint, tx_signature, 0 AS event_index, slot, {second},
           CASE WHEN slot % 5 = 0 THEN 'add' ELSE 'remove' END AS event_type
    FROM swap_events WHERE slot % 2 = 1"""),
        "decode_generic_swaps": _with(f"""
    SELECT {account} AS mint, tx_signature, 7 AS event_index FROM swap_events"""),
        "stream_decoded": _with(decoded),
        "decoded_events": _with(decoded),
        "compacted_series": _with("""
    SELECT candidate_id, timestamp_ms, slot, price, round(volume, 6) AS volume, swap_count, CAST(NULL AS BIGINT) AS swaps FROM price
    UNION ALL SELECT candidate_id, NULL, NULL, NULL, NULL, NULL, count(*) FROM swaps GROUP BY candidate_id""", True),
        "decode_inferred_mints": _with(f"""
    SELECT {key} AS mint, 'pool' || mint AS pool, tx_signature, 2 AS event_index, slot, {second},
           CAST(0 AS DOUBLE) AS amount_out FROM swap_events"""),
    }


def _more_tables() -> dict[str, str]:
    last = "(SELECT max(timestamp) FROM swap_events)"

    # four files that follow each other; at the end of each its last event is the time of evaluation
    cuts = f"""
    SELECT k, max(timestamp) AS due, (k + 1) * (SELECT max(slot) + 1 FROM swap_events) AS slots
    FROM range(4) t(k) JOIN swap_events ON slot * 4 < (k + 1) * (SELECT max(slot) + 1 FROM swap_events) GROUP BY k"""
    window = f"""
    SELECT k, mint, sum(amount_out) AS v24, sum(amount_out) FILTER (timestamp >= due - {HOUR}) AS v1,
           count(*) AS n24, count(*) FILTER (timestamp >= due - {HOUR}) AS n1,
           CASE WHEN any_value(due) - min(timestamp) >= {HOUR}
                THEN (any_value(due) - min(timestamp)) / CAST({HOUR} AS DOUBLE) END AS hours
    FROM swap_events JOIN cuts ON slot * 4 < slots AND timestamp >= due - {DAY} AND timestamp < due GROUP BY k, mint"""
    trigger = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, mint
        ORDER BY timestamp DESC, slot, tx_signature, event_index) AS rn
      FROM swap_events JOIN cuts ON slot * 4 < slots AND timestamp >= due - {HOUR} AND timestamp < due) WHERE rn = 1"""
    return {
        "scan_by_key": _with("SELECT * FROM swaps WHERE candidate_id = '7'"),
        "ingested_range": _with(f"""
    SELECT * FROM swaps WHERE timestamp >= {EVAL_AT - 3 * DAY} AND timestamp < {EVAL_AT}"""),
        "scan_by_attribute": _with("SELECT * FROM token_candidates WHERE source = 'ACTIVE_TOKEN'"),
        "trades_of_family": _with("""
    SELECT * FROM wtrades WHERE strategy_id LIKE 'TIME_EXIT%' AND scenario_id = 'realistic'""", **_WIDE),
        "newest_version": """
    SELECT o_custkey, max(o_orderkey) AS created_at, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus,
           arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""",
        "seen_mints": _with(f"SELECT DISTINCT mint FROM swap_events WHERE {UNSEEN}"),
        "enum_check": _with("""
    SELECT tx_signature, CASE WHEN slot % 10 = 0 THEN 'hold' END AS side, 'side' AS reason
    FROM swaps WHERE slot % 10 = 0 OR slot % 11 = 0"""),
        "run_statistics": _with("""
    SELECT (SELECT count(*) FROM token_candidates) AS candidates, (SELECT count(*) FROM trades) AS trades,
           (SELECT count(*) FROM (SELECT DISTINCT strategy_id, scenario_id, entry_event_type FROM grouped))
             AS aggregates,
           (SELECT count(*) * 3 FROM token_candidates) - (SELECT count(*) // 4 FROM trades) AS errors""",
            **_EXITS, grouped=_grouped("trades", "token_candidates")),
        "csv_text_trades": _with(f"""
    SELECT {', '.join(f"""'"' || {c} || '"' AS {c}""" for c in TRADE_TEXT)},
           {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in TRADE_WHOLE)},
           {', '.join(f"coalesce(left(printf('%.6f', {c}), CAST(length(printf('%.6f', {c})) - 2 AS BIGINT)) || '..', '') AS {c}" for c in TRADE_DOUBLE)} FROM trades""", **_EXITS),
        "csv_text_scenarios": _with(f"""
    SELECT '"' || strategy_id || '"' AS strategy_id, '"' || entry_event_type || '"' AS entry_event_type,
           {', '.join(f"printf('%.6f', coalesce(max(outcome_median) FILTER (scenario_id = '{x}'), 0)) AS outcome_{x}"
                      for x in ("optimistic", "realistic", "pessimistic", "degraded"))} FROM agg GROUP BY 1, 2""", **_WIDE),
        "ordered_trades": _with("""
    SELECT row_number() OVER (ORDER BY entry_signal_time, trade_id) - 1 AS position, trade_id, entry_signal_time FROM trades""", **_EXITS),
        "ordered_events": _with("""
    SELECT candidate_id, tx_signature, event_index, slot,
           row_number() OVER (ORDER BY slot, tx_signature, event_index, candidate_id) - 1 AS position FROM swaps_wide"""),
        "json_report": _LATEST,
        "token_metadata_decoded": _with("""
    SELECT candidate_id, mint, CASE WHEN n5 THEN NULL ELSE 'Token ' || mint END AS name, CASE WHEN n5 THEN NULL ELSE 'T' || mint END AS symbol,
           CAST(CAST(mint AS BIGINT) % 10 AS INTEGER) AS decimals, n / pow(10.0, CAST(mint AS BIGINT) % 10) AS supply, fetched_at
    FROM token_candidates JOIN (SELECT mint, CAST(mint AS BIGINT) % 5 = 0 AS n5, count(*) AS n, max(timestamp) AS fetched_at
                                FROM swap_events GROUP BY mint) USING (mint)"""),
        "replay_determinism": _with("SELECT count(DISTINCT mint) AS candidates, CAST(0 AS BIGINT) AS different FROM swap_events"),
        "required_fingerprint": _with("""
    SELECT (SELECT count(*) FROM price) + (SELECT count(*) FROM liq) AS rows, true AS accepted, true AS refused"""),
        "custom_exit_rule": _with(f"""
    SELECT candidate_id, exit_reason, exit_signal_time, exit_signal_price FROM time_exit WHERE source = 'NEW_TOKEN'
    UNION ALL
    SELECT candidate_id, 'TOP', arg_max(timestamp_ms, (price, -timestamp_ms)), max(price)
    FROM token_candidates JOIN price USING (candidate_id)
    WHERE source = 'NEW_TOKEN' AND timestamp_ms >= discovered_at AND timestamp_ms < discovered_at + {5 * DAY} GROUP BY candidate_id""", **_EXITS),
        "registered_decoder": _with(f"""
    SELECT mint, 'P' || mint AS pool, tx_signature, 1 AS event_index, slot, (timestamp // 1000) * 1000 AS timestamp,
           CAST(0 AS DOUBLE) AS amount_out FROM swap_events WHERE slot % 7 <> 0 AND timestamp // 1000 < {EVAL_AT} // 1000"""),
        "replay_fold_hot": _with("""
    SELECT candidate_id, count(*) AS events, arg_min(slot, (timestamp // 3600000, slot)) AS first_slot, arg_max(slot, (timestamp // 3600000, slot)) AS last_slot,
           CAST(coalesce(sum(abs(slot - before)), 0) AS BIGINT) AS moved
    FROM (SELECT *, lag(slot) OVER (PARTITION BY candidate_id ORDER BY timestamp // 3600000, slot) AS before FROM (
      SELECT candidate_id, slot, timestamp FROM swaps UNION ALL SELECT candidate_id, slot, timestamp FROM liquidity_events))
    GROUP BY candidate_id""", ev=_events(hot=True)),
        "stream_active_token": _with(f"""
    SELECT {_cid("'ACTIVE_TOKEN'")} AS candidate_id, 'ACTIVE_TOKEN' AS source, {_CAND[8:]}
    FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY k) AS hit FROM win JOIN last USING (k, mint)
          WHERE v1 > 3.0 * (v24 / hours) OR n1 > 5.0 * (n24 / hours)) WHERE hit = 1""",
            cuts=cuts, win=window, last=trigger),
        "stream_deduplicated": _with("SELECT * FROM swap_events"),
    }
