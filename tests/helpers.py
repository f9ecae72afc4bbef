"""Small builders for test relations."""

from marketlab import schemas


def frame(spark, schema, rows):
    """Rows given as dicts; missing columns are NULL."""
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def swaps(spark, rows):
    out = []
    for i, r in enumerate(rows):
        out.append({"candidate_id": "c1", "tx_signature": f"tx{i:04d}", "event_index": 0, "slot": i,
                    "side": "buy", "amount_in": 1.0, "amount_out": 1.0, "price": 1.0, **r})
    return frame(spark, schemas.SWAPS, out)


def swap_events(spark, rows):
    out = []
    for i, r in enumerate(rows):
        out.append({"mint": "m1", "tx_signature": f"tx{i:04d}", "event_index": 0, "slot": i,
                    "amount_out": 1.0, **r})
    return frame(spark, schemas.SWAP_EVENTS, out)


def price(spark, points, candidate="c1"):
    return frame(spark, schemas.PRICE_TIMESERIES, [
        {"candidate_id": candidate, "timestamp_ms": t, "slot": t, "price": float(p), "volume": 1.0,
         "swap_count": 1} for t, p in points])


def liquidity(spark, points, candidate="c1"):
    return frame(spark, schemas.LIQUIDITY_TIMESERIES, [
        {"candidate_id": candidate, "timestamp_ms": t, "slot": t, "liquidity": float(x),
         "liquidity_token": float(x), "liquidity_quote": float(x)} for t, x in points])


def candidates(spark, rows):
    return frame(spark, schemas.TOKEN_CANDIDATES, [
        {"candidate_id": "c1", "source": "NEW_TOKEN", "mint": "m1", "tx_signature": "tx",
         "event_index": 0, "slot": 0, "discovered_at": 0, **r} for r in rows])


def rows_of(df, *cols, order=None):
    data = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(data, key=order or (lambda r: tuple((x is None, x) for x in r)))
