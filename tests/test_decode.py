import base64

from helpers import candidates, frame, rows_of

from marketlab import schemas
from marketlab.functions.base58 import encode
from marketlab.sources import decode

AMM, CURVE, TOKEN, NATIVE = (decode.AMM_PROGRAM, decode.CURVE_PROGRAM, decode.TOKEN_PROGRAM,
                             decode.WRAPPED_NATIVE)
NATIVE_BYTES = bytes.fromhex(decode._NATIVE_HEX)
MINT = bytes(range(1, 33))


def logs(spark, rows):
    return frame(spark, schemas.TX_LOGS, [
        {"tx_signature": f"t{i}", "slot": 10 + i, "block_time_s": 100 + i, "account_keys": [], **r}
        for i, r in enumerate(rows)])


def ray(data: bytes) -> str:
    return "Program log: ray_log: " + base64.b64encode(data).decode()


def test_base58():
    assert encode(NATIVE_BYTES) == NATIVE
    assert encode(b"\0\0\1") == "112" and encode(bytes(32)) == "1" * 32


def test_usable_transactions(spark):
    df = logs(spark, [{"logs": ["x"]}, {"logs": ["x"], "err": "bad"}, {"logs": ["x"], "block_time_s": None},
                      {"logs": ["x"], "block_time_s": 200}])
    assert rows_of(decode.usable(df, 100_000, 200_000), "tx_signature", "timestamp") == [("t0", 100_000)]


def test_text_swaps(spark):
    df = decode.usable(logs(spark, [{"logs": ["noise", "Program log: Swap mint=Abc1 pool=Pool9",
                                              "Program log: Swap mint=Def2"]}]))
    assert rows_of(decode.text_swaps(df), "mint", "pool", "event_index") == [
        ("Abc1", "Pool9", 1), ("Def2", None, 2)]


def test_generic_swaps(spark):
    mint = "A" * 40
    df = decode.usable(logs(spark, [{"logs": [f"TRADE done MINT: {mint}", "swap mint=short"]}]))
    assert rows_of(decode.generic_swaps(df), "mint", "event_index") == [(mint, 0)]


def swap_data(disc, first, second, amount_out, cut=None):
    return bytes([disc]) + bytes(32) + first + second + (7).to_bytes(8, "little") + \
        amount_out.to_bytes(8, "little")


def test_amm_swaps(spark):
    keys = [f"key{i}" for i in range(18)]
    big = 2**64 - 1
    df = decode.usable(logs(spark, [
        {"logs": ["x", ray(swap_data(9, NATIVE_BYTES, MINT, 12345))], "account_keys": keys},
        {"logs": [ray(swap_data(0x0B, MINT, NATIVE_BYTES, big))], "account_keys": keys},
        {"logs": [ray(swap_data(3, MINT, NATIVE_BYTES, 1)), "ray_log: ===", ray(b"")], "account_keys": keys},
        {"logs": [ray(swap_data(9, MINT, MINT, 1))], "account_keys": keys[:17]},
        {"logs": [ray(b"\x0d\x01")], "account_keys": keys[:17] + ["M" * 32]},
        {"logs": [ray(swap_data(9, NATIVE_BYTES, NATIVE_BYTES, 4))], "account_keys": keys}]))
    assert rows_of(decode.amm_swaps(df), "tx_signature", "mint", "pool", "event_index", "amount_out") == [
        ("t0", encode(MINT), "key1", 1, 12345.0), ("t1", encode(MINT), "key1", 0, float(big)),
        ("t4", "M" * 32, "key1", 0, 0.0)]


def test_amm_liquidity(spark):
    data = lambda d: bytes([d]) + (11).to_bytes(8, "little") + (22).to_bytes(8, "little")
    keys = ["a", "pool", NATIVE, AMM, "b", "K" * 40]
    df = decode.usable(logs(spark, [{"logs": [ray(data(3)), ray(data(4)), ray(data(9)), ray(b"\x03")],
                                     "account_keys": keys}]))
    assert rows_of(decode.amm_liquidity(df), "event_index", "event_type", "amount_token", "amount_quote",
                   "pool", "mint") == [
        (0, "add", 11.0, 22.0, "pool", "K" * 40), (1, "remove", 11.0, 22.0, "pool", "K" * 40),
        (3, "add", 0.0, 0.0, "pool", "K" * 40)]


BUY, SELL = "Program log: Instruction: Buy", "Program log: Instruction: Sell"
ENTER, LEAVE = f"Program {CURVE} invoke [1]", f"Program {CURVE} success"


def test_curve_swaps_state(spark):
    lines = [BUY, ENTER, "mint=AAA token_amount: 500", BUY, ENTER, SELL, LEAVE, BUY, ENTER, BUY,
             "amount=99999999999999999999999", "amount=7 mint=BBB", SELL, LEAVE]
    df = decode.usable(logs(spark, [{"logs": lines}]))
    # entering again clears the amount but keeps the mint; leaving clears both
    assert rows_of(decode.curve_swaps(df), "event_index", "mint", "amount_out") == [
        (3, "AAA", 500.0), (5, "AAA", 0.0), (9, "", 0.0), (12, "BBB", 7.0)]


def test_curve_swaps_take_the_mint_from_the_accounts(spark):
    mint = "M" * 44
    keys = ["a", "b", mint, "d", "e", "f", "g", TOKEN]
    df = decode.usable(logs(spark, [{"logs": [ENTER, BUY], "account_keys": keys},
                                    {"logs": [ENTER, BUY], "account_keys": keys[:7]},
                                    {"logs": [ENTER, BUY], "account_keys": keys[:2] + [NATIVE] + keys[3:]}]))
    assert rows_of(decode.curve_swaps(df), "tx_signature", "mint") == [("t0", mint), ("t1", ""), ("t2", "")]


def test_curve_liquidity_counts_events(spark):
    df = decode.usable(logs(spark, [{"logs": [ENTER, "mint=AAA", "Program log: Instruction: Create", "x",
                                              "Program log: Instruction: Migrate", LEAVE]}]))
    assert rows_of(decode.curve_liquidity(df), "event_index", "event_type", "mint") == [
        (0, "add", "AAA"), (1, "remove", "AAA")]


def account(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def test_accounts_fill_missing_mints(spark):
    keys = [f"key{i}" for i in range(7)]
    accounts = frame(spark, schemas.ACCOUNTS, [
        {"pubkey": "key5", "data": account(NATIVE_BYTES + bytes(40))},
        {"pubkey": "key6", "data": account(MINT + bytes(40))}])
    df = logs(spark, [{"logs": [f"Program {AMM} invoke", ENTER, BUY, LEAVE], "account_keys": keys},
                      {"logs": [ENTER, BUY, LEAVE], "account_keys": keys}])
    assert rows_of(decode.swap_events(df, accounts), "tx_signature", "mint", "pool") == [
        ("t0", encode(MINT), "key1")]
    assert decode.swap_events(df).isEmpty()


def test_liquidity_events_find_their_candidate(spark):
    mint = "K" * 40
    data = bytes([3]) + bytes(16)
    df = logs(spark, [{"logs": [ray(data)], "account_keys": ["a", "pool", "b", "c", "d", mint]}])
    out = decode.liquidity_events(df, None, candidates(spark, [{"candidate_id": "c9", "mint": mint}]))
    assert rows_of(out, "candidate_id", "mint", "event_type") == [("c9", mint, "add")]


def test_registered_decoder(spark):
    df = logs(spark, [{"logs": ["Program log: Swap mint=Abc1"]}])
    assert rows_of(decode.swap_events(df, decoders={"own": decode.text_swaps}), "mint") == [("Abc1",)]


def test_token_metadata(spark):
    supply = (5_000_000).to_bytes(8, "little")
    mint_data = bytes(36) + supply + bytes([6]) + bytes(37)
    name, symbol = b"Coin\0\0", b"CN\0"
    text = bytes([4]) + bytes(64) + len(name).to_bytes(4, "little") + name + \
        len(symbol).to_bytes(4, "little") + symbol + bytes(40)
    c = candidates(spark, [{"mint": "m1"}, {"candidate_id": "c2", "mint": "m2"}, {"candidate_id": "c3", "mint": "m3"}])
    mints = frame(spark, schemas.ACCOUNTS, [
        {"pubkey": m, "data": account(mint_data), "fetched_at": 9} for m in ("m1", "m2")]
        + [{"pubkey": "m3", "data": account(bytes(50)), "fetched_at": 9}])
    bad = bytes([4]) + bytes(64) + (2**32 - 1).to_bytes(4, "little") + bytes(60)
    names = spark.createDataFrame([("m1", account(text)), ("m2", account(bad))], "mint string, data string")
    out = decode.token_metadata(mints, names, c)
    assert rows_of(out, "mint", "name", "symbol", "decimals", "supply", "fetched_at") == [
        ("m1", "Coin", "CN", 6, 5.0, 9), ("m2", None, None, 6, 5.0, 9)]


def test_one_scan_for_all_programs_and_kinds(spark):
    keys = [f"key{i}" for i in range(18)]
    lines = [ray(swap_data(0x0D, MINT, NATIVE_BYTES, 5)), ENTER, "mint=AAA", BUY, "Program log: Instruction: Create",
             ray(b"\x04" + bytes(16))]
    df = logs(spark, [{"logs": lines, "account_keys": keys}, {"logs": ["nothing"]}, {"logs": None}])
    decoded = decode.events(df)
    assert rows_of(decoded, "kind", "event_index", "mint", "event_type", "amount") == [
        ("liquidity", 0, "AAA", "add", 0.0), ("liquidity", 5, "", "remove", 0.0), ("swap", 0, encode(MINT), None, 5.0),
        ("swap", 3, "AAA", None, 0.0)]
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan and plan.count("Generate") == 1


def test_only_incomplete_events_meet_the_accounts(spark):
    keys = [f"key{i}" for i in range(7)]
    accounts = frame(spark, schemas.ACCOUNTS, [
        {"pubkey": "key5", "data": account(MINT + bytes(40))}, {"pubkey": "key6", "data": account(bytes(32) + bytes(40))}])
    first = logs(spark, [{"logs": [f"Program {AMM} invoke", ENTER, "mint=AAA", BUY, LEAVE, ENTER, BUY], "account_keys": keys},
                         {"logs": [f"Program {AMM} invoke", ENTER, "mint=BBB", BUY], "account_keys": keys},
                         {"logs": [f"Program {AMM} invoke", ENTER, BUY], "account_keys": keys[:6]}])
    # a swap without a mint fills the pool of its whole transaction, a complete transaction is left alone
    assert rows_of(decode.swap_events(first, accounts), "tx_signature", "event_index", "mint", "pool") == [
        ("t0", 3, "AAA", "key1"), ("t0", 6, encode(MINT), "key1"), ("t1", 3, "BBB", None)]
    only = frame(spark, schemas.ACCOUNTS, [{"pubkey": "key6", "data": account(NATIVE_BYTES)}, {"pubkey": "key5", "data": account(b"short")}])
    assert rows_of(decode.swap_events(first, only).where("event_index = 6"), "mint") == [(NATIVE,)]


def test_accounts_are_not_broadcast_in_copies(spark):
    logs = [f"Program {decode.AMM_PROGRAM} invoke [1]", f"Program {decode.CURVE_PROGRAM} invoke [1]", "Program log: Instruction: Sell"]
    tx = frame(spark, schemas.TX_LOGS, [{"tx_signature": "t", "slot": 1, "block_time_s": 1, "logs": logs, "account_keys": list("abcdefg")}])
    data = base64.b64encode(bytes([0] * 31 + [5] + [0] * 40)).decode()
    accounts = spark.range(1).selectExpr("'g' AS pubkey", f"'{data}' AS data")
    found = decode.swap_events(tx, accounts)
    plan = found.select("mint")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_salt" in x]
    assert found.count() == 1


def test_a_transaction_is_decoded_once(spark):
    tx = logs(spark, [{"logs": [ray(swap_data(0x0D, MINT, NATIVE_BYTES, 5))], "account_keys": [f"key{i}" for i in range(18)]}, {"logs": []}])
    decoded = decode.events(tx)
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64") == 1  # not once more in a filter that asks whether there are events
    assert rows_of(decoded, "mint", "amount") == [(encode(MINT), 5.0)]


def test_a_pair_of_accounts_is_written_as_text_once(spark):
    keys = [f"key{i}" for i in range(7)]
    accounts = frame(spark, schemas.ACCOUNTS, [{"pubkey": "key5", "data": account(MINT + bytes(40))}, {"pubkey": "key6", "data": account(bytes(72))}])
    df = logs(spark, [{"tx_signature": f"t{i}", "logs": [f"Program {AMM} invoke", ENTER, BUY, LEAVE], "account_keys": keys} for i in range(9)])
    found = decode.swap_events(df, accounts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ArrowEvalPython")  # text is written before the events are joined, not for each
    assert rows_of(found, "tx_signature", "mint") == [(f"t{i}", encode(MINT)) for i in range(9)]
