"""Swaps, liquidity events and token metadata from raw transaction logs and accounts.

Everything is a row-wise expression over the transaction table (no shuffle), so the same
functions serve batch and streaming input.  The decoder of a program is an array column: the
events that it finds in a transaction, evaluated only where the logs name the program or its
format.  All programs are decoded in one projection, whose arrays are concatenated and exploded,
so the transactions are read once however many programs and kinds of events there are.  Only
base58 text needs Python, and only for exploded events.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions.base58 import base58
from marketlab.operators.joins import resolve_candidates, salted_join
from marketlab.schemas import LIQUIDITY_EVENTS, SWAP_EVENTS, TOKEN_METADATA, conform
from marketlab.session import materialize

# Fixed program and token addresses.
AMM_PROGRAM = "675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8"
CURVE_PROGRAM = "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P"
TOKEN_PROGRAM = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"
WRAPPED_NATIVE = "So11111111111111111111111111111111111111112"
# Fixed log patterns.
SWAP_TEXT = r"Program log: Swap mint=([A-Za-z0-9]+)(?: pool=([A-Za-z0-9]+))?"
GENERIC_TEXT = r"(?i)(?:swap|trade|exchange).*mint[=:]?\s*([A-Za-z0-9]{32,44})"
AMM_LOG = r"ray_log: ([A-Za-z0-9+/=]+)"
MINT_TEXT = r"mint=([A-Za-z0-9]+)"
AMOUNT_TEXT = r"(?:amount|token_amount)[=:]?\s*(\d+)"
ADDRESS = "^[123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz]{32,44}$"
# Fixed discriminators (first byte, hex) of the binary AMM log, and the wrapped native mint in it.
SWAP_BYTES = ["09", "0B", "0D", "0E"]
ADD_BYTE, REMOVE_BYTE = "03", "04"
_NATIVE_HEX = "069B8857FEAB8184FB687F634618C035DAC439DC1AEB3B5598A0F00000000001"

TX = ["tx_signature", "slot", "timestamp"]


def usable(tx_logs: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Successful transactions with a block time inside [start, end) at second grain."""
    s = F.col("block_time_s")
    out = tx_logs.where("err is null and block_time_s is not null")
    if start_ms is not None:
        out = out.where(s >= start_ms // 1000)
    if end_ms is not None:
        out = out.where(s < end_ms // 1000)
    return out.withColumn("timestamp", s * 1000)


def log_lines(tx: DataFrame) -> DataFrame:
    """One row per log line; the event index is the position of the line."""
    return tx.select(*TX, "account_keys", F.posexplode("logs").alias("event_index", "line"))


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- text logs ----------------------------------------------------------------------------

def text_swaps(tx: DataFrame) -> DataFrame:
    """``Swap mint=… pool=…`` lines; the pool is optional."""
    lines = log_lines(tx).where(F.col("line").rlike(SWAP_TEXT))
    return lines.select(
        F.regexp_extract("line", SWAP_TEXT, 1).alias("mint"),
        _empty_to_null(F.regexp_extract("line", SWAP_TEXT, 2)).alias("pool"),
        "tx_signature", "event_index", "slot", "timestamp", F.lit(0.0).alias("amount_out"))


def generic_swaps(tx: DataFrame) -> DataFrame:
    """Fallback for unknown programs: any swap-like line that names a mint."""
    lines = log_lines(tx).where(F.col("line").rlike(GENERIC_TEXT))
    return lines.select(
        F.regexp_extract("line", GENERIC_TEXT, 1).alias("mint"),
        F.lit(None).cast("string").alias("pool"), "tx_signature", "event_index", "slot",
        "timestamp", F.lit(0.0).alias("amount_out"))


# --- binary AMM logs ----------------------------------------------------------------------

def little_endian(data: str | Column, offset: int | Column, size: int = 8) -> Column:
    """Unsigned little-endian integer at a byte offset, as decimal(20,0)."""
    data = F.col(data) if isinstance(data, str) else data
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    h = F.hex(F.substring(data, start, F.lit(size)))
    pairs = [F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)")


def _key(i: int) -> Column:
    return F.try_element_at("account_keys", F.lit(i + 1))


def _first_mint_key() -> Column:
    """First account key that looks like an address and is neither currency nor program."""
    return F.try_element_at(F.filter(
        "account_keys", lambda k: ~k.isin(WRAPPED_NATIVE, AMM_PROGRAM)
        & F.length(k).between(32, 44)), F.lit(1))


EVENT = ("struct<kind:string,event_index:int,mint:string,raw:binary,pool:string,event_type:string,"
         "amount:double,quote:double>")


def _event(kind: str, index: Column, **fields) -> Column:
    """One decoded event; a mint is text, or ``raw`` bytes that are still to be written as base58."""
    given = {"kind": F.lit(kind), "event_index": index, **fields}
    names = ("kind", "event_index", "mint", "raw", "pool", "event_type", "amount", "quote")
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(EVENT)


def _rays() -> Column:
    """Position and bytes of the binary lines of a transaction."""
    lines = F.transform("logs", lambda line, i: F.struct(
        i.cast("int").alias("pos"),
        F.try_to_binary(F.regexp_extract(line, AMM_LOG, 1), F.lit("base64")).alias("data")))
    return F.filter(lines, lambda r: F.octet_length(r["data"]) > 0)


def amm_events() -> Column:
    """Binary swap, deposit and withdraw logs.

    A swap trades the mint that is not the wrapped native token and needs the 18 accounts of a
    swap instruction; account 1 is the pool.  Deposits and withdrawals have both raw amounts.
    """
    def one(r: Column) -> Column:
        data, index = r["data"], r["pos"]
        size, disc = F.octet_length(data), F.hex(F.substring(data, 1, 1))

        def other(offset: int) -> Column:
            b = F.substring(data, offset + 1, 32)
            return F.when((size >= 97) & (F.hex(b) != _NATIVE_HEX), b)

        def amount(offset: int, least: int) -> Column:
            return F.when(size >= least, little_endian(data, offset).cast("double")).otherwise(0.0)

        swap = _event("swap", index, raw=F.coalesce(other(33), other(65)), mint=_first_mint_key(),
                      pool=_empty_to_null(_key(1)), amount=amount(105, 113))
        change = _event(
            "liquidity", index, pool=F.coalesce(_key(1), F.lit("")),
            mint=F.coalesce(F.when(F.size("account_keys") > 5, _first_mint_key()), F.lit("")),
            event_type=F.when(disc == ADD_BYTE, "add").otherwise("remove"), amount=amount(1, 17), quote=amount(9, 17))
        return (F.when(disc.isin(SWAP_BYTES) & (F.size("account_keys") >= 18), swap)
                .when(disc.isin(ADD_BYTE, REMOVE_BYTE), change))

    found = F.transform(_rays(), one)
    return F.filter(found, lambda e: e.isNotNull() & (e["raw"].isNotNull() | e["mint"].isNotNull()))


# --- bonding-curve logs: a scan with state inside one transaction --------------------------

_STATE = "struct<inside:boolean,mint:string,amount:double,found:array<struct<pos:int,kind:string,mint:string,amount:double>>>"


def _any_of(line: Column, texts: list[str]) -> Column:
    return reduce(Column.__or__, [line.contains(t) for t in texts])


def _scan(kinds: dict[str, list[str]], finish: Callable[[Column], Column]) -> Column:
    """Fold over the log lines of a row: inside-program flag, current mint, pending amount.

    Entering the program clears the amount but keeps the mint; leaving clears both.  Every
    line that holds one of the texts of a kind emits an event with the state so far.  ``finish``
    takes the array of all events found.
    """
    def found(line: Column, pattern: str) -> Column:
        return _empty_to_null(F.regexp_extract(line, pattern, 1))

    steps = F.transform("logs", lambda line, i: F.struct(
        i.cast("int").alias("pos"),
        line.contains(f"Program {CURVE_PROGRAM} invoke").alias("enter"),
        (line.contains(f"Program {CURVE_PROGRAM} success")
         | line.contains(f"Program {CURVE_PROGRAM} failed")).alias("leave"),
        found(line, MINT_TEXT).alias("mint"),
        found(line, AMOUNT_TEXT).alias("amount"),
        F.array_compact(F.array(*[F.when(_any_of(line, texts), F.lit(kind))
                                  for kind, texts in kinds.items()])).alias("kinds")))

    def unsigned(text: Column) -> Column:
        n = text.try_cast("decimal(38,0)")
        return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n.cast("double"))

    def state(inside, mint, amount, events) -> Column:
        return F.struct(inside.alias("inside"), mint.alias("mint"), amount.alias("amount"),
                        events.alias("found")).cast(_STATE)

    def step(acc: Column, x: Column) -> Column:
        mint = F.coalesce(x["mint"], acc["mint"])
        amount = F.coalesce(unsigned(x["amount"]), acc["amount"])
        new = F.transform(x["kinds"], lambda k: F.struct(
            x["pos"].alias("pos"), k.alias("kind"), mint.alias("mint"), amount.alias("amount")))
        return (
            F.when(x["enter"], state(F.lit(True), acc["mint"], F.lit(0.0), acc["found"]))
            .when(x["leave"], state(F.lit(False), F.lit(""), F.lit(0.0), acc["found"]))
            .when(~acc["inside"], acc)
            .otherwise(state(acc["inside"], mint, amount, F.concat(acc["found"], new)))
        )

    start = F.expr(f"cast(named_struct('inside', false, 'mint', '', 'amount', 0.0D, "
                   f"'found', array()) as {_STATE})")
    return F.aggregate(steps, start, step, lambda acc: finish(acc["found"]))


def curve_events() -> Column:
    """Buy and Sell are swaps, Create adds and Migrate removes liquidity.

    The mint of a swap comes from the log or from account 2.  Swaps are numbered by their line,
    liquidity events by their order.
    """
    layout = (_key(7) == TOKEN_PROGRAM) | F.coalesce(_key(8) == TOKEN_PROGRAM, F.lit(False))
    from_keys = F.when(
        (F.size("account_keys") >= 8) & layout & _key(2).rlike(ADDRESS)
        & ~_key(2).isin(WRAPPED_NATIVE, CURVE_PROGRAM), _key(2))
    kinds = {"swap": ["Program log: Instruction: Buy", "Program log: Instruction: Sell"],
             "add": ["Program log: Instruction: Create"], "remove": ["Program log: Instruction: Migrate"]}

    def swap(e: Column) -> Column:
        return _event("swap", e["pos"], mint=F.coalesce(_empty_to_null(e["mint"]), from_keys, F.lit("")), amount=e["amount"])

    def change(e: Column, i: Column) -> Column:
        return _event("liquidity", i, pool=F.lit(""), mint=e["mint"], event_type=e["kind"], amount=F.lit(0.0), quote=F.lit(0.0))

    return _scan(kinds, lambda found: F.concat(
        F.transform(F.filter(found, lambda e: e["kind"] == "swap"), swap),
        F.transform(F.filter(found, lambda e: e["kind"] != "swap"), change)))


# --- decoders by program -------------------------------------------------------------------

@dataclass(frozen=True)
class LogDecoder:
    """Events of one program (an array of EVENT over ``logs`` and ``account_keys``) and where it runs.

    A transaction goes to the decoder if one of its log lines holds ``text``.
    """

    events: Callable[[], Column]
    text: str

    def found(self) -> Column:
        here = F.exists("logs", lambda line: line.contains(self.text))
        return F.when(here, self.events()).otherwise(F.array().cast(f"array<{EVENT}>"))


Decoder = LogDecoder | Callable[[DataFrame], DataFrame]
DECODERS: dict[str, Decoder] = {
    AMM_PROGRAM: LogDecoder(amm_events, "ray_log: "),  # its lines also come below other programs
    CURVE_PROGRAM: LogDecoder(curve_events, f"Program {CURVE_PROGRAM} invoke"),
}


def register_decoder(program: str, decoder: Decoder) -> None:
    """Add a program: an array column runs where the logs name the program, a function on all transactions.

    A function returns (mint, pool, tx_signature, event_index, slot, timestamp) and amount_out for
    swaps or event_type, amount_token, amount_quote for liquidity events.
    """
    DECODERS[program] = decoder


def _exploded(tx: DataFrame, decoders: list[LogDecoder]) -> DataFrame:
    """All events of all decoders in one pass, with the accounts that can still name a missing mint.

    ``ask`` is null unless something is to be filled in: the pool of the transaction and the two
    token accounts, for transactions that name the AMM program, have its accounts, and hold a
    liquidity event or a swap without a mint.
    """
    found = tx.select(*TX, "logs", "account_keys", F.concat(*[d.found() for d in decoders]).alias("_events"))
    amm = F.exists("logs", lambda line: line.contains(AMM_PROGRAM)) & (F.size("account_keys") >= 7)
    open_swap = F.exists("_events", lambda e: (e["kind"] == "swap") & (e["mint"] == "") & e["raw"].isNull())
    ask = F.when(amm, F.struct(_key(1).alias("pool"), _key(5).alias("a"), _key(6).alias("b")))
    asked = found.select(*TX, F.when(open_swap, ask).alias("swap_ask"), ask.alias("liquidity_ask"), "_events")
    # explode would make the optimizer ask for the size of the array in a filter below, which decodes once more
    rows = asked.select(*TX, "swap_ask", "liquidity_ask", F.explode_outer("_events").alias("e")).where("e is not null")
    rows = rows.select(*TX, "e.*", F.when(F.col("e.kind") == "swap", F.col("swap_ask"))
                       .otherwise(F.col("liquidity_ask")).alias("ask"))
    return rows.withColumn("mint", F.coalesce(base58("raw"), "mint")).drop("raw")


def events(tx_logs: DataFrame, accounts: DataFrame | None = None, start_ms: int | None = None,
           end_ms: int | None = None, decoders: dict[str, Decoder] | None = None,
           staged: bool = False) -> DataFrame:
    """Swaps and liquidity events of all registered programs, told apart by ``kind``; one scan.

    With ``accounts`` the decoded events are stored, and only those without a mint meet the
    snapshots of the accounts.  ``staged`` stores what is not stored yet, for callers that read the
    events several times.
    """
    tx = usable(tx_logs, start_ms, end_ms)
    by_program = list((decoders or DECODERS).values())
    inline = [d for d in by_program if isinstance(d, LogDecoder)]
    none = "cast(null as struct<pool:string,a:string,b:string>)"
    parts = [_exploded(tx, inline)] if inline else []
    for fn in by_program:
        if not isinstance(fn, LogDecoder):
            own = fn(tx)
            kind = "swap" if "amount_out" in own.columns else "liquidity"
            amounts = ("amount_out",) if kind == "swap" else ("amount_token", "amount_quote")
            kinds = F.lit(None).cast("string") if kind == "swap" else F.col("event_type")
            parts.append(own.select(
                *TX, F.lit(kind).alias("kind"), "event_index", "mint", "pool", kinds.alias("event_type"),
                F.col(amounts[0]).alias("amount"),
                (F.col(amounts[1]) if amounts[1:] else F.lit(None).cast("double")).alias("quote"), F.expr(none).alias("ask")))
    out = reduce(DataFrame.unionByName, parts)
    if accounts is not None:
        return _filled(out, accounts, staged)
    return materialize(out.drop("ask"), "decoded") if staged else out.drop("ask")


def _account_mints(accounts: DataFrame, asked: DataFrame) -> DataFrame:
    """(acct, raw): the mint bytes that the snapshots of the asked accounts hold."""
    data = F.try_to_binary("data", F.lit("base64"))
    return accounts.select(F.col("pubkey").alias("acct"), data.alias("d")).join(asked, "acct", "left_semi").where(
        F.octet_length("d") >= 32).groupBy("acct").agg(F.max(F.substring("d", 1, 32)).alias("raw"))


def _filled(decoded: DataFrame, accounts: DataFrame, staged: bool = False) -> DataFrame:
    """Fill empty pools from the transaction and empty mints from account snapshots.

    Of the two token accounts the one that is not the wrapped native token wins, then the first.
    A pair of accounts is looked up and written as text once; the events meet that one row,
    hot pairs spread over salts.
    """
    decoded = materialize(decoded.withColumn("pool", F.coalesce(_empty_to_null(F.col("pool")), "ask.pool", "pool")), "decoded")
    names = [c for c in decoded.columns if c != "ask"]
    open_ = (F.col("mint") == "") & F.col("ask").isNotNull()
    whole = decoded.where(~open_).select(*names)
    rest = decoded.where(open_).select(*names, F.struct("ask.a", "ask.b").alias("pair"))
    pairs = rest.select("pair").distinct().select("pair", "pair.a", "pair.b")
    mints = _account_mints(accounts, pairs.select(F.explode(F.array("a", "b")).alias("acct")).distinct())
    for c in ("a", "b"):
        pairs = salted_join(pairs, mints.select(F.col("acct").alias(c), F.col("raw").alias(f"raw_{c}")), c, "pair")
    other = [F.when(F.hex(f"raw_{c}") != _NATIVE_HEX, F.col(f"raw_{c}")) for c in ("a", "b")]
    texts = pairs.select("pair", base58(F.coalesce(*other, "raw_a", "raw_b")).alias("text"))
    rest = salted_join(rest, texts, "pair", "tx_signature").withColumn("mint", F.coalesce("text", "mint")).select(*names)
    return whole.unionByName(materialize(rest, "filled") if staged else rest)


def as_swaps(decoded: DataFrame) -> DataFrame:
    return decoded.where("kind = 'swap'").select(
        "mint", "pool", "tx_signature", "event_index", "slot", "timestamp", F.col("amount").alias("amount_out"))


def as_liquidity(decoded: DataFrame) -> DataFrame:
    return decoded.where("kind = 'liquidity'").select(
        "pool", "mint", "event_type", F.col("amount").alias("amount_token"), F.col("quote").alias("amount_quote"),
        "tx_signature", "event_index", "slot", "timestamp")


def amm_swaps(tx: DataFrame) -> DataFrame:
    return as_swaps(_exploded(tx, [DECODERS[AMM_PROGRAM]]))


def amm_liquidity(tx: DataFrame) -> DataFrame:
    return as_liquidity(_exploded(tx, [DECODERS[AMM_PROGRAM]]))


def curve_swaps(tx: DataFrame) -> DataFrame:
    return as_swaps(_exploded(tx, [DECODERS[CURVE_PROGRAM]]))


def curve_liquidity(tx: DataFrame) -> DataFrame:
    return as_liquidity(_exploded(tx, [DECODERS[CURVE_PROGRAM]]))


def complete_swaps(decoded: DataFrame) -> DataFrame:
    """Rows of ``swap_events``; swaps without a mint are dropped."""
    return conform(as_swaps(decoded).where("mint <> ''"), SWAP_EVENTS)


def complete_liquidity(decoded: DataFrame) -> DataFrame:
    """Rows of ``liquidity_events``; a mint or a pool is enough to find the candidate later."""
    return conform(as_liquidity(decoded).where("mint <> '' or coalesce(pool, '') <> ''"), LIQUIDITY_EVENTS)


def swap_events(tx_logs: DataFrame, accounts: DataFrame | None = None,
                start_ms: int | None = None, end_ms: int | None = None,
                decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Swaps of all registered programs; rows without a mint are dropped at the end."""
    return complete_swaps(events(tx_logs, accounts, start_ms, end_ms, decoders))


def liquidity_events(tx_logs: DataFrame, accounts: DataFrame | None = None,
                     candidates: DataFrame | None = None, start_ms: int | None = None,
                     end_ms: int | None = None,
                     decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Liquidity events with their candidate where the mint is already known."""
    found = complete_liquidity(events(tx_logs, accounts, start_ms, end_ms, decoders))
    return found if candidates is None else resolve_candidates(found, candidates)


# --- token metadata -----------------------------------------------------------------------

def token_metadata(mint_accounts: DataFrame, name_accounts: DataFrame,
                   candidates: DataFrame) -> DataFrame:
    """Metadata from account snapshots.

    ``mint_accounts(pubkey, data, fetched_at)`` hold supply and decimals,
    ``name_accounts(mint, data)`` length-prefixed name and symbol.
    """
    m = (
        mint_accounts.withColumn("d", F.try_to_binary("data", F.lit("base64")))
        .where(F.octet_length("d") >= 82)
        .select(
            F.col("pubkey").alias("mint"), "fetched_at",
            F.conv(F.hex(F.substring("d", 45, 1)), 16, 10).cast("int").alias("decimals"),
            little_endian("d", 36).cast("double").alias("raw"))
        .withColumn("supply", F.col("raw") / F.pow(F.lit(10.0), F.col("decimals")))
    )
    size = F.octet_length("d")

    def text(at: Column, length: Column) -> Column:
        body = F.decode(F.substring(F.col("d"), at + 1, length), "UTF-8")
        return _empty_to_null(F.rtrim(body, F.lit("\u0000")))

    def length_at(at: int | Column) -> Column:
        return F.least(little_endian(F.col("d"), at, 4), F.lit(1_000_000)).cast("int")

    name_len = F.when(size >= 69, length_at(65))
    name_ok = (F.col("n") <= 100) & (69 + F.col("n") <= size)
    sym_at = 69 + F.col("n")
    sym_len = F.when(name_ok & (sym_at + 4 <= size), length_at(sym_at))
    n = (
        name_accounts.withColumn("d", F.try_to_binary("data", F.lit("base64")))
        .where((size >= 100) & (F.hex(F.substring("d", 1, 1)) == "04"))
        .withColumn("n", name_len).withColumn("s", sym_len)
        .select("mint", F.when(name_ok, text(F.lit(69), F.col("n"))).alias("name"),
                F.when((F.col("s") <= 20) & (sym_at + 4 + F.col("s") <= size),
                       text(sym_at + 4, F.col("s"))).alias("symbol"))
    )
    c = candidates.select("candidate_id", "mint")
    return conform(c.join(m, "mint").join(n, "mint", "left"), TOKEN_METADATA)
