"""Benchmark decontamination with templates: numbers, names and units become typed placeholders.

Items and documents go through the same canonicalisation; windows of ``window`` template words are hashed
and joined.  A document that covers enough windows of an item is compared slot by slot: along an
alignment every value of the item must always be met by the same value of the document.  Equal values are
a verbatim copy, other values used consistently are a re-parameterised question, and a clash means that
only the wording around the slots is alike.  Every alignment that covers enough windows by itself is
judged, and the longest one in any case; the item is reported if one of them has no clash.  Column
expressions only.

The windows of the items are stored first, so Spark knows their size: it sends them to all tasks while
they are below its own broadcast threshold and shuffles both sides by hash beyond it.

Defined cases: a null or empty text has no windows; items of fewer than ``least`` words are not looked for,
other short ones by a window of all their words; windows with more placeholders than words are left out;
items of equal template are looked for once and reported all; a verdict belongs to a text: rows of equal
text share it, whatever their ids, and rows without an id or with a repeated one are judged by their own
text; an empty benchmark finds nothing.  Only ``doc_id``, ``text`` and ``item_id`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import table
from marketlab.session import materialize

NUMBER, NAME, UNIT = "0n", "0p", "0u"
# Units of measure that may follow a number.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "oz",
         "lb", "lbs", "ton", "tons", "ml", "l", "liter", "liters", "s", "sec", "seconds", "min", "minute", "minutes", "h",
         "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar",
         "dollars", "euro", "euros", "cents", "usd", "eur", "gbp", "km/h", "mph", "m/s", "c", "f", "k", "w", "kw", "v", "hz")
# Java repeats a group by recursion unless it is possessive: a run of thousands would overflow the stack and end the executor.
_NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*+"
_NAME = r"(?<=[\p{Ll}\p{N},;] )\p{Lu}[\p{L}\p{M}]*(?:[ '’-]\p{Lu}[\p{L}\p{M}]*)*+"
_UNIT = rf"(?i)(?<={NUMBER}  ?)({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"


def _stages(text: Column) -> tuple[Column, Column, Column]:
    numbered = F.regexp_replace(text, _NUMBER, f" {NUMBER} ")
    named = F.regexp_replace(numbered, _NAME, f" {NAME} ")
    return numbered, named, F.regexp_replace(named, _UNIT, f" {UNIT} ")


def template(text: Column) -> Column:
    """Template words of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_remove(F.split(F.lower(_stages(text)[2]), r"[^\p{L}\p{M}\p{N}]+"), "")


def slot_values(text: Column) -> Column:
    """Map from placeholder to the values it stands for, in order."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    numbered, named, _ = _stages(text)
    return F.create_map(
        F.lit(NUMBER), F.regexp_extract_all(text, F.lit(f"({_NUMBER})")),
        F.lit(NAME), F.regexp_extract_all(numbered, F.lit(f"({_NAME})")),
        F.lit(UNIT), F.transform(F.regexp_extract_all(named, F.lit(_UNIT)), F.lower))


def _window_hashes(words: str, size: Column | int) -> Column:
    """Hash of each run of ``size`` words."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.size(words) - size
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, size)))


def benchmark_windows(benchmark: DataFrame, window: int = 8, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Windows (h, template_id, at, size, n_windows) and members (template_id, item_id), both stored."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), template(F.col("text")).alias("words")).where(
        (F.size("words") >= least) & F.col("item_id").isNotNull())
    whole = items.withColumn("template_id", F.min("item_id").over(Window.partitionBy("words")))
    whole = materialize(whole.select("item_id", "template_id", "words"), "benchmark_items")
    size = F.least(F.lit(window), F.size("words"))
    slots = F.transform("words", lambda w: w.isin(NUMBER, NAME, UNIT).cast("int"))
    cut = whole.where("item_id = template_id").select(
        "template_id", size.alias("size"), slots.alias("slots"), F.posexplode(_window_hashes("words", size)).alias("at", "h"))
    placeholders = F.aggregate(F.slice("slots", F.col("at") + 1, F.col("size")), F.lit(0), lambda a, b: a + b)
    cut = cut.where(2 * placeholders <= F.col("size")).drop("slots")
    cut = cut.withColumn("n_windows", F.count("*").over(Window.partitionBy("template_id")))
    return materialize(cut.select("h", "template_id", "at", "size", "n_windows"), "benchmark_windows"), whole


def _slots(texts: DataFrame, key: str) -> DataFrame:
    """(key, at, kind, value) of each placeholder of the texts."""
    words = texts.select(key, F.posexplode(template(F.col("text"))).alias("at", "kind")).where(F.col("kind").isin(NUMBER, NAME, UNIT))
    order = Window.partitionBy(key, "kind").orderBy("at")
    words = words.withColumn("i", F.row_number().over(order) - 1)
    values = texts.select(key, F.explode(slot_values(F.col("text"))).alias("kind", "vs")).select(key, "kind", F.posexplode("vs").alias("i", "value"))
    return words.join(values, [key, "kind", "i"]).select(key, "at", "kind", "value")


def text_key(text: Column) -> Column:
    """A 64-bit hash that stands for a text; kept narrow, so the keys of all hits stay small enough to send."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, cover: float = 0.5, least: int = 5) -> DataFrame:
    """(doc_id, item_id, coverage, kind, text_key) of each document that holds a benchmark item.

    ``coverage`` is the share of the item's windows found in the document, at least ``cover``; ``kind`` is
    ``verbatim`` if one alignment is, else ``reparameterised``.
    """
    windows, members = benchmark_windows(benchmark, window, least)
    sizes = [r.size for r in windows.select("size").distinct().collect()]  # at most window - least + 1 numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    words = rows.select("key", template(F.col("text")).alias("words"))
    hashed = None
    for size in sizes or [window]:
        one = words.select("key", F.posexplode(_window_hashes("words", size)).alias("pos", "h"))
        hashed = one if hashed is None else hashed.unionAll(one)
    hits = hashed.join(windows.select("h", "template_id", "at", "n_windows"), "h").select(
        "key", "template_id", "n_windows", "at", (F.col("pos") - F.col("at")).alias("shift"))
    hits = materialize(hits.distinct(), "benchmark_hits")
    covered = hits.select("key", "template_id", "n_windows", "at").distinct().groupBy("key", "template_id", "n_windows").agg(
        (F.count("*") / F.col("n_windows")).alias("coverage")).where(F.col("coverage") >= cover)
    aligned = hits.groupBy("key", "template_id", "n_windows", "shift").agg(F.count("*").alias("n"), F.min("at").alias("lo"), (F.max("at") + window).alias("hi"))
    longest = aligned.groupBy("key", "template_id").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("longest"))
    aligned = aligned.join(longest, ["key", "template_id"]).where((F.col("n") >= cover * F.col("n_windows")) | (F.col("shift") == F.col("longest")))
    found = materialize(covered.join(aligned.drop("n_windows", "longest", "n"), ["key", "template_id"]).select(
        "key", "template_id", "coverage", "shift", "lo", "hi"), "benchmark_found")
    texts = rows.join(found.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("template_id"), F.col("text").cast("string").alias("text")).join(
        found.select("template_id").distinct(), "template_id", "left_semi").groupBy("template_id").agg(F.max("text").alias("text"))
    asked = _slots(items, "template_id").select("template_id", F.col("at").alias("item_at"), F.col("kind").alias("item_kind"), F.col("value").alias("asked"))
    given = _slots(texts, "key")
    one = ["key", "template_id", "shift"]
    pairs = found.join(asked, "template_id").where("item_at >= lo and item_at < hi").join(
        given, (given["key"] == found["key"]) & (F.col("item_at") + F.col("shift") == given["at"]) & (F.col("item_kind") == given["kind"])).select(
        found["key"], "template_id", "shift", "item_kind", "asked", "value")
    clash = pairs.groupBy(*one, "item_kind", "asked").agg(
        (F.min("value") != F.max("value")).alias("clash"), F.max(F.col("value") != F.col("asked")).alias("other"))
    clash = clash.groupBy(*one).agg(F.max("clash").alias("clash"), F.max("other").alias("other"))
    judged = found.join(clash, one, "left").where("not coalesce(clash, false)").groupBy("key", "template_id", "coverage").agg(
        F.min(F.coalesce("other", F.lit(False))).alias("other"))
    kind = F.when(F.col("other"), "reparameterised").otherwise("verbatim")
    judged = judged.join(members.select("template_id", "item_id"), "template_id").select("key", "item_id", "coverage", kind.alias("kind"))
    return rows.select("doc_id", "key").join(materialize(judged, "benchmark_judged"), "key").select(
        "doc_id", "item_id", "coverage", "kind", F.col("key").alias("text_key"))


def verdicts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, items (sorted), coverage of the best item, kind."""
    by = found.select("text_key", "item_id", "coverage", "kind").distinct().groupBy("text_key").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"), F.max("kind").alias("kind"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))
    return rows.join(by, "text_key", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "kind")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    found = contaminated(docs, benchmark).select(F.col("text_key").alias("_key")).distinct()
    found = materialize(found, "contaminated")  # of known size: Spark sends it to the rows while it is small
    return docs.join(found, text_key(F.col("text")) == F.col("_key"), "left_anti")


def query(spark, sf_dir) -> DataFrame:
    """op5: which documents hold benchmark items."""
    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))
