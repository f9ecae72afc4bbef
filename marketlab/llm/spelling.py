"""Spelling variants: words of the corpus that lie one edit from a much more frequent word.

Near words are found with a bit-sliced position index: for every position and letter a bitset over the
words of a tile.  All words that agree with the first j letters of a query with no error, and with one,
are two sets of bits; one step of the recurrence takes both to j + 1 for 64 words at a time.  A replaced
letter keeps the positions aligned, an additional letter in the word shifts the index by one position; the
words with a letter less are found from the other side.

No word meets the whole vocabulary.  Two words at one edit agree before the edit and behind it, so they
share what lies outside the half in which the edit is.  Words are grouped by that part; a group of more
than ``tile`` words is cut in half again, until an edit has one place left: then the alphabet bounds the
group.  Groups of all sizes are dealt into tiles of bounded size by the hash of their key; a tile tells
near words from others exactly, so colliding keys do no harm.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text where it is part
of a hash; repeated rows count as often as they occur; texts and words of any length are taken whole; ties
of frequency go to the smaller word in code-point order; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marketlab.llm.common import per_batch, table
from marketlab.session import intermediates_mark, materialize, settle

_RUN = re.compile(rb"[a-z\xc0-\xff]+")  # of Latin-1 bytes, lower-cased
LETTERS = 4_000_000  # of one index, unless a single group has more
NEAR = "word string, n long, near string, near_n long"


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, spoil: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lower-cased, of all texts.

    With ``spoil``, a run loses one letter wherever the crc32 of ``<doc_id>:<run>`` is divisible by it.
    """

    def run(t: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        for doc_id, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
            if not text:
                continue
            start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for word, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
                if len(word) < shortest:
                    continue
                if spoil:
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % spoil == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                counts[word] += n
        return pa.table({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()),
                         "n": pa.array(counts.values(), pa.int64())})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = picked.mapInArrow(per_batch(run, 16_000_000), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- groups of words that can be near ------------------------------------------------------

def _key() -> Column:
    """What is known of a word outside the places lo..hi, in words of ``size`` letters and those with one more."""
    more = F.char_length("word") - F.col("size")
    return F.xxhash64("size", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")),
                      F.substring("word", F.col("hi") + more + 1, F.char_length("word")))


def _entries(words: DataFrame) -> DataFrame:
    """Every word among those of its own length, and as the longer one among those of one letter less."""
    sized = words.withColumn("size", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)))
    whole = sized.select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    return _halves(whole)


def _halves(entries: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi"))))
    cut = entries.select("word", "n", "size", both.alias("h")).select("word", "n", "size", "h.lo", "h.hi")
    return cut.select("*", _key().alias("key"))


def tiles(words: DataFrame, tile: int) -> DataFrame:
    """(word, n, size, key): groups of at most ``tile`` words, or of words that differ in one place only."""
    level, done = _entries(words), []
    while True:
        level = materialize(level, "spelling_groups")
        large = level.where("hi - lo > 1").groupBy("key").agg(F.count(F.lit(1)).alias("in_group")).where(F.col("in_group") > tile).select("key")
        if large.isEmpty():
            done.append(level)
            break
        large = materialize(large, "spelling_large")
        done.append(level.join(large, "key", "left_anti"))
        level = _halves(level.join(large, "key", "left_semi"))
    out = done[0].select("word", "n", "size", "key")
    for more in done[1:]:
        out = out.unionByName(more.select("word", "n", "size", "key"))
    return out


# --- the index of a tile -------------------------------------------------------------------

def _bits(mask: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    packed = np.packbits(mask, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def _members(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of every set bit."""
    r, k = np.nonzero(rows)
    picked, bit = np.nonzero((rows[r, k][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    return r[picked], k[picked] * 64 + bit


def one_edit(codes: np.ndarray, lengths: np.ndarray, size: int, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows: a has ``size`` letters, b as many with one replaced, or one letter more.

    ``codes`` are letters numbered from 0, -1 behind the end.
    """
    letters = int(codes.max(initial=0)) + 1
    width = codes.shape[1]
    numbers = np.arange(letters)[:, None]

    def at(place: int) -> np.ndarray:  # bitsets of one position by letter
        column = codes[:, place] if 0 <= place < width else np.full(len(codes), -1, codes.dtype)
        return _bits(column == numbers)

    equal_length, longer = _bits((lengths == size)[None])[0], _bits((lengths == size + 1)[None])[0]
    asked = np.flatnonzero(lengths == size)
    left, right = [], []
    for start in range(0, len(asked), batch):
        mine = asked[start:start + batch]
        exact = np.repeat((equal_length | longer)[None], len(mine), axis=0)
        replaced, added = np.zeros_like(exact), np.zeros_like(exact)
        here = at(0)
        for j in range(size):
            after, letter = at(j + 1), codes[mine, j]
            added = (added | exact) & after[letter]
            fits = here[letter]
            replaced = (replaced & fits) | exact
            exact = exact & fits
            here = after
        for found in (replaced & ~exact & equal_length, (added | exact) & longer):
            a, b = _members(found)
            left.append(mine[a])
            right.append(b)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    codes = np.full((len(words), lengths.max(initial=0)), -1, np.int16)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.unique(points, return_inverse=True)[1]
    return codes, lengths


def _tile_pairs(t: pa.Table) -> pa.Table:
    """Near words among the groups of one tile, both ways; groups of one word meet nobody."""
    out: list[tuple[str, int, str, int]] = []
    rows = sorted(set(zip(t["size"].to_pylist(), t["key"].to_pylist(), t["word"].to_pylist(), t["n"].to_pylist())))
    at = 0
    while at < len(rows):  # runs of whole groups of one size, of bounded memory
        size, end = rows[at][0], at
        while end < len(rows) and rows[end][0] == size:
            group = end
            while group < len(rows) and rows[group][:2] == rows[end][:2]:
                group += 1
            if end > at and (group - at) * (size + 1) > LETTERS:
                break
            end = group
        entries = sorted({(w, n) for _, _, w, n in rows[at:end]})
        at = end
        if len(entries) < 2:
            continue
        words = [w for w, _ in entries]
        for a, b in zip(*(x.tolist() for x in one_edit(*_coded(words), size))):
            out.append((*entries[a], *entries[b]))
            if len(words[a]) != len(words[b]):
                out.append((*entries[b], *entries[a]))
    names = ("word", "n", "near", "near_n")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*out)) or [()] * 4
    return pa.table({k: pa.array(c, kind) for k, c, kind in zip(names, columns, kinds)})


def near_words(words: DataFrame, tile: int = 1024) -> DataFrame:
    """(word, n, near, near_n): all pairs of ``words`` (word, n; words distinct) that differ by one edit, both ways."""
    grouped = tiles(words, tile)
    parts = max(1, grouped.count() // (8 * tile))
    dealt = grouped.withColumn("tile", F.pmod("key", F.lit(parts)))
    return dealt.groupBy("tile").applyInArrow(_tile_pairs, NEAR).dropDuplicates(["word", "near"])


# --- forms and roots -----------------------------------------------------------------------

def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following the forms ends.

    Paths double in each round.  A form is several times as frequent as its word, so a path has at most a
    few dozen steps and a handful of rounds suffice.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = Observation()
        step = now.join(then, "root", "left").observe(moved, F.count("next").alias("n")).select(
            "word", F.coalesce("next", "root").alias("root"))
        now = materialize(step, "spelling_roots")
        if not moved.get["n"]:
            return now


def variants(words: DataFrame, factor: int = 5, tile: int = 1024) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    The form is the near word of largest n, if that is at least ``factor`` times the word's own.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their words")
    mark = intermediates_mark()
    words = materialize(words.select("word", "n"), "spelling_words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    summed = near_words(words, tile).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(summed, "word", "left").withColumn("frequent", -F.col("best.less") >= factor * F.col("n"))
    known = materialize(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("frequent"), F.col("best.near")).alias("form"),
        F.when(F.col("frequent"), -F.col("best.less")).alias("form_n")), "spelling_forms")
    ends = roots(known.where("form is not null").select("word", "form"))
    out = known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return settle(out, "spelling", mark)


def query(spark, sf_dir) -> DataFrame:
    """op13: spelling variants in the whole documents, one run in 199 spoilt."""
    return variants(word_counts(table(spark, sf_dir, "documents"), spoil=199))


# crc32 byte by byte from a table of 256 entries; near words meet in what is left without one letter.
_RUNS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')"

ORACLE = f"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
entries AS (SELECT list(c ORDER BY b) AS crc FROM steps WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest({_RUNS}) AS run FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc, run),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(doc || ':' || run))::BIGINT),
      lambda i: CAST('0x' || substr(hex(encode(doc || ':' || run)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: xor(c // 256, crc[CAST(xor(c % 256, x) + 1 AS BIGINT)]))) AS h
  FROM counted, entries),
spoilt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT))
                  ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, unnest(range(length(word))) AS place FROM words),
shorter AS (SELECT word, n, place, left(word, place) || substr(word, place + 2) AS rest FROM less),
near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
summed AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, near AS form, n AS form_n FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS nth FROM near) WHERE nth = 1),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
    CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN summed USING (word) LEFT JOIN best USING (word)),
paths AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT p.word, f.form, k + 1 FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, k) AS root FROM paths GROUP BY word) USING (word)
"""
