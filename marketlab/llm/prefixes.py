"""Conversation prefix trie: every distinct beginning of a conversation is a node.

Turns become numbers (parts of the SHA-256 of role and text) and stand in positional columns, ``WIDTH`` to a
row.  One ROLLUP over these columns counts all prefixes of all conversations together; grouping_id tells
the depth.  Longer conversations go on in further rows, each keyed by the node that the row before ends
in.  That key is a sum of hashes of the turns up to there, so it is known without walking down the trie, all
rows take part in the same ROLLUP, and a node's parent is found by taking its last turn off the sum.

Sums over a node's subtree need no walk either.  A node belongs to the smallest conversation that starts
with it.  What belongs to a conversation is the lower end of its path, so the subtree of a node holds
everything that belongs to its members, except what its own smallest member holds above the node.  Both are
sums over members, a second ROLLUP, and along one path.

No conversation or node is ever one task's work: positions come from a range partitioning of all turns and
the counts of its parts, sums along a path are cut into slices, ids of a node's conversations are joined in
slices of 4,096 before they stream through the digest in order, and joins with the children of one node are
left to the splitting of skewed joins.

Defined cases: a null role or text is empty; null turns come first; turns with the same number follow each
other by role and text, repeated rows stay; rows without a conversation id belong to none; an empty table
has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm.common import table
from marketlab.session import intermediates_mark, materialize, settle

WIDTH = 8          # turns in a row
SLICE = 4096       # rows of a conversation, or nodes of a path, summed in one window
SPREAD = 4096      # rows of a conversation that look up its sums in one task
NODE = ["depth", "k0", "k1", "k2", "k3"]
_EARLIER = (Window.unboundedPreceding, -1)


def positions(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars, length): turns numbered from 0 by (turn, role, text) within their conversation.

    ``a`` and ``b`` stand for role and text, ``chars`` counts the text's code points, ``length`` the turns.
    """
    order = ["conv_id", "turn", "role", "text"]
    said = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # an id of this kind grows along the order, by ones within a part
    sorted_ = said.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))
    number = [F.conv(F.substring("digest", i, 15), 16, 10).cast("long").alias(c) for i, c in ((1, "a"), (16, "b"))]
    stored = materialize(sorted_.select("conv_id", "part", "at", *number, "chars"), "prefix_turns")
    parts = stored.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("conv_id")  # as many rows as parts that the conversation reaches into
    parts = parts.select("conv_id", "part", "first", F.sum("n").over(own).alias("length"),
                         F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(*_EARLIER)), F.lit(0)).alias("before"))
    return stored.join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "a", "b", "chars", "length")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv_id, length) in which a first few turns are those of another conversation.

    Conversation c starts with the first h = crc32(c) % ``most`` turns of conversation c - c % ``every`` and
    goes on with its own turns after its first h.
    """
    turns = materialize(turns, "prefix_placed")
    own = turns.groupBy("conv_id").agg(F.max("length").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_length"))
    told = own.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_length", F.lit(0))))
    told = materialize(told.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "prefix_heads")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).select(
        F.col("conv_id").alias("base"), "pos", "a", "b", "chars")
    borrowed = heads.join(told, "base").where(F.col("pos") < F.col("m")).select("conv_id", "pos", "a", "b", "chars")
    # h is known from the id; the shift is not, where the other conversation is shorter than h
    kept = turns.drop("length").withColumn("h", h).where(F.col("pos") >= F.col("h"))
    less = told.where(F.col("m") < F.col("h")).select("conv_id", (F.col("h") - F.col("m")).alias("less"))
    copies = less.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    kept = kept.withColumn("salt", F.pmod("pos", F.lit(32)).cast("int")).join(copies, ["conv_id", "salt"], "left")
    kept = kept.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "a", "b", "chars")
    return borrowed.unionByName(kept), told.select("conv_id", "length")


def _words(pos: Column, a: Column, b: Column) -> list[Column]:
    """Four 32-bit words that stand for a turn at its position; sums of them tell sequences apart."""
    u, v = F.xxhash64(pos, a, b), F.xxhash64(b, pos, a, F.lit(1))
    low = F.lit(0xFFFFFFFF).cast("long")
    return [u.bitwiseAND(low), F.shiftrightunsigned(u, 32), v.bitwiseAND(low), F.shiftrightunsigned(v, 32)]


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, block, p0..p3, t0..): rows of turns with the sums over all earlier rows of the conversation."""
    rows = turns.select("conv_id", F.expr(f"pos div {WIDTH}").alias("block"), (F.col("pos") % WIDTH).alias("place"),
                        "a", "b", "chars", *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col("pos"), F.col("a"), F.col("b")))])
    none = convs.select("conv_id", F.lit(0).cast("long").alias("block"))  # a conversation without turns is a member of the root
    rows = rows.unionByName(none, allowMissingColumns=True)
    placed = [F.max(F.when(F.col("place") == i, F.col(c))).alias(f"{c}{i}") for i in range(WIDTH) for c in ("a", "b", "chars")]
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"s{i}") for i in range(4)]
    wide = rows.groupBy("conv_id", "block").agg(*placed, *sums)
    turn = [F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"chars{i}").alias("chars"))).alias(f"t{i}")
            for i in range(WIDTH)]
    wide = materialize(wide.select("conv_id", "block", F.expr(f"block div {SLICE}").alias("slice"), *turn, *[f"s{i}" for i in range(4)]), "prefix_blocks")
    inside = Window.partitionBy("conv_id", "slice").orderBy("block").rowsBetween(*_EARLIER)
    across = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(*_EARLIER)
    slices = wide.groupBy("conv_id", "slice").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)])
    carried = slices.select("conv_id", "slice", *[F.sum(f"s{i}").over(across).alias(f"c{i}") for i in range(4)]).where("slice > 0")
    summed = wide.select("*", *[F.coalesce(F.sum(f"s{i}").over(inside), F.lit(0)).alias(f"b{i}") for i in range(4)])
    before = [(F.col(f"b{i}") + F.coalesce(f"c{i}", F.lit(0))).alias(f"p{i}") for i in range(4)]
    return summed.join(carried, ["conv_id", "slice"], "left").select(
        "conv_id", "block", *before, *[f"t{i}" for i in range(WIDTH)], *[f"s{i}" for i in range(4)])


def _rolled_up(blocks: DataFrame, **sums: str) -> DataFrame:
    """All prefixes: NODE, the parent's sums q0..q3, chars of the last turn, n_convs, conv_id, longest, and ``sums``."""
    turns = ", ".join(f"t{i}" for i in range(WIDTH))
    more = "".join(f", {expr} AS {name}" for name, expr in sums.items())
    rolled = blocks.sparkSession.sql(f"""
        SELECT block, p0, p1, p2, p3, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, count(*) AS n_convs,
          min(conv_id) AS conv_id, max(length) AS longest{more}
        FROM {{blocks}} GROUP BY block, p0, p1, p2, p3, ROLLUP({turns})""", blocks=blocks)
    known = sum(F.col(f"t{i}").isNotNull().cast("int") for i in range(WIDTH))
    last = F.element_at(F.array(*[f"t{i}" for i in range(WIDTH)]), F.greatest(F.col("level"), F.lit(1)))
    # a row that ends before the level has no turn there; the start of a later row is the end of the one before
    nodes = rolled.where((known == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0))).withColumn("last", last)
    pos = F.col("block") * WIDTH
    each = [_words(pos + i, F.col(f"t{i}.a"), F.col(f"t{i}.b")) for i in range(WIDTH)]
    whole = [F.col(f"p{k}") + sum(F.when(F.col(f"t{i}").isNotNull(), each[i][k]).otherwise(0) for i in range(WIDTH)) for k in range(4)]
    own = _words(pos + F.col("level") - 1, F.col("last.a"), F.col("last.b"))
    nodes = nodes.withColumns({f"k{k}": whole[k] for k in range(4)})
    return nodes.select(
        (pos + F.col("level")).alias("depth"), *[f"k{k}" for k in range(4)],
        *[F.when(F.col("level") > 0, F.col(f"k{k}") - own[k]).alias(f"q{k}") for k in range(4)],
        F.coalesce("last.chars", F.lit(0)).alias("chars"), "n_convs", "conv_id", "longest", *sums)


def _ends(blocks: DataFrame) -> DataFrame:
    """(NODE, ends_sha256) of every node in which a conversation ends."""
    whole = blocks.groupBy("conv_id").agg(F.max("length").alias("depth"), *[F.sum(f"s{i}").alias(f"k{i}") for i in range(4)])
    sliced = whole.groupBy(*NODE, F.shiftright("conv_id", 12).alias("slice")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = sliced.select(*NODE, "slice", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    texts = texts.repartition(*NODE).sortWithinPartitions(*NODE, "slice")  # streams in order, whatever the number of slices

    def digests(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield from _batch(done)
        if node is not None:
            yield from _batch([(*node, digest.hexdigest())])

    return texts.mapInArrow(digests, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def _batch(rows: list[tuple]) -> list[pa.RecordBatch]:
    if not rows:
        return []
    columns = list(zip(*rows))
    kinds = [pa.int64()] * len(NODE) + [pa.string()]
    return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "ends_sha256"])]


def trie(turns: DataFrame, convs: DataFrame, since: int | None = None) -> DataFrame:
    """One row for each node, from turns (conv_id, pos, a, b, chars) and all conversations (conv_id, length).

    ``since`` marks the first intermediate table that goes when the nodes are stored.
    """
    mark = intermediates_mark() if since is None else since
    convs = materialize(convs.select("conv_id", "length"), "prefix_convs")
    blocks = _blocks(turns, convs)
    # the rows of a long conversation look up in several tasks what there is once for each conversation
    salts = (1 + F.expr(f"length div {WIDTH * SPREAD}")).cast("int")
    salted = convs.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    blocks = blocks.withColumn("salt", F.expr(f"cast(block div {SPREAD} as int)"))
    blocks = materialize(blocks.join(salted, ["conv_id", "salt"]), "prefix_rows")

    first = materialize(_rolled_up(blocks).select("depth", "n_convs", "conv_id", "longest", "chars"), "prefix_counts")
    weight = (F.col("n_convs") - 1) * F.col("chars")
    held = first.groupBy("conv_id").agg(F.sum(weight).alias("held"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"),
                                        F.min("depth").alias("top"))
    held = materialize(held, "prefix_held")
    found = blocks.join(salted.select("conv_id", "salt").join(held, "conv_id"), ["conv_id", "salt"], "left")
    nodes = materialize(_rolled_up(found, held="coalesce(sum(held), 0)", n_leaves="coalesce(sum(leaf), 0)"), "prefix_nodes")

    # of the sums over all members goes what the smallest one holds above the node
    path = nodes.select(*NODE, "q0", "q1", "q2", "q3", "n_convs", "conv_id", "held", "n_leaves", weight.alias("weight"), F.expr(f"depth div {SLICE}").alias("slice"))
    slices = path.groupBy("conv_id", "slice").agg(F.sum("weight").alias("weight"))
    across = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(*_EARLIER)
    carried = slices.select("conv_id", "slice", F.sum("weight").over(across).alias("carried"), 
                             F.lag("slice").over(Window.partitionBy("conv_id").orderBy("slice")).isNotNull().alias("goes_on")).where("slice > 0")
    inside = Window.partitionBy("conv_id", "slice").orderBy("depth")
    path = path.select("*", F.coalesce(F.sum("weight").over(inside.rowsBetween(*_EARLIER)), F.lit(0)).alias("above"), F.row_number().over(inside).alias("nth"))
    path = path.join(carried, ["conv_id", "slice"], "left")
    path = path.withColumn("saved_tokens", F.col("held") - F.col("above") - F.coalesce("carried", F.lit(0)))
    path = path.withColumn("is_top", (F.col("nth") == 1) & ~F.coalesce("goes_on", F.lit(False)))

    parent = [(F.col("depth") - 1).alias("depth"), *[F.col(f"q{k}").alias(f"k{k}") for k in range(4)]]
    children = nodes.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    # below its first node a conversation's nodes have that conversation's nodes as parents
    path = materialize(path.select(*NODE, "q0", "q1", "q2", "q3", "conv_id", "n_convs", "n_leaves", "saved_tokens", "is_top"), "prefix_paths")
    above = nodes.where("depth > 0").select(*[F.col(c).alias(f"up_{c}") for c in NODE], F.col("conv_id").alias("up_conv"))
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root_conv"))
    tops = path.where("is_top and depth > 1")
    tops = tops.join(above, [F.col("up_depth") == F.col("depth") - 1, *[F.col(f"up_k{k}") == F.col(f"q{k}") for k in range(4)]])
    first_turns = path.where("is_top and depth = 1").crossJoin(F.broadcast(root))  # one row
    rest = path.where("not is_top").withColumn("parent_conv_id", F.col("conv_id"))
    start = path.where("is_top and depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    picked = [*NODE, "conv_id", "n_convs", "n_leaves", "saved_tokens", "parent_conv_id"]
    whole = rest.select(*picked)
    for part in (start, first_turns.withColumn("parent_conv_id", F.col("root_conv")), tops.withColumn("parent_conv_id", F.col("up_conv"))):
        whole = whole.unionByName(part.select(*picked))
    out = whole.join(children, NODE, "left").join(_ends(blocks), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    return settle(out, "prefix_trie", mark)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations as they are, from (conv_id, turn, role, text)."""
    mark = intermediates_mark()
    turns = positions(rows)
    return trie(turns.drop("length"), turns.groupBy("conv_id").agg(F.max("length").alias("length")), mark)


def query(spark, sf_dir) -> DataFrame:
    """op11: the trie of all conversations, rebuilt so that the first turns of a hundred conversations are shared."""
    mark = intermediates_mark()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(*with_shared_heads(positions(rows)), since=mark)


# crc32 of the decimal id, bit by bit; at this size a node's subtree is found by comparing paths.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT)"""

ORACLE = f"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS base FROM ordered GROUP BY conv_id),
told AS (SELECT o.*, least(o.h, coalesce(b.n, 0)) AS m FROM own o LEFT JOIN own b ON b.conv_id = o.base),
rebuilt AS (
  SELECT t.conv_id, r.pos, r.role, r.text FROM told t JOIN ordered r ON r.conv_id = t.base AND r.pos < t.m
  UNION ALL SELECT t.conv_id, r.pos - t.h + t.m, r.role, r.text FROM told t JOIN ordered r ON r.conv_id = t.conv_id AND r.pos >= t.h),
pathed AS (
  SELECT conv_id, pos + 1 AS depth, length(text) AS chars,
    string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM own),
lengths AS (SELECT conv_id, max(depth) AS length FROM pathed GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM pathed JOIN lengths USING (conv_id) GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (
  SELECT v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.chars) AS BIGINT) AS saved_tokens
  FROM known v JOIN known u ON starts_with(u.path, v.path) GROUP BY v.path)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM known k JOIN sums USING (path) LEFT JOIN known p ON k.depth > 0 AND p.path = left(k.path, length(k.path) - 32)
"""
