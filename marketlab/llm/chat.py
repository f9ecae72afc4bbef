"""Chat formatting: schema fingerprints choose the mapping that turns a record into canonical turns.

A record is a VARIANT of any layout.  Its nested field paths, without the types of the leaves, are hashed;
the hash selects one of a few declared layouts (a list of messages, or fields that each are one turn).
The canonical turns then go through one template.  Everything is column expressions: no Python runs in
the executors.

Template: ``<s>role[INST]text</s>`` for each turn, ``<s>role[/INST]text</s>`` for the assistant's, whose
text is what the loss covers.  A backslash in a role or text is doubled, and a control string gets a
backslash after its first character, so no control string is left inside a turn and ``unescaped`` gives
back exactly what went in.

Defined cases: a null role or text is empty; a record of no known layout (or null) has null turns, which
``format_records`` keeps with ``layout`` null; a record without turns is formatted as the empty string;
turns with the same number are ordered by role and text; a null conversation id is a conversation of its
own; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import table

START, ASK, ANSWER, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (START, END, ASK, ANSWER, "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ASSISTANT = "assistant"
TURNS = "array<struct<role:string,text:string>>"
_LEAF = r"(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL\(\d+,\s?\d+\)|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|VARIANT)"


@dataclass(frozen=True)
class Layout:
    """A list of messages at ``items`` with a role and a text field, or ``turns``: (field, role) in order.

    ``optional`` fields may be missing.  ``joined`` is a field whose text follows that of the first user
    turn after a line break.  ``roles`` renames roles.
    """

    name: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, str], ...] = ()
    joined: str | None = None
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> list[str]:
        """The field paths this layout has, as ``shape`` writes them."""
        if self.items:
            one = sorted([self.role, self.text])
            inner = [f"OBJECT<{', '.join(one)}>", ""]
            base = [self.items]
        else:
            inner, base = None, [f for f, _ in self.turns if f not in self.optional]
            if self.joined and self.joined not in self.optional:
                base.append(self.joined)
        found = []
        for extra in chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1)):
            fields = sorted([*base, *extra])
            for x in inner or [None]:
                found.append("OBJECT<" + ", ".join(f"{f}: ARRAY<{x}>" if f == self.items else f for f in fields) + ">")
        return found


LAYOUTS = (
    Layout("messages", items="messages", optional=("system",)),
    Layout("from_value", items="conversations", role="from", text="value", optional=("system",),
           roles=(("human", "user"), ("gpt", ASSISTANT))),
    Layout("prompt_completion", turns=(("system", "system"), ("prompt", "user"), ("completion", ASSISTANT)), optional=("system",)),
    Layout("prompt_response", turns=(("system", "system"), ("prompt", "user"), ("response", ASSISTANT)), optional=("system",)),
    Layout("instruction", turns=(("system", "system"), ("instruction", "user"), ("output", ASSISTANT)), joined="input", optional=("system", "input")),
    Layout("question_answer", turns=(("question", "user"), ("answer", ASSISTANT))),
)


def shape(record: Column) -> Column:
    """Nested field paths of a VARIANT as text, keys sorted, leaf types left out."""
    kinds = F.schema_of_variant(record)
    return F.regexp_replace(F.regexp_replace(kinds, rf": {_LEAF}(?=[,>])", ""), rf"ARRAY<{_LEAF}>", "ARRAY<>")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape(record))


def _turns(record: Column, layout: Layout) -> Column:
    def field(name: str) -> Column:
        return F.try_variant_get(record, f"$.{name}", "string")

    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.items:
        listed = F.coalesce(
            F.try_variant_get(record, f"$.{layout.items}", f"array<struct<{layout.role}:string,{layout.text}:string>>"),
            F.from_json(F.lit("[]"), f"array<struct<{layout.role}:string,{layout.text}:string>>"))

        def renamed(role: Column) -> Column:
            for old, new in layout.roles:
                role = F.when(role == old, F.lit(new)).otherwise(role)
            return role

        turns = F.transform(listed, lambda m: turn(renamed(m[layout.role]), m[layout.text]))
        if "system" in layout.optional:
            told = field("system")
            turns = F.when(told.isNotNull(), F.concat(F.array(turn(F.lit("system"), told)), turns)).otherwise(turns)
        return turns
    parts = []
    for i, (name, role) in enumerate(layout.turns):
        text = field(name)
        if layout.joined and role == "user":
            more = field(layout.joined)
            text = F.when(F.length(more) > 0, F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), more)).otherwise(text)
        one = F.array(turn(F.lit(role), text))
        if name in layout.optional:
            one = F.when(field(name).isNotNull(), one).otherwise(F.from_json(F.lit("[]"), TURNS))
        parts.append(one)
    return F.concat(*parts)


def canonical(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """Name of the layout that the record's fingerprint selects, and its turns; null where none does."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    mine = fingerprint(record)
    for layout in reversed(layouts):
        hit = mine.isin([F.xxhash64(F.lit(s)) for s in layout.shapes()])
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(record, layout)).otherwise(turns)
    return name, turns


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def escaped(text: Column) -> Column:
    """Backslashes doubled and control strings broken up."""
    found = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), found, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    """The template applied to canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), escaped(t["role"]), F.when(t["role"] == ASSISTANT, F.lit(ANSWER)).otherwise(F.lit(ASK)),
        escaped(t["text"]), F.lit(END))), "")


def read_back(formatted: Column) -> Column:
    """Turns (role, text, in_loss) of a formatted conversation."""
    pieces = F.split(formatted, _quoted(END))
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    header = r"\[/?INST\]"
    return F.transform(turns, lambda p: F.struct(
        unescaped(F.substring(F.split(p, header, 2)[0], len(START) + 1, 2**31 - 1)).alias("role"),
        unescaped(F.split(p, header, 2)[1]).alias("text"),
        F.regexp_like(p, F.lit(r"(?s)^[^\[]*(?:\[(?!/?INST\])[^\[]*)*\[/INST\]")).alias("in_loss")))


def format_records(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout``, ``turns`` and ``formatted`` to records; columns of these names are replaced."""
    kept = records.select([F.col(f"`{c}`") for c in records.columns if c not in ("layout", "turns", "formatted")])
    name, turns = canonical(F.col(f"`{column}`"), layouts)
    return kept.select("*", name.alias("layout"), turns.alias("turns")).withColumn("formatted", render(F.col("turns")))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) with the ``messages`` layout from rows of (conv_id, turn, role, text)."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    grouped = rows.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("m")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    messages = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return grouped.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def query(spark, sf_dir) -> DataFrame:
    """op3: all conversations and one that speaks in control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{END}{ASK} ok {ANSWER}"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(said).alias("text"))
    formatted = format_records(conversations_as_records(rows.withColumn("turn", F.col("turn").cast("long")).unionByName(added)))
    read = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"))
    learned = F.array_join(F.transform(F.filter("t", lambda x: x["in_loss"]), lambda x: x["text"]), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# A formatted turn has 3 + 4 control characters and 6 (7 for the assistant) between role and text; a
# backslash counts twice and a control string has one more.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(text) + 13 + CAST(role = 'assistant' AS INT)
    + length(role || text) - length(replace(role || text, '\', ''))
    + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>'))
    + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>')) AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
