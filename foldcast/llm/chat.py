r"""Chat formatting by schema fingerprints, on DataFrame functions alone.

Records of mixed layouts come as VARIANT values. The nested field paths that a record has, of
those that any declared layout uses, are hashed; the hash selects the declarative mapping of the
most specific layout whose paths are all there, which yields canonical turns. Records of no
layout are kept apart with a reason. Turns become one text per conversation:

    user       ``[INST] text [/INST]``
    assistant  `` text </s>``
    others     ``[ROLE]role[/ROLE] text </s>``

A control string inside a text or role gets a backslash after its bracket (``<\/s>``); one
that has backslashes there already gets one more, so escaping can be undone exactly. The loss
mask is a list of (start, length) spans, in code points of the formatted text, that cover
the assistant texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldcast.llm.common import table

_TAIL = r"(?:/?(?:INST|ROLE)\]|/?s>)"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout: the field paths that mark it, and its turns as SQL over the variant ``v``."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _field(path: str) -> str:
    return f"variant_get(v, '$.{path}', 'string')"


def _turn(role: str, path: str) -> str:
    return f"named_struct('role', '{role}', 'text', {_field(path)})"


def _listed(path: str, role: str, text: str, alias: bool = False) -> str:
    named = "CASE lower(x.r) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE x.r END" if alias else "x.r"
    parts = f"transform(variant_get(v, '$.{path}', 'array<variant>'), m -> named_struct('r', variant_get(m, '$.{role}', 'string'), 't', variant_get(m, '$.{text}', 'string')))"
    return f"transform({parts}, x -> named_struct('role', {named}, 'text', x.t))"


LAYOUTS = (
    Layout("turn_row", ("role", "text"), f"array(named_struct('role', {_field('role')}, 'text', {_field('text')}))"),
    Layout("messages", ("messages[0].role", "messages[0].content"), _listed("messages", "role", "content")),
    Layout("conversations", ("conversations[0].from", "conversations[0].value"), _listed("conversations", "from", "value", True)),
    Layout("prompt_response", ("prompt", "response"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Layout("prompt_completion", ("prompt", "completion"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
    Layout("instruction", ("instruction", "output"), f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})"),
    Layout("instruction_input", ("instruction", "input", "output"), f"array(named_struct('role', 'user', 'text', concat_ws('\\n', {_field('instruction')}, nullif({_field('input')}, ''))), {_turn('assistant', 'output')})"),
)


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the known nested field paths that a VARIANT record has; unknown fields don't count."""
    known = sorted({p for x in layouts for p in x.paths})
    found = F.array(*(F.when(F.try_variant_get(record, f"$.{p}", "variant").isNotNull(), F.lit(p)) for p in known))
    return F.xxhash64(F.array_join(found, "\n"))


def _with_layouts(records: DataFrame, layouts: tuple[Layout, ...]) -> DataFrame:
    """conv_id, turn, v (the record), layout (null: none) and turns.

    Of the layouts whose paths a record has, the one with the most paths counts, the first of equals. The table
    that leads from fingerprints to layouts has a row for each set of known paths.
    """
    known = sorted({p for x in layouts for p in x.paths})
    have = lambda x: sum(1 << known.index(p) for p in x.paths)
    best = F.coalesce(*(F.when(F.col("id").bitwiseAND(F.lit(have(x))) == have(x), x.name) for x in sorted(layouts, key=lambda x: -len(x.paths))))
    told = F.filter(F.array(*map(F.lit, known)), lambda p, i: F.expr("id").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0)
    sets = records.sparkSession.range(1 << len(known)).select(F.xxhash64(F.array_join(told, "\n")).alias("f"), best.alias("layout")).where("layout is not null")
    marked = records.select("conv_id", "turn", F.col("record").alias("v"), fingerprint(F.col("record"), layouts).alias("f")).join(F.broadcast(sets), "f", "left")
    turns = F.lit(None).cast(_TURNS)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns)).otherwise(turns)
    return marked.select("conv_id", "turn", "v", "layout", turns.alias("turns"))


def unmatched(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records that give no turns: (conv_id, turn, record, reason).

    Reasons: 'null record', 'no known layout', 'no turns' (a layout fits, but its list is empty).
    """
    reason = F.when(F.col("v").isNull(), "null record").when(F.col("layout").isNull(), "no known layout").when(F.coalesce(F.size("turns"), F.lit(0)) < 1, "no turns")
    return _with_layouts(records, layouts).select("conv_id", "turn", F.col("v").alias("record"), reason.alias("reason")).where("reason is not null")


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns of each record: (conv_id, turn, part, layout, role, text).

    ``records`` has conv_id long, turn long (the record's place within its conversation, null
    where a record is a whole one) and record VARIANT. Further fields of a record, known ones too, don't
    matter where a layout's paths are all there. Records that give no turns are those of
    :func:`unmatched`; null roles and texts become empty.
    """
    rows = _with_layouts(records, layouts).select("conv_id", "turn", "layout", F.posexplode("turns").alias("part", "t"))
    return rows.select("conv_id", "turn", "part", "layout", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)(?={_TAIL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)\\(?={_TAIL})", "$1")


def render(turns: DataFrame) -> DataFrame:
    """One formatted text per conversation: (conv_id, formatted, loss_spans).

    Turns stand in the order of (turn, part, role, text); repeated rows stay. A conversation
    is one output value, so its turns meet in one row.
    """
    esc, role = escape(F.col("text")), F.col("role")
    head = F.when(role == "user", F.lit("[INST] ")).when(role == "assistant", F.lit(" ")).otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE] ")))
    tail = F.when(role == "user", F.lit(" [/INST]")).otherwise(F.lit(" </s>"))
    rows = turns.select("conv_id", "turn", "part", "role", "text", esc.alias("esc"), head.alias("head"), F.concat(head, esc, tail).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("conv_id", F.row_number().over(order).alias("k"), "piece", (role == "assistant").alias("learn"), (before + F.length("head")).alias("start"), F.length("esc").cast("long").alias("length"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "piece", "learn", "start", "length"))).alias("ps"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("ps", lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, r"(?<= \[/INST\])|(?<= </s>)"), lambda p: p != "")

    def turn(p: Column) -> Column:
        user, other = p.startswith("[INST] "), p.startswith("[ROLE]")
        mark = F.instr(p, "[/ROLE] ")
        first = F.when(user, 8).when(other, mark + 8).otherwise(2)
        size = F.length(p) - first + 1 - F.when(user, 8).otherwise(5)
        role = F.when(user, F.lit("user")).when(other, unescape(F.substring(p, F.lit(7), mark - 7))).otherwise(F.lit("assistant"))
        return F.struct(role.alias("role"), unescape(F.substring(p, first, size)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def table_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn as records of the ``turn_row`` layout."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.to_variant_object(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))).alias("record"))
    return c


PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all conversations, and conversation -1 in another layout, formatted and read back."""
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.parse_json(F.lit(PROBE)).alias("record"))
    done = render(canonical_turns(table_records(table(spark, sf_dir, "conversations")).unionByName(probe)))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[]\\*)(/?(INST|ROLE)\]|/?s>)', '\1\\\2', 'g')) AS n,
    length(regexp_replace(role, '([<\[]\\*)(/?(INST|ROLE)\]|/?s>)', '\1\\\2', 'g')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 19 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
