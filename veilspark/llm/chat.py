"""Operator 3: chat formatting by schema fingerprints, with DataFrame functions only.

Conversations come in many layouts: tables with a row a turn, with columns of prompts and answers or
with lists of messages, and JSON records of any of these. The nested field paths that a table's schema
or a record has, among those that any mapping of the registry knows, are hashed; the hash selects a
declarative mapping into canonical turns (array<struct<role, text>>). A path counts as present in a
record if any element of a list has it, whatever its value (JSON null too). Unknown fields don't count.
Paths that together match no mapping (two layouts in one) select the first mapping, in the registry's
order, that they hold completely; where there is none, a record gets null turns and a null layout, and
a table raises ValueError.

The template writes each turn between control strings. Inside texts, `&` becomes `&amp;` and the
first character of each control string becomes an entity, so no control string is left in a text
and none can arise at a border (they begin with `[` or `<`, which none holds further in).
Reading splits at the opening marks and takes the entities back, so every text returns exactly.

Null text or role: empty. Turns with equal numbers: by role, then text. Repeated rows all stay. A null
conv_id is a conversation like any other. An empty table gives an empty result. Columns that no mapping
knows are ignored in tables of turns and kept beside records; `layout` and `turns` replace columns of
these names. Very long texts stay whole; a conversation must fit into one row (2 GB).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths that make this layout (`a`, `a[]` for a list, `a[].b`); optional
    ones may be missing. One of: `pairs` (role, path of its text) and/or `items` (list path, field of
    the role, field of the text), or `rows` (conversation, order, role and text of a table with a row a
    turn). unless_empty: (path, name of the layout to use where its text is null or empty)."""

    name: str
    paths: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()
    unless_empty: tuple[str, str] | None = None


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("system_messages", ("system", "messages[]"), (("system", "system"),), ("messages", "role", "content"), optional=("messages[].role", "messages[].content")),
    Layout("messages", ("messages[]",), items=("messages", "role", "content"), optional=("messages[].role", "messages[].content")),
    Layout("from_value", ("conversations[]",), items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}, optional=("conversations[].from", "conversations[].value")),
    Layout("instruction_input", ("instruction", "input", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output")), unless_empty=("input", "instruction")),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
)


def known_paths() -> list[str]:
    return sorted({p for x in LAYOUTS for p in (*x.paths, *x.optional)})


def print_of(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def prints(layout: Layout) -> list[str]:
    """The fingerprints that select a layout: its paths, with any of the optional ones."""
    return [print_of((*layout.paths, *some)) for n in range(len(layout.optional) + 1) for some in itertools.combinations(layout.optional, n)]


def registry() -> dict[str, Layout]:
    return {h: x for x in reversed(LAYOUTS) for h in prints(x)}


def schema_paths(schema: T.DataType, prefix: str = "") -> set[str]:
    """All nested field paths of a schema."""
    out: set[str] = set()
    for f in schema.fields if isinstance(schema, T.StructType) else []:
        path, kind = prefix + f.name, f.dataType
        if isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out |= {path} | schema_paths(kind, path + ".")
    return out


def fingerprint(record: Column) -> Column:
    """The hash of the known field paths that a variant record has."""

    def has(path: str) -> Column:
        name, _, inner = path.partition("[].")
        if path == name.removesuffix("[]"):
            return F.try_variant_get(record, "$." + name, "variant").isNotNull()
        many = F.try_variant_get(record, "$." + name.removesuffix("[]"), "array<variant>")
        return F.coalesce(F.exists(many, lambda x: F.try_variant_get(x, "$." + inner, "variant").isNotNull()), F.lit(False)) if inner else many.isNotNull()

    return _present({p: has(p) for p in known_paths()})


def _present(has: dict[str, Column]) -> Column:
    """Struct of the fingerprint (paths sort as their names do) and, for each layout, whether all its paths are there."""
    paths = F.array_compact(F.array(*[F.when(has[p], F.lit(p)) for p in sorted(has)]))
    whole = [F.forall(F.array(*map(F.lit, x.paths)), lambda p: F.array_contains(paths, p)).alias(x.name) for x in LAYOUTS]
    return F.struct(F.sha2(F.array_join(paths, "\n"), 256).alias("print"), F.struct(*whole).alias("holds"))


def _turns(layout: Layout, text: Callable[[str], Column], listed: Callable[[str, str, str], Column]) -> Column:
    fixed = [F.struct(F.lit(role).alias("role"), F.coalesce(text(path), F.lit("")).alias("text")) for role, path in layout.pairs]
    out = F.array(*fixed) if fixed else F.lit(None).cast(TURNS)
    if layout.items:
        name, role, said = layout.items
        renamed = F.create_map(*[F.lit(x) for kv in layout.roles.items() for x in kv]) if layout.roles else None

        def canonical(x: Column) -> Column:
            own = F.coalesce(x[role], F.lit(""))
            return F.struct((F.coalesce(renamed[own], own) if renamed is not None else own).alias("role"), F.coalesce(x[said], F.lit("")).alias("text"))

        many = F.transform(listed(name, role, said), canonical)
        out = F.concat(F.array(*fixed), many) if fixed else many
    return out.cast(TURNS)


def _mapped(layout: Layout, text: Callable[[str], Column], listed: Callable[[str, str, str], Column]) -> Column:
    """Struct of the mapping's name and the turns."""
    own = F.struct(F.lit(layout.name).alias("layout"), _turns(layout, text, listed).alias("turns"))
    if layout.unless_empty:
        path, other = layout.unless_empty
        instead = next(x for x in LAYOUTS if x.name == other)
        return F.when(F.coalesce(text(path), F.lit("")) == "", _mapped(instead, text, listed)).otherwise(own)
    return own


def from_records(df: DataFrame, record: Column) -> DataFrame:
    """df with `layout` and canonical `turns`, from JSON text records of any known layout but a row a
    turn. Text that isn't JSON: no layout."""
    out = df.withColumn("__record", F.try_parse_json(record)).withColumn("__print", fingerprint(F.col("__record")))

    def text(path: str) -> Column:
        return F.try_variant_get(F.col("__record"), "$." + path, "string")

    def listed(name: str, role: str, said: str) -> Column:
        return F.try_variant_get(F.col("__record"), "$." + name, f"array<struct<`{role}` string, `{said}` string>>")

    exact = held = F.lit(None).cast(f"struct<layout string, turns {TURNS}>")
    for x in reversed([x for x in LAYOUTS if not x.rows]):
        own = _mapped(x, text, listed)
        exact = F.when(F.col("__print.print").isin(prints(x)), own).otherwise(exact)
        held = F.when(F.col(f"__print.holds.{x.name}"), own).otherwise(held)
    return out.withColumn("__both", F.coalesce(exact, held)).withColumns({"layout": F.col("__both.layout"), "turns": F.col("__both.turns")}).drop("__record", "__print", "__both")


def layout_of(schema: T.StructType) -> Layout:
    """The mapping that a table's nested field paths select."""
    paths = schema_paths(schema) & set(known_paths())
    found = registry().get(print_of(paths)) or next((x for x in LAYOUTS if set(x.paths) <= paths), None)
    if found is None:
        raise ValueError(f"no mapping for the field paths {sorted(paths)}")
    return found


def from_table(df: DataFrame) -> DataFrame:
    """Canonical `turns` from a table, by the mapping that its schema selects: beside the conversation's
    id from rows of turns, else beside the table's own columns and `layout`."""
    layout = layout_of(df.schema)
    if not layout.rows:
        def listed(name: str, role: str, said: str) -> Column:
            inner = df.schema[name].dataType.elementType
            fields = {f.name for f in inner.fields} if isinstance(inner, T.StructType) else set()
            return F.transform(name, lambda x: F.struct(*[(x[f].cast("string") if f in fields else F.lit(None).cast("string")).alias(f) for f in (role, said)]))

        both = df.withColumn("__both", _mapped(layout, lambda path: F.col(path).cast("string"), listed))
        return both.withColumns({"layout": F.col("__both.layout"), "turns": F.col("__both.turns")}).drop("__both")
    key, order, role, text = layout.rows
    row = F.struct(F.col(order).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = df.select(F.col(key).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def from_turn_rows(df: DataFrame) -> DataFrame:
    """conv_id and canonical `turns`; the table must be one with a row a turn."""
    if not layout_of(df.schema).rows:
        raise ValueError("not a table with a row a turn")
    return from_table(df)


BEGIN = "<s>"
#: Each role's opening and closing marks; any other role is written out between [TURN] and [AS].
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[TURN] ", " [AS] ", " [/TURN]")


def escape(text: Column) -> Column:
    held = F.regexp_replace(F.replace(text, F.lit("&"), F.lit("&amp;")), r"\[(?=/?(?:INST|SYS|TURN)\]|ANS\]|AS\])", "&#91;")
    return F.regexp_replace(held, r"<(?=/?s>)", "&lt;")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _write(turn: Column) -> Column:
    """Struct of what stands before, in and after the loss mask's span of a turn."""
    body = escape(turn["text"])
    before, after = F.concat(F.lit(OTHER[0]), escape(turn["role"]), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, (a, b) in MARKS.items():
        before, after = F.when(turn["role"] == role, F.lit(a)).otherwise(before), F.when(turn["role"] == role, F.lit(b)).otherwise(after)
    return F.struct(before.alias("before"), body.alias("body"), after.alias("after"), (turn["role"] == "assistant").alias("loss"))


def render(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with `formatted` and `loss_spans` (start, length in characters of `formatted`, from 0)."""
    parts = df.withColumn("__parts", F.transform(turns, _write))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("__parts", lambda x: F.concat(x["before"], x["body"], x["after"])), ""))
    zero = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start bigint, length bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        size = F.length(x["body"]).cast("long")
        one = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + F.length(x["after"])).alias("at"), F.when(x["loss"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return parts.withColumns({"formatted": formatted, "loss_spans": F.aggregate("__parts", zero, step)["spans"]}).drop("__parts")


def read_back(formatted: Column) -> Column:
    """The canonical turns that a formatted text holds."""
    pieces = F.filter(F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), r"(?=\[(?:INST|ANS|SYS|TURN)\] )"), lambda x: x != "")

    def one(x: Column) -> Column:
        rest = F.substring(x, len(OTHER[0]) + 1, 2**31 - 1)
        cut = F.instr(rest, "[AS]")
        role = unescape(rest.substr(F.lit(1), cut - 2))
        text = rest.substr(cut + len("[AS] "), F.length(rest) - cut - len("[AS] ") + 1 - len(OTHER[2]))
        for name, (a, b) in MARKS.items():
            here = x.startswith(a)
            role = F.when(here, name).otherwise(role)
            text = F.when(here, x.substr(F.lit(len(a) + 1), F.length(x) - len(a) - len(b))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, one)


def digests(rendered: DataFrame) -> DataFrame:
    """The query's columns, all read back from `formatted` and `loss_spans`."""
    turns = F.transform("__turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return rendered.withColumns({"__turns": read_back(F.col("formatted")), "__loss": loss}).select(
        "conv_id", F.size("__turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), held AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '\[(/?(INST|SYS|TURN)\]|ANS\]|AS\])', '&#91;\1', 'g'), '<(/?s>)', '&lt;\1', 'g')) AS n,
    length(regexp_replace(regexp_replace(replace(role, '&', '&amp;'), '\[(/?(INST|SYS|TURN)\]|ANS\]|AS\])', '&#91;\1', 'g'), '<(/?s>)', '&lt;\1', 'g')) AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 13 ELSE 21 + r END) AS BIGINT) AS formatted_chars
FROM held GROUP BY conv_id
"""
