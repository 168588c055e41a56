r"""Chat formatting: layouts found by schema fingerprint, canonical turns, one template.

A layout is known by the hash of its nested field paths (``messages[].role``,
``instruction``, ...). Each fingerprint selects a declarative mapping to
canonical turns, ``array<struct<role string, text string>>``:

* ``to_turns`` fingerprints the schema of a DataFrame (columns that no
  mapping names are ignored, whatever they are called);
* ``json_turns`` fingerprints every record of a JSON column on its own, so
  one table may mix layouts; an unknown layout gives null turns. A
  conversation is one record, and so one row.

Template: ``### role:\n`` + text + ``</turn>\n`` for every turn. The control
strings ``###`` and ``</turn>`` cannot occur inside an escaped text:
``\`` becomes ``\\``, ``###`` becomes ``\h`` and ``</turn>`` becomes ``\e``
(in roles a newline also becomes ``\n``), which ``unescape`` undoes.

Nulls: a null role or text is empty; null turns format to null; no turns
format to the empty string. Turns that tie on ``turn`` are ordered by role
and text; null turn numbers come first. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_END = "</turn>"
HEAD = "###"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths``: nested field paths that make the fingerprint; ``turns``: SQL over the fields."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _message(role: str, text: str) -> str:
    return f"transform(%s, m -> struct(CAST(m.{role} AS STRING) AS role, CAST(m.{text} AS STRING) AS text))"


_CANON = "CASE lower(m.from) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END"
_PAIR = "struct('user' AS role, {0} AS text), struct('assistant' AS role, {1} AS text)"

LAYOUTS = [
    Layout("turn rows", ("turns[].role", "turns[].text", "turns[].turn"), "transform(array_sort(transform(turns, m -> struct(m.turn, m.role, m.text))), m -> struct(m.role AS role, m.text AS text))"),
    Layout("messages", ("messages[].content", "messages[].role"), _message("role", "content") % "messages"),
    Layout("shared", ("conversations[].from", "conversations[].value"), f"transform(conversations, m -> struct({_CANON} AS role, CAST(m.value AS STRING) AS text))"),
    Layout("instruction with input", ("input", "instruction", "output"), "array(" + _PAIR.format("concat(instruction, if(coalesce(input, '') = '', '', concat('\\n\\n', input)))", "output") + ")"),
    Layout("instruction", ("instruction", "output"), "array(" + _PAIR.format("instruction", "output") + ")"),
    Layout("prompt and response", ("prompt", "response"), "array(" + _PAIR.format("prompt", "response") + ")"),
    Layout("prompt and completion", ("completion", "prompt"), "array(" + _PAIR.format("prompt", "completion") + ")"),
]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` steps into an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def layout_of(schema: T.StructType, layouts: list[Layout] | None = None) -> Layout:
    """The mapping whose fingerprint equals that of its top-level fields in ``schema``."""
    known = sorted(layouts or LAYOUTS, key=lambda x: -len(x.paths))
    for x in known:
        tops = {p.split(".")[0].removesuffix("[]") for p in x.paths}
        own = T.StructType([f for f in schema.fields if f.name in tops])
        if fingerprint(field_paths(own)) == fingerprint(x.paths):
            return x
    raise ValueError(f"no layout has fingerprint {fingerprint(field_paths(schema))}: {field_paths(schema)}")


def to_turns(df: DataFrame, key: str, layouts: list[Layout] | None = None) -> DataFrame:
    """(key, turns): records of one layout as canonical turns."""
    return df.select(F.col(key), F.expr(layout_of(df.schema, layouts).turns).cast(TURNS).alias("turns"))


def rows_to_records(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turn rows of one conversation as one record (key, turns[].turn/role/text)."""
    one = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    return rows.groupBy(key).agg(F.collect_list(one).alias("turns"))


_KINDS = {
    "turn rows": "struct<turns:array<struct<turn:bigint,role:string,text:string>>>",
    "messages": "struct<messages:array<struct<role:string,content:string>>>",
    "shared": "struct<conversations:array<struct<from:string,value:string>>>",
    "instruction with input": "struct<instruction:string,input:string,output:string>",
    "instruction": "struct<instruction:string,output:string>",
    "prompt and response": "struct<prompt:string,response:string>",
    "prompt and completion": "struct<prompt:string,completion:string>",
}
_ARRAYS = {top: sorted(p.split("[].")[1] for x in LAYOUTS for p in x.paths if p.startswith(top + "[].")) for top in ("turns", "messages", "conversations")}
_FIELDS = sorted({p for x in LAYOUTS for p in x.paths if "[]" not in p})


def record_paths(json: Column) -> Column:
    """Sorted field paths of a JSON record, of those that some mapping names; null if it is no object.

    Paths carry no types, so a null value keeps its path. Inner paths are
    those of all elements together; an array without any gives ``name[]``.
    Fields that no mapping names are left out.
    """
    keys = F.json_object_keys(json)
    none = F.array().cast("array<string>")

    def inner_paths(top: str, inner: list[str]) -> Column:
        elements = F.from_json(F.get_json_object(json, f"$.{top}"), "array<map<string,string>>")
        seen = F.array_distinct(F.flatten(F.transform(elements, lambda m: F.coalesce(F.map_keys(m), none))))
        paths = F.transform(F.filter(seen, lambda k: k.isin(inner)), lambda k: F.concat(F.lit(f"{top}[]."), k))
        some = F.when(F.size(paths) > 0, paths).otherwise(F.array(F.lit(f"{top}[]")))
        return F.when(F.array_contains(keys, top), some).otherwise(none)

    out = [F.filter(keys, lambda k: k.isin(_FIELDS)), *[inner_paths(top, inner) for top, inner in _ARRAYS.items()]]
    return F.when(keys.isNotNull(), F.array_sort(F.concat(*out)))


def _marks(layout: Layout) -> list[str]:
    """Fingerprints that select a layout: of its paths, and of its empty array if it has one."""
    tops = {p.split("[].")[0] for p in layout.paths if "[]." in p}
    return [fingerprint(layout.paths), *[fingerprint([f"{t}[]"]) for t in tops]]


def json_turns(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, fingerprint, layout, turns) of JSON records that may mix layouts.

    Every record is fingerprinted by itself: the hash of its field paths
    (``record_paths``) selects the mapping. Null values, further fields and
    empty arrays do not hide a layout: they give empty texts, are ignored and
    give no turns. Text that is no JSON object and paths without a mapping
    (such as those of two layouts at once) give null layout and turns.
    """
    told = F.sha2(F.array_join(record_paths(F.col(column)), "\n"), 256)
    out = df.select(F.col(key), F.col(column).alias("_json"), told.alias("fingerprint"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for i, x in enumerate(LAYOUTS):
        mark, kind, record = F.col("fingerprint").isin(_marks(x)), _KINDS[x.name], f"_r{i}"
        out = out.withColumn(record, F.when(mark, F.from_json("_json", kind)))
        sql = x.turns
        for f in T._parse_datatype_string(kind).fieldNames():
            sql = _qualified(sql, f, f"{record}.{f}")
        found = F.coalesce(F.expr(sql).cast(TURNS), F.array().cast(TURNS))
        layout, turns = F.when(mark, x.name).otherwise(layout), F.when(mark, found).otherwise(turns)
    return out.select(key, "fingerprint", layout.alias("layout"), turns.alias("turns"))


def _qualified(sql: str, name: str, to: str) -> str:
    import re

    return re.sub(rf"(?<![\w.'_]){name}(?![\w'])", to, sql)


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit(HEAD), F.lit("\\h")), F.lit(TURN_END), F.lit("\\e"))


def unescape(text: Column) -> Column:
    # Pieces between doubled backslashes hold single escapes only.
    pieces = F.split(text, r"\\\\", -1)
    plain = F.transform(pieces, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit(HEAD)), F.lit("\\e"), F.lit(TURN_END)), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEAD + " "), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit(":\n"))


def render(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), escape(t["text"]), F.lit(TURN_END + "\n"))), "")


def loss_spans(turns: Column, learn: str = "assistant") -> Column:
    """Spans (start, length) in characters of the formatted text that the loss covers."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        head, body = F.length(_head(t["role"])), F.length(escape(t["text"]))
        span = F.struct((acc["at"] + head).cast("int").alias("start"), body.cast("int").alias("length"))
        mine = F.coalesce(t["role"], F.lit("")) == learn
        spans = F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body + len(TURN_END) + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def read_back(formatted: Column) -> Column:
    """Canonical turns of a formatted text (inverse of ``render``)."""
    pieces = F.split(formatted, TURN_END + "\n", -1)
    own = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(piece):
        head = F.substring_index(piece, ":\n", 1)
        role = unescape(F.substring(head, F.lit(len(HEAD) + 2), F.length(head)))
        return F.struct(role.alias("role"), unescape(F.substring(piece, F.length(head) + 3, F.length(piece))).alias("text"))

    return F.transform(own, one)


def format_turns(t: DataFrame, key: str) -> DataFrame:
    """(key, n_turns, formatted, loss_spans) of canonical turns (null turns: nulls)."""
    return t.select(key, F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def format_records(records: DataFrame, key: str, layouts: list[Layout] | None = None) -> DataFrame:
    """(key, n_turns, formatted, loss_spans) of records of one layout."""
    return format_turns(to_turns(records, key, layouts), key)
