"""Chat formatting: schema fingerprints select declarative mappings.

A record is a struct column whose layout may differ from row to row (wide
structs with null branches, as schema-merging readers give them). The paths of
its non-null leaves that occur in a known layout, sorted and hashed, are the row's fingerprint. Each known
layout declares its leaf paths and how they become turns; the fingerprints of
all non-empty subsets of its leaves point to it, so a null field does not lose
a record. Only built-in expressions run: fingerprint, turns, template and loss
mask are one projection.

The template writes a turn as ``<s>[INST] role [/INST]text</s>``. Control
strings inside roles and texts are escaped with U+241B, reversibly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESC = "␛"
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``parts``: (role, leaf path) in turn order; or ``items``: the array's
    path with its role, text and (optional) order fields."""

    name: str
    parts: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str, str | None] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def leaves(self) -> list[str]:
        if self.items:
            return [f"{self.items[0]}[].{f}" for f in self.items[1:] if f]
        return [path for _, path in self.parts]

    def fingerprints(self) -> list[str]:
        some = self.leaves()
        return [fingerprint(x) for x in chain.from_iterable(combinations(some, n) for n in range(1, len(some) + 1))]


def fingerprint(paths) -> str:
    """SHA-256 of the sorted leaf paths, one a line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# Where two layouts share a fingerprint, the first one listed is taken.
LAYOUTS = (
    Layout("rows", items=("turns", "role", "text", "turn")),
    Layout("messages", items=("messages", "role", "content", None), roles=SPEAKERS),
    Layout("speakers", items=("conversations", "from", "value", None), roles=SPEAKERS),
    Layout("prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question_answer", (("user", "context"), ("user", "question"), ("assistant", "answer"))),
)


def leaf_paths(kind: T.DataType, path: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaf_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return leaf_paths(kind.elementType, f"{path}[]")
    return [path]


def _present(col: Column, path: str) -> Column:
    if "[]" not in path:
        for name in path.split("."):
            col = col.getField(name)
        return col.isNotNull()
    head, tail = path.split("[].", 1)
    for name in head.split("."):
        col = col.getField(name)
    return F.coalesce(F.exists(col, lambda x: _present(x, tail)), F.lit(False))


def row_fingerprint(record: Column, kind: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Of the leaves that some layout declares; others do not change it."""
    declared = {p for layout in layouts for p in layout.leaves()}
    marks = [F.when(_present(record, p), F.lit(p)) for p in sorted(declared & set(leaf_paths(kind)))]
    return F.sha2(F.concat_ws("\n", *marks), 256)


def _turns(record: Column, layout: Layout, kind: T.StructType) -> Column | None:
    have = set(leaf_paths(kind))
    role_of = F.create_map(*[F.lit(x) for kv in layout.roles.items() for x in kv]) if layout.roles else None
    if layout.items:
        array, role, text, order = layout.items
        if not any(p.startswith(f"{array}[].") for p in have) or not {f"{array}[].{role}", f"{array}[].{text}"} <= have:
            return None
        items = record.getField(array)
        if order and f"{array}[].{order}" in have:
            items = F.sort_array(F.transform(items, lambda x: F.struct(
                x[order].alias("o"), x[role].cast("string").alias(role), x[text].cast("string").alias(text))))
        name = (lambda x: F.coalesce(role_of[F.lower(x)], x)) if role_of is not None else (lambda x: x)
        return F.transform(items, lambda x: F.struct(F.coalesce(name(x[role].cast("string")), F.lit("")).alias("role"),
                                                     F.coalesce(x[text].cast("string"), F.lit("")).alias("text")))
    parts = [(role, path) for role, path in layout.parts if path in have]
    if not parts:
        return None
    turns = F.array(*[F.when(record.getField(path).isNotNull(), F.struct(
        F.lit(role).alias("role"), record.getField(path).cast("string").alias("text"))) for role, path in parts])
    return F.filter(turns, lambda x: x.isNotNull())


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` (``array<struct<role, text>>``).

    A record of unknown fingerprint, a null record and one without any
    non-null leaf are kept: null layout, no turns. Null roles and texts become
    empty. Turns with an order field are sorted by it, then by role and text
    (null first); repeated turns stay. Columns named ``layout`` or ``turns``
    are replaced; all others are left alone.
    """
    kind, col = df.schema[record].dataType, F.col(f"`{record}`")
    code, name, turns = row_fingerprint(col, kind, layouts), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    claimed: set[str] = set()
    for layout in layouts:
        prints = [x for x in layout.fingerprints() if x not in claimed]
        made = _turns(col, layout, kind)
        if made is None:
            continue
        claimed.update(prints)
        name = F.when(F.col("__print").isin(prints), F.lit(layout.name)).otherwise(name)
        turns = F.when(F.col("__print").isin(prints), made).otherwise(turns)
    return (df.withColumn("__print", code)
            .withColumns({"layout": name, "turns": F.coalesce(turns, F.array().cast(TURNS))}).drop("__print"))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    text = F.regexp_replace(text, r"<(?=/?s>)", ESC + "1")
    return F.regexp_replace(text, r"\[(?=/?INST\])", ESC + "2")


def unescape(text: Column) -> Column:
    for mark, char in (("2", "["), ("1", "<"), ("0", ESC)):
        text = F.replace(text, F.lit(ESC + mark), F.lit(char))
    return text


def apply_template(df: DataFrame, turns: str = "turns", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (``array<struct<start, length>>``,
    code points of ``formatted``): the texts of the trained roles."""
    shown = F.transform(F.col(turns), lambda t: F.struct(
        F.concat(F.lit(OPEN + HEAD), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body"),
        t["role"].isin(*trained).alias("on")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        size = F.length(x["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(CLOSE)).alias("at"),
                        F.when(x["on"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return (df.withColumn("__shown", shown)
            .withColumn("formatted", F.array_join(F.transform("__shown", lambda x: F.concat(
                x["head"], x["body"], F.lit(CLOSE))), ""))
            .withColumn("loss_spans", F.aggregate("__shown", start, step, lambda acc: acc["spans"])).drop("__shown"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, BODY, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN + HEAD) + 1))).alias("role"),
                        unescape(F.substr(part, F.length(head) + len(BODY) + 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"),
                                                                        s["length"].cast("int"))), ""))


def format_chats(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``canonical_turns`` and ``apply_template``; adds ``layout, turns,
    formatted, loss_spans``. An empty table gives an empty result."""
    return apply_template(canonical_turns(df, record, layouts))
