"""Chat formatting: records of many layouts become canonical turns, and turns one marked text with a loss mask.

A layout is declared by nested field paths (``messages[].role``) and a mapping to turns. The hash of the known paths
that a table or a record has is its fingerprint, and the fingerprint selects the layout:

* a table that holds turns as rows (``conv_id, turn, role, text``) is mapped as a whole, by the fingerprint of its schema;
* any other table is mapped row by row, by the fingerprint of the paths that are not null in the row, so one table
  may mix prompts, instructions and messages. Other columns don't count; a row without a known fingerprint has null turns.

The template puts ``OPEN role MIDDLE text CLOSE`` for each turn. Strings that look like control strings of this or
other chat formats get one more backslash after their first character inside roles and texts (``</s>`` becomes
``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which ``unescaped`` takes out again: the marks found in a formatted text are its own.
The mask has, for each turn, its length and the span of it, in code points from the turn's start, that the loss covers:
the texts of ``LOSS_ROLE``. Nothing is read by position from the start of a text, so long texts take linear time.

Only built-in columns are used. A turn is one shuffled row; map tasks gather the turns they have of a conversation
first, so a conversation with a third of all rows arrives as one array per map task. Its formatted text is one value.

Edge cases: a null text or role is empty; turns go by ``turn`` (null first), ties by role, then text; repeated rows
are repeated turns; rows with a null ``conv_id`` form one conversation; a conversation with null or no turns is
formatted as the empty text; an empty table gives an empty result; input columns named like results are replaced,
other columns of a table of records are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The marks of the template, and what else is escaped because chat formats use it as a control string.
OPEN, MIDDLE, CLOSE = "<|start|>", "<|message|>", "</s>"
CONTROL_TAILS = r"\||/?s>|/?SYS>>|/?INST\]"
LOSS_ROLE = "assistant"
# Names of the same role in public chat data.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

TURNS = "array<struct<role:string,text:string>>"
RESULTS = ("layout", "turns", "formatted", "mask")


@dataclass(frozen=True)
class Layout:
    """``turns`` (an array of messages) or ``parts`` (role, path of its text), or neither: turns as rows."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    def fingerprints(self) -> list[str]:
        subsets = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint([*self.required, *extra]) for extra in subsets]


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


ROWS = Layout("rows", ("conv_id", "turn", "role", "text"))
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system",), turns=("conversations", "from", "value"),
           parts=(("system", ("system",)),)),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "completion"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", ("question", "answer"), ("context",), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("nested", ("data.prompt", "data.response"), parts=(("user", ("data.prompt",)), ("assistant", ("data.response",)))),
)


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema's leaves: ``a.b`` in structs, ``a[].b`` in arrays of structs."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix + "[]")
    if not isinstance(schema, T.StructType):
        return [prefix]
    return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]


def quoted(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def present(path: str) -> Column:
    """Whether the row has a value at ``path``; in an array, in any element."""
    if "[]." not in path:
        return quoted(path).isNotNull()
    array, inner = path.split("[].", 1)
    return F.coalesce(F.exists(quoted(array), lambda e: e[inner].isNotNull()), F.lit(False))


def row_fingerprint(known: list[str]) -> Column:
    """The fingerprint of each row: the hash of the ``known`` paths with a value, in order."""
    found = F.concat_ws("\n", *[F.when(present(p), F.lit(p)) for p in sorted(known)])
    return F.sha2(found, 256)


def role_of(role: Column) -> Column:
    plain = F.coalesce(role.cast("string"), F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair]), plain), plain)


def made_turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def mapped(layout: Layout, known: list[str]) -> Column:
    """The canonical turns that ``layout`` declares; parts whose fields are all null are left out."""
    pieces = []
    for role, paths in layout.parts:
        fields = [quoted(p).cast("string") for p in paths if p in known]
        if fields:
            text = F.concat_ws("\n", *[F.when(f != "", f) for f in fields])
            turn = F.array(made_turn(F.lit(role), text))
            pieces.append(F.when(F.coalesce(*fields).isNotNull(), turn).otherwise(F.lit([]).cast(TURNS)))
    if layout.turns:
        array, role, text = layout.turns
        pieces.append(F.transform(F.filter(quoted(array), lambda e: e.isNotNull()), lambda e: made_turn(role_of(e[role]), e[text])))
    return F.concat(*[p.cast(TURNS) for p in pieces])


def from_records(records: DataFrame) -> DataFrame:
    """Add ``layout`` and ``turns`` to records of any mix of layouts."""
    records = records.drop(*RESULTS)
    have = set(schema_paths(records.schema))
    usable = [lay for lay in LAYOUTS if have.issuperset(lay.required)]
    known = sorted({p for lay in usable for p in (*lay.required, *lay.optional) if p in have})
    if not usable:
        return records.withColumn("layout", F.lit(None).cast("string")).withColumn("turns", F.lit(None).cast(TURNS))
    names = F.create_map(*[F.lit(v) for lay in usable for print_ in lay.fingerprints() for v in (print_, lay.name)])
    records = records.withColumn("layout", F.element_at(names, row_fingerprint(known)))
    return records.withColumn("turns", F.coalesce(*[F.when(F.col("layout") == lay.name, mapped(lay, known)) for lay in usable]))


def from_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, turns) from turns as rows, by ``turn`` (null first), role and text."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    gathered = rows.select("conv_id", turn.alias("_turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return gathered.select("conv_id", F.lit(ROWS.name).alias("layout"),
                           F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def canonical(table: DataFrame) -> DataFrame:
    """``layout`` and ``turns`` of a table in any layout, chosen by fingerprint."""
    paths = set(schema_paths(table.schema)).intersection(ROWS.required)
    if fingerprint(paths) in ROWS.fingerprints():
        return from_rows(table)
    return from_records(table)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])(\\*)({CONTROL_TAILS})"), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])\\(\\*)({CONTROL_TAILS})"), F.lit(r"$1$2$3"))


def formatted(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """Add ``formatted`` and ``mask`` (per turn: chars, start, end) to rows with ``turns``; ``turns`` goes."""

    def marked(turn: Column) -> Column:
        role, text = escaped(turn["role"]), escaped(turn["text"])
        return F.struct(F.concat(F.lit(OPEN), role, F.lit(MIDDLE)).alias("head"), text.alias("text"), (turn["role"] == loss_role).alias("loss"))

    def masked(turn: Column) -> Column:
        head, body = F.char_length(turn["head"]), F.char_length(turn["text"])
        return F.struct((head + body + len(CLOSE)).alias("chars"), head.alias("start"), F.when(turn["loss"], head + body).otherwise(head).alias("end"))

    kept = [c for c in conversations.columns if c not in ("turns", "formatted", "mask", "_marked")]
    rows = conversations.select(*kept, F.transform(F.coalesce("turns", F.lit([]).cast(TURNS)), marked).alias("_marked"))
    text = F.array_join(F.transform("_marked", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))), "")
    return rows.select(*kept, text.alias("formatted"), F.transform("_marked", masked).alias("mask"))


def read_back(rows: DataFrame) -> DataFrame:
    """Add ``turns`` (unescaped) and ``loss_texts`` (unescaped), read from ``formatted`` and ``mask`` alone."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")  # each turn has a mark at least
    masked = F.zip_with(pieces, "mask", lambda p, m: F.struct(p.alias("piece"), m.alias("mask")))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, MIDDLE.replace("|", r"\|"), -1)
        return F.struct(unescaped(F.substring(halves[0], len(OPEN) + 1, 2**31 - 1)).alias("role"), unescaped(halves[1]).alias("text"))

    def loss(p: Column) -> Column:
        return unescaped(F.substr(p["piece"], p["mask"]["start"] + 1, p["mask"]["end"] - p["mask"]["start"]))

    covered = F.filter(masked, lambda p: p["mask"]["end"] > p["mask"]["start"])
    return rows.select("*", F.transform(pieces, turn).alias("turns"), F.transform(covered, loss).alias("loss_texts"))


def chat(table: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``formatted`` and ``mask`` of a table in any known layout."""
    return formatted(canonical(table), loss_role)
