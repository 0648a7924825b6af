"""Chat formatting: schema fingerprints select a mapping to canonical turns; DataFrame functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of nested fields; ``[]`` stands for an array's elements, ``{}`` for a map's values."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, prefix + "[]")
    if isinstance(schema, T.MapType):
        return paths(schema.valueType, prefix + "{}")
    return [prefix]


def fingerprint(leaves: list[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted({p.lower() for p in leaves})).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: rows of their own, an array of messages, or one column for each turn."""

    leaves: tuple[str, ...]
    rows: tuple[str, str, str] | None = None  # turn, role, text
    messages: tuple[str, str, str] | None = None  # array, role, text
    columns: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, columns whose texts are joined by an empty line)
    roles: dict[str, str] = field(default_factory=dict, hash=False)


_SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: The declared layouts.
LAYOUTS = (
    Mapping(("turn", "role", "text"), rows=("turn", "role", "text")),
    Mapping(("turn", "role", "content"), rows=("turn", "role", "content")),
    Mapping(("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Mapping(("messages[].role", "messages[].text"), messages=("messages", "role", "text")),
    Mapping(("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), roles=_SPOKEN),
    Mapping(("system", "instruction", "input", "output"), columns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), columns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("instruction", "output"), columns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "context", "response"), columns=(("user", ("context", "instruction")), ("assistant", ("response",)))),
    Mapping(("system", "prompt", "response"), columns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "response"), columns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "completion"), columns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("question", "answer"), columns=(("user", ("question",)), ("assistant", ("answer",)))),
)
_BY_PRINT = {fingerprint(list(m.leaves)): m for m in LAYOUTS}


def select_mapping(schema: T.StructType) -> Mapping:
    """The layout with the most leaves whose fingerprint the schema has.

    Columns that a layout does not name are set aside before hashing, so extra ones don't hide it.
    """
    leaves = paths(schema)
    found = []
    for m in LAYOUTS:
        tops = {p.partition(".")[0].partition("[")[0].lower() for p in m.leaves}
        own = [p for p in leaves if p.partition(".")[0].partition("[")[0].partition("{")[0].lower() in tops]
        wanted = set(m.leaves)
        if m.messages:  # further fields of a message are set aside too
            own = [p for p in own if p.lower() in wanted]
        if _BY_PRINT.get(fingerprint(own)) is m:
            found.append(m)
    if not found:
        raise ValueError(f"no layout matches the fields {sorted(leaves)}")
    return max(found, key=lambda m: len(m.leaves))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of any declared layout. Null roles and texts are empty; null messages, and system columns that are null, are no turns."""
    m = select_mapping(T.StructType([f for f in df.schema.fields if f.name != id_col]))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.rows:
        turn, role, said = m.rows
        out = df.select(F.col(id_col).alias("conv_id"), F.col(turn).cast("long").alias("turn"), text(F.col(role)).alias("role"), text(F.col(said)).alias("text"))
    elif m.messages:
        array, role, said = m.messages
        out = (
            df.select(F.col(id_col).alias("conv_id"), F.posexplode(array).alias("turn", "m"))
            .where(F.col("m").isNotNull())
            .select("conv_id", F.col("turn").cast("long"), text(F.col("m")[role]).alias("role"), text(F.col("m")[said]).alias("text"))
        )
    else:
        turns = []
        for k, (role, columns) in enumerate(m.columns):
            given = F.concat_ws("\n\n", *[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in columns])
            turn = F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), given.alias("text"))
            turns.append(F.when(F.col(columns[0]).isNotNull(), turn) if role == "system" else turn)
        out = df.select(F.col(id_col).alias("conv_id"), F.explode(F.array(*turns)).alias("m")).where(F.col("m").isNotNull()).select("conv_id", "m.*")
    if m.roles:
        named = F.col("role")
        for old, new in m.roles.items():
            named = F.when(F.lower("role") == old, F.lit(new)).otherwise(named)
        out = out.withColumn("role", named)
    return out


def escape(text: Column) -> Column:
    r"""Double backslashes, then put one behind each < or [ that could begin a control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"(<(?=[|/s<])|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    r"""Format canonical turns: conv_id, formatted, loss_spans (array of start, end in code points).

    A turn is ``<|im_start|>`` role ``\n`` text ``<|im_end|>\n``, with the role URL-encoded and the
    text escaped, so neither can hold a control string and both can be read back. Assistants' texts
    are under the loss mask. Turns go by number; equal numbers by role and text; null numbers come
    first; a null conv_id is one conversation. An empty table gives no rows. One shuffle, by conv_id.
    """
    segment = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"), F.col("said"), F.lit(CLOSE))
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("said", escape(F.col("text")))
        .withColumn("segment", segment)
        .withColumn("at", F.row_number().over(own))
        .withColumn("start", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)) + F.length("segment") - F.length("said") - len(CLOSE))
    )
    span = F.struct("at", "segment", (F.col("role") == "assistant").alias("loss"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("said")).cast("long").alias("end"))
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(span)).alias("s")).select(
        "conv_id",
        F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"),
        F.transform(F.filter("s", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_texts and formatted, parsed from the output alone.

    A row for each row given, repeated ones too; null ids stay, an empty table gives none, and other
    columns are left out. Text without turns, as an empty one, reads as no turns; a null one as null.
    """
    cut = F.split("formatted", r"<\|im_end\|>\n", -1)
    bare = lambda x: F.substr(x, F.lit(len(OPEN) + 1))
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(
            F.slice(cut, 1, F.size(cut) - 1),
            lambda x: F.struct(
                F.url_decode(F.substring_index(bare(x), "\n", 1)).alias("role"),
                unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text"),
            ),
        ).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("loss_texts"),
    )


def digests(back: DataFrame) -> DataFrame:
    """The digest columns of conversations that were read back, row by row; without turns the digests are those of empty text."""
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
