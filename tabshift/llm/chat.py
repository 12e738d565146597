"""Chat formatting by schema fingerprints, in DataFrame functions alone.

``LAYOUTS`` is a registry of declarative mappings. Each names the nested field paths that it needs; its fingerprint is the hash of
these. A record or a table is of a layout if the hash of those of the layout's paths that it has is that fingerprint; of several
the one with the most paths maps it, so further fields never matter. The paths of JSON records are read row by row (a path below a
list is there if any element has it), those of tables once from the schema; both ways give one hash. The chosen mapping turns
turn rows, messages, prompt or instruction layouts into canonical turns (conversation, turn, role, text). The template then writes
turns as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

Inside a text, any ``<``, backslashes, ``|`` gets one more backslash, and loses it on reading, so texts can never show a control
string; roles are percent-encoded where they aren't plain words. The loss mask is the list of code-point spans of assistant
texts. Offsets come from a running sum over turns, so a long conversation costs no more a turn than a short one.

Ids of conversations are longs where the given ones are whole numbers, else texts. Names of speakers (``human``, ``gpt``, ...) become
roles in records and in tables whose column is one of speakers; a table's column of roles stays as it is.

Defined results: null roles and texts are empty; turns with equal numbers go by role, then text; null turns come first; rows
without a conversation id can't be told to belong together, so that each is a conversation of its own; a record of unknown layout,
without a turn, or that is no JSON is one turn of role ``unknown`` that holds the record as it is, with layout null, so that none
is lost; a message without text that calls tools has its calls as text, and the texts of a list of parts are joined by newlines;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
UNKNOWN = "unknown"


class Layout(NamedTuple):
    """paths: the field paths that it needs. Then one of

    * turns: (role, path) of single texts; those that are empty are left out;
    * each, fields: a list of messages and (role path, text path) below it;
    * rows: the columns (conversation, turn, role, text) of a table of turns.

    before: (role, path) of texts that may go before the turns.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    fields: tuple[str, str] = ("", "")
    rows: tuple[str, str, str, str] | None = None
    before: tuple[tuple[str, str], ...] = (("system", "system"),)


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("utterance_rows", ("dialog_id", "position", "speaker", "utterance"), rows=("dialog_id", "position", "speaker", "utterance")),
    Layout("message_rows", ("conversation_id", "index", "role", "content"), rows=("conversation_id", "index", "role", "content")),
    Layout("messages", ("messages[].role", "messages[].content"), each="messages", fields=("role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each="conversations", fields=("from", "value")),
    Layout("instruction_input", ("instruction", "input", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Layout("nested_prompt", ("data.prompt", "data.response"), turns=(("user", "data.prompt"), ("assistant", "data.response"))),
)
#: Most specific first; of equals the one listed first.
BY_PATHS = tuple(sorted(LAYOUTS, key=lambda layout: -len(layout.paths)))
KNOWN = tuple(sorted({p for layout in LAYOUTS if not layout.rows for p in layout.paths}))
#: Names of speakers in common layouts.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def fingerprint_of(paths: Iterable[str], layout: Layout) -> int:
    """The hash of those of a layout's paths that are among ``paths``, as the signed long that ``record_fingerprint`` gives."""
    value = xxhash.xxh64_intdigest(",".join(sorted(set(paths) & set(layout.paths))).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def schema_paths(kind: T.DataType, before: str = "") -> list[str]:
    """All nested field paths of a schema; ``[]`` after arrays."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, before + "[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{before}.{f.name}" if before else f.name)]
    return [before]


def record_paths(variant: Column) -> Column:
    """The KNOWN paths that a record has, in order."""

    def has(path: str) -> Column:
        above, listed, below = path.partition("[].")
        if not listed:
            return F.try_variant_get(variant, f"$.{path}", "variant").isNotNull()
        elements = F.try_variant_get(variant, f"$.{above}", "array<variant>")
        return F.exists(elements, lambda m: F.try_variant_get(m, f"$.{below}", "variant").isNotNull())

    return F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in KNOWN]))


def record_fingerprint(paths: Column, layout: Layout) -> Column:
    """The hash of those of a layout's paths that a record has."""
    own = F.array(*[F.lit(p) for p in sorted(layout.paths)])
    return F.xxhash64(F.array_join(F.array_intersect(own, paths), ","))


def layout_of(paths: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for layout in reversed([x for x in BY_PATHS if not x.rows]):
        chosen = F.when(record_fingerprint(paths, layout) == F.lit(fingerprint_of(layout.paths, layout)), F.lit(layout.name)).otherwise(chosen)
    return chosen


def table_layout(schema: T.StructType) -> Layout | None:
    """The layout whose fingerprint a table's schema has."""
    paths = schema_paths(schema)
    return next((x for x in BY_PATHS if fingerprint_of(paths, x) == fingerprint_of(x.paths, x)), None)


def conversation_id(table: DataFrame, name: str) -> Column:
    """Whole numbers as longs, all other ids as texts."""
    whole = isinstance(table.select(name).schema[0].dataType, T.IntegralType)
    return F.col(name).cast("long" if whole else "string")


def role_of(speaker: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.coalesce(speaker, F.lit(""))), speaker)


def _message(role: str, text: str):
    """A message's canonical turn, from a variant."""

    def turn(m: Column) -> Column:
        get = lambda path: F.try_variant_get(m, f"$.{path}", "string")
        parts = F.try_variant_get(m, f"$.{text}", "array<variant>")
        joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"))), NEWLINE)
        said = F.coalesce(F.when(parts.isNotNull(), joined).otherwise(get(text)), get("tool_calls"), get("function_call"))
        return F.struct(role_of(get(role)).alias("role"), said.alias("text"))

    return turn


def canonical(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, layout, turns) of JSON records; turns: array<struct<role, text>>."""
    rows = records.select(conversation_id(records, id_col).alias("conv_id"), F.col(json_col).cast("string").alias("json"), F.try_parse_json(F.col(json_col).cast("string")).alias("v"))
    rows = rows.withColumn("layout", layout_of(record_paths(F.col("v"))))

    def single(pairs: tuple[tuple[str, str], ...]) -> Column:
        both = F.array(*[F.struct(F.lit(r).alias("role"), F.try_variant_get(F.col("v"), f"$.{p}", "string").alias("text")) for r, p in pairs]).cast(TURNS)
        return F.filter(both, lambda t: F.coalesce(t["text"], F.lit("")) != "")

    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        if layout.each:
            own = F.transform(F.try_variant_get(F.col("v"), f"$.{layout.each}", "array<variant>"), _message(*layout.fields)).cast(TURNS)
        elif layout.turns:
            own = single(layout.turns)
        else:
            continue
        turns = F.when(F.col("layout") == layout.name, F.concat(single(layout.before), own)).otherwise(turns)
    whole = F.array(F.struct(F.lit(UNKNOWN).alias("role"), F.col("json").alias("text"))).cast(TURNS)
    found = rows.select("conv_id", "json", "layout", turns.alias("turns"))
    some = F.coalesce(F.size("turns") > 0, F.lit(False))
    return found.select("conv_id", F.when(some, F.col("layout")).alias("layout"), F.when(some, F.col("turns")).otherwise(whole).alias("turns"))


def turn_rows(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical (conv_id, turn, role, text) rows of JSON records; those without an id are told apart by negative ids below -1 or, among texts, by ``no id`` and a number."""
    found = canonical(records, id_col, json_col)
    number = F.monotonically_increasing_id()
    alone = -2 - number if isinstance(found.schema["conv_id"].dataType, T.LongType) else F.concat(F.lit("no id "), number.cast("string"))
    found = found.withColumn("conv_id", F.coalesce("conv_id", alone))
    return found.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def table_rows(table: DataFrame, id_col: str | None = None) -> DataFrame:
    """Canonical (conv_id, turn, role, text) rows of a table, by the mapping that its schema's fingerprint selects.

    Tables of records (one conversation a row) need ``id_col``.
    """
    layout = table_layout(table.schema)
    if layout is not None and layout.rows:
        conversation, turn, role, text = layout.rows
        said = F.col(role).cast("string")
        return table.select(conversation_id(table, conversation).alias("conv_id"), F.col(turn).try_cast("long").alias("turn"), (said if role == "role" else role_of(said)).alias("role"), F.col(text).cast("string").alias("text"))
    if layout is None or id_col is None:
        raise ValueError("not a table of turns" if layout is None else f"a table of {layout.name} needs the column of its ids")
    return turn_rows(table.select(F.col(id_col).alias("id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])).alias("record")), "id", "record")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): one text a conversation; mask: array<struct<start, end>> of the assistant's texts in it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit(NEWLINE))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    shown = rows.select("conv_id", alone.alias("alone"), "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    shown = shown.withColumn("piece", F.concat("head", "body", F.lit(END + NEWLINE)))
    order = Window.partitionBy("conv_id", "alone").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shown.withColumn("place", F.row_number().over(order)).withColumn("past", F.sum(F.char_length("piece").cast("long")).over(order))
    start = F.col("past") - F.char_length("piece") + F.char_length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.char_length("body")).alias("end")))
    parts = F.array_sort(F.collect_list(F.struct("place", "piece", span.alias("span"))))
    whole = placed.groupBy("conv_id", "alone").agg(parts.alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), F.array_compact(F.transform("parts", lambda p: p["span"])).alias("mask"))


def parsed(text: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted text."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        head = F.position(F.lit(NEWLINE), piece)
        body = F.substring(piece, head + 1, F.char_length(piece) - head - len(END + NEWLINE))
        return F.struct(F.url_decode(F.substring(piece, F.lit(1), head - 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def masked(text: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(text, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def digests(shown: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted texts."""
    turns = shown.withColumn("turns", parsed(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
