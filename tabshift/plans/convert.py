"""Whole-file conversions by a declarative spec: read, transform, and give the output as one text (for small files).

For large inputs use the same transforms with the distributed sinks of ``sources.files``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions import grammar as G
from tabshift.operators import profile as P
from tabshift.operators import transforms as T
from tabshift.sources import chunks
from tabshift.sources import files as S
from tabshift.sources.committed import write_document


class Spec(NamedTuple):
    """kind: nest, flatten, log, report, rename_json, rename_csv or restructure; the other fields as that kind needs them."""

    kind: str
    entities: tuple[T.Entity, ...] = ()
    order: tuple[str, ...] = ()
    names: Mapping[str, str] = {}
    root: str = ""
    new_root: str = ""
    target: Mapping[str, object] = {}
    title: str = ""
    sums: Mapping[str, str] = {}
    means: Mapping[str, str] = {}
    product: tuple[str, str, str] = ("", "", "")


def typed(df: DataFrame) -> DataFrame:
    """Text columns cast by their profile: integers and floats become numbers, booleans booleans; empty cells null.

    Integers stay exact: longs up to 18 digits, decimals up to 38, beyond that their text.
    """
    found = {r.col_name: r for r in P.profile(df.drop("row_idx")).collect()}
    kinds = {c: r.dtype for c, r in found.items()}

    def cast(c: str) -> Column:
        cell = F.col(f"`{c}`")
        if kinds.get(c) == "integer":
            digits = found[c].max_digits
            return (G.to_integer(cell).cast("long" if digits <= 18 else "decimal(38,0)") if digits <= 38 else F.when(~G.is_null(cell), cell)).alias(c)
        if kinds.get(c) == "float":
            return G.to_number(cell).alias(c)
        if kinds.get(c) == "boolean":
            return cell.isin("true", "True", "1", "yes").alias(c)
        return F.when(~G.is_null(cell), cell).alias(c)

    return df.select(*[F.col(c) if c == "row_idx" else cast(c) for c in df.columns])


def csv_lines(df: DataFrame, order: str) -> tuple[str, DataFrame]:
    """The header, and (order, line) of each row: comma, doubled quotes, blanks for nulls."""
    names = [c for c in df.columns if c != order]

    def cell(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    lines = df.select(order, F.concat_ws(",", *[cell(F.col(f"`{c}`")) for c in names]).alias("line"))
    return ",".join(f'"{n}"' if "," in n else n for n in names), lines


def csv_text(df: DataFrame, order: str) -> str:
    """All rows in order as one text, for small tables."""
    head, lines = csv_lines(df, order)
    return "\n".join([head, *[r.line for r in lines.orderBy(order).collect()]]) + "\n"


def write_csv_document(df: DataFrame, root: str, order: str) -> DataFrame:
    """All rows in order as one CSV document, written by many tasks."""
    head, lines = csv_lines(df, order)
    return write_document(lines, root, order, head=head + "\n")


def write_json_document(df: DataFrame, root: str, order: str) -> DataFrame:
    """All rows in order as one JSON array, written by many tasks."""
    item = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != order])
    lines = df.select(order, F.to_json(item, {"ignoreNullFields": "false"}).alias("line"))
    return write_document(lines, root, order, head="[\n", between=",\n", tail="\n]\n")


def json_text(df: DataFrame, order: str | None) -> str:
    return S.as_json_text(df, True, order).first().json + "\n"


def write_nested_document(df: DataFrame, entities: Sequence[T.Entity], root: str, order: str) -> DataFrame:
    """``nest`` with key entities and one array entity, as one JSON array from many tasks, in which no group is ever one row.

    Rows are sorted by their group's first place and their own, so that a task's range may begin and end within a group; a row
    whose place is its group's first or last also carries the text that opens or closes the group.
    """
    keys, arrays = [e for e in entities if e.key], [e for e in entities if not e.key]
    if len(arrays) != 1 or arrays[0].kind != "array" or not keys:
        raise ValueError("a nested document needs key entities and one array entity")
    columns = [c for c in df.columns if c != order]
    rules = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(*[T.entity_struct(columns, e).alias(e.name) for e in keys]), rules)
    rows = df.select(F.col(order).alias("at"), head.alias("group"), F.to_json(T.entity_struct(columns, arrays[0]), rules).alias("item"))
    ends = rows.groupBy("group").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    name = F.to_json(F.array(F.lit(arrays[0].name)))
    opening = F.concat(F.expr("substring(group, 1, length(group) - 1)"), F.lit(","), F.substring(name, F.lit(2), F.char_length(name) - 2), F.lit(":["))
    line = F.concat(F.when(F.col("at") == F.col("first"), opening).otherwise(""), F.col("item"), F.when(F.col("at") == F.col("last"), "]}").otherwise(""))
    lines = rows.join(ends, "group").select(F.struct("first", "at").alias("place"), line.alias("line"))
    return write_document(lines, root, "place", head="[\n", between=",\n", tail="\n]\n")


def field_order(spark: SparkSession, path: str) -> list[str]:
    """Leaf paths of the first record in the order of the file, which schema inference sorts away; elements of a list share its path."""
    import json

    start = spark.read.text(path, wholetext=True).select(F.col("value")) if S.one_partition(spark.read.text(path, lineSep=",")) else chunks.json_elements(spark, path).filter("row_idx = 0").select("text")
    value = json.loads(start.first()[0])

    def walk(v: object, before: str) -> list[str]:
        if isinstance(v, list):
            return list(dict.fromkeys(p for x in v for p in walk(x, before))) or [before]
        return [p for k, x in v.items() for p in walk(x, f"{before}.{k}" if before else k)] if isinstance(v, dict) else [before]

    return walk(value[0] if isinstance(value, list) and value else value, "")


def convert(spark: SparkSession, path: str, spec: Spec) -> str:
    if spec.kind == "log":
        lines = spark.read.text(path)
        lines = S.with_position(lines, single=S.one_partition(lines))
        return csv_text(T.parse_log(lines, keep=("row_idx",)), "row_idx")
    if spec.kind in ("flatten", "rename_json", "restructure"):
        rows = S.read_json(spark, path)
        if spec.kind == "flatten":
            return csv_text(T.flatten_indexed(rows, ["row_idx", *field_order(spark, path)]), "row_idx")
        if spec.kind == "rename_json":
            return json_text(T.rename_and_reorder(rows, spec.names, ["row_idx", *spec.order]), "row_idx")
        moved = T.migrate_records(rows, spec.root, spec.new_root, spec.target)
        return moved.select(F.to_json(F.struct(spec.new_root), {"pretty": "true", "ignoreNullFields": "false"}).alias("j")).first().j + "\n"
    sample = S.first_text(spark, path, "utf-8")
    raw = S.read_raw(spark, path, S.sniff(sample)._replace(has_header=True), sample=sample)
    if spec.kind == "rename_csv":
        return csv_text(T.rename_and_reorder(raw, spec.names, ["row_idx", *spec.order]), "row_idx")
    if spec.kind == "nest":
        nested = T.nest(typed(raw), spec.entities, "row_idx")
        return json_text(nested, "first_at" if "first_at" in nested.columns else "row_idx")
    if spec.kind == "report":
        return _report(raw, spec)
    raise ValueError(f"unknown kind {spec.kind}")


def plain_number(value: Decimal | None) -> str:
    """All digits of a decimal, without zeros after the last place that counts."""
    text = f"{value or 0:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _report(raw: DataFrame, spec: Spec) -> str:
    names: Sequence[str] = [c for c in raw.columns if c != "row_idx"]
    kinds = {r.col_name: r.dtype for r in P.profile(raw.drop("row_idx")).collect()}
    head = raw.sparkSession.createDataFrame([(-1, *names)], ["row_idx", *names])
    numeric = [c for c in names if kinds[c] in ("integer", "float")]
    table = T.aligned(head.unionByName(raw), names, "row_idx", numeric=numeric)
    lines = [r.line for r in table.orderBy("row_idx").collect()]
    facts = []
    if spec.sums:
        facts += [f"{label}: {plain_number(total)}" for label, total in T.totals(raw, spec.sums).first().asDict().items()]
    if spec.means:
        facts += [f"{label}: {mean}" for label, mean in T.means(raw, spec.means).first().asDict().items()]
    category, quantity, price = spec.product
    if category:
        totals = T.category_totals(raw, category, quantity, price)
        firsts = raw.groupBy(category).agg(F.min("row_idx").alias("at"))
        for r in totals.join(firsts, category, "left").orderBy(F.col("is_total"), F.col("at")).collect():
            facts.append(f"{'Grand total' if r.is_total else r[category]}: {r.total}")
    return "\n".join([spec.title, "=" * len(spec.title), "", *lines, "", *facts]) + "\n"
