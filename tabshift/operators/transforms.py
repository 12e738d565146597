"""The five conversions as declarative plans: nest, flatten, parse logs, report, migrate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.functions import grammar as G

# ---- flat to nested ----


class Entity(NamedTuple):
    """Columns with ``prefix`` become ``name``: one object, or an array of objects with one element a row; key: rows group by it."""

    name: str
    prefix: str
    kind: str = "object"
    key: bool = False


def entity_struct(columns: Sequence[str], entity: Entity) -> Column:
    own = [c for c in columns if c.startswith(entity.prefix)]
    if not own:
        raise ValueError(f"no column begins with {entity.prefix}")
    return F.struct(*[F.col(f"`{c}`").alias(c[len(entity.prefix) :]) for c in own])


def nest(df: DataFrame, entities: Sequence[Entity], order: str | None = None) -> DataFrame:
    """Nested rows. With key entities, rows of equal keys collapse: arrays in row order, groups ranked by ``first_at``."""
    columns = [c for c in df.columns if c != order]
    left = [c for c in columns if not any(c.startswith(e.prefix) for e in entities)]
    if left:
        raise ValueError(f"no entity takes {left}")
    structs = {e.name: entity_struct(columns, e) for e in entities}
    if not any(e.key for e in entities):
        return df.select(*([order] if order else []), *[(F.array(structs[e.name]) if e.kind == "array" else structs[e.name]).alias(e.name) for e in entities])
    if order is None:
        raise ValueError("grouping needs the column that orders rows")
    keys = [structs[e.name].alias(e.name) for e in entities if e.key]
    grouped = df.groupBy(*keys).agg(F.min(order).alias("first_at"), *[F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), structs[e.name].alias("x")))).alias(e.name) for e in entities if not e.key])
    return grouped.select("first_at", *[F.col(e.name) if e.key else F.transform(e.name, lambda s: s["x"]).alias(e.name) if e.kind == "array" else F.element_at(F.col(e.name), 1)["x"].alias(e.name) for e in entities])


# ---- nested to flat ----


def leaf_paths(kind: T.DataType, before: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in leaf_paths(f.dataType, (*before, f.name))]
    return [before]


def flatten(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Struct leaves as columns with dotted names, in schema order or in that of ``order``."""
    paths = {".".join(p): p for p in leaf_paths(df.schema)}
    names = list(order) if order is not None else list(paths)
    if set(names) != set(paths):
        raise ValueError(f"the order must name all leaves: {sorted(set(names) ^ set(paths))}")
    return df.select(*[F.col(".".join(f"`{x}`" for x in paths[n])).alias(n) for n in names])


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def array_widths(df: DataFrame) -> dict[str, int]:
    """The most elements that any array of each path has (``items``, ``items[].tags``), structs and arrays in arrays included: one aggregation."""
    found: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, name: str, at: Column, many: bool) -> None:
        """``at``: the value, or if ``many`` the array of all values that a row has there."""
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{name}.{f.name}" if name else f.name, F.transform(at, _field(f.name)) if many else at[f.name], many)
        elif isinstance(kind, T.ArrayType):
            sizes = F.array_max(F.transform(at, F.size)) if many else F.size(at)
            found.append((name, F.greatest(F.coalesce(F.max(sizes), F.lit(0)), F.lit(0))))
            walk(kind.elementType, f"{name}[]", F.flatten(F.filter(at, lambda x: x.isNotNull())) if many else at, True)

    for f in df.schema.fields:
        walk(f.dataType, f.name, F.col(f"`{f.name}`"), False)
    if not found:
        return {}
    widths = df.agg(*[w.alias(str(i)) for i, (_, w) in enumerate(found)]).first()
    return {name: widths[i] for i, (name, _) in enumerate(found)}


def flatten_indexed(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Every leaf as a column, array elements too: ``items.0.name``, ``items.1.name``, as many as the longest array of that path has.

    ``order`` names paths without indices (``items.name``) in the order of their columns; paths that it lacks come last, in schema
    order. Elements beyond a row's array, and leaves of null structs, are null. Two leaves of one name raise an error.
    """
    widths = array_widths(df)
    places = {p: i for i, p in reversed(list(enumerate(order)))}
    columns: list[tuple[str, Column]] = []

    def place(path: str) -> int:
        return min((i for p, i in places.items() if p == path or p.startswith(path + ".")), default=len(order))

    def walk(kind: T.DataType, name: str, path: str, shape: str, at: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in sorted(kind.fields, key=lambda f: place(f"{path}.{f.name}")):
                walk(f.dataType, f"{name}.{f.name}", f"{path}.{f.name}", f"{shape}.{f.name}", at[f.name])
        elif isinstance(kind, T.ArrayType):
            for i in range(widths[shape]):
                walk(kind.elementType, f"{name}.{i}", path, f"{shape}[]", F.get(at, F.lit(i)))
        else:
            columns.append((name, at))

    for f in sorted(df.schema.fields, key=lambda f: place(f.name)):
        walk(f.dataType, f.name, f.name, f.name, F.col(f"`{f.name}`"))
    names = [n for n, _ in columns]
    if len(set(names)) < len(names):
        raise ValueError(f"several leaves are named {sorted({n for n in names if names.count(n) > 1})}")
    return df.select(*[c.alias(n) for n, c in columns])


def expand_rows(df: DataFrame, array: str, index: str = "index") -> DataFrame:
    """One row an element, with its index; rows without elements stay."""
    return df.select(*[c for c in df.columns if c != array], F.posexplode_outer(array).alias(index, array))


def expand_columns(df: DataFrame, array: str, n: int) -> DataFrame:
    """The first n elements as columns array.0, array.1, ..."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(F.col(array), F.lit(i)).alias(f"{array}.{i}") for i in range(n)])


# ---- logs ----

#: Patterns with groups date, time, level, source, message.
LOG_PATTERNS = {
    "bracket": r"^\[(\S+) (\S+)\] (\w+) ([^:]+): (.*)$",
    "iso_z": r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})Z? (\w+) \[([^\]]+)\] (.*)$",
    "java": r"^(\S+) (\S+),\d+ (\w+)\s+\[[^\]]+\] (\S+) - (.*)$",
}


def parse_log(lines: DataFrame, line: str = "value", pattern: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., timestamp, level, source, message). Lines of no known form keep their text as message; works on streams too."""
    text = F.col(line)
    chosen = [LOG_PATTERNS[pattern]] if pattern else list(LOG_PATTERNS.values())

    def part(group: Column | None, build) -> Column:
        out = group
        for p in reversed(chosen):
            out = F.when(text.rlike(p), build(p)).otherwise(out)
        return out

    get = lambda p, i: F.regexp_extract(text, p, i)
    return lines.select(
        *keep, part(F.lit(""), lambda p: F.concat(get(p, 1), F.lit("T"), get(p, 2))).alias("timestamp"), part(F.lit(""), lambda p: get(p, 3)).alias("level"),
        part(F.lit(""), lambda p: get(p, 4)).alias("source"), part(text, lambda p: get(p, 5)).alias("message"),
    )


# ---- reports ----


def aligned(rows: DataFrame, columns: Sequence[str], order: str, numeric: Sequence[str] = (), group: Sequence[str] = ()) -> DataFrame:
    """(group..., order, line): cells padded to the widest of their column (and group), numbers to the right.

    Widths are an aggregation; without groups its one row becomes part of the plan, with groups it is joined back.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    widest = [F.greatest(F.max(F.char_length(text(c))), F.lit(len(c))).alias(f"_w{i}") for i, c in enumerate(columns)]
    if group:
        named = {g: f"_g{i}" for i, g in enumerate(group)}
        widths = rows.groupBy(*group).agg(*widest).withColumnsRenamed(named)
        same = [F.col(g).eqNullSafe(F.col(n)) for g, n in named.items()]
        rows, width = rows.join(widths, same), [F.col(f"_w{i}") for i in range(len(columns))]
    else:
        found = rows.agg(*widest).first()
        width = [F.lit(found[i] or 0) for i in range(len(columns))]
    cells = []
    for c, w in zip(columns, width, strict=True):
        fill = F.repeat(F.lit(" "), (w - F.char_length(text(c))).cast("int"))
        cells.append(F.concat(fill, text(c)) if c in numeric else F.concat(text(c), fill))
    return rows.select(*group, order, F.rtrim(F.concat_ws("  ", *cells)).alias("line"))


def report(lines: DataFrame, title: Column, order: str, line: str = "line", group: Sequence[str] = (), footer: Column | None = None) -> DataFrame:
    """(group..., report): title, underline, the lines in order, and a footer."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda s: s["l"]), "\n")
    grouped = lines.groupBy(*group).agg(body.alias("body"))
    parts = [title, F.repeat(F.lit("="), F.char_length(title)), F.lit(""), F.col("body")]
    return grouped.select(*group, F.concat_ws("\n", *parts, *([F.lit(""), footer] if footer is not None else [])).alias("report"))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def totals(rows: DataFrame, sums: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., label...): sums of columns by their labels, exact in decimals of ten places; text cells count as far as they are numbers."""
    text = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}

    def exact(c: str) -> Column:
        cell = F.col(f"`{c}`")
        return F.when(G.is_number(cell), F.regexp_replace(F.trim(cell), "_", "").try_cast("decimal(28,10)")) if c in text else cell.cast("decimal(28,10)")

    return rows.groupBy(*by).agg(*[F.sum(exact(c)).alias(label) for label, c in sums.items()])


def means(rows: DataFrame, columns: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., label...): means of columns by their labels, written with two places."""
    text = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    number = lambda c: G.to_number(F.col(f"`{c}`")) if c in text else F.col(f"`{c}`").cast("double")
    return rows.groupBy(*by).agg(*[F.format_string("%.2f", F.round(F.avg(number(c)), 2)).alias(label) for label, c in columns.items()])


def category_totals(rows: DataFrame, category: str, quantity: str, price: str) -> DataFrame:
    """(category, total): money sums by category and over all (category null), exact in decimals."""
    amount = F.col(quantity).cast("decimal(18,0)") * money(F.col(price))
    return rows.rollup(category).agg(F.sum(amount).cast("decimal(28,2)").alias("total"), F.grouping(category).cast("int").alias("is_total"))


# ---- schema migration ----


def rename_and_reorder(df: DataFrame, names: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Columns renamed and put in order; none may be lost or added."""
    renamed = df.withColumnsRenamed(dict(names))
    if sorted(order) != sorted(renamed.columns):
        raise ValueError("the order must have every column once")
    return renamed.select(*[F.col(f"`{c}`") for c in order])


def restructure(source: Column, target: Mapping[str, object]) -> Column:
    """A struct after a tree of names: leaves are field paths of ``source``, branches are mappings.

    >>> restructure(F.col("r"), {"name": {"first": "firstName", "last": "lastName"}, "birth_year": "birthYear"})
    """

    def at(path: str) -> Column:
        out = source
        for name in path.split("."):
            out = out[name]
        return out

    return F.struct(*[(restructure(source, v) if isinstance(v, Mapping) else at(str(v))).alias(k) for k, v in target.items()])


def target_leaves(target: Mapping[str, object]) -> list[str]:
    return [p for v in target.values() for p in (target_leaves(v) if isinstance(v, Mapping) else [str(v)])]


def migrate_records(df: DataFrame, root: str, new_root: str, target: Mapping[str, object]) -> DataFrame:
    """{root: [records]} to {new_root: [restructured records]}; every field of a record must be used once."""
    element = df.schema[root].dataType.elementType
    if sorted(target_leaves(target)) != sorted(".".join(p) for p in leaf_paths(element)):
        raise ValueError("the target must use every field once")
    return df.select(F.transform(F.col(root), lambda r: restructure(r, target)).alias(new_root))
