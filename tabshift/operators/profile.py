"""Column profiles, samples and data-quality rules of a table.

A profile is two aggregations: distinct (column, value) pairs with their counts, then one row a column. Every predicate of the
dtype ladder is so evaluated once for each distinct value, and the second aggregation combines before its shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.functions import grammar as G

MAX_INVALID_DATES = 0.05


def unpivoted(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., col_pos, col_name, value): one row a cell."""
    cells = [F.struct(F.lit(i).alias("col_pos"), F.lit(c).alias("col_name"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(x for x in df.columns if x not in keep)]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.*")


def dtype_ladder() -> Column:
    """integer, float, boolean, date or datetime, mixed, string: the first that all values (for mixed: any value) accept."""
    dates = (F.col("invalid_dates") / F.col("n_values") < MAX_INVALID_DATES) & (F.col("zero_padded") == 0)
    return (
        F.when(F.col("n_values") == 0, "string").when(F.col("ints") == F.col("n_values"), "integer").when(F.col("floats") == F.col("n_values"), "float")
        .when(F.col("bools") == F.col("n_values"), "boolean").when(dates & F.col("has_time"), "datetime").when(dates, "date")
        .when(F.col("typed") > 0, "mixed").otherwise("string")
    )


def kinds_of(df: DataFrame) -> dict[int, str]:
    """By place, what the schema says of columns that aren't text: integer, float, boolean, date or timestamp."""
    found = {}
    for i, f in enumerate(df.schema.fields):
        t = f.dataType
        if isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0):
            found[i] = "integer"
        elif isinstance(t, (T.FractionalType, T.DecimalType)):
            found[i] = "float"
        elif isinstance(t, T.BooleanType):
            found[i] = "boolean"
        elif isinstance(t, T.DateType):
            found[i] = "date"
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            found[i] = "timestamp"
    return found


def by_kind(kinds: Mapping[int, str]) -> Callable[..., Column]:
    """by_kind(kinds)(text, integer=..., ...): one expression for the columns of each kind, and ``text`` for all others."""

    def choose(text: Column, **known: Column) -> Column:
        out = text
        for kind, value in known.items():
            places = [i for i, k in kinds.items() if k == kind]
            if places:
                out = F.when(F.col("col_pos").isin(*places), value).otherwise(out)
        return out

    return choose


def distinct_cells(cells: DataFrame, order: str | None = None) -> DataFrame:
    """(col_pos, col_name, value, n): each distinct value of a column with its count, and with its first place if there is an order. Cells without col_name give rows without it."""
    first = [F.min(order).alias("first_at")] if order else []
    return cells.groupBy(*[c for c in ("col_pos", "col_name", "value") if c in cells.columns]).agg(F.count("*").alias("n"), *first)


def profile_cells(cells: DataFrame, approximate: bool = False, kinds: Mapping[int, str] = {}) -> DataFrame:
    """The profile of (col_pos, col_name, value) rows, see ``profile_distinct``. ``kinds`` (see ``kinds_of``) spares typed columns the tests of their text.

    ``approximate`` estimates unique_count (HyperLogLog, 2 % relative deviation) in one aggregation over the cells, so that nothing
    but a few numbers a column and task is shuffled; all else is as exact as before.
    """
    if approximate:
        return profile_distinct(cells.withColumn("n", F.lit(1)), F.approx_count_distinct(F.when(~F.col("null"), F.col("value")), 0.02), kinds)
    return profile_distinct(distinct_cells(cells), kinds=kinds)


def profile_distinct(distinct: DataFrame, uniques: Column | None = None, kinds: Mapping[int, str] = {}) -> DataFrame:
    """(col_pos, col_name, dtype, row_count, null_count, unique_count, min_value, max_value, max_length, min_integer, max_integer, max_digits) of (col_pos, col_name, value, n) rows.

    min_value and max_value are doubles; those of integer columns are also given exactly, as decimals of up to 38 digits.
    """
    return of_totals(totals(facts(distinct, kinds), uniques))


def facts(distinct: DataFrame, kinds: Mapping[int, str] = {}) -> DataFrame:
    """What each (col_pos, col_name, value, n) row is: the predicates and readings that totals need."""
    value, never, typed = F.col("value"), F.lit(None).cast("timestamp"), by_kind(kinds)
    length, whole = F.char_length(value), ~value.contains(".")
    plain = lambda known, other: F.when(F.col("plain"), known).otherwise(other)
    # a plain number is a day only if it is as long as a year, or as one with month and day
    ts = F.when(~F.col("plain") | length.isin(4, 8), G.to_timestamp(value))
    return distinct.withColumn("plain", F.coalesce(G.is_plain(value), F.lit(False))).select(
        "col_pos", "col_name", "n", "value", G.is_null(value).alias("null"), typed(plain(whole, G.is_integer(value)), integer=F.lit(True), float=F.lit(False), boolean=F.lit(False), date=F.lit(False), timestamp=F.lit(False)).alias("i"),
        typed(plain(F.lit(True), G.is_float(value)), integer=F.lit(True), float=F.lit(True), boolean=F.lit(False), date=F.lit(False), timestamp=F.lit(False)).alias("f"), G.is_boolean(value).alias("b"),
        typed(ts, integer=never, float=never, boolean=never, date=value.try_cast("date").cast("timestamp"), timestamp=value.try_cast("timestamp")).alias("ts"),
        typed(plain(F.lit(False), G.zero_padded(value)), integer=F.lit(False), float=F.lit(False), date=F.lit(False), timestamp=F.lit(False)).alias("z"),
        typed(plain(value.try_cast("double"), G.to_number(value)), integer=value.try_cast("double"), float=value.try_cast("double")).alias("number"),
        typed(plain(F.when(whole, value.try_cast("decimal(38,0)")), G.to_integer(value)), integer=value.try_cast("decimal(38,0)")).alias("whole"),
        typed(plain(F.when(whole, length - value.startswith("-").cast("int")), G.integer_digits(value)), integer=F.char_length(F.replace(value, F.lit("-"), F.lit("")))).alias("digits"), length.alias("length"),
    )


def totals(seen: DataFrame, uniques: Column | None = None, *more: Column) -> DataFrame:
    """One row a column: counts and ends of ``facts``, of which the dtype and all else follows. They add up over parts of a table."""
    when = lambda c: F.coalesce(F.sum(F.when(~F.col("null") & c, F.col("n"))), F.lit(0)).cast("long")
    t = F.col("ts")
    return seen.groupBy("col_pos", "col_name").agg(
        F.sum("n").cast("long").alias("row_count"), F.coalesce(F.sum(F.when(F.col("null"), F.col("n"))), F.lit(0)).cast("long").alias("null_count"),
        (F.count(F.when(~F.col("null"), 1)) if uniques is None else uniques).cast("long").alias("unique_count"), when(F.lit(True)).alias("n_values"), when(F.col("i")).alias("ints"),
        when(F.col("f")).alias("floats"), when(F.col("b")).alias("bools"), when(t.isNull()).alias("invalid_dates"), when(F.col("z")).alias("zero_padded"),
        when(F.col("i") | F.col("f") | F.col("b")).alias("typed"), F.coalesce(F.bool_or((F.hour(t) != 0) | (F.minute(t) != 0) | (F.second(t) != 0)), F.lit(False)).alias("has_time"),
        F.min(F.when(~F.col("null"), F.col("number"))).alias("min_value"), F.max(F.when(~F.col("null"), F.col("number"))).alias("max_value"), F.max(F.when(~F.col("null"), F.col("length"))).alias("length"),
        F.min("whole").alias("min_integer"), F.max("whole").alias("max_integer"), F.max("digits").alias("max_digits"), *more,
    )


def of_totals(stats: DataFrame) -> DataFrame:
    """The profile that totals stand for."""
    typed = stats.withColumn("dtype", dtype_ladder())
    numeric = F.col("dtype").isin("integer", "float")
    return typed.select(
        "col_pos", "col_name", "dtype", "row_count", "null_count", "unique_count", F.when(numeric, F.col("min_value")).alias("min_value"), F.when(numeric, F.col("max_value")).alias("max_value"),
        F.when(F.col("dtype") == "string", F.coalesce("length", F.lit(0))).cast("long").alias("max_length"),
        *[F.when(F.col("dtype") == "integer", F.col(c)).alias(c) for c in ("min_integer", "max_integer", "max_digits")],
    )


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """The profile of all columns. With ``approximate``, typed columns are aggregated as they are and only text is taken apart."""
    kinds = kinds_of(df)
    if not approximate:
        # places stand for names until each value is there once
        names = F.get(F.array(*[F.lit(c) for c in df.columns]), F.col("col_pos"))
        return profile_distinct(distinct_cells(unpivoted(df).drop("col_name")).withColumn("col_name", names), kinds=kinds)
    text = [c for i, c in enumerate(df.columns) if i not in kinds]
    places = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    parts = [profile_cells(unpivoted(df.select(*[F.col(f"`{c}`") for c in text])), True).withColumn("col_pos", places[F.col("col_name")])] if text else []
    return functools.reduce(DataFrame.unionByName, parts + ([typed_profile(df, kinds)] if kinds else []))


def typed_profile(df: DataFrame, kinds: Mapping[int, str]) -> DataFrame:
    """The profile of the columns at the places of ``kinds`` in one aggregation without a cell table; distinct counts are estimates."""
    aggregates, rows = [F.count("*").alias("_n")], []
    for i, kind in kinds.items():
        c = F.col(f"`{df.columns[i]}`")
        timed = F.bool_or((F.hour(c) != 0) | (F.minute(c) != 0) | (F.second(c) != 0)) if kind == "timestamp" else F.lit(False)
        aggregates += [F.count(c).alias(f"_c{i}"), F.approx_count_distinct(c, 0.02).alias(f"_u{i}"), F.min(c).alias(f"_l{i}"), F.max(c).alias(f"_h{i}"), timed.alias(f"_t{i}")]
        some, number = F.col(f"_c{i}") > 0, kind in ("integer", "float")
        dtype = F.when(F.col(f"_t{i}"), "datetime").otherwise("date") if kind == "timestamp" else F.lit(kind)
        ends = [F.col(f"_{k}{i}").cast("double") if number else F.lit(None).cast("double") for k in "lh"]
        whole = [F.col(f"_{k}{i}").cast("decimal(38,0)") if kind == "integer" else F.lit(None).cast("decimal(38,0)") for k in "lh"]
        digits = F.greatest(*[F.char_length(F.abs(x).cast("string")) for x in whole])
        rows.append(F.struct(
            F.lit(i).alias("col_pos"), F.lit(df.columns[i]).alias("col_name"), F.when(some, dtype).otherwise("string").alias("dtype"), F.col("_n").alias("row_count"), (F.col("_n") - F.col(f"_c{i}")).alias("null_count"),
            F.col(f"_u{i}").alias("unique_count"), ends[0].alias("min_value"), ends[1].alias("max_value"), F.when(~some, F.lit(0)).cast("long").alias("max_length"),
            whole[0].alias("min_integer"), whole[1].alias("max_integer"), digits.alias("max_digits"),
        ))
    return df.agg(*aggregates).filter("_n > 0").select(F.inline(F.array(*rows)))


def first_distinct(df: DataFrame, order: str, k: int = 3) -> DataFrame:
    """(col_name, rank, value): the first k distinct non-null values of each column in order of ``order``."""
    return first_of_distinct(distinct_cells(unpivoted(df, keep=(order,)), order), k)


def first_of_distinct(distinct: DataFrame, k: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    firsts = distinct.filter(~G.is_null(F.col("value")))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("col_name").orderBy("first_at", "value")))
    return ranked.filter(F.col("rank") <= k).select("col_name", F.col("rank").cast("long").alias("rank"), "value", *keep)


def sample_rows(df: DataFrame, position: Column, total: Column, head: int = 3, middle: int = 1, tail: int = 1) -> DataFrame:
    """Rows of the head, the middle and the tail by their position from 0, with their bucket; a short table is all head."""
    small = total <= head + middle + tail
    half = F.floor(total / 2)
    bucket = (
        F.when(small | (position < head), "head").when((position >= total - tail), "tail").when((position >= half) & (position < half + middle), "middle")
    )
    # a row may belong to the middle and the tail; it is given once for each
    both = F.array_compact(F.array(
        F.when(small | (position < head), F.lit("head")), F.when(~small & (position >= half) & (position < half + middle), F.lit("middle")), F.when(~small & (position >= total - tail), F.lit("tail")),
    ))
    return df.filter(bucket.isNotNull()).withColumn("bucket", F.explode(both))


def warnings_of(profiled: DataFrame) -> DataFrame:
    """(col_pos, col_name, code, severity, message, context) of the column rules."""
    return profiled.select("col_pos", "col_name", F.explode(column_warnings()).alias("w")).select("col_pos", "col_name", "w.*")


def column_warnings() -> Column:
    """array<struct<code, severity, message, context>> of a profiled column."""
    string = lambda c: F.col(c).cast("string")
    rate = F.col("null_count") / F.col("row_count")

    def warning(code: str, severity: str, message: Column, **context: Column) -> Column:
        pairs = [x for k, v in {"column": F.col("col_name"), **context}.items() for x in (F.lit(k), v)]
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.create_map(*pairs).alias("context"))

    repeating = (F.col("dtype") == "string") & (F.col("row_count") > 0) & (F.col("unique_count") > 0) & (F.col("unique_count") / F.col("row_count") < 0.5)
    per_entity = F.bround(F.col("row_count") / F.col("unique_count"), 2)
    return F.array_compact(F.array(
        F.when(repeating, warning("REPEATING_ENTITY", "warn", F.concat(F.col("col_name"), F.lit(" repeats; rows may be grouped by it")), unique_count=string("unique_count"), row_count=string("row_count"), rows_per_entity_avg=per_entity.cast("string"))),
        F.when(F.col("dtype").isin("integer", "float"), warning("NUMERIC_COLUMN_QUOTE_RISK", "warn", F.concat(F.col("col_name"), F.lit(" is numeric; write it unquoted")), dtype=F.col("dtype"))),
        F.when(F.col("dtype") == "mixed", warning("MIXED_DTYPE_COLUMN", "error", F.concat(F.col("col_name"), F.lit(" mixes types")))),
        F.when((F.col("row_count") > 0) & (rate > 0.1), warning("HIGH_NULL_RATE", "warn", F.format_string("%s is null in %.1f%% of rows", F.col("col_name"), rate * 100), null_count=string("null_count"), row_count=string("row_count"), null_rate=F.bround(rate, 3).cast("string"))),
        F.when(F.col("dtype").isin("date", "datetime"), warning("LIKELY_DATE_COLUMN", "info", F.concat(F.col("col_name"), F.lit(" looks like dates")), dtype=F.col("dtype"))),
    ))


def duplicate_names(header: DataFrame, key: str, names: str) -> DataFrame:
    """(key, name, second_at): names that a header (an array column) has more than once, with the place of their second time."""
    at = header.select(key, F.posexplode(names).alias("pos", "name"))
    grouped = at.groupBy(key, "name").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    return grouped.filter(F.size("at") > 1).select(key, "name", F.element_at("at", 2).cast("long").alias("second_at"))


def deduplicated_names(names: Sequence[str]) -> list[str]:
    """Second and further uses of a name get .1, .2, ..., as headers are read."""
    used: dict[str, int] = {}
    out: list[str] = []
    for name in names:
        n = used.get(name, 0)
        fresh = name
        while n and (fresh := f"{name}.{n}") in used:
            n += 1
        used[name] = n + 1
        used.setdefault(fresh, 1)
        out.append(fresh)
    return out
