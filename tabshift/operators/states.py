"""Column states: profiles that are kept and merged, so that a day or a file more needs no second reading of the others.

A state is one row a column: the totals from which a profile follows, a sketch of its distinct values (HyperLogLog), a sketch of its
numbers (KLL) and its first distinct values with their places. Sums, ends and first values of merged states are exactly those of
one profile over all rows; distinct counts are estimates (2 % relative standard deviation at 2^12 registers), quantiles too
(about 1.3 % of rank). States are small whatever their parts' sizes, and are stored like any table.

``part`` orders the parts of a table: the first values of part 0 come before those of part 1. Parts are merged by column name; a
column that a part lacks is merged from the others. States merge in any grouping and order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.operators import profile as P

REGISTERS = 12  # 2^12 of the distinct sketch
QUANTILE_ACCURACY = 200
SUMS = ("row_count", "null_count", "n_values", "ints", "floats", "bools", "invalid_dates", "zero_padded", "typed")
LEAST, MOST = ("min_value", "min_integer"), ("max_value", "length", "max_integer", "max_digits")


def column_states(df: DataFrame, order: str, *, part: int = 0, firsts: int = 3) -> DataFrame:
    """The states of all columns but ``order``, which gives the rows' places."""
    plain = df.drop(order)
    distinct = P.distinct_cells(P.unpivoted(df, keep=(order,)), order)
    some = F.when(~F.col("null"), F.col("value"))
    sketches = (F.hll_sketch_agg(some, F.lit(REGISTERS)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.when(~F.col("null") & ~F.isnan("number"), F.col("number")), F.lit(QUANTILE_ACCURACY)).alias("number_sketch"))
    stats = P.totals(P.facts(distinct, P.kinds_of(plain)), F.lit(0), *sketches).drop("unique_count")
    # the distinct values that come first, of which each task keeps as many as are asked for
    at = F.struct(F.lit(part).cast("long").alias("part"), F.col("first_at").cast("long").alias("row"))
    first = P.first_of_distinct(distinct, firsts, keep=("first_at",)).groupBy("col_name").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "value"))).alias("firsts"))
    return stats.join(first, "col_name", "left").select("col_pos", "col_name", *SUMS, *LEAST, *MOST, "has_time", "distinct_sketch", "number_sketch", F.coalesce("firsts", F.array().cast("array<struct<at:struct<part:long,row:long>,value:string>>")).alias("firsts"))


def merged(states: DataFrame, *keys: str, firsts: int = 3) -> DataFrame:
    """The states of parts put together, by column and, if there are any, by further keys (a table's name, a month)."""
    whole = states.groupBy(*keys, "col_name").agg(
        F.min("col_pos").alias("col_pos"), *[F.sum(c).cast("long").alias(c) for c in SUMS], *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST], F.bool_or("has_time").alias("has_time"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("number_sketch").alias("number_sketch"))
    # a value's first place, then the first values: as many a part as are kept
    each = states.select(*keys, "col_name", F.explode("firsts").alias("f")).groupBy(*keys, "col_name", F.col("f.value").alias("value")).agg(F.min("f.at").alias("at"))
    first = each.groupBy(*keys, "col_name").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "value"))), 1, firsts).alias("firsts"))
    return whole.join(first, [*keys, "col_name"], "left").withColumn("firsts", F.coalesce("firsts", F.array().cast("array<struct<at:struct<part:long,row:long>,value:string>>")))


def profile_of(states: DataFrame, quantiles: Sequence[float] = ()) -> DataFrame:
    """The profile of states, with sample_values and, for numeric columns, quantiles."""
    counted = states.withColumn("unique_count", F.hll_sketch_estimate("distinct_sketch"))
    found = P.of_totals(counted)
    extra = counted.select("col_name", F.transform("firsts", lambda f: f["value"]).alias("sample_values"), *([F.when(F.col("min_value").isNotNull(), F.kll_sketch_get_quantile_double("number_sketch", F.array(*[F.lit(float(q)) for q in quantiles]))).alias("quantiles")] if quantiles else []))
    return found.join(extra, "col_name")
