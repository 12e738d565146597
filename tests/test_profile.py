import itertools

import pytest
from pyspark.sql import functions as F

from tabshift.functions import grammar as G
from tabshift.operators import profile as P


def dtype(spark, values):
    cells = spark.createDataFrame([(0, "c", v) for v in values], "col_pos int, col_name string, value string")
    return P.profile_cells(cells).first().dtype


def test_ladder(spark):
    cases = {
        ("1", "2"): "integer", ("007", "8"): "mixed", ("1.5", "2"): "float", ("true", "no"): "boolean", ("TRUE", "FALSE"): "string", ("2024-01-01", "2024-02-02"): "date",
        ("01/31/2024",): "date", ("2024-01-01 10:00:00", "2024-01-01"): "datetime", ("2024-01-01T00:00:00",): "date", ("1", "x"): "mixed", ("x", "y"): "string", ("", None): "string",
        ("", "5"): "integer", ("2024-01-01", "x", "y"): "string",
    }
    for values, want in cases.items():
        assert dtype(spark, values) == want, values


def test_dates_may_be_invalid_in_less_than_a_twentieth(spark):
    good = [f"2024-01-{i % 28 + 1:02d}" for i in range(99)]
    assert dtype(spark, [*good, "soon"]) == "date"
    assert dtype(spark, [*good[:19], "soon"]) == "string"


def test_profile_columns(spark):
    df = spark.createDataFrame([("Ada", 3, 2.5), ("Ada", -4, None), ("", 10, 0.5)], "name string, n int, x double")
    rows = {r.col_name: r for r in P.profile(df).collect()}
    assert (rows["name"].null_count, rows["name"].unique_count, rows["name"].max_length) == (1, 1, 3)
    assert (rows["n"].min_value, rows["n"].max_value, rows["n"].dtype, rows["n"].max_length) == (-4.0, 10.0, "integer", None)
    assert (rows["x"].null_count, rows["x"].dtype) == (1, "float")


def test_empty_table(spark):
    assert P.profile(spark.createDataFrame([], "a string, b int")).count() == 0


def test_dotted_and_clashing_names(spark):
    df = spark.createDataFrame([("x", "y", "z")], "`a.b` string, value string, n string")
    assert {r.col_name for r in P.profile(df).collect()} == {"a.b", "value", "n"}


def warned(spark, **profile):
    base = {"col_pos": 0, "col_name": "c", "dtype": "string", "row_count": 10, "null_count": 0, "unique_count": 10} | profile
    df = spark.createDataFrame([base], "col_pos int, col_name string, dtype string, row_count long, null_count long, unique_count long")
    return {r.code: r for r in P.warnings_of(df).collect()}


def test_rule_boundaries(spark):
    assert not warned(spark)
    assert not warned(spark, unique_count=5)
    assert warned(spark, unique_count=4)["REPEATING_ENTITY"].context["rows_per_entity_avg"] == "2.5"
    assert not warned(spark, unique_count=0)
    assert not warned(spark, null_count=1)
    assert warned(spark, null_count=2)["HIGH_NULL_RATE"].message == "c is null in 20.0% of rows"
    assert not warned(spark, row_count=0, unique_count=0)
    assert warned(spark, dtype="integer")["NUMERIC_COLUMN_QUOTE_RISK"].severity == "warn"
    assert warned(spark, dtype="mixed")["MIXED_DTYPE_COLUMN"].severity == "error"
    assert warned(spark, dtype="datetime")["LIKELY_DATE_COLUMN"].severity == "info"


def test_samples(spark):
    def buckets(n, **sizes):
        df = spark.range(n).withColumnRenamed("id", "i")
        rows = P.sample_rows(df, F.col("i"), F.lit(n), **sizes).orderBy("i").collect()
        return {b: [r.i for r in rows if r.bucket == b] for b in ("head", "middle", "tail")}

    assert buckets(0) == {"head": [], "middle": [], "tail": []}
    assert buckets(5) == {"head": [0, 1, 2, 3, 4], "middle": [], "tail": []}
    assert buckets(6) == {"head": [0, 1, 2], "middle": [3], "tail": [5]}
    assert buckets(10, head=2, middle=2, tail=2) == {"head": [0, 1], "middle": [5, 6], "tail": [8, 9]}


def test_first_distinct_and_names(spark):
    df = spark.createDataFrame([(0, "b"), (1, ""), (2, "a"), (3, "b"), (4, "c"), (5, "d")], "i int, v string")
    assert [r.value for r in P.first_distinct(df, "i").orderBy("rank").collect()] == ["b", "a", "c"]
    assert P.deduplicated_names(["a", "b", "a", "a", "a.1"]) == ["a", "b", "a.1", "a.2", "a.1.1"]
    header = spark.createDataFrame([(1, ["x", "y", "x", "y", "x"])], "id int, names array<string>")
    assert [(r.name, r.second_at) for r in P.duplicate_names(header, "id", "names").orderBy("second_at").collect()] == [("x", 2), ("y", 3)]


def test_estimated_counts_are_near(spark):
    df = spark.range(20_000).selectExpr("cast(id % 7000 as string) as a", "cast(id as string) as b", "if(id % 4 = 0, null, 'x') as c")
    exact, near = ({r.col_name: r for r in P.profile(df, approximate=x).collect()} for x in (False, True))
    for c in "abc":
        assert near[c].unique_count == pytest.approx(exact[c].unique_count, rel=0.06)
        assert near[c].asDict() | {"unique_count": 0} == exact[c].asDict() | {"unique_count": 0}


def test_typed_columns_profile_like_their_text(spark):
    rows = spark.range(500).selectExpr(
        "cast(if(id % 9 = 0, null, id - 250) as int) i", "cast(id as decimal(20,0)) * 1000000000000 big", "id / 7 f", "cast(id as decimal(10,2)) d", "id % 2 = 0 b", "date_add(date'2024-01-01', cast(id as int)) day",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) at", "timestamp'2024-01-01 00:00:00' midnight", "cast(id as string) t", "cast(null as int) none")
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    for approximate in (False, True):
        typed, plain = ({r.col_name: r for r in P.profile(x, approximate).collect()} for x in (rows, text))
        for c in rows.columns:
            assert typed[c].unique_count == (pytest.approx(plain[c].unique_count, rel=0.1) if approximate else plain[c].unique_count)
            assert typed[c].asDict() | {"unique_count": 0} == plain[c].asDict() | {"unique_count": 0}
    assert P.profile(rows.limit(0), True).count() == P.profile(rows.limit(0)).count() == 0
    assert {c: r.dtype for c, r in typed.items()} == {"i": "integer", "big": "integer", "f": "float", "d": "float", "b": "boolean", "day": "date", "at": "datetime", "midnight": "date", "t": "integer", "none": "string"}


def test_facts_of_plain_numbers_are_those_of_the_grammar(spark):
    numbers = [a + b + c + d for a, b, c, d in itertools.product(("", "-", "+", " ", "--"), ("0", "00", "7", "1", "1_0", "2024", "20240229", "20241399", "0012", "9" * 19, "9" * 39), ("", ".", ".0", ".50", ".5_0"), ("", " ", "e5", "\n", "\u2028", "x"))]
    cells = [*numbers, None, "", " ", "true", "0x1", ".5", "-.5", "-", "nan", "inf", "\u0663", "2024-01-05", "01/31/2024", "10:30", "yes"]
    v = F.col("value")
    rows = spark.createDataFrame([(0, "c", x, 1) for x in cells], "col_pos int, col_name string, value string, n long")
    want = rows.select(
        "col_pos", "col_name", "n", "value", G.is_null(v).alias("null"), G.is_integer(v).alias("i"), G.is_float(v).alias("f"), G.is_boolean(v).alias("b"), G.to_timestamp(v).alias("ts"), G.zero_padded(v).alias("z"),
        G.to_number(v).alias("number"), G.to_integer(v).alias("whole"), G.integer_digits(v).alias("digits"), F.char_length(v).alias("length"))
    got = P.facts(rows)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rows.filter(G.is_plain(v)).count() == 48


def test_distinct_values_travel_without_their_columns_names(spark):
    df = spark.createDataFrame([("x", "1", "y"), ("x", "2", None)], "`a.b` string, value string, col_pos string")
    found = P.profile(df)
    dealt = [x.split(")")[0] for x in found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert any("value#" in x for x in dealt) and not any("value#" in x and "col_name#" in x for x in dealt)
    assert {(r.col_pos, r.col_name, r.dtype, r.unique_count, r.null_count) for r in found.collect()} == {(0, "a.b", "string", 1, 0), (1, "value", "integer", 2, 0), (2, "col_pos", "string", 1, 1)}
