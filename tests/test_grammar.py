import math

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabshift.functions import grammar as G
from tabshift.operators.scoring import equal


def evaluate(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def python_float(v):
    try:
        float(v)
        return True
    except ValueError:
        return False


def test_integers(spark):
    values = ["7", "+7", "-7", " 5 ", "1_000", "007", "-007", "+007", "0", "-0", "1.0", "abc", "", "1__0", "--3"]
    assert evaluate(spark, values, G.is_integer) == [True, True, True, True, True, False, False, True, True, True, False, False, False, False, False]


def test_floats(spark):
    values = ["1.5", ".5", "5.", "1e5", "nan", "-inf", "00.5", "0e5", "0.5", "5d", "1_0.5", "x", "", "007"]
    assert evaluate(spark, values, G.is_float) == [True, True, True, True, True, True, False, False, True, False, True, False, False, False]


def test_booleans_are_exact(spark):
    assert evaluate(spark, ["true", "True", "TRUE", "yes", "Yes", "0", "y"], G.is_boolean) == [True, True, False, True, False, True, False]


def test_null_is_empty_not_blank(spark):
    assert evaluate(spark, [None, "", " "], G.is_null) == [True, True, False]


def test_numbers_agree_with_python(spark):
    @given(st.lists(st.text("0123456789+-._eE infa", max_size=7), min_size=40, max_size=60))
    @settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.generate])
    def check(values):
        assert evaluate(spark, values, lambda v: F.coalesce(G.is_number(v), F.lit(False))) == [python_float(v) for v in values]

    check()


def test_values_equal_agrees_with_the_row_form(spark):
    values = ["1", "1.0", "1_0", "10", " a", "a", "A", "", None, "nan", " nan", "NaN ", "x", "inf"]
    pairs = [(a, b) for a in values for b in values]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in rows.select("i", G.values_equal(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    # equal texts are equal even as nan; the numbers nan never are
    assert got == [equal(a, b) for a, b in pairs]
    assert math.isnan(float("nan"))


def test_dates_of_many_forms(spark):
    values = ["2024-01-05", "2024/01/05", "01/05/2024", "25/12/2024", "Jan 5, 2024", "January 5, 2024", "5 Jan 2024", "05-Jan-2024", "2024-01-05T10:20:30Z", "2024-01-05T10:20:30+02:00", "2024-01-05 10:20:30.123456", "10:30", "007", "20240105", "Apple 5", "", None]
    got = evaluate(spark, values, lambda v: F.date_format(G.to_timestamp(v), "MM-dd HH:mm:ss"))
    assert got[:3] == ["01-05 00:00:00"] * 3 and got[3] == "12-25 00:00:00" and got[4:8] == ["01-05 00:00:00"] * 4
    assert got[8:11] == ["01-05 10:20:30", "01-05 08:20:30", "01-05 10:20:30"] and got[11].endswith("10:30:00") and got[12:] == [None, "01-05 00:00:00", None, None, None]
