from pyspark.sql import functions as F

from tabshift.operators import profile as P
from tabshift.operators import states as St

EXACT = ["col_name", "dtype", "row_count", "null_count", "min_value", "max_value", "max_length", "min_integer", "max_integer"]


def parts_of(spark):
    text = F.element_at(F.array(*[F.lit(x) for x in ("a", "", "2024-01-05", "7", "long text")]), (F.col("at") % 5 + 1).cast("int"))
    rows = spark.range(6000, numPartitions=4).withColumnRenamed("id", "at").select("at", (F.col("at") * 7 % 4001).cast("string").alias("n"), text.alias("t"), F.when(F.col("at") % 3 > 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("at") % 300).cast("int")), "yyyy-MM-dd")).alias("d"), (F.col("at") / 8).alias("x"))
    return rows, [rows.filter("at < 1000"), rows.filter("at >= 1000 and at < 1001"), rows.filter("at > 1000")]


def test_merged_states_are_the_profile_of_all_rows(spark, tmp_path):
    rows, parts = parts_of(spark)
    for i, part in enumerate(parts):
        St.column_states(part, "at", part=i).write.mode("append").parquet(str(tmp_path / "states"))
    stored = spark.read.parquet(str(tmp_path / "states"))
    got = St.profile_of(St.merged(stored), [0.0, 0.5, 1.0])
    whole = P.profile(rows.drop("at"))
    assert sorted(map(tuple, got.select(*EXACT).collect()), key=str) == sorted(map(tuple, whole.select(*EXACT).collect()), key=str)
    exact = {r.col_name: r.unique_count for r in whole.collect()}
    firsts = {}
    for r in P.first_distinct(rows, "at").orderBy("rank").collect():
        firsts.setdefault(r.col_name, []).append(r.value)
    for r in got.collect():
        assert abs(r.unique_count - exact[r.col_name]) <= 0.08 * exact[r.col_name] and r.sample_values == firsts[r.col_name]
        if r.col_name == "n":
            assert r.quantiles[0] == 0 and r.quantiles[2] == 4000 and abs(r.quantiles[1] - 2000) < 200
    twice = St.merged(St.merged(stored.filter("firsts[0].at.part < 2")).unionByName(stored.filter("firsts[0].at.part = 2")))
    assert {(r.col_name, r.row_count, tuple(f.value for f in r.firsts)) for r in twice.collect()} == {(c, 6000, tuple(v)) for c, v in firsts.items()}


def test_columns_of_some_parts_keys_and_empty_tables(spark):
    a = St.column_states(spark.createDataFrame([(0, "1", None)], "at long, k string, z string"), "at").withColumn("month", F.lit("m1"))
    b = St.column_states(spark.createDataFrame([(0, "x")], "at long, k string"), "at", part=1).withColumn("month", F.lit("m2"))
    both = a.unionByName(b)
    assert {(r.col_name, r.dtype, r.row_count, r.null_count) for r in St.profile_of(St.merged(both)).collect()} == {("k", "mixed", 2, 0), ("z", "string", 1, 1)}
    assert {(r.month, r.col_name, r.row_count) for r in St.merged(both, "month").collect()} == {("m1", "k", 1), ("m1", "z", 1), ("m2", "k", 1)}
    none = St.column_states(spark.createDataFrame([], "at long, k string"), "at")
    assert St.merged(none).count() == 0
