import json
import os

import pytest
from pyspark.sql import functions as F

from tabshift.plans import convert
from tabshift.sources import chunks, committed


def visible(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if "/_" not in d)


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b/x.txt", "é"), ("y.json", None), ("a/z", "1")], "name string, text string").repartition(3)
    for root in (str(tmp_path / "out"), f"file://{tmp_path}/uri"):
        got = committed.write_named_files(rows, root)
        assert sorted((r.name, r.bytes) for r in got.collect()) == [("a/b/x.txt", 2), ("a/z", 1), ("y.json", 0)]
    assert visible(tmp_path / "out") == visible(tmp_path / "uri") == ["a/b/x.txt", "a/z", "y.json"]
    assert (tmp_path / "out/a/b/x.txt").read_text() == "é"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 37, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("text")).alias("text"))
    with pytest.raises(Exception, match="lost|failed"):
        committed.write_named_files(rows, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or visible(tmp_path / "out") == []
    again = committed.write_named_files(rows.filter("name <> 'f37'"), str(tmp_path / "out"))
    assert again.count() == 39 and len(visible(tmp_path / "out")) == 39


def test_names_must_differ(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "name string, text string")
    with pytest.raises(Exception, match="several rows|failed"):
        committed.write_named_files(rows, str(tmp_path / "out"))
    assert visible(tmp_path / "out") == []


def test_documents_of_many_tasks(spark, tmp_path):
    rows = spark.range(5000, numPartitions=7).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit('q"\n,'), "id")).alias("t"), (F.col("id") / 4).alias("n"))
    ordered = rows.orderBy(F.rand(1))
    files = convert.write_csv_document(ordered, str(tmp_path / "csv"), "id").count()
    assert files > 3 and committed.read_document(spark, str(tmp_path / "csv")) == convert.csv_text(rows.withColumn("id", F.col("id")), "id")
    convert.write_json_document(ordered, str(tmp_path / "json"), "id")
    text = committed.read_document(spark, str(tmp_path / "json"))
    assert [(x.get("t"), x["n"]) for x in json.loads(text)] == [(f'q"\n,{i}' if i % 5 else None, i / 4) for i in range(5000)]
    whole = tmp_path / "whole.json"
    whole.write_text(text)
    assert chunks.read_json_array(spark, str(whole)).count() == 5000


def test_a_document_without_lines(spark, tmp_path):
    convert.write_json_document(spark.range(0).withColumn("x", F.lit(1)), str(tmp_path / "e"), "id")
    assert json.loads(committed.read_document(spark, str(tmp_path / "e"))) == []


def test_a_hot_group_is_written_by_several_tasks(spark, tmp_path):
    from tabshift.operators import transforms as T

    entities = (T.Entity("user", "user_", key=True), T.Entity("orders", "order_", "array"))
    who = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 50))
    rows = spark.range(6000, numPartitions=5).select(F.col("id").alias("row_idx"), who.alias("user_name"), F.when(F.col("id") % 7 > 0, F.col("id") % 4).alias("user_age"), F.concat(F.lit('"x,'), "id").alias("order_code"), (F.col("id") / 2).alias("order_price"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables in several tasks
    files = convert.write_nested_document(rows.orderBy(F.rand(2)), entities, str(tmp_path / "n"), "row_idx")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.bytes for r in files.orderBy("name").collect()]
    got = json.loads(committed.read_document(spark, str(tmp_path / "n")))
    assert got == json.loads(convert.json_text(T.nest(rows, entities, "row_idx"), "first_at"))
    hot = max(len(json.dumps(g)) for g in got)
    assert sum(s > 10 for s in sizes) >= 3 and max(sizes) < sum(sizes) / 2 and hot > sum(sizes) / 8
    with pytest.raises(ValueError, match="one array entity"):
        convert.write_nested_document(rows, entities[:1], str(tmp_path / "m"), "row_idx")
