import json

import pytest

from tabshift.operators import transforms as T
from tabshift.plans.convert import Spec, convert

SCHEMA = "id long, items array<struct<name string, tags array<struct<k string, v array<long>>>>>, box struct<a struct<b string>, list array<array<long>>>"


def test_arrays_of_structs_within_structs(spark):
    rows = [
        (1, [{"name": "x", "tags": [{"k": "p", "v": [1, 2]}]}, {"name": "y", "tags": None}], {"a": {"b": "q"}, "list": [[1], [2, 3]]}),
        (2, [{"name": None, "tags": [{"k": "r", "v": []}, {"k": "s", "v": [7]}]}], {"a": None, "list": [None]}),
        (3, None, None), (4, [None], {"a": {"b": ""}, "list": []}),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert T.array_widths(df) == {"items": 2, "items[].tags": 2, "items[].tags[].v": 2, "box.list": 2, "box.list[]": 2}
    flat = T.flatten_indexed(df)
    per_item = ["name", *[f"tags.{t}.{x}" for t in (0, 1) for x in ("k", "v.0", "v.1")]]
    assert flat.columns == ["id", *[f"items.{i}.{p}" for i in (0, 1) for p in per_item], "box.a.b", "box.list.0.0", "box.list.0.1", "box.list.1.0", "box.list.1.1"]
    got = {r[0]: r for r in flat.collect()}
    assert tuple(got[1])[1:8] == ("x", "p", 1, 2, None, None, None) and got[1]["items.1.name"] == "y" and got[1]["box.list.1.1"] == 3
    assert got[2]["items.0.tags.1.v.0"] == 7 and got[2]["items.0.tags.0.v.0"] is None and set(tuple(got[3])[1:]) == {None} and got[4]["box.a.b"] == ""


def test_order_and_names(spark):
    df = spark.createDataFrame([(1, [{"b": "x", "a": "y"}] * 2, 3)], "z long, items array<struct<a string, b string>>, c long")
    assert T.flatten_indexed(df, ["c", "items.b", "items.a"]).columns == ["c", "items.0.b", "items.0.a", "items.1.b", "items.1.a", "z"]
    clash = spark.createDataFrame([([1], 2)], "a array<long>, `a.0` long")
    with pytest.raises(ValueError, match="several leaves"):
        T.flatten_indexed(clash)
    assert T.flatten_indexed(spark.range(0)).columns == ["id"]


def test_conversion_of_a_file_with_lists(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text(json.dumps([{"id": 1, "lines": [{"sku": "a", "n": 2}, {"sku": "b,c", "n": 1}], "to": {"zip": "01"}}, {"id": 2, "lines": [], "to": {"zip": None}}]))
    assert convert(spark, str(path), Spec("flatten")) == 'id,lines.0.sku,lines.0.n,lines.1.sku,lines.1.n,to.zip\n1,a,2,"b,c",1,01\n2,,,,,\n'
