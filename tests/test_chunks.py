import csv
import io
import json
import random

import numpy as np
import pytest

from tabshift.sources import chunks as C
from tabshift.sources import files as S


@pytest.fixture
def small_chunks(spark):
    """Files of a few kilobytes have several chunks."""
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "400")
    yield
    spark.conf.set(key, before)


CELLS = ["a", "x y", "", '"', '""', "l1\nl2", 'q "in" it', ",", ";", ",\n,", 'a"b', "\n", "\r\nz", "é", " ", "\n\n\n", "long " * 90 + "\n" + "er" * 300]


def table_of(rng, n):
    return [["k", "first name", "t"], *[[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(n)]]


@pytest.mark.parametrize("seed,delimiter,end", [(1, ",", "\n"), (2, ";", "\r\n"), (3, ",", "\n")])
def test_quoted_csv_in_several_tasks(spark, tmp_path, small_chunks, seed, delimiter, end):
    rows, path = table_of(random.Random(seed), 80), tmp_path / "q.csv"
    with open(path, "w", newline="") as out:
        csv.writer(out, delimiter=delimiter, lineterminator=end).writerows(rows)
    records = C.csv_records(spark, str(path), delimiter)
    assert C.pieces(spark, str(path), "\n").rdd.getNumPartitions() > 5
    got = records.orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(81))
    assert [next(csv.reader(io.StringIO(r.text, newline=""), delimiter=delimiter)) for r in got] == rows
    assert S.count_records(spark, str(path), S.Dialect(delimiter, '"', True)).first().row_count == 80


def test_several_tasks_read_what_one_reads(spark, tmp_path, small_chunks):
    path = tmp_path / "r.csv"
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows(table_of(random.Random(4), 90))
    dialect = S.Dialect(",", '"', True)
    many = S.read_raw(spark, str(path), dialect, sample=S.first_text(spark, str(path), "utf-8"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    one = S.read_raw(spark, str(path), dialect)
    assert many.columns == one.columns == ["row_idx", "k", "first name", "t"]
    assert many.orderBy("row_idx").collect() == one.orderBy("row_idx").collect()


def test_latin1_and_other_marks(spark, tmp_path, small_chunks):
    path = tmp_path / "l.csv"
    path.write_bytes("".join(f"{i}|'caf\xe9 {i}\n''x''|'|z\n" for i in range(60)).encode("latin-1"))
    rows = S.read_raw(spark, str(path), S.Dialect("|", "'", False), "latin-1").orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [(i, str(i), f"café {i}\n'x'|", "z") for i in range(60)]


def test_marks_within_bare_cells_open_nothing(spark, tmp_path, small_chunks):
    text = "".join(f'{i},5" pipe,it"s\n\n"closed"then,x,"a""b"\n' for i in range(50))
    path = tmp_path / "m.csv"
    path.write_text(text)
    got = [r.text for r in C.csv_records(spark, str(path)).orderBy("row_idx").collect()]
    assert got == [x for x in text.split("\n") if x]


def test_a_cell_longer_than_several_chunks(spark, tmp_path, small_chunks):
    long = "\n".join(f"line {i}" for i in range(500))
    path = tmp_path / "g.csv"
    path.write_text(f'a,b\n1,"{long}"\n2,x\n3,"open to the end\nof the file')
    got = [r.text for r in C.csv_records(spark, str(path)).orderBy("row_idx").collect()]
    assert got == ["a,b", f'1,"{long}"', "2,x", '3,"open to the end\nof the file']


def test_running_states_equal_a_walk():
    rng = np.random.default_rng(5)
    for _ in range(200):
        opens, stays, state = rng.random(30) < 0.5, rng.random(30) < 0.5, bool(rng.random() < 0.5)
        want, now = [], state
        for o, s in zip(opens, stays, strict=True):
            now = bool(s if now else o)
            want.append(now)
        assert C.running(opens, stays, state).tolist() == want


def value_of(rng, deep):
    kind = rng.randrange(8)
    if kind < 4 or deep > 3:
        return [rng.randrange(1000), rng.choice(["a,b", "[{", '"q"', "\\", "}],", "é\n", '\\"', '\\\\",', ""]), None, True][kind % 4]
    if kind == 4:
        return [value_of(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc,{"): value_of(rng, deep + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed,indent,end", [(1, None, ""), (2, 2, "\n\n"), (3, None, "\n"), (4, 0, " ")])
def test_json_arrays_in_several_tasks(spark, tmp_path, small_chunks, seed, indent, end):
    rng = random.Random(seed)
    values, path = [value_of(rng, 1) for _ in range(150)], tmp_path / "a.json"
    path.write_text("﻿" * (seed % 2) + json.dumps(values, indent=indent, ensure_ascii=False) + end)
    assert C.pieces(spark, str(path), ",").rdd.getNumPartitions() > 3
    got = C.json_elements(spark, str(path)).orderBy("row_idx").collect()
    assert [json.loads(r.text) for r in got] == values and [r.row_idx for r in got] == list(range(150))


@pytest.mark.parametrize("text,values", [("[]", []), (" [ ]\n", []), ("[5]", [5]), ('["a,b"]', ["a,b"]), ("[[1,2],[]]", [[1, 2], []])])
def test_small_json_arrays(spark, tmp_path, text, values):
    path = tmp_path / "s.json"
    path.write_text(text)
    assert [json.loads(r.text) for r in C.json_elements(spark, str(path)).orderBy("row_idx").collect()] == values


def test_json_rows_of_both_ways_are_equal(spark, tmp_path, small_chunks):
    values = [{"id": i, "name": "x,y" * (i % 3), "tags": [{"k": "]"}] * (i % 2), "at": {"n": i / 2}} for i in range(120)]
    path = tmp_path / "b.json"
    path.write_text(json.dumps(values, indent=1))
    many = S.read_json(spark, str(path))
    assert not S.one_partition(C.pieces(spark, str(path), ","))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    one = S.read_json(spark, str(path))
    assert sorted(many.columns) == sorted(one.columns)
    assert many.select(*one.columns).orderBy("row_idx").collect() == one.orderBy("row_idx").collect()
    path.write_text("\n".join(json.dumps(v) for v in values))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    assert S.read_json(spark, str(path)).count() == 120


def test_beginning_of_a_file_of_short_lines(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("".join(f"{i % 10}\n" for i in range(30_000)))
    assert S.first_text(spark, str(path), "utf-8") == path.read_text()[: S.SNIFF_CHARS]
    path.write_text("a,b\n" + "x" * 40_000 + ",1\n" + "y\n" * 100)
    assert S.first_text(spark, str(path), "utf-8") == path.read_text()[: S.SNIFF_CHARS]
