"""Every query of the engine that has SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabshift import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    columns = ", ".join(f'"{c}"' for c in names)
    want = duck.execute(f"SELECT {columns} FROM ({core.ORACLE_SQL[name]}) q").fetchall()
    assert canonical(got) == canonical(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
