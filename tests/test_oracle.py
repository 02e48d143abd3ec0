"""Every query with SQL against DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, v or "") for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), [c[0] for c in cursor.description])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
