"""Every query with SQL against DuckDB over the smallest tables; the others must give rows with the columns they name."""

import math
import os

import duckdb
import pytest

from recallium import registry
from recallium.functions import vector

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DIR}/{f}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{float(x):.5f}" if isinstance(x, float) else str(list(x) if isinstance(x, (list, tuple)) else x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = duck.execute(sql)
    assert table(df.columns, rows) == table([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["lexical_fallback", "noise_bank", "admission_novelty"])
def test_all_blocks_of_queries_count(spark, duck, name, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    df = registry.queries()[name](spark, DIR)
    found = duck.execute(registry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in found.description], found.fetchall())
