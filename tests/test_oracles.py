"""Every query of the reference's operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tidemark import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "~" if math.isnan(v) else str(int(v)) if v == int(v) else f"{v:.6g}"
    return str(v).replace(" 00:00:00", "")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    sql = duck.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{name}").limit(0).write.parquet(f"{path}/{name}")
    return str(path)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_runs_on_empty_tables(spark, empty, name):
    catalog.QUERIES[name](spark, empty).collect()
