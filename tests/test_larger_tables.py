"""Queries that were right on small tables only."""

import os

import duckdb
import pytest

from tests.test_oracles import plain
from tidemark import catalog

LARGER = "/root/testdata/sf0.1"


def sql_rows(folder, name, columns):
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{folder}/{table}{'/*.parquet' if os.path.isdir(f'{folder}/{table}') else ''}'")
    sql = con.sql(catalog.ORACLES[name])
    at = [sql.columns.index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", ["in_triangles", "line_entries"])
def test_places_on_an_edge_are_in_no_triangle(spark, name):
    found = catalog.QUERIES[name](spark, LARGER)
    columns = sorted(found.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sql_rows(LARGER, name, columns)


def test_recipients_are_counted_by_sets_of_areas(spark, tmp_path):
    people = [(i, None if i % 11 == 0 else i % 25) for i in range(200)]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    notices = [(i, i % 25, 9000.0) for i in range(60)] + [(99, None, 9000.0), (98, 1, 10.0)]
    spark.createDataFrame(notices, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalog.QUERIES["alert_recipients"](spark, str(tmp_path))
    columns = sorted(found.columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sql_rows(str(tmp_path), "alert_recipients", columns)
    # people are no longer told apart behind the join with the alerts
    assert "distinct c_custkey" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_contradictions_are_told_by_the_next_three_people(spark, tmp_path):
    from datetime import datetime, timedelta
    from random import Random

    rng, start = Random(7), datetime(2024, 1, 1)
    rows = [(i, rng.choice([0, 40, 80, 120, 1, 41, None]), start + timedelta(minutes=30 * rng.randrange(150)), rng.choice(["error", "signup", "view"])) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").selectExpr("*", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    found = catalog.QUERIES["uncontradicted_reports"](spark, str(tmp_path))
    columns = sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert mine == sql_rows(str(tmp_path), "uncontradicted_reports", columns) and len({m[0] for m in mine}) == 2
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # reports and contradictions are not paired


def test_copies_of_a_record_are_linked_with_one_of_them(spark, tmp_path):
    parts = [(i, "Big  ring" if i % 2 else "big ring", 900.0 + (i % 3) * 0.4) for i in range(60)] + [(99, "other", 900.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r.left_key, r.right_key, r.same) for r in catalog.QUERIES["linked_names"](spark, str(tmp_path)).collect()}
    assert found == {(i % 3, i, True) for i in range(3, 60)} | {(0, 1, False), (1, 2, False)}


def test_lines_at_one_place_cross_roads_once_for_all_of_them(spark, tmp_path, monkeypatch):
    """Places repeat every 39,000 keys: lines and roads of the same shape are met as one, and none is sent through the driver."""
    from tidemark.operators import areas

    keys = lambda n: [(i + j * 39_000,) for j in range(3) for i in range(n)]
    spark.createDataFrame(keys(60), "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(keys(30), "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    sides = []
    real = areas.meetings
    monkeypatch.setattr(areas, "meetings", lambda a, b, *rest: sides.append((a.count(), b.count())) or real(a, b, *rest))
    found = catalog.QUERIES["rivers_over_roads"](spark, str(tmp_path))
    columns = sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert mine == sql_rows(str(tmp_path), "rivers_over_roads", columns) and len(mine) > 900
    assert sides == [(3 * 19, 3 * 9)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_members_of_a_frequent_shape_are_dealt_to_several_rows(spark):
    from tidemark.operators import areas

    rows = spark.range(5000).selectExpr("id", "CASE WHEN id < 4990 THEN 1.0D ELSE id END AS x")
    found = [sorted(r.ids) for r in areas._alike(rows, "id", ["x"]).collect()]
    assert sorted(i for f in found for i in f) == list(range(5000))
    assert len(found) == 10 + 5 and max(len(f) for f in found) < 1200
