"""Join levels, fillings, served houses, walks and components against plain versions."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph


def grid(rng, reaches, rows, cols, holes=0.1):
    return [(q, r, c, float(rng.randrange(30)), c == 0) for q in range(reaches) for r in range(rows) for c in range(cols) if c == 0 or rng.random() > holes]


CELLS = "reach int, row long, col long, height double, channel boolean"


def plain_levels(cells):
    found = {}
    for reach in {x[0] for x in cells}:
        height = {(r, c): h for q, r, c, h, _ in cells if q == reach}
        best, heap = {}, [(h, (r, c)) for q, r, c, h, ch in cells if q == reach and ch]
        heapq.heapify(heap)
        while heap:
            level, at = heapq.heappop(heap)
            if at in best:
                continue
            best[at] = level
            for n in ((at[0] + 1, at[1]), (at[0] - 1, at[1]), (at[0], at[1] + 1), (at[0], at[1] - 1)):
                if n in height and n not in best:
                    heapq.heappush(heap, (max(level, height[n]), n))
        found |= {(reach, *at): best.get(at) for at in height}
    return found


def test_join_levels_equal_a_search_from_the_channel(spark):
    cells = grid(random.Random(3), 3, 12, 15)
    cells += [(9, 0, 0, 1.0, False), (9, 0, 1, 2.0, False)]  # a reach without a channel
    found = graph.join_levels(spark.createDataFrame(cells, CELLS)).collect()
    assert {(r.reach, r.row, r.col): r.level for r in found} == plain_levels(cells)


def test_join_levels_move_narrow_rows(spark, monkeypatch):
    """Rounds carry numbers, not places, and find what is least by hash; many cells of one height, a place with two rows and one without a height."""
    plans = []
    real = graph.written

    def kept(df, name):
        if name in ("exits", "pointers"):
            plans.append((df.dtypes, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(graph, "written", kept)
    cells = [(q, r, c, float(h % 3), ch) for q, r, c, h, ch in grid(random.Random(4), 2, 8, 9)]
    rows = [*cells, (7, 0, 0, 1.0, True), (7, 0, 1, 2.0, False), (7, 0, 1, 5.0, False), (7, 0, 2, None, False), (7, 0, 3, 0.0, False)]
    found = sorted((r.reach, r.row, r.col, r.height, r.level) for r in graph.join_levels(spark.createDataFrame(rows, CELLS)).where("reach = 7").collect())
    assert found == [(7, 0, 0, 1.0, 1.0), (7, 0, 1, 2.0, 2.0), (7, 0, 1, 5.0, 2.0), (7, 0, 3, 0.0, None)]
    assert plans and all(kind in ("bigint", "double", "boolean") for types, _ in plans for _, kind in types)
    assert not any("SortAggregate" in plan for _, plan in plans)


@pytest.mark.parametrize("volume", [0.5, 40.0, 900.0, 20_000.0])
def test_fillings_equal_the_search_by_halving(spark, volume):
    cells = spark.createDataFrame(grid(random.Random(5), 4, 9, 11) + [(9, 0, 0, 1.0, False)], CELLS)
    old = {r.reach: r for r in graph.filled(cells, volume, 2.0, steps=44).collect()}
    for r in graph.filled_by_levels(cells, volume, 2.0, steps=16).collect():
        assert (r.level is None) == (old[r.reach].level is None)
        if r.level is not None:
            assert r.level == pytest.approx(old[r.reach].level, abs=1e-5) and r.cells == old[r.reach].cells
            assert r.volume == pytest.approx(old[r.reach].volume, abs=1e-2)


def test_houses_served_with_and_without_floods(spark):
    roads = [(1, 2, 3.0, False), (2, 3, 3.0, True), (1, 4, 2.0, False), (4, 3, 9.0, False), (3, 5, 1.0, False)]
    both = [(a, b, c, f) for a, b, c, f in roads] + [(b, a, c, f) for a, b, c, f in roads]
    edges = spark.createDataFrame(both, "a int, b int, cost double, flooded boolean")
    sources = spark.createDataFrame([("x", 1), ("y", 5), ("z", 99)], "source string, node int")
    houses = spark.createDataFrame([(1, 1), (2, 10), (3, 100), (4, 1000), (5, 10000)], "node int, houses long")
    found = {r.source: (r.houses, r.houses_dry, r.route_dry, r.mean_dry) for r in graph.served(edges, sources, houses, 7.0).collect()}
    assert found["x"] == (11111, 1011, 0.091, round((10 * 3 + 1000 * 2) / 1011, 4))
    assert found["y"] == (10111, 10100, 0.999, round(100 / 10100, 4))  # 1 is as far as the limit, over a flooded road
    assert found["z"] == (0, 0, None, None)


def test_edges_are_made_once_for_all_rounds(spark, monkeypatch):
    """What edges are made of, a broadcast for one, is not done again each round; what is cheaper over more edges is found."""
    names = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    rng = random.Random(2)
    roads = [(i, i + 1, 1.0) for i in range(9)] + [(0, j, 2.0 * j) for j in range(2, 10)] + [(rng.randrange(10), rng.randrange(10), 9.0) for _ in range(5)]
    made = F.udf(lambda cost: cost, "double")
    edges = spark.createDataFrame(roads, "a int, b int, cost double").withColumn("cost", made("cost"))
    found = {r.node: r.cost for r in graph.reach_within(edges, spark.createDataFrame([(0,)], "node int"), 8.0).collect()}
    assert found == {i: float(i) for i in range(9)}
    assert [n for n, plan in names if "<lambda>(" in plan] == ["edges"] and len(names) > 8


def test_edges_are_flooded_by_two_of_three_points(spark):
    rows = [(1, 2, 0.5, 0.5, 1.5, 0.5, False), (2, 3, 1.5, 0.5, 4.5, 0.5, False), (3, 4, 0.5, 0.5, 1.4, 0.5, True)]
    edges = spark.createDataFrame(rows, "a int, b int, x1 double, y1 double, x2 double, y2 double, bridge boolean")
    wet = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "row int, col int")
    assert {(r.a, r.b): r.flooded for r in graph.flooded_edges(edges, wet, 1.0).collect()} == {(1, 2): True, (2, 3): False, (3, 4): False}


def test_walks_take_the_largest_channel_and_circles_are_cut(spark):
    ways = [(1, 10, 11, 1, 2.0), (2, 11, 12, 2, 9.0), (3, 11, 13, 1, 1.0), (4, 13, 14, 1, 1.0), (5, 11, 15, 1, 3.0), (7, 20, 21, 1, 1.0), (8, 21, 22, 1, 1.0), (6, 22, 20, 1, 1.0), (9, 30, 21, 1, 5.0)]
    df = spark.createDataFrame(ways, "way int, a int, b int, cls int, km double")
    pointers = graph.successors(df)
    assert {(r.node, r.to) for r in pointers.collect()} == {(1, 5), (3, 4), (7, 8), (6, 7), (9, 8)}  # 8 would go on to 6, the smallest of its circle
    found = {r.way: (r.outlet, r.ways, r.km) for r in graph.walks(df, pointers).collect()}
    assert found[1] == (5, 2, 5.0) and found[6] == (8, 3, 3.0) and found[9] == (8, 2, 6.0) and found[2] == (2, 1, 9.0)


def test_lower_reaches_go_back_up_the_largest_channel(spark):
    ways = [(1, 1, 2, 1, 5.0), (2, 2, 3, 1, 5.0), (10, 20, 2, 2, 1.0), (11, 21, 20, 2, 4.0), (12, 22, 20, 3, 9.0), (13, 23, 21, 2, 9.0), (14, 30, 3, 2, 0.5)]
    df = spark.createDataFrame(ways, "way int, a int, b int, cls int, km double")
    found = graph.lower_reaches(df, df.where("way < 3").select("way"), 1.0, 6.0).collect()
    assert [(r.way, r["at"], r.network_km, r.reach_km, r.ways) for r in found] == [(10, 2, 23.0, 6.0, 3)]


def test_components_of_chains_stars_and_circles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + rng.randrange(1, 200)) for _ in range(300)] + [(3000 + i, 3000 + (i + 1) % 50) for i in range(50)] + [(7, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: 0 if n < 1000 else 1000 if n < 3000 else 3000 for e in edges for n in e}
    assert graph.components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []


def test_settled_nodes_join_no_more(spark, monkeypatch):
    sizes = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: sizes.append(out.count()) or out if (out := real(df, name)) is not None else out)
    pointers = spark.range(1, 1025).select(F.col("id").alias("node"), F.floor(F.col("id") / 2).alias("to"))
    found = {r.node: (r.outlet, r.steps) for r in graph.pointer_doubling(pointers).collect()}
    assert found == {i: (0, i.bit_length()) for i in range(1, 1025)}
    assert sizes[0] == 1024 and sizes == sorted(sizes, reverse=True) and sizes[-1] < 800


def test_upstream_counts_a_node_once_however_many_ways_lead_there(spark, monkeypatch):
    """A ladder of forks has 2 ** 12 ways through it, and a circle never ends: each node is found in one round only."""
    sizes = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: sizes.append(out.count()) or out if (out := real(df, name)) is not None else out)
    ladder = [(2 * i + a, 2 * (i - 1) + b) for i in range(1, 13) for a in (0, 1) for b in (0, 1)] + [(100, 0), (101, 100), (100, 101)]
    found = graph.upstream(spark.createDataFrame(ladder, "node long, to long"), spark.createDataFrame([(0,)], "node long")).collect()
    assert sorted(r.node for r in found) == [0, *range(2, 26), 100, 101] and {r.target for r in found} == {0}
    assert max(sizes) <= 3 and sum(sizes) == 27


def test_sides_that_grow_are_not_sent_through_the_driver(spark):
    nodes = spark.range(1, 2000).select(F.col("id").alias("node"), F.floor(F.col("id") / 2).alias("to"))
    edges = nodes.select(F.col("node").alias("a"), F.col("to").alias("b"), F.lit(3.0).alias("cost"), (F.col("node") % 3 == 0).alias("flooded"))
    sources, houses = spark.range(1, 900).select(F.col("id").alias("source"), F.col("id").alias("node")), nodes.select("node", F.lit(1).cast("long").alias("houses"))
    ways = nodes.select(F.col("node").alias("way"), F.col("node").alias("a"), F.col("to").alias("b"), F.lit(1).alias("cls"), F.lit(1.0).alias("km"))
    for found in (graph.served(edges, sources, houses, 6.0), graph.walks(ways, nodes.where("to > 0"))):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
