from datetime import datetime, timedelta

import pytest

from tidemark.operators import graph, quantiles, series, spatial

T0 = datetime(2024, 1, 1)


def frame(spark, values, flag=None):
    rows = [("a", T0 + timedelta(hours=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity string, hour timestamp_ntz, value double")
    return df if flag is None else df.selectExpr("*", f"coalesce({flag}, false) AS flag")


def column(df, name):
    return [r[name] for r in df.orderBy("hour").collect()]


def test_short_gaps_are_bridged_and_long_ones_kept(spark):
    df = frame(spark, [1.0, None, 3.0, None, None, None, 7.0])
    assert column(series.bridged(df, 1), "bridged") == [1.0, 2.0, 3.0, None, None, None, 7.0]
    assert column(series.bridged(df, 3), "bridged") == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]


def test_a_gap_never_satisfies_a_window(spark):
    df = frame(spark, [1.0, 1.0, None, 1.0, 1.0])
    assert column(series.forward_sum(df, 2), "ahead") == [2.0, None, None, 2.0, None]


def test_confirmation_needs_all_rows(spark):
    df = frame(spark, [5.0, 1.0, 5.0, 5.0, 5.0], "value >= 5")
    assert column(series.confirmed(df, 3), "confirmed") == [False, False, False, False, True]


def test_spells_merge_over_small_gaps_and_end_with_the_record(spark):
    df = frame(spark, [9.0, 0.0, 9.0, 0.0, 0.0, 0.0, 9.0, 9.5], "value >= 9")
    found = sorted((r.n_rows, r.peak) for r in series.spells(df, 2).collect())
    assert found == [(2, 9.0), (2, 9.5)]


def fallen(df, n=2, **more):
    hours = lambda t: None if t is None else int((t - T0).total_seconds() // 3600)
    found = series.recessions(df, 9.0, n, **more).orderBy("start").collect()
    return [(hours(r.peak_at), r.dropped, hours(r.below), hours(r.known), r.censored) for r in found]


def test_a_fall_is_dated_from_the_peak_and_censored_at_gaps_and_at_the_end(spark):
    quiet = [0.0] * 4
    assert fallen(frame(spark, [*quiet, 9.0, 12.0, 10.0, 0.0, 0.0, 0.0, 0.0]), guard=1) == [(5, None, 7, 7, False)]
    # below for one hour only, then over the level again: one spell, its fall is the last one
    assert fallen(frame(spark, [*quiet, 12.0, 1.0, 10.0, 0.0, 0.0, 0.0]), guard=1) == [(4, None, 7, 7, False)]
    # missing hours hide whether it stayed below: not "fell after one hour"
    assert fallen(frame(spark, [*quiet, 40.0, 39.0, *[None] * 6, 40.0, 0.0, 0.0]), guard=0, gap_hours=1)[0] == (4, None, None, 5, True)
    # the record ends first
    assert fallen(frame(spark, [*quiet, 12.0, 10.0, 0.0]), guard=1) == [(4, None, None, 5, True)]
    assert fallen(frame(spark, [*quiet, 12.0, 10.0]), guard=1) == [(4, None, None, 5, True)]


def test_spells_without_a_seen_rise_or_peak_are_dropped(spark):
    assert [x[1] for x in fallen(frame(spark, [12.0, 0.0, 0.0, 0.0, 0.0, 0.0]), guard=1)] == ["starts_in_gap"]
    assert [x[1] for x in fallen(frame(spark, [0.0, 0.0, None, 12.0, 0.0, 0.0]), guard=1)] == ["starts_in_gap"]
    assert [x[1] for x in fallen(frame(spark, [0.0, 10.0, 12.0, None, 0.0, 0.0]), guard=2)] == ["gap_at_peak"]


def test_never_rising_fit(spark):
    df = frame(spark, [3.0, 1.0, 2.0, 0.0])
    assert column(series.never_rising(df, "entity", "hour", "value"), "fitted") == [3.0, 1.5, 1.5, 0.0]


def test_running_totals_become_increments(spark):
    df = frame(spark, [1.0, 2.0, 4.0, 0.5])
    assert column(series.deaccumulated(df), "increment") == [0.0, 1.0, 2.0, 0.5]


def test_harmonics_recover_a_known_wave(spark):
    import math

    rows = [("a", float(h), 2.0 * math.cos(2 * math.pi * h / 12.4206 + 0.3) + 5) for h in range(500)]
    df = spark.createDataFrame(rows, "entity string, t double, value double")
    found = {r.period: r.amplitude for r in graph.harmonics(df, "entity", "t", "value", (12.4206, 24.0), least_hours=400).collect()}
    assert found[12.4206] == pytest.approx(2.0, abs=1e-6) and found[24.0] == pytest.approx(0.0, abs=1e-6)
    assert {r.amplitude for r in graph.harmonics(df, "entity", "t", "value", (12.4206,)).collect()} == {None}  # too short a record


def test_percentiles_equal_numpy_with_a_hot_key_ties_and_few_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"hot": np.round(rng.exponential(5, 4000), 1).tolist(), "one": [7.0], "ties": [2.0] * 50, "two": [1.0, 4.0], "nulls": [None, 3.0, None]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "k string, v double")
    found = {r.k: (r.a, r.b, r.c) for r in quantiles.percentiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.97}, steps=64).collect()}
    for k, x in values.items():
        assert found[k] == pytest.approx(np.percentile([v for v in x if v is not None], [10, 50, 97]).tolist())
    whole = quantiles.percentiles(df, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median([v for x in values.values() for v in x if v is not None]))
    assert quantiles.percentiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_places_and_tiles_over_a_whole_table(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, 9.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    rows = quantiles.placed(df, "v", "i", steps=4).withColumn("t", quantiles.tile(quantiles.F.col("place"), quantiles.F.col("n_rows"), 3)).orderBy("place").collect()
    assert [r.v for r in rows] == sorted(values) and [r["rank"] for r in rows] == [1, 2, 2, 4, 5, 5, 5] and [r.t for r in rows] == [1, 1, 1, 2, 2, 3, 3]


def test_places_near_the_pole_and_over_the_date_line(spark):
    a = spark.createDataFrame([(1, 10.0, 80.0), (2, 179.95, 0.0), (3, 0.0, 89.9)], "id long, lon double, lat double")
    b = spark.createDataFrame([(1, 10.6, 80.0), (2, -179.95, 0.0), (3, 90.0, 89.9), (4, 40.0, 10.0)], "id long, lon double, lat double")
    assert sorted((r.id, r.id_r) for r in spatial.within(a, b, 12.0).collect())[:2] == [(1, 1), (2, 2)]
    near = {r.id: r.id_r for r in spatial.nearest(a, b, "id", "id", 1, 1.0).collect()}
    assert near == {1: 1, 2: 2, 3: 3}
    assert spatial.nearest(a, b, "id", "id", 9, 500.0).count() == 12  # all there are


def test_spaced_picks_are_those_of_one_by_one(spark):
    import random

    rng = random.Random(5)
    rows = [(i, 100 + rng.random(), 7 + rng.random(), float(rng.randrange(20))) for i in range(120)]
    found = {r.id for r in spatial.spaced(spark.createDataFrame(rows, "id long, lon double, lat double, weight double"), "id", "weight", 20.0).collect()}

    def km(p, q):
        import math

        x = (q[1] - p[1]) * math.cos(math.radians((p[2] + q[2]) / 2)) * 111.32
        return math.hypot(x, (q[2] - p[2]) * 111.32)

    picked = []
    for p in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(km(p, q) > 20 for q in picked):
            picked.append(p)
    assert found == {p[0] for p in picked}


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(50, 50), (60, 41), (60, 61)], "u long, v long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(found[i] == i - i % 10 for i in range(40)) and (found[60], found[61], found[41]) == (41, 41, 41) and 50 not in found
    ways = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 12, 14)], "way long, a long, b long")
    assert {r.way: r.chain for r in graph.chains(ways).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_reach_has_no_limit_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(15)] + [(0, 9, 20.0)], "a long, b long, cost double")
    found = {r.node: r.cost for r in graph.reach_within(edges, spark.createDataFrame([(0,)], "node long"), 12.0).collect()}
    assert found == {i: float(i) for i in range(13)}


def test_a_reach_is_filled_from_its_channel(spark):
    """A channel at 0, a bank of 2 and a hollow behind it at 1: water reaches the hollow over the bank only."""
    row = [0.0, 2.0, 1.0]
    cells = spark.createDataFrame([("a", 0, c, h, c == 0) for c, h in enumerate(row)], "reach string, row int, col int, height double, channel boolean")
    (low,) = graph.filled(cells, 1.5, 1.0).collect()
    assert low.level == pytest.approx(1.5, abs=1e-5) and low.cells == 1
    (high,) = graph.filled(cells, 6.0, 1.0).collect()
    assert high.level == pytest.approx(3.0, abs=1e-5) and high.cells == 3


def test_points_before_the_first_knot_read_no_frame_to_the_end(spark):
    knots = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 3.0), ("b", 5.0, 7.0)], "river string, x double, y double")
    points = spark.createDataFrame([(1, "a", 0.0), (2, "a", 15.0), (3, "a", 30.0), (4, "b", 1.0), (5, "c", 1.0)], "id int, river string, x double")
    found = series.between_knots(points, knots, "river")
    assert {r.id: r.y for r in found.collect()} == {1: -1.0, 2: 2.0, 3: 5.0, 4: None, 5: None}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rows_at_one_place_are_searched_for_once(spark, monkeypatch):
    sizes = {}
    real = spatial.written
    monkeypatch.setattr(spatial, "written", lambda df, name: sizes.setdefault(name, []).append(out.count()) or out if (out := real(df, name)) is not None else out)
    rows = lambda n, places: spark.createDataFrame([(i, 100.0 + i % places / 10, 6.0) for i in range(n)], "id int, lon double, lat double")
    left, right = rows(400, 4), rows(300, 5)
    near = spatial.nearest(left, right, "id", "id", 3, 50.0).collect()
    assert sorted((r.id, r["rank"], r.id_r) for r in near) == [(i, k + 1, i % 4 + 5 * k) for i in range(400) for k in range(3)]
    assert max(sizes["nearest"]) <= 4 * 3 and max(sizes["kept"]) == 5 * 3
    far = spatial.nearest(left, right.where("lon > 100.35"), "id", "id", 100, 1.0, limit=25.0).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in far} == {i: 60 for i in range(400) if i % 4 in (2, 3)}  # the place at 100.4 only, 11 and 22 km away
    pairs = spatial.within(left, right, 12.0)
    assert pairs.count() == sum(abs(i % 4 - j % 5) <= 1 for i in range(400) for j in range(300)) and sizes["places"] == [4 * 3 - 1]
