"""Never-rising fits of long groups over many tasks, and picks with a quota an area."""

import math
import random

import pytest

from tidemark.operators import series, spatial


def plain_fit(values):
    pools = []
    for v in values:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] < pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1]]
    return [t / n for t, n in pools for _ in range(n)]


@pytest.mark.parametrize("most", [30, 10**6])
@pytest.mark.parametrize("shape", ["falling", "rising", "waves", "noise"])
def test_a_group_in_a_hundred_parts_equals_the_plain_fit(spark, most, shape):
    rng = random.Random(9)
    make = {"falling": lambda i: -float(i), "rising": lambda i: float(i), "waves": lambda i: math.sin(i / 97) * 50 - i / 40, "noise": lambda i: rng.gauss(0, 30) - i / 20}[shape]
    groups = {"a": [make(i) for i in range(3000)], "b": [make(i) for i in range(7)], "c": [1.0]}
    rows = [(g, i * 3, v) for g, values in groups.items() for i, v in enumerate(values)] + [("a", 1, None)]
    rng.shuffle(rows)
    found = series.never_rising(spark.createDataFrame(rows, "g string, at long, v double"), "g", "at", "v", most=most).collect()
    by = {(r.g, r["at"]): r.fitted for r in found}
    assert len(by) == len(found) == len(rows) - 1
    for g, values in groups.items():
        assert [by[g, i * 3] for i in range(len(values))] == pytest.approx(plain_fit(values), abs=1e-9)


def test_fit_of_nothing(spark):
    assert series.never_rising(spark.createDataFrame([], "g string, at long, v double"), "g", "at", "v").collect() == []


@pytest.mark.parametrize("quota", [1, 2, 5, 1000])
def test_picks_with_a_quota_equal_picking_one_by_one(spark, quota):
    rng = random.Random(quota)
    places = [(i, 100 + rng.random() * 0.8, 7 + rng.random() * 0.8, float(rng.randrange(40)), rng.choice("abbbbbc")) for i in range(140)]
    picks = []
    for p in sorted(places, key=lambda p: (-p[3], p[0])):
        near = lambda q: math.hypot((q[1] - p[1]) * math.cos(math.radians((q[2] + p[2]) / 2)), q[2] - p[2]) * spatial.KM_PER_DEGREE <= 12.0  # noqa: E731, B023
        if not any(near(q) for q in picks) and sum(q[4] == p[4] for q in picks) < quota:
            picks.append(p)
    df = spark.createDataFrame(places, "id long, lon double, lat double, w double, area string")
    assert sorted(r.id for r in spatial.spaced(df, "id", "w", 12.0, "area", quota).collect()) == sorted(p[0] for p in picks)
