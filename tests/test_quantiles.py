"""Percentiles and places of skewed values."""

from functools import reduce

import numpy as np
import pytest

from tidemark.operators import quantiles


def skewed(n):
    rng = np.random.default_rng(4)
    return np.concatenate([rng.normal(0, 1, n), 1e9 + rng.random(n // 10), np.full(n // 4, 7.0), [1e12, -1e300, 1e300]])


def test_one_far_value_leaves_no_full_step(spark, monkeypatch):
    kept = {}
    real = quantiles.written
    monkeypatch.setattr(quantiles, "written", lambda df, name: kept.setdefault(name, []).append(out := real(df, name)) or out)
    v = np.append(np.arange(50_000) / 7.0, 1e12)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").repartition(4)
    found = quantiles.placed(df, "v", most=400).orderBy("place").collect()
    assert [r.i for r in found] == list(range(len(v))) and [r["rank"] for r in found] == [i + 1 for i in range(len(v))]
    most = max(r["_many"] for r in kept["counts"][-1].collect())
    assert most <= 400 < 0.01 * len(v)


@pytest.mark.parametrize("steps,most", [(4096, 20_000), (16, 50), (2, 30)])
def test_places_of_skewed_values_with_ties(spark, steps, most):
    v = skewed(1000)
    df = spark.createDataFrame([(i * 37 % 1009, i, float(x)) for i, x in enumerate(v)], "tie long, i long, v double").repartition(5)
    found = {r.i: (r.place, r["rank"], r.n_rows) for r in quantiles.placed(df, "v", "tie", "i", steps=steps, most=most).collect()}
    order = sorted(range(len(v)), key=lambda i: (v[i], i * 37 % 1009, i))
    ranks = {x: k + 1 for k, x in reversed(list(enumerate(sorted(v))))}
    assert found == {i: (k + 1, ranks[v[i]], len(v)) for k, i in enumerate(order)}


def test_equal_rows_are_numbered_together(spark):
    df = spark.createDataFrame([(1.0,)] * 200 + [(2.0,)], "v double")
    found = quantiles.placed(df, "v", most=10).collect()
    assert sorted(r.place for r in found) == list(range(1, 202)) and {(r.v, r["rank"]) for r in found} == {(1.0, 1), (2.0, 201)}


@pytest.mark.parametrize("steps,most", [(4096, 20_000), (16, 50), (2, 30)])
def test_percentiles_of_skewed_values(spark, steps, most):
    v = skewed(1000)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 3.0), ("c", None), ("d", 1.0), ("d", 2.0)], "k string, v double")
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p90": 0.9, "p999": 0.999, "p100": 1.0}
    found = {r.k: [r[n] for n in shares] for r in quantiles.percentiles(df, ["k"], "v", shares, steps=steps, most=most).collect()}
    for k, values in (("a", v), ("b", [3.0]), ("d", [1.0, 2.0])):
        assert found.pop(k) == pytest.approx([float(np.quantile(values, p)) for p in shares.values()], rel=1e-12)
    assert found == {}


def test_sums_and_means_do_not_depend_on_the_order(spark):
    """Added up as doubles these groups' figures differ in the last place: equal means would not tie, and a sum would be under itself."""
    cents = [10, 20, 30, 99_999_999_99, 7] * 40
    rows = [(g, c / 100) for g, order in enumerate((cents, sorted(cents), sorted(cents, reverse=True))) for c in order]
    df = spark.createDataFrame(rows, "g int, v double").coalesce(1).groupBy("g")
    found = df.agg(quantiles.exact_sum("v").alias("s"), quantiles.exact_mean("v").alias("m")).collect()
    assert {(r.s, r.m) for r in found} == {(sum(cents) / 100, sum(cents) / (100 * len(cents)))}
    assert len({reduce(lambda a, c: a + c / 100, order, 0.0) for order in (cents, sorted(cents), sorted(cents, reverse=True))}) > 1
