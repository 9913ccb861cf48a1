"""Sketches of people against exact counts, and the stored roll-up."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import people


def test_sketches_are_near_the_exact_counts(spark):
    """A hundred thousand people: under two per cent off, from one scan."""
    user = F.pmod(F.xxhash64("id"), F.lit(100_000))
    day = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(20)).cast("int")
    rows = spark.range(600_000).select(user.alias("u"), F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("ts"))
    days = people.daily(rows, "ts", "u", log_size=14)
    found = {r.day: r for r in people.active(days, {"dau": 1, "wau": 7, "mau": 30}, 14).collect()}
    exact = {}
    seen = rows.select(F.to_date("ts").alias("day"), "u").distinct().persist()
    for name, span in (("dau", 1), ("wau", 7), ("mau", 30)):
        spread = seen.select("u", F.explode(F.sequence("day", F.date_add("day", span - 1))).alias("day")).groupBy("day").agg(F.countDistinct("u").alias("n"))
        exact[name] = {r.day: r.n for r in spread.collect()}
    for d, r in found.items():
        assert all(abs(r[name] / exact[name][d] - 1) < 0.02 for name in exact)
    assert max(r.mau for r in found.values()) > 90_000


def test_days_are_stored_once_and_replaced(spark, tmp_path):
    path, t = str(tmp_path / "days"), datetime(2024, 1, 1)
    log = lambda *rows: spark.createDataFrame([(t + timedelta(days=d), u, p) for d, u, p in rows], "ts timestamp, u long, page string")
    people.store(people.daily(log((0, 1, "a"), (0, 2, "a"), (1, 1, "b"), (1, None, "b")), "ts", "u", "page"), path)
    people.store(people.daily(log((1, 7, "b"), (1, 8, "b"), (1, 8, "b"), (2, 1, "a")), "ts", "u", "page"), path)  # the second day again, and one more
    read = lambda days: {r.day: (r.n, r.dau, r.wau) for r in people.active(days, {"dau": 1, "wau": 7}).collect()}
    assert read(people.stored(spark, path)) == {date(2024, 1, 1): (2, 2, 2), date(2024, 1, 2): (3, 2, 4), date(2024, 1, 3): (1, 1, 4)}
    assert read(people.stored(spark, path, "2024-01-02")) == {date(2024, 1, 2): (3, 2, 2), date(2024, 1, 3): (1, 1, 3)}


def test_cohorts_count_who_came_back(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 0), (2, 0), (3, 0), (1, 1), (2, 9), (4, 1), (4, 1), (5, 2), (4, 30), (None, 3)]
    log = spark.createDataFrame([(u, t + timedelta(days=d)) for u, d in rows], "u long, ts timestamp")
    found = {(r.day - t.date()).days: (r.cohort, r.returned, r.after) for r in people.cohorts(people.daily(log, "ts", "u")).collect()}
    assert found == {0: (3, 1, 1), 1: (1, 0, 1), 2: (1, 0, 0)}


def test_parts_make_counts_of_many_people_exact(spark):
    rows = spark.range(6000).select((F.col("id") * 7919 % 3000).alias("u"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 13).cast("int")).cast("timestamp").alias("ts"))
    parts = people.parts_for(rows, "u", 8)
    days = people.daily(rows, "ts", "u", log_size=8, parts=parts)
    seen = [(r.u, r.ts.date()) for r in rows.collect()]
    every = sorted({d for _, d in seen})
    for r in people.active(days, {"dau": 1, "wau": 7}, 8).collect():
        assert r.n == sum(d == r.day for _, d in seen)
        assert [r.dau, r.wau] == [len({u for u, d in seen if 0 <= (r.day - d).days < n}) for n in (1, 7)]
    first = {u: min(d for v, d in seen if v == u) for u in range(3000)}
    after = {(u, (d - first[u]).days) for u, d in seen}
    expected = {d: [sum(f == d for f in first.values()), len({u for u, n in after if 1 <= n <= 8 and first[u] == d}), len({u for u, n in after if n > 7 and first[u] == d})] for d in every if d in first.values()}
    assert {r.day: [r.cohort, r.returned, r.after] for r in people.cohorts(days, log_size=8).collect()} == expected
