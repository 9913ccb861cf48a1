"""Distinct people from a stored sketch a day: one scan of the log, and then only a row a day, whatever the span asked for.

Sketches are theta sketches of up to ``2 ** log_size`` hashes: exact below that many people, with an error of about
``2 ** (-log_size / 2)`` (0.4 % for 16) above, and closed under union, intersection and difference. So days make weeks, months, people
seen for the first time and people who came back. With ``parts_for`` so many parts a day, counts are exact for any number of people. Rows of the log are added up by day before they move; a day that a third of
all rows fall on is one sketch of each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SIZE = 16


def daily(events: DataFrame, ts: str, user: str, *cuts: str, log_size: int = LOG_SIZE, parts: int = 1) -> DataFrame:
    """(day, cuts, n, people): rows and the sketch of their people by day; rows without a person count, but not as people.

    With ``parts`` people are dealt to so many sketches a day by a hash (column ``part``).
    """
    cuts = [*cuts, F.pmod(F.xxhash64(user), F.lit(parts)).alias("part")] if parts > 1 else [*cuts]
    return events.groupBy(F.to_date(ts).alias("day"), *cuts).agg(F.count("*").alias("n"), F.theta_sketch_agg(user, log_size).alias("people"))


def parts_for(events: DataFrame, user: str, log_size: int = LOG_SIZE) -> int:
    """How many parts a day leave each sketch half empty over all days, so that every count is exact."""
    people = events.agg(F.approx_count_distinct(user).alias("n")).first().n
    return -(-2 * people // 2**log_size) or 1


def _parts(days: DataFrame) -> list[str]:
    """A person is always in the same part, so parts are counted by themselves and added up."""
    return [c for c in days.columns if c == "part"]


def store(days: DataFrame, path: str) -> None:
    """Days put into the stored roll-up at ``path``, in place of what it has for them; other days stay as they are."""
    days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The roll-up, of days from ``since`` on: only their partitions are opened."""
    found = spark.read.parquet(path)
    return found if since is None else found.where(F.col("day") >= F.lit(since).cast("date"))


def active(days: DataFrame, spans: dict[str, int], log_size: int = LOG_SIZE) -> DataFrame:
    """(day, n, one column a span): people seen in the last so many days, the day with them, of each day that has rows."""
    part = _parts(days)
    whole = days.groupBy("day", *part).agg(F.sum("n").alias("n"), F.theta_union_agg("people", log_size).alias("people"))
    most = max(spans.values())
    later = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    counted = whole.select("people", "day", *part, later.alias("back")).withColumn("day", F.date_add("day", F.col("back")))
    each = [F.theta_union_agg(F.when(F.col("back") < n, F.col("people")), log_size).alias(name) for name, n in spans.items()]
    merged = counted.groupBy("day", *part).agg(*each)
    estimate = [F.sum(F.round(F.theta_sketch_estimate(name)).cast("long")).alias(name) for name in spans]
    return whole.groupBy("day").agg(F.sum("n").alias("n")).join(merged.groupBy("day").agg(*estimate), "day")


def cohorts(days: DataFrame, near: int = 8, far: int = 7, log_size: int = LOG_SIZE) -> DataFrame:
    """(day, cohort, returned, after): people first seen on a day, and how many of them came in the next ``near`` days and after ``far`` days.

    Unions run over a row a day (and part): before a day, in the days behind it, and from some days behind it on.
    """
    part = _parts(days)
    whole = days.groupBy("day", *part).agg(F.theta_union_agg("people", log_size).alias("people")).withColumn("_d", F.unix_date("day"))
    over = lambda low, high: F.theta_union_agg("people", log_size).over(Window.partitionBy(*part).orderBy("_d").rangeBetween(low, high))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    rows = whole.withColumn("_before", over(first, -1)).withColumn("_near", over(1, near)).withColumn("_far", over(far + 1, last))
    fresh = F.when(F.col("_before").isNull(), F.col("people")).otherwise(F.theta_difference("people", "_before"))
    rows = rows.withColumn("_new", fresh)
    count = lambda sketch: F.round(F.theta_sketch_estimate(sketch)).cast("long")
    among = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(count(F.theta_intersection("_new", F.col(c))))
    found = rows.select("day", count(F.col("_new")).alias("cohort"), among("_near").alias("returned"), among("_far").alias("after"))
    return found.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("cohort", "returned", "after")]).where("cohort > 0")
