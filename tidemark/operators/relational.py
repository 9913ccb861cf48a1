"""Joins and predicates of boards: bands, ladders, latest rows, overlaps, contradicted reports, small-count cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band(value: Column, low: Column, high: Column) -> Column:
    """low, middle or high against two references; unknown where anything is missing."""
    return (
        F.when(value.isNull() | low.isNull() | high.isNull(), "unknown").when(value < low, "low").when(value > high, "high").otherwise("middle")
    )


def ladder(value: Column, fresh: Column, watch: Column, warning: Column, evacuate: Column) -> Column:
    """The highest level reached; no_recent_data before anything else, no_levels where there is nothing to compare."""
    return (
        F.when(value.isNull() | ~fresh, "no_recent_data").when(value >= evacuate, "above_evacuate").when(value >= warning, "above_warning")
        .when(value >= watch, "above_watch").when(watch.isNull() & warning.isNull() & evacuate.isNull(), "no_levels").otherwise("normal")
    )


def ordinal(column: Column, labels: list[str]) -> Column:
    """Rank of an ordered label from 1; NULL for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), column), F.lit(0))


def weighted_known(parts: dict[str, float]) -> tuple[Column, Column]:
    """(mean of the known parts with their weights renormalised, names of the missing parts)."""
    known = [F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    weight = sum(known, F.lit(0.0))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in parts]))
    return F.when(weight > 0, total / weight), missing


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, tolerance_s: int) -> DataFrame:
    """Each left row with the right row of its key nearest in time within the tolerance, the earlier of equals, else NULLs.

    The time axis is cut into buckets as long as the tolerance and joined on key and bucket, so a hot key spreads over
    its buckets. Left rows need a column row_id; right columns come as a struct ``near``.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    bucket = lambda c: F.floor(seconds(c) / tolerance_s)
    wide = left.withColumn("_b", F.explode(F.array(bucket(left_ts) - 1, bucket(left_ts), bucket(left_ts) + 1)))
    near = right.select(F.col(key).alias("_k"), bucket(right_ts).alias("_rb"), seconds(right_ts).alias("_rs"), F.struct("*").alias("near"))
    away = F.abs(F.col("_rs") - seconds(left_ts))
    found = wide.join(near, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_rb")) & (away <= tolerance_s))
    best = found.groupBy("row_id").agg(F.min_by("near", F.struct(away, "_rs")).alias("near"))
    return left.join(best, "row_id", "left")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, stale_s: int) -> DataFrame:
    """Each left row with the last right value at or before it, unless that is older than stale_s seconds.

    One sorted pass over the union of both sides; no join on ranges.
    """
    a = left.select("*", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side"))
    b = right.select(F.col(key), F.col(ts), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(ts, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col(ts).alias("t"), F.col("_v").alias("v"))), ignorenulls=True).over(w)
    fresh = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_l.t").cast("timestamp")) <= stale_s * 1_000_000
    return both.withColumn("_l", last).where("_side = 1").withColumn("as_of", F.when(fresh, F.col("_l.v"))).drop("_l", "_v", "_side")


def active_in_buckets(sessions: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Sessions joined to every bucket they touch, by exploding each session's own buckets."""
    step = f"INTERVAL {minutes} MINUTES"
    floor = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (minutes * 60)) * (minutes * 60))
    return sessions.withColumn("bucket", F.explode(F.sequence(floor(start), floor(end), F.expr(step))))


def sessions(events: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """(key, session, started, ended, n): a new session after a pause longer than the gap."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    pause = F.col(ts) - F.lag(ts).over(w) > F.make_dt_interval(mins=F.lit(gap_minutes))
    numbered = events.withColumn("_new", F.coalesce(pause, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def suppressed(counts: DataFrame, people: str, k: int, *columns: str) -> DataFrame:
    """Figures over fewer than k people withheld."""
    return counts.withColumns({c: F.when(F.col(people) >= k, F.col(c)) for c in columns})


def contingency(df: DataFrame, group: str, said: Column, true: Column) -> DataFrame:
    """Hits, misses, false alarms, quiet, and POD, FAR, CSI, bias; NULL where nothing divides."""
    counts = df.groupBy(group).agg(
        F.count_if(said & true).alias("hits"), F.count_if(~said & true).alias("misses"),
        F.count_if(said & ~true).alias("false_alarms"), F.count_if(~said & ~true).alias("quiet"),
    )
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return counts.withColumns({"pod": ratio(h, h + m), "far": ratio(f, h + f), "csi": ratio(h, h + m + f), "bias": ratio(h + f, h + m)})


def threshold_sweep(df: DataFrame, value: str, true: Column, bins: int, low: float, high: float) -> DataFrame:
    """CSI of every bin edge as the threshold, from one histogram and running sums over its bounded bins."""
    b = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count_if(true).alias("yes"), F.count_if(~true).alias("no"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    everything = Window.partitionBy()
    hits, false, total = F.sum("yes").over(above), F.sum("no").over(above), F.sum("yes").over(everything)
    return counts.select("bin", hits.alias("hits"), false.alias("false_alarms"), (total - hits).alias("misses"), (hits / (total + false)).alias("csi"))


def guarded_csv(df: DataFrame) -> DataFrame:
    """Text columns made safe for spreadsheets: what would start a formula gets an apostrophe before it."""
    guard = lambda c: F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))
    return df.select(*[guard(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def anonymised(df: DataFrame, ids: list[str], times: list[str], coordinates: list[str]) -> DataFrame:
    """Ids removed, times cut to the hour, coordinates to two places."""
    return df.withColumns(
        {c: F.lit(None).cast(dict(df.dtypes)[c]) for c in ids} | {c: F.date_trunc("hour", c) for c in times} | {c: F.round(c, 2) for c in coordinates}
    )
