"""Daily figures of long (entity, time, value) series on local days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_day(ts: Column | str, offset_hours: int = 7) -> Column:
    """The calendar day at a fixed offset from UTC, without daylight saving."""
    return F.to_date(F.col(ts) + F.make_dt_interval(hours=F.lit(offset_hours)) if isinstance(ts, str) else ts + F.make_dt_interval(hours=F.lit(offset_hours)))


def daily_floor(df: DataFrame, entity: str, ts: str, value: str, offset_hours: int = 7, min_rows: int = 1) -> DataFrame:
    """Lowest value of each local day; days with fewer than ``min_rows`` values are left out."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(entity).alias("entity"), local_day(ts, offset_hours).alias("local_day"))
        .agg(F.min(value).alias("floor"), F.count("*").alias("n_rows"))
        .where(F.col("n_rows") >= min_rows)
    )


def rose_days(floors: DataFrame, steps: int = 7) -> DataFrame:
    """How many of the last ``steps`` day-to-day steps of the floor rose; NULL until that many consecutive days exist.

    A missing day breaks the run: no step is judged across a gap.
    """
    days = Window.partitionBy("entity").orderBy("local_day")
    last = days.rowsBetween(-(steps - 1), 0)
    next_day = F.datediff("local_day", F.lag("local_day").over(days)) == 1
    step = F.when(next_day, (F.col("floor") > F.lag("floor").over(days)).cast("int"))
    return floors.withColumn("rose", step).withColumn(
        "rose_days", F.when(F.count("rose").over(last) == steps, F.sum("rose").over(last))
    ).drop("rose")
