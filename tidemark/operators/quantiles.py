"""Exact percentiles and ranks without sorting a key's rows in one task: histograms find where to look.

Values fall into equal steps between the smallest and the largest; counts of steps are added up before the shuffle. A step that is
still too full is cut again between its own smallest and largest value, so skewed values spread, too. Only rows of steps
that hold an asked-for place (percentiles) or are too full (places) are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import written

STEPS = 4096
MOST = 20_000  # rows of a step that are ordered in one task
SMALL = 100_000  # steps that are broadcast: a few megabytes


def _step(value: Column, low: Column, high: Column, steps: Column) -> Column:
    share = F.coalesce(F.try_divide(value / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
    return F.least(F.floor(share * steps), steps - 1).cast("int")


def _many(n: Column, most: int, steps: int) -> Column:
    return F.least(F.ceil(4 * n / most), F.lit(steps)).cast("int")


def exact_sum(value: str, places: int = 4) -> Column:
    """Sum of figures with at most so many decimal places as a double, whatever order they come in: added up as whole numbers."""
    return F.sum(_whole(value, places)).cast("double") / 10**places


def exact_mean(value: str, places: int = 4) -> Column:
    """Mean of figures with at most so many decimal places: equal means are equal doubles, so they tie."""
    return F.try_divide(F.sum(_whole(value, places)).cast("double"), F.count(value) * F.lit(10**places))


def _whole(value: str, places: int) -> Column:
    return F.round(F.col(value) * 10**places).cast("decimal(18,0)")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], steps: int = STEPS, most: int = MOST) -> DataFrame:
    """One row a key with the percentiles by name, linear between neighbours; NULL values are left out.

    One key may hold most rows. Keys must not be NULL.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = written(rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n")), "ends")
    # the two neighbours of each share, as places from 0
    asked = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in shares.values()])))
    holding = ends.where("_n > 0").select(*keys, F.lit(0).cast("long").alias("_before"), "_n", "_low", "_high", asked.alias("_asked"))
    done = []

    def among(bins: DataFrame) -> DataFrame:
        """The rows of some value ranges, at most two for each share and key."""
        bins = F.broadcast(bins) if bins.count() <= SMALL else bins
        met = rows.join(bins, keys) if keys else rows.join(bins, F.lit(True))
        return met.where("_v >= _low AND _v <= _high")

    while True:
        done.append(holding.where("_low = _high").select(*keys, F.explode("_asked").alias("_place"), F.col("_low").alias("_v")))
        few = among(holding.where(f"_low < _high AND _n <= {most}")).groupBy(*keys, "_low", "_v").agg(F.count("*").alias("_many"), F.first("_before").alias("_before"), F.first("_asked").alias("_asked"))
        rising = Window.partitionBy(*keys, "_low").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        few = few.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_many").over(rising), F.lit(0)))
        hit = F.filter("_asked", lambda x: (x >= F.col("_first")) & (x < F.col("_first") + F.col("_many")))
        done.append(few.select(*keys, F.explode(hit).alias("_place"), "_v"))
        full = holding.where(f"_low < _high AND _n > {most}")
        if full.isEmpty():
            break
        cut = among(full).withColumn("_step", _step(F.col("_v"), F.col("_low"), F.col("_high"), _many(F.col("_n"), most, steps)))
        counts = cut.groupBy(*keys, "_low", "_step").agg(
            F.count("*").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.first("_before").alias("_before"), F.first("_asked").alias("_asked")
        )
        upto = Window.partitionBy(*keys, "_low").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        own = F.filter("_asked", lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_n")))
        holding = counts.select(*keys, "_before", "_n", F.col("_from").alias("_low"), F.col("_to").alias("_high"), own.alias("_asked")).where(F.size("_asked") > 0)
        holding = written(holding, "holding")
    found = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_at"))
    both = found.join(F.broadcast(ends), keys) if keys else found.join(F.broadcast(ends), F.lit(True))

    def between(p: float) -> Column:
        place = (F.col("_n") - 1) * p
        low, high = F.element_at("_at", F.floor(place)), F.element_at("_at", F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    return both.select(*keys, *[between(p).alias(name) for name, p in shares.items()])


def placed(df: DataFrame, value: str, *ties: str, steps: int = STEPS, most: int = MOST) -> DataFrame:
    """Every row with ``place`` (row number from 1 by value, then ties), ``rank`` (by value alone) and ``n_rows``, over the whole table.

    Values and ties are numbers. Steps that hold one value only are cut by the ties; rows equal in all are numbered together.
    """
    order = [value, *ties]
    rows = df.withColumn("_path", F.lit("")).withColumn("_value", F.lit(""))
    settled = []
    while True:
        sums = rows.groupBy("_path").agg(
            F.count("*").alias("_n"), *[f(F.col(c).cast("double")).alias(f"_{n}{i}") for i, c in enumerate(order) for n, f in (("low", F.min), ("high", F.max))]
        )
        by = F.coalesce(*[F.when(F.col(f"_low{i}") < F.col(f"_high{i}"), i) for i in range(len(order))])
        sums = written(sums.withColumn("_by", F.when(F.col("_n") > most, by)), "steps")
        if sums.where("_by IS NOT NULL").isEmpty():
            settled.append(rows)
            break
        joined = rows.join(F.broadcast(sums) if sums.count() <= SMALL else sums, "_path")
        settled.append(joined.where("_by IS NULL").select(*rows.columns))
        of = lambda name: F.coalesce(*[F.when(F.col("_by") == i, F.col(f"_{name}{i}") if name != "v" else F.col(c).cast("double")) for i, c in enumerate(order)])  # noqa: E731, B023
        step = _step(of("v"), of("low"), of("high"), _many(F.col("_n"), most, steps))
        path = F.concat("_path", F.lpad(F.hex(step), 3, "0"))
        deeper = joined.where("_by IS NOT NULL").withColumn("_deeper", path)
        rows = written(deeper.withColumn("_value", F.when(F.col("_by") == 0, F.col("_deeper")).otherwise(F.col("_value"))).withColumn("_path", F.col("_deeper")).select(*rows.columns), "rows")
    found = reduce(DataFrame.unionByName, settled)
    # a row for each step: some hundred for a million rows
    counts = written(found.groupBy("_value", "_path").agg(F.count("*").alias("_many")), "counts")
    along = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_many").over(along), F.lit(0)))
    before = before.withColumn("_first", F.min("_before").over(Window.partitionBy("_value"))).withColumn("n_rows", F.sum("_many").over(Window.partitionBy()))
    before = before.select("_path", "_before", "_first", "n_rows")
    found = found.join(F.broadcast(before) if counts.count() <= SMALL else before, "_path")
    inside = Window.partitionBy("_path")
    by_value = F.when(F.col("_path") == F.col("_value"), F.col("_before") + F.rank().over(inside.orderBy(value))).otherwise(F.col("_first") + 1)
    found = found.withColumn("place", F.col("_before") + F.row_number().over(inside.orderBy(value, *ties))).withColumn("rank", by_value)
    return found.drop("_path", "_value", "_before", "_first")


def tile(place: Column, n_rows: Column, tiles: int) -> Column:
    """Which of so many equal tiles a place from 1 is in; the first ones take the rows that are left over."""
    size, more = F.floor(n_rows / tiles), n_rows % tiles
    split = more * (size + 1)
    return F.when(place <= split, F.floor((place - 1) / (size + 1)) + 1).otherwise(more + F.floor((place - 1 - split) / F.greatest(size, F.lit(1))) + 1)
