"""Operators on series: long (entity, ts, value) rows in, rows out.

Windows are partitioned by entity. A gap never satisfies a rule: hours that are missing stay NULL on the gapless spine,
and rolling figures are NULL until enough of their rows are there.
"""

from __future__ import annotations

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import written


def hourly(df: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """(entity, hour, value): the mean of each hour."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.date_trunc("hour", ts).alias("hour"))
        .agg(F.avg(value).alias("value"))
    )


def spine(series: DataFrame, step: str = "1 hour") -> DataFrame:
    """Every step between an entity's first and last row; missing ones have a NULL value."""
    ends = series.groupBy("entity").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    steps = ends.select("entity", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("hour"))
    return steps.join(series, ["entity", "hour"], "left")


def ordered(*more: str) -> Window:
    return Window.partitionBy("entity").orderBy("hour", *more)


def rise(gapless: DataFrame, n: int) -> DataFrame:
    """Change over n steps, and per step."""
    change = F.col("value") - F.lag("value", n).over(ordered())
    return gapless.withColumn("rise", change).withColumn("rate", F.col("rise") / n)


def rolling_sum(gapless: DataFrame, n: int, share: float = 0.9) -> DataFrame:
    """Sum of the last n steps where at least ``share`` of them are there."""
    last = ordered().rowsBetween(-(n - 1), 0)
    known = F.count("value").over(last)
    return gapless.withColumn("known", known).withColumn("total", F.when(known >= share * n, F.sum("value").over(last)))


def forward_sum(gapless: DataFrame, n: int) -> DataFrame:
    """Sum of this and the next n - 1 steps where all are there."""
    ahead = ordered().rowsBetween(0, n - 1)
    return gapless.withColumn("ahead", F.when(F.count("value").over(ahead) == n, F.sum("value").over(ahead)))


def centred_mean(gapless: DataFrame, n: int, share: float, source: str = "value", to: str = "slow") -> DataFrame:
    """Mean of the n steps around each; an even n reaches one step further back."""
    around = ordered().rowsBetween(-(n // 2), n - 1 - n // 2)
    return gapless.withColumn(to, F.when(F.count(source).over(around) >= share * n, F.avg(source).over(around)))


def tidal_split(gapless: DataFrame) -> DataFrame:
    """Slow part by a centred mean of 25 steps with at least 80 % there, and the rest."""
    return centred_mean(gapless, 25, 0.8).withColumn("fast", F.col("value") - F.col("slow"))


def godin(gapless: DataFrame) -> DataFrame:
    """Three centred means in a row, over 24, 24 and 25 steps, each of them complete."""
    first = centred_mean(gapless, 24, 1.0, "value", "_one")
    second = centred_mean(first, 24, 1.0, "_one", "_two")
    return centred_mean(second, 25, 1.0, "_two", "residual").drop("_one", "_two")


def bridged(gapless: DataFrame, longest: int) -> DataFrame:
    """Gaps of up to ``longest`` steps filled linearly; longer gaps stay."""
    place = gapless.withColumn("_i", F.row_number().over(ordered()))
    at = F.when(F.col("value").isNotNull(), F.struct("_i", "value"))
    before = F.last(at, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(ordered().rowsBetween(0, Window.unboundedFollowing))
    ends = place.withColumn("_b", before).withColumn("_a", after)
    gap = F.col("_a._i") - F.col("_b._i") - 1
    line = F.col("_b.value") + (F.col("_a.value") - F.col("_b.value")) * (F.col("_i") - F.col("_b._i")) / (gap + 1)
    filled = F.coalesce("value", F.when(gap <= longest, line))
    return ends.withColumn("bridged", filled).drop("_i", "_b", "_a")


def confirmed(flagged: DataFrame, n: int) -> DataFrame:
    """``flag`` held in each of the last n rows."""
    last = ordered().rowsBetween(-(n - 1), 0)
    held = F.coalesce(F.min(F.col("flag").cast("int")).over(last) == 1, F.lit(False))
    whole = F.count("flag").over(last) == n
    return flagged.withColumn("confirmed", held & whole)


def spells(flagged: DataFrame, gap_hours: int = 1, least: int = 1, *more: Column) -> DataFrame:
    """(entity, start, end, n_rows, peak) of runs of true rows, and more aggregates; runs no more than gap_hours apart are one."""
    true = flagged.where("flag")
    far = F.col("hour") - F.lag("hour").over(ordered()) > F.make_dt_interval(hours=F.lit(gap_hours))
    marked = true.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int"))
    numbered = marked.withColumn("spell", F.sum("_new").over(ordered()))
    found = numbered.groupBy("entity", "spell").agg(
        F.min("hour").alias("start"), F.max("hour").alias("end"), F.count("*").alias("n_rows"), F.max("value").alias("peak"), *more
    )
    return found.where(F.col("n_rows") >= least).drop("spell")


def rising_edges(flagged: DataFrame) -> DataFrame:
    """(entity, n_spells): how often the flag turns true."""
    before = F.coalesce(F.lag("flag").over(ordered()), F.lit(False))
    return flagged.withColumn("_edge", F.col("flag") & ~before).groupBy("entity").agg(F.count_if("_edge").alias("n_spells"))


def longest_run(flagged: DataFrame) -> DataFrame:
    """(entity, longest): the most rows in a row with the flag true, by the difference of two row numbers."""
    every = flagged.withColumn("_i", F.row_number().over(ordered()))
    true = every.where("flag").withColumn("_k", F.col("_i") - F.row_number().over(ordered()))
    runs = true.groupBy("entity", "_k").agg(F.count("*").alias("n"))
    return runs.groupBy("entity").agg(F.max("n").alias("longest"))


def best_window(gapless: DataFrame, k: int) -> DataFrame:
    """(entity, start, total): the complete window of k steps with the largest sum, the earliest of equals."""
    sums = forward_sum(gapless, k).where("ahead IS NOT NULL")
    first = Window.partitionBy("entity").orderBy(F.col("ahead").desc(), "hour")
    top = sums.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return top.select("entity", F.col("hour").alias("start"), F.col("ahead").alias("total"))


def deaccumulated(gapless: DataFrame, least: int = 3, reach: float = 0.0) -> DataFrame:
    """Running totals turned into increments inside non-falling runs of at least ``least`` rows that reach ``reach``."""
    falls = F.coalesce(F.col("value") < F.lag("value").over(ordered()), F.lit(True))
    runs = gapless.where("value IS NOT NULL").withColumn("_run", F.sum(falls.cast("int")).over(ordered()))
    size = F.count("*").over(Window.partitionBy("entity", "_run"))
    step = F.greatest(F.col("value") - F.lag("value").over(Window.partitionBy("entity", "_run").orderBy("hour")), F.lit(0.0))
    total = (size >= least) & (F.max("value").over(Window.partitionBy("entity", "_run")) >= reach)
    return runs.withColumn("increment", F.when(total, step).otherwise(F.col("value"))).drop("_run")


def coverage(series: DataFrame) -> DataFrame:
    """(entity, first, last, n_rows, median_step, n_gaps): gaps are steps of more than three medians."""
    step = F.unix_timestamp(F.col("hour").cast("timestamp")) - F.unix_timestamp(F.lag("hour").over(ordered()).cast("timestamp"))
    steps = series.withColumn("_step", step)
    middle = steps.groupBy("entity").agg(F.median("_step").alias("median_step"))
    return steps.join(middle, "entity").groupBy("entity", "median_step").agg(
        F.min("hour").alias("first"), F.max("hour").alias("last"), F.count("*").alias("n_rows"),
        F.count_if(F.col("_step") > 3 * F.col("median_step")).alias("n_gaps"),
    )


def recessions(gapless: DataFrame, level: float, n: int, gap_hours: int = 4, least: int = 1, guard: int = 3) -> DataFrame:
    """(entity, start, peak_at, peak, dropped, below, known, censored) of each spell at or above the level.

    From the peak on, ``below`` is the first hour from which n hours are there and below the level. A missing hour or the
    end of the record that comes first censors it: ``known`` is then the last hour known before. Dropped are spells that
    begin with the record or behind a gap, or with a gap within ``guard`` hours of the peak.
    """
    place = gapless.withColumn("_i", F.row_number().over(ordered())).withColumn("flag", F.coalesce(F.col("value") >= level, F.lit(False)))
    missing = F.col("value").isNull()
    ahead = ordered().rowsBetween(0, n - 1)
    offender = F.min(F.when(missing | F.col("flag"), F.struct("_i", missing.alias("missing")))).over(ahead)
    marked = place.withColumn("_off", offender).withColumn("_n", F.count("*").over(ahead))
    quiet = ~missing & ~F.col("flag") & F.col("_off").isNull()
    decisive = missing | (~F.col("flag") & (F.col("_off").isNull() | F.col("_off.missing")))
    before = F.lag("hour").over(ordered())
    verdict = F.when(decisive, F.struct("_i", "hour", before.alias("before"), (quiet & (F.col("_n") == n)).alias("fell")))
    following = ordered().rowsBetween(0, Window.unboundedFollowing)
    around = ordered().rowsBetween(-guard, guard)
    marked = marked.withColumn("_v", F.min(verdict).over(following)).withColumn("_last", F.last("hour").over(following))
    marked = marked.withColumn("_gap", F.max(missing.cast("int")).over(around) == 1).withColumn("_open", F.lag("value").over(ordered()).isNull())
    found = spells(marked, gap_hours, least, F.min_by(F.struct("_open"), "hour").alias("_first"), F.max_by(F.struct("hour", "_v", "_last", "_gap"), F.struct("value", -F.col("_i"))).alias("_p"))
    dropped = F.when(F.col("_first._open"), "starts_in_gap").when(F.col("_p._gap"), "gap_at_peak")
    keep = lambda c: F.when(dropped.isNull(), c)
    fell = F.coalesce(F.col("_p._v.fell"), F.lit(False))
    known = F.when(F.col("_p._v").isNull(), F.col("_p._last")).otherwise(F.col("_p._v.before"))
    return found.select(
        "entity", "start", F.col("_p.hour").alias("peak_at"), "peak", dropped.alias("dropped"),
        keep(F.when(fell, F.col("_p._v.hour"))).alias("below"), keep(F.when(fell, F.col("_p._v.hour")).otherwise(known)).alias("known"), keep(~fell).alias("censored"),
    )


def _pooled(columns: list[str]):
    """Rows or pools (group, place, total, n, pool) of sorted ranges with ``new``, the pool that each falls into within its range."""

    def run(frames):
        part, made = TaskContext.get().partitionId() << 40, 0
        open_: list[list] = []  # total, n, number of the pool, of the group that is being read
        group, held = None, []

        def close():
            """The pools' numbers for what is held of a group."""
            numbers = [number for _, _, number, many in open_ for _ in range(many)]
            return pd.DataFrame(held, columns=columns).assign(new=pd.array(numbers, "int64"))

        for frame in frames:
            for row in frame[columns].itertuples(index=False, name=None):
                if group is None or row[0] != group[0]:
                    if held:
                        yield close()
                    group, held, open_ = (row[0],), [], []
                held.append(row)
                open_.append([row[2], row[3], part | made, 1])
                made += 1
                while len(open_) > 1 and open_[-2][0] * open_[-1][1] < open_[-1][0] * open_[-2][1]:
                    total, n, _, many = open_.pop()
                    open_[-1][0] += total
                    open_[-1][1] += n
                    open_[-1][3] += many
        if held:
            yield close()

    return run


def never_rising(df: DataFrame, group: str, order: str, value: str, most: int = 100_000) -> DataFrame:
    """(group, order, fitted): the isotonic fit that never rises along ``order``, which has one row a place of a group.

    Adjacent violators may be pooled in any order, so ranges of about ``most`` rows pool their own, and then ranges of pools do, with
    other borders each round, until no two pools at a border rise. A group spreads over as many tasks as it needs; where a fit
    falls all the way, pools stay many, but no task holds more than a range of them. NULL values are left out.
    """
    kind = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).cast("double").alias("total"), F.lit(1).cast("long").alias("n"))
    size, turn, of_row = rows.count(), 0, None
    while True:
        parts = max(1, -(-size // most))
        parts += turn % 2 if parts > 1 else 0
        columns = ["g", "o", "total", "n"] + ([] if of_row is None else ["pool"])
        kinds = {"g": kind[group], "o": kind[order], "total": "double", "n": "long", "pool": "long", "new": "long"}
        ranges = rows.repartitionByRange(parts, "g", "o").sortWithinPartitions("g", "o")
        found = written(ranges.mapInPandas(_pooled(columns), ", ".join(f"{c} {kinds[c]}" for c in [*columns, "new"])), "pooled")
        of_row = found.select("g", "o", "new") if of_row is None else of_row.withColumnRenamed("new", "pool").join(found.select("pool", "new"), "pool").select("g", "o", "new")
        of_row = written(of_row, "places") if parts > 1 or turn else of_row
        pools = found.groupBy(F.col("new").alias("pool")).agg(F.first("g").alias("g"), F.min("o").alias("o"), F.sum("total").alias("total"), F.sum("n").alias("n"))
        pools = written(pools, "pools")
        # the first and last pool of each range: two rows a range
        place, mean = F.struct("g", "o"), F.col("total") / F.col("n")
        ends = pools.groupBy(F.shiftright("pool", 40).alias("part")).agg(
            F.min(place).alias("first"), F.min_by(mean, place).alias("begins"), F.max(place).alias("last"), F.max_by(mean, place).alias("ends"), F.count("*").alias("many")
        ).orderBy("first").collect()
        if not any(a["last"]["g"] == b["first"]["g"] and a["ends"] < b["begins"] for a, b in zip(ends, ends[1:], strict=False)):
            fit = of_row.join(pools.select(F.col("pool").alias("new"), mean.alias("fitted")), "new")
            return fit.select(F.col("g").alias(group), F.col("o").alias(order), "fitted")
        rows, size, turn = pools.select("g", "o", "total", "n", "pool"), sum(e["many"] for e in ends), turn + 1


def between_knots(points: DataFrame, knots: DataFrame, group: str) -> DataFrame:
    """Points (..., group, x) with ``y`` on the line between the knots (group, x, y) around them; the outer lines go on beyond the ends."""
    w = Window.partitionBy(group).orderBy("x")
    here, after, before = F.struct("x", "y"), F.lead(F.struct("x", "y")).over(w), F.lag(F.struct("x", "y")).over(w)
    lines = knots.select(group, "x", here.alias("_here"), after.alias("_after"), before.alias("_before"))
    line = F.when(F.col("_after").isNotNull(), F.struct(F.col("_here").alias("a"), F.col("_after").alias("b"))).otherwise(F.struct(F.col("_before").alias("a"), F.col("_here").alias("b")))
    lines = lines.select(group, "x", line.alias("_line"), F.lit(0).alias("_side"))
    both = points.withColumn("_side", F.lit(1)).unionByName(lines, allowMissingColumns=True)
    sorted_ = Window.partitionBy(group).orderBy("x", "_side")
    last = F.last("_line", ignorenulls=True).over(sorted_.rowsBetween(Window.unboundedPreceding, 0))
    # before the first knot its line is drawn on; a row a group, as a frame to the group's end would be read again for each row
    first = lines.groupBy(group).agg(F.min_by("_line", "x").alias("_first"))
    found = both.withColumn("_on", last).where("_side = 1").join(first, group, "left").withColumn("_on", F.coalesce("_on", "_first"))
    a, b = F.col("_on.a"), F.col("_on.b")
    slope = (b["y"] - a["y"]) / (b["x"] - a["x"])
    return found.withColumn("y", a["y"] + slope * (F.col("x") - a["x"])).drop("_on", "_first", "_line", "_side")


def season_start(day: Column | str, month: int = 10) -> Column:
    """The year in which the season of a day began; seasons start in ``month``."""
    day = F.col(day) if isinstance(day, str) else day
    return F.year(day) - F.when(F.month(day) >= month, 0).otherwise(1)
