"""Season states, sea gates, dam grades, notices and forecasts: answers put together from the operators.

The event log stands for gauges (entity is the event type), line items for dams (ten of them, by supplier) and orders for
model forecasts (model is the priority, points are customers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import daily
from tidemark.operators import relational as r
from tidemark.operators import series as s
from tidemark.plans.registry import registry
from tidemark.plans.series import _gapless
from tidemark.tables import load

query, QUERIES, ORACLES = registry()

_DAILY = "d AS (SELECT event_type AS entity, CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, min(value) AS floor, sum(value) AS fall, max(ts) AS last_ts FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


def _daily(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.groupBy(F.col("event_type").alias("entity"), daily.local_day("ts").alias("day")).agg(F.min("value").alias("floor"), F.sum("value").alias("fall"), F.max("ts").alias("last_ts"))


def season_state(days: DataFrame, now: DataFrame, rose_min: int = 4, stale_hours: int = 36) -> DataFrame:
    """One row an entity: floor, rising days, sums of whole days, bands against the own record, grade, reasons and what is blind.

    ``days`` is (entity, day, floor, fall, last_ts), ``now`` one row (now, today). Today still runs and counts nowhere. A gap
    is no judgement: floors need the eight days before today, sums each of their days.
    """
    dated = days.join(F.broadcast(now), F.lit(True)).withColumn("back", F.datediff("today", "day")).where("back >= 1")
    season = F.make_date(s.season_start("today"), F.lit(10), F.lit(1))
    whole = lambda n: F.when(F.count_if(F.col("back") <= n) == n, F.sum(F.when(F.col("back") <= n, F.col("fall"))))
    eight = F.sort_array(F.collect_list(F.when(F.col("back") <= 8, F.struct("day", "floor"))))
    summed = dated.groupBy("entity", "now").agg(
        eight.alias("eight"), F.max("last_ts").alias("last_ts"), whole(15).alias("sum_15"), whole(30).alias("sum_30"),
        F.sum(F.when(F.col("day") >= season, F.col("fall"))).alias("sum_season"),
    )
    # the entity's own record: thirds of its floors and of its sums of fifteen whole days
    number = F.datediff("day", F.lit("1970-01-01"))
    fifteen = Window.partitionBy("entity").orderBy(number).rangeBetween(-14, 0)
    record = dated.withColumn("f15", F.when(F.count("*").over(fifteen) == 15, F.sum("fall").over(fifteen)))
    thirds = record.groupBy("entity").agg(*[F.expr(f"percentile({c}, array(0.33D, 0.5D, 0.67D))").alias(p) for c, p in (("floor", "pf"), ("f15", "pr"))])
    both = summed.join(thirds, "entity", "left")
    full = F.size("eight") == 8
    rose = F.when(full, F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda n, i: n + (F.get("eight", i)["floor"] > F.get("eight", i - 1)["floor"]).cast("int")))
    out = both.select(
        "entity", rose.alias("rose_days"), F.when(full, F.get("eight", F.lit(7))["floor"]).alias("floor"),
        F.when(full, F.get("eight", F.lit(7))["floor"] - F.get("eight", F.lit(0))["floor"]).alias("change"),
        (~full | (F.col("last_ts") < F.col("now") - F.make_dt_interval(hours=F.lit(stale_hours)))).alias("stale"), "sum_15", "sum_30", "sum_season", "pf", "pr",
    )
    out = out.withColumn("floor_band", r.band(F.col("floor"), F.col("pf")[0], F.col("pf")[2])).withColumn("sum_band", r.band(F.col("sum_15"), F.col("pr")[0], F.col("pr")[2]))
    rising = F.coalesce(~F.col("stale") & (F.col("rose_days") >= rose_min), F.lit(False))
    wet = F.col("sum_band") == "high"
    reasons = F.array_compact(F.array(F.when(rising, F.lit("rising_week")), F.when(wet, F.lit("wet_fortnight"))))
    blind = F.array_compact(F.array(F.when(F.col("floor").isNull(), F.lit("gaugeDays")), F.when(F.col("sum_15").isNull(), F.lit("rainDays"))))
    grade = F.when(rising & wet, "rising_wet").when(wet, "wet").when(rising, "rising").otherwise("quiet")
    return out.select(
        "entity", "rose_days", "floor", "change", "stale", "sum_15", "sum_30", "sum_season", "floor_band", "sum_band", (F.col("floor") - F.col("pf")[1]).alias("vs_normal"),
        grade.alias("grade"), F.array_join(reasons, ",").alias("reasons"), F.array_join(blind, ",").alias("blind"),
    )


@query(f"""WITH {_DAILY}, n AS (SELECT max(ts) AS now, CAST(max(ts) + INTERVAL 7 HOUR AS DATE) AS today FROM events),
b AS (SELECT d.*, now, today, today - day AS back FROM d, n WHERE day < today),
f AS (SELECT *, CASE WHEN count(*) OVER w = 15 THEN sum(fall) OVER w END AS f15 FROM b WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND CURRENT ROW)),
l AS (SELECT *, CASE WHEN back <= 7 AND floor > lag(floor) OVER (PARTITION BY entity ORDER BY day) THEN 1 ELSE 0 END AS up FROM f),
g AS (SELECT entity, count(*) FILTER (back <= 8) = 8 AS whole, sum(up) AS rose, max(floor) FILTER (back = 1) AS f1, max(floor) FILTER (back = 8) AS f8, max(last_ts) AS last_ts, any_value(now) AS now,
  CASE WHEN count(*) FILTER (back <= 15) = 15 THEN sum(fall) FILTER (back <= 15) END AS s15, CASE WHEN count(*) FILTER (back <= 30) = 30 THEN sum(fall) FILTER (back <= 30) END AS s30,
  sum(fall) FILTER (day >= make_date(year(today) - (month(today) < 10)::INT, 10, 1)) AS ss, quantile_cont(floor, 0.33) AS a, quantile_cont(floor, 0.5) AS m, quantile_cont(floor, 0.67) AS z,
  quantile_cont(f15, 0.33) AS ra, quantile_cont(f15, 0.67) AS rz FROM l GROUP BY 1),
h AS (SELECT *, NOT whole OR last_ts < now - INTERVAL 36 HOUR AS stale, CASE WHEN s15 IS NULL OR ra IS NULL THEN 'unknown' WHEN s15 < ra THEN 'low' WHEN s15 > rz THEN 'high' ELSE 'middle' END AS band FROM g),
k AS (SELECT *, whole AND NOT stale AND rose >= 4 AS rising, band = 'high' AS wet FROM h)
SELECT entity, CASE WHEN whole THEN rose END AS rose_days, round(CASE WHEN whole THEN f1 END, 6) AS floor, round(CASE WHEN whole THEN f1 - f8 END, 6) AS change, stale, round(s15, 4) AS sum_15, round(s30, 4) AS sum_30,
  round(ss, 4) AS sum_season, CASE WHEN NOT whole THEN 'unknown' WHEN f1 < a THEN 'low' WHEN f1 > z THEN 'high' ELSE 'middle' END AS floor_band, band AS sum_band, round(CASE WHEN whole THEN f1 - m END, 6) AS vs_normal,
  CASE WHEN rising AND wet THEN 'rising_wet' WHEN wet THEN 'wet' WHEN rising THEN 'rising' ELSE 'quiet' END AS grade,
  concat_ws(',', CASE WHEN rising THEN 'rising_week' END, CASE WHEN wet THEN 'wet_fortnight' END) AS reasons, concat_ws(',', CASE WHEN NOT whole THEN 'gaugeDays' END, CASE WHEN s15 IS NULL THEN 'rainDays' END) AS blind FROM k""")
def season_states(spark, sf_dir):
    now = load(spark, sf_dir, "events").agg(F.max("ts").alias("now")).withColumn("today", daily.local_day("now"))
    found = season_state(_daily(spark, sf_dir), now)
    return found.withColumns({c: F.round(c, 6) for c in ("floor", "change", "vs_normal")} | {c: F.round(c, 4) for c in ("sum_15", "sum_30", "sum_season")})


def sea_gate(lows: DataFrame) -> DataFrame:
    """One row an entity: shut where its lowest water stays over its own 90th percentile for two days in a row, narrowing for one or where it
    never falls under the median, else open. ``lows`` is (entity, day, low), whole days only."""
    thirds = lows.groupBy("entity").agg(F.expr("percentile(low, array(0.5D, 0.9D))").alias("p"))
    flagged = lows.join(thirds, "entity").withColumn("hour", F.col("day")).withColumn("flag", F.col("low") >= F.col("p")[1])
    every = flagged.withColumn("_i", F.row_number().over(s.ordered()))
    true = every.where("flag").withColumn("_k", F.col("_i") - F.row_number().over(s.ordered()))
    runs = true.groupBy("entity", "_k").agg(F.count("*").alias("n"), F.min("day").alias("from_day"))
    best = runs.groupBy("entity").agg(F.max(F.struct("n", (-F.datediff("from_day", F.lit("1970-01-01"))).alias("early"), "from_day")).alias("b"))
    summary = flagged.groupBy("entity").agg(F.bool_and(F.col("low") >= F.col("p")[0]).alias("over_median"), F.count("*").alias("days"))
    state = F.when(F.col("b.n") >= 2, "shut").when(F.col("b.n").isNotNull() | F.col("over_median"), "narrowing").otherwise("open")
    return summary.join(best, "entity", "left").select("entity", "days", state.alias("state"), F.col("b.from_day").alias("shut_from"), F.coalesce("b.n", F.lit(0)).alias("shut_days"))


@query("""WITH l AS (SELECT event_type AS entity, CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, min(value) AS low FROM events WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT date_trunc('hour', ts)) >= 3),
t AS (SELECT entity, quantile_cont(low, 0.5) AS p50, quantile_cont(low, 0.9) AS p90 FROM l GROUP BY 1), f AS (SELECT l.*, p50, low >= p90 AS shut, row_number() OVER (PARTITION BY l.entity ORDER BY day) AS rn FROM l JOIN t USING (entity)),
r AS (SELECT entity, min(day) AS from_day, count(*) AS len FROM (SELECT *, rn - row_number() OVER (PARTITION BY entity ORDER BY rn) AS grp FROM f WHERE shut) GROUP BY entity, grp),
b AS (SELECT DISTINCT ON (entity) entity, from_day, len FROM r ORDER BY entity, len DESC, from_day), s AS (SELECT entity, count(*) AS days, bool_and(low >= p50) AS over FROM f GROUP BY 1)
SELECT entity, days, CASE WHEN coalesce(len, 0) >= 2 THEN 'shut' WHEN coalesce(len, 0) > 0 OR over THEN 'narrowing' ELSE 'open' END AS state, from_day AS shut_from, coalesce(len, 0) AS shut_days FROM s LEFT JOIN b USING (entity)""")
def sea_gates(spark, sf_dir):
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL")
    days = rows.groupBy(F.col("event_type").alias("entity"), daily.local_day("ts").alias("day")).agg(F.min("value").alias("low"), F.countDistinct(F.date_trunc("hour", "ts")).alias("hours"))
    return sea_gate(days.where("hours >= 3").drop("hours"))


_READINGS = """rd AS (SELECT l_suppkey % 10 AS dam, l_shipdate AS ts, 24 AS window_h, sum(l_quantity) AS released, sum(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN l_quantity ELSE 0 END) AS spilled,
  sum(l_extendedprice) / 1000 AS inflow, max(l_extendedprice) / 100 AS storage FROM lineitem GROUP BY 1, 2)"""


def _readings(spark, sf_dir) -> DataFrame:
    spilled = F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), F.col("l_quantity")).otherwise(0.0))
    return load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("dam"), F.col("l_shipdate").alias("ts")).agg(
        F.lit(24).alias("window_h"), F.sum("l_quantity").alias("released"), spilled.alias("spilled"), (F.sum("l_extendedprice") / 1000).alias("inflow"), (F.max("l_extendedprice") / 100).alias("storage")
    )


def rate(volume: Column, hours: Column) -> Column:
    """Million cubic metres over some hours as cubic metres a second."""
    return F.when(hours > 0, volume * 1_000_000 / (hours * 3600))


def dam_grade(readings: DataFrame, turbine: float, inflow_high: float, rise_high: float, normal: float, near_full: float, full: float, held: int = 2, window: int = 6) -> DataFrame:
    """One row a dam: releasing, watchful or quiet, held for ``held`` readings, with the reasons and what awaits confirmation.

    ``readings`` is (dam, ts, window_h, released, spilled, inflow, storage) in volumes over window_h hours.
    """
    back = Window.partitionBy("dam").orderBy(F.col("ts").desc())
    recent = readings.withColumn("back", F.row_number().over(back)).where(F.col("back") <= held + window + 2)
    flow = F.coalesce(rate(F.col("released"), F.col("window_h")), F.lit(0.0)) + F.coalesce(rate(F.col("spilled"), F.col("window_h")), F.lit(0.0))
    up = Window.partitionBy("dam").orderBy("ts")
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    hours = F.greatest((seconds(F.col("ts")) - seconds(F.lag("ts", window).over(up))) / 3600, F.lit(1.0))
    risen = recent.withColumn("outflow", flow).withColumn("inflow_rate", rate(F.col("inflow"), F.col("window_h"))).withColumn("rise", (F.col("storage") - F.lag("storage", window).over(up)) / hours)
    some = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    is_full, is_near = (F.col("storage") >= full) & (some("rise") > 0), F.col("storage") >= near_full
    tested = risen.withColumn("releasing", (some("spilled") > 0) | (F.col("outflow") > turbine) | F.coalesce(is_full, F.lit(False)))
    tested = tested.withColumn("watchful", F.coalesce((F.col("storage") > normal) | is_near, F.lit(False)) | (some("inflow_rate") > inflow_high) | (some("rise") > rise_high))
    last = F.max(F.when(F.col("back") == 1, F.struct("ts", "storage", "outflow", "inflow_rate", "rise", "spilled", "releasing", "watchful"))).alias("l")
    grouped = tested.groupBy("dam").agg(
        last, F.expr(f"bool_and(releasing) FILTER (WHERE back <= {held})").alias("r"), F.expr(f"bool_and(watchful) FILTER (WHERE back <= {held})").alias("w"), F.count_if(F.col("back") <= held).alias("have")
    )
    out = grouped.select("dam", "l.*", "r", "w", "have")
    grade = F.when((F.col("have") >= held) & F.col("r"), "releasing").when((F.col("have") >= held) & F.col("w"), "watchful").otherwise("quiet")
    say = lambda c, word: F.when(c, F.lit(word))
    reasons = F.array_compact(F.array(
        say((some("spilled") > 0) & F.col("r"), "spilling"), say((F.col("outflow") > turbine) & F.col("r"), "above_turbines"), say(is_full & F.col("r"), "full_and_rising"),
        say((F.col("storage") > normal) & F.col("w"), "above_normal_high"), say(is_near & ~is_full & F.col("w"), "near_full"),
        say((some("inflow_rate") > inflow_high) & F.col("w"), "inflow_high"), say((some("rise") > rise_high) & F.col("w"), "rising_fast"),
    ))
    awaiting = F.array_compact(F.array(say(F.col("releasing") & ~F.col("r"), "release_unconfirmed"), say(F.col("watchful") & ~F.col("w"), "watch_unconfirmed")))
    return out.select("dam", "ts", "storage", "outflow", "inflow_rate", "rise", grade.alias("grade"), F.array_join(reasons, ",").alias("reasons"), F.array_join(awaiting, ",").alias("awaiting"))


@query(f"""WITH {_READINGS}, n AS (SELECT *, released * 1e6 / (window_h * 3600) + spilled * 1e6 / (window_h * 3600) AS outflow, inflow * 1e6 / (window_h * 3600) AS rate, row_number() OVER (PARTITION BY dam ORDER BY ts DESC) AS back FROM rd QUALIFY back <= 10),
i AS (SELECT *, (storage - lag(storage, 6) OVER w) / greatest((epoch(ts) - epoch(lag(ts, 6) OVER w)) / 3600, 1) AS rise FROM n WINDOW w AS (PARTITION BY dam ORDER BY ts)),
t AS (SELECT *, storage >= 900 AND coalesce(rise, 0) > 0 AS full_up FROM i), u AS (SELECT *, spilled > 0 OR outflow > 1500 OR full_up AS rel, storage > 500 OR rate > 4000 OR coalesce(rise, 0) > 3 OR storage >= 700 AS wat FROM t),
g AS (SELECT dam, bool_and(rel) FILTER (back <= 2) AS r, bool_and(wat) FILTER (back <= 2) AS w, count(*) FILTER (back <= 2) AS have FROM u GROUP BY 1)
SELECT dam, ts, round(storage, 4) AS storage, round(outflow, 4) AS outflow, round(rate, 4) AS inflow_rate, round(rise, 6) AS rise, CASE WHEN have >= 2 AND r THEN 'releasing' WHEN have >= 2 AND w THEN 'watchful' ELSE 'quiet' END AS grade,
concat_ws(',', CASE WHEN spilled > 0 AND r THEN 'spilling' END, CASE WHEN outflow > 1500 AND r THEN 'above_turbines' END, CASE WHEN full_up AND r THEN 'full_and_rising' END, CASE WHEN storage > 500 AND w THEN 'above_normal_high' END,
  CASE WHEN storage >= 700 AND NOT full_up AND w THEN 'near_full' END, CASE WHEN rate > 4000 AND w THEN 'inflow_high' END, CASE WHEN coalesce(rise, 0) > 3 AND w THEN 'rising_fast' END) AS reasons,
concat_ws(',', CASE WHEN rel AND NOT r THEN 'release_unconfirmed' END, CASE WHEN wat AND NOT w THEN 'watch_unconfirmed' END) AS awaiting FROM u JOIN g USING (dam) WHERE back = 1""")
def dam_grades(spark, sf_dir):
    found = dam_grade(_readings(spark, sf_dir), 1500.0, 4000.0, 3.0, 500.0, 700.0, 900.0)
    return found.withColumns({c: F.round(c, 4) for c in ("storage", "outflow", "inflow_rate")} | {"rise": F.round("rise", 6)})


@query("""WITH rd AS (SELECT l_suppkey % 10 AS dam, CAST(l_shipdate AS DATE) AS day, l_linenumber AS h, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS released, CASE WHEN l_returnflag = 'R' THEN l_discount END AS spilled,
  l_extendedprice AS storage, l_orderkey AS k, l_linenumber AS n FROM lineitem),
e AS (SELECT max(day) AS d FROM rd), sp AS (SELECT dam, unnest(generate_series(d - INTERVAL 400 DAY, d, INTERVAL 1 DAY))::DATE AS day FROM e, (SELECT DISTINCT dam FROM rd)),
p AS (SELECT dam, day, coalesce(sum(h) FILTER (released IS NOT NULL OR spilled IS NOT NULL), 0) AS hours, sum(released) AS released, sum(spilled) AS spilled, sum(coalesce(released, 0) + coalesce(spilled, 0)) AS outflow,
  arg_max(storage, (k, n)) AS last FROM rd GROUP BY 1, 2)
SELECT dam, day, coalesce(hours, 0)::BIGINT AS hours, round(CASE WHEN hours > 0 THEN released * 1e6 / (hours * 3600) END, 4) AS released_mean, round(CASE WHEN hours > 0 THEN spilled * 1e6 / (hours * 3600) END, 4) AS spilled_mean,
  round(CASE WHEN hours > 0 THEN outflow * 1e6 / (hours * 3600) END, 4) AS outflow_mean, round(outflow, 4) AS outflow, round(last, 4) AS storage_end FROM sp LEFT JOIN p USING (dam, day)""")
def dam_days(spark, sf_dir):
    """Day bars of the last 400 days: means over the hours that the day's rows span, days without rows too."""
    rows = load(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("dam"), F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("h"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("released"),
        F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("spilled"), F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_extendedprice").alias("storage"),
    )
    known = F.col("released").isNotNull() | F.col("spilled").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    days = rows.groupBy("dam", "day").agg(
        F.sum(F.when(known, F.col("h")).otherwise(0)).alias("hours"), F.sum("released").alias("released"), F.sum("spilled").alias("spilled"), F.sum(zero("released") + zero("spilled")).alias("outflow"),
        F.max_by("storage", "at").alias("storage_end"),
    )
    end = rows.agg(F.max("day").alias("d"))
    spine = rows.select("dam").distinct().join(F.broadcast(end), F.lit(True)).select("dam", F.explode(F.sequence(F.date_sub("d", 400), "d")).alias("day"))
    mean = lambda c: F.round(rate(F.col(c), F.col("hours")), 4)
    found = spine.join(days, ["dam", "day"], "left")
    return found.select(
        "dam", "day", F.coalesce("hours", F.lit(0)).alias("hours"), *[mean(c).alias(f"{c}_mean") for c in ("released", "spilled", "outflow")],
        F.round("outflow", 4).alias("outflow"), F.round("storage_end", 4).alias("storage_end"),
    )


def notices(grades: DataFrame, top: str, quiet: str) -> DataFrame:
    """(entity, day, grade, open): a notice opens on the top grade and closes on quiet only; grades between change nothing."""
    upto = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("grade").isin(top, quiet), F.col("grade")), ignorenulls=True).over(upto)
    return grades.withColumn("open", F.coalesce(last == top, F.lit(False)))


@query(f"""WITH {_DAILY}, g AS (SELECT entity, day, CASE WHEN fall >= 1500 THEN 'high' WHEN fall < 900 THEN 'quiet' ELSE 'between' END AS grade FROM d)
SELECT entity, day, grade, coalesce(last_value(CASE WHEN grade <> 'between' THEN grade END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY day ROWS UNBOUNDED PRECEDING) = 'high', false) AS open FROM g""")
def notices_open(spark, sf_dir):
    grade = F.when(F.col("fall") >= 1500, "high").when(F.col("fall") < 900, "quiet").otherwise("between")
    return notices(_daily(spark, sf_dir).select("entity", "day", grade.alias("grade")), "high", "quiet")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE value IS NOT NULL QUALIFY back <= 5),
s AS (SELECT user_id, value, ts, abs(value - lead(value) OVER w) / greatest((epoch_us(ts) - epoch_us(lead(ts) OVER w)) / 3.6e9, 1) AS step FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, round(max(step), 6) AS steepest, coalesce(max(step) > 20, true) AS suspect FROM s GROUP BY 1""")
def spike_suspects(spark, sf_dir):
    """Of the last five readings of each series the steepest step an hour; without two readings a series is suspect, too."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = load(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("back", F.row_number().over(w)).where("back <= 5")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = F.greatest((micros(F.col("ts")) - micros(F.lead("ts").over(w))) / 3.6e9, F.lit(1.0))
    steps = last.select("user_id", (F.abs(F.col("value") - F.lead("value").over(w)) / hours).alias("step"))
    return steps.groupBy("user_id").agg(F.round(F.max("step"), 6).alias("steepest"), F.coalesce(F.max("step") > 20, F.lit(True)).alias("suspect"))


_FOLD = """p AS (SELECT o_orderpriority AS model, o_orderdate AS t, o_custkey % 7 AS point, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), m AS (SELECT model, t, avg(v) AS v FROM p GROUP BY 1, 2)"""


@query(f"WITH {_FOLD} SELECT t, round(max(v) FILTER (model = '1-URGENT'), 4) AS first_model, round(max(v), 4) AS highest, count(*) AS models FROM m GROUP BY 1")
def forecast_fold(spark, sf_dir):
    """Per time the mean over points of the first model, and the highest such mean of all models."""
    points = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("t"), (F.col("o_custkey") % 7).alias("point")).agg(F.avg("o_totalprice").alias("v"))
    means = points.groupBy("model", "t").agg(F.avg("v").alias("v"))
    return means.groupBy("t").agg(F.round(F.max(F.when(F.col("model") == "1-URGENT", F.col("v"))), 4).alias("first_model"), F.round(F.max("v"), 4).alias("highest"), F.count("*").alias("models"))


@query("""WITH n AS (SELECT max(ts) - INTERVAL 48 HOUR AS now FROM events), f AS (SELECT user_id % 20 AS place, ts, value, event_type FROM events, n WHERE ts > now AND ts <= now + INTERVAL 24 HOUR)
SELECT place, round(sum(value), 4) AS total, arg_max(event_type, (value, event_type)) AS worst, round(max(value), 4) AS peak, count(*) FILTER (event_type = 'error') > 0 AS thunder,
CASE WHEN max(value) >= 120 THEN 'danger' WHEN max(value) >= 60 OR count(*) FILTER (event_type = 'error') > 2 THEN 'care' ELSE 'calm' END AS grade FROM f GROUP BY 1""")
def next_day_outlook(spark, sf_dir):
    """Of the 24 hours after a moment, by place: total, worst group, peak and the worst grade of its signs."""
    events = load(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("INTERVAL 48 HOURS")).alias("now"))
    rows = events.join(F.broadcast(now), F.lit(True)).where("ts > now AND ts <= now + INTERVAL 24 HOURS")
    errors = F.count_if(F.col("event_type") == "error")
    grade = F.when(F.max("value") >= 120, "danger").when((F.max("value") >= 60) | (errors > 2), "care").otherwise("calm")
    return rows.groupBy((F.col("user_id") % 20).alias("place")).agg(
        F.round(F.sum("value"), 4).alias("total"), F.max_by("event_type", F.struct("value", "event_type")).alias("worst"), F.round(F.max("value"), 4).alias("peak"), (errors > 0).alias("thunder"), grade.alias("grade")
    )


@query(f"""WITH {_DAILY}, t AS (SELECT max(day) AS today FROM d), w AS (SELECT entity, avg(fall) FILTER (today - day BETWEEN 1 AND 7) AS this, avg(fall) FILTER (today - day BETWEEN 8 AND 14) AS before, max(last_ts) AS newest FROM d, t GROUP BY 1)
SELECT count(*) AS gauges, count(*) FILTER (this > before) AS rising, count(*) FILTER (this < before) AS falling, count(*) FILTER (this >= 1200) AS high, max(newest) AS newest FROM w""")
def gauge_tally(spark, sf_dir):
    """How many gauges rise, fall and stand high, this week against the last, and the newest reading: one row."""
    days = _daily(spark, sf_dir)
    today = days.agg(F.max("day").alias("today"))
    back = F.datediff("today", "day")
    weeks = days.join(F.broadcast(today), F.lit(True)).groupBy("entity").agg(F.avg(F.when(back.between(1, 7), F.col("fall"))).alias("this"), F.avg(F.when(back.between(8, 14), F.col("fall"))).alias("before"), F.max("last_ts").alias("newest"))
    return weeks.agg(
        F.count("*").alias("gauges"), F.count_if(F.col("this") > F.col("before")).alias("rising"), F.count_if(F.col("this") < F.col("before")).alias("falling"), F.count_if(F.col("this") >= 1200).alias("high"), F.max("newest").alias("newest")
    )


@query("""WITH h AS (SELECT event_type AS entity, date_trunc('hour', ts) AS hour, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT entity, count(*) AS hours, round(avg((value >= 30)::INT), 6) AS over_level, round(avg((value >= 60)::INT), 6) AS over_high, round(sum(greatest(value - 30, 0)) / count(DISTINCT CAST(hour AS DATE)), 4) AS spill_a_day FROM h GROUP BY 1""")
def rule_evidence(spark, sf_dir):
    """Share of hours in which each rule would hold, and what spills over the first a day."""
    h = s.hourly(load(spark, sf_dir, "events"), "event_type", "ts", "value")
    share = lambda limit: F.round(F.avg((F.col("value") >= limit).cast("int")), 6)
    return h.groupBy("entity").agg(
        F.count("*").alias("hours"), share(30).alias("over_level"), share(60).alias("over_high"), F.round(F.sum(F.greatest(F.col("value") - 30, F.lit(0.0))) / F.countDistinct(F.to_date("hour")), 4).alias("spill_a_day")
    )


@query()
def hourly_gaps(spark, sf_dir):
    """How many hours of each series are missing."""
    return _gapless(spark, sf_dir).groupBy("entity").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("hours"))


ORACLES["hourly_gaps"] = """WITH h AS (SELECT event_type AS entity, date_trunc('hour', ts) AS hour FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT entity, (epoch(max(hour)) - epoch(min(hour)))::BIGINT // 3600 + 1 AS hours, (epoch(max(hour)) - epoch(min(hour)))::BIGINT // 3600 + 1 - count(*) AS missing FROM h GROUP BY 1"""
