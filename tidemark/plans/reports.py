"""Roll-ups, pulses, episode summaries and advisories over the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import quantiles
from tidemark.operators import series as s
from tidemark.plans.series import _F, _G, _flagged, _gapless
from tidemark.plans.series import ORACLES as _SERIES
from tidemark.tables import load, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def five_minute_pulse(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    return load(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT CAST(ts + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS people, count(*) FILTER (event_type = 'error') AS errors,
round(sum(value), 4) AS total, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY 1""")
def daily_rollup(spark, sf_dir):
    day = F.to_date(F.col("ts") + F.expr("INTERVAL 7 HOURS")).alias("day")
    return load(spark, sf_dir, "events").groupBy(day).agg(
        F.count("*").alias("views"), F.countDistinct("user_id").alias("people"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.round(F.sum("value"), 4).alias("total"), F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"),
    )


_FALLS = _SERIES["stay_below"]
_SPELLS = f"""{_F(30.0)}, t AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY entity ORDER BY hour) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM f WHERE flag),
n AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY hour) AS spell FROM t),
ep AS (SELECT entity, min(hour) AS start, max(hour) AS stop, count(*) AS n_rows, (epoch(max(hour)) - epoch(min(hour))) / 3600 + 1 AS hours FROM n GROUP BY entity, spell)"""


@query(f"""WITH {_SPELLS} SELECT entity, count(*) AS episodes, count(*) FILTER (hours < 2) AS too_short,
CASE WHEN count(*) FILTER (hours >= 2) >= 5 THEN round(quantile_cont(hours, 0.25) FILTER (hours >= 2), 6) END AS p25,
CASE WHEN count(*) FILTER (hours >= 2) >= 5 THEN round(quantile_cont(hours, 0.5) FILTER (hours >= 2), 6) END AS p50,
CASE WHEN count(*) FILTER (hours >= 2) >= 5 THEN round(quantile_cont(hours, 0.75) FILTER (hours >= 2), 6) END AS p75 FROM ep GROUP BY 1""")
def episode_summary(spark, sf_dir):
    """Durations of merged spells; quartiles are withheld under five episodes of two hours or more."""
    found = s.spells(_flagged(spark, sf_dir), 3)
    hours = (F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / 3600 + 1
    found = found.withColumn("hours", hours)
    summed = found.groupBy("entity").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("hours") < 2).alias("too_short"),
        F.expr("percentile(hours, array(0.25D, 0.5D, 0.75D)) FILTER (WHERE hours >= 2)").alias("p"),
    )
    enough = F.col("episodes") - F.col("too_short") >= 5
    return summed.select("entity", "episodes", "too_short", *[F.when(enough, F.round(F.col("p")[i], 6)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


@query(f"""WITH {_G}, a AS (SELECT *, CASE WHEN count(value) OVER w = 6 THEN sum(value) OVER w END AS six FROM g WINDOW w AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT entity, min(hour) FILTER (value >= 120) AS first_hour, min(hour) FILTER (six >= 250) AS first_window,
CASE WHEN min(hour) FILTER (value >= 120) <= min(hour) FILTER (six >= 250) THEN 'hour' WHEN min(hour) FILTER (six >= 250) IS NOT NULL THEN 'window' WHEN min(hour) FILTER (value >= 120) IS NOT NULL THEN 'hour' ELSE 'none' END AS kind FROM a GROUP BY 1""")
def advisories(spark, sf_dir):
    """The first hour over one limit or the first whole six hours over another, whichever comes first."""
    a = s.forward_sum(_gapless(spark, sf_dir), 6)
    found = a.groupBy("entity").agg(F.expr("min(hour) FILTER (WHERE value >= 120)").alias("first_hour"), F.expr("min(hour) FILTER (WHERE ahead >= 250)").alias("first_window"))
    kind = F.when(F.col("first_hour") <= F.col("first_window"), "hour").when(F.col("first_window").isNotNull(), "window").when(F.col("first_hour").isNotNull(), "hour").otherwise("none")
    return found.withColumn("kind", kind)


@query("""WITH l AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9 AS h FROM events)
SELECT count(*) FILTER (h IS NULL) AS firsts, round(quantile_cont(h, 0.25), 5) AS p25, round(quantile_cont(h, 0.5), 5) AS p50, round(quantile_cont(h, 0.75), 5) AS p75 FROM l""")
def return_quartiles(spark, sf_dir):
    """Quartiles of the hours between visits, and how many visits had none before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    h = load(spark, sf_dir, "events").select(((micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 3.6e9).alias("h"))
    q = quantiles.percentiles(h, [], "h", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    firsts = h.agg(F.count_if(F.col("h").isNull()).alias("firsts"))
    return firsts.join(F.broadcast(q), F.lit(True), "left").select("firsts", *[F.round(n, 5).alias(n) for n in ("p25", "p50", "p75")])


@query("""WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT l_suppkey, rank() OVER (ORDER BY v DESC) AS place, ntile(3) OVER (ORDER BY v, l_suppkey) AS third FROM m""")
def supplier_ranks(spark, sf_dir):
    """Rank and third of each supplier among all."""
    m = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(quantiles.exact_mean("l_extendedprice").alias("v")).withColumn("down", -F.col("v"))
    m = written(m, "means")
    up = quantiles.placed(m, "v", "l_suppkey").select("l_suppkey", quantiles.tile(F.col("place"), F.col("n_rows"), 3).cast("long").alias("third"))
    return quantiles.placed(m, "down").select("l_suppkey", F.col("rank").alias("place")).join(up, "l_suppkey")


@query(f"""WITH x AS ({_FALLS}), h AS (SELECT *, CASE WHEN NOT censored THEN (epoch(below) - epoch(peak_at)) / 3600 END AS hours FROM x)
SELECT entity, count(*) AS episodes, count(*) FILTER (dropped = 'starts_in_gap') AS starts_in_gap, count(*) FILTER (dropped = 'gap_at_peak') AS gap_at_peak, count(*) FILTER (censored) AS censored,
CASE WHEN count(hours) >= 3 THEN round(quantile_cont(hours, 0.25), 6) END AS p25, CASE WHEN count(hours) >= 3 THEN round(quantile_cont(hours, 0.5), 6) END AS p50, CASE WHEN count(hours) >= 3 THEN round(quantile_cont(hours, 0.75), 6) END AS p75 FROM h GROUP BY 1""")
def recession_summary(spark, sf_dir):
    """Hours from the peak until a series fell, over the episodes that are not censored; the dropped ones by reason."""
    x = s.recessions(_gapless(spark, sf_dir), 30.0, 6)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    h = x.withColumn("hours", F.when(~F.col("censored"), (seconds("below") - seconds("peak_at")) / 3600))
    summed = h.groupBy("entity").agg(
        F.count("*").alias("episodes"), *[F.count_if(F.col("dropped") == d).alias(d) for d in ("starts_in_gap", "gap_at_peak")], F.count_if("censored").alias("censored"),
        F.count("hours").alias("n"), F.expr("percentile(hours, array(0.25D, 0.5D, 0.75D))").alias("p"),
    )
    part = lambda i, name: F.when(F.col("n") >= 3, F.round(F.col("p")[i], 6)).alias(name)
    return summed.select("entity", "episodes", "starts_in_gap", "gap_at_peak", "censored", *[part(i, n) for i, n in enumerate(("p25", "p50", "p75"))])


@query(f"""WITH {_G}, st AS (SELECT entity, min(hour) AS start FROM g WHERE value >= 90 GROUP BY 1), d AS (SELECT st.entity, start, min(hour) FILTER (value < 15) AS dry FROM st LEFT JOIN g ON g.entity = st.entity AND g.hour > start GROUP BY 1, 2),
w AS (SELECT d.entity, start, dry, round(max(value), 6) AS gust, count(value) AS hours, round(sum(value), 6) AS total FROM d JOIN g ON g.entity = d.entity AND g.hour >= start AND (dry IS NULL OR g.hour < dry) GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (ORDER BY gust >= 150 DESC, total DESC, entity) AS priority FROM w""")
def advisory_spells(spark, sf_dir):
    """From each series' first hour over a limit until it is dry again: gust, hours, total, and in which order advisories go out."""
    g = _gapless(spark, sf_dir)
    starts = g.where("value >= 90").groupBy("entity").agg(F.min("hour").alias("start"))
    rows = g.join(starts, "entity").where("hour >= start")
    dry = rows.where("hour > start AND value < 15").groupBy("entity").agg(F.min("hour").alias("dry"))
    wet = rows.join(dry, "entity", "left").where("dry IS NULL OR hour < dry")
    w = wet.groupBy("entity", "start", "dry").agg(F.round(F.max("value"), 6).alias("gust"), F.count("value").alias("hours"), F.round(F.sum("value"), 6).alias("total"))
    return w.withColumn("priority", F.row_number().over(Window.orderBy(F.desc(F.col("gust") >= 150), F.desc("total"), "entity")))  # a row a series
