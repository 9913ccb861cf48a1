"""Queries over the event log as hourly series: entity is the event type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import series as s
from tidemark.tables import load


def _hourly(spark, sf_dir):
    return s.hourly(load(spark, sf_dir, "events"), "event_type", "ts", "value")


def _gapless(spark, sf_dir):
    return s.spine(_hourly(spark, sf_dir))


def _flagged(spark, sf_dir, limit: float = 30.0):
    return _gapless(spark, sf_dir).withColumn("flag", F.coalesce(F.col("value") >= limit, F.lit(False)))


def _rounded(df, *columns, places: int = 7):
    return df.withColumns({c: F.round(c, places) for c in columns})


def hourly_spine(spark, sf_dir):
    return _rounded(_gapless(spark, sf_dir), "value")


def rise_3h(spark, sf_dir):
    return _rounded(s.rise(_gapless(spark, sf_dir), 3), "value", "rise", "rate")


def rolling_24h(spark, sf_dir):
    return _rounded(s.rolling_sum(_gapless(spark, sf_dir), 24), "total").select("entity", "hour", "known", "total")


def forward_6h(spark, sf_dir):
    return _rounded(s.forward_sum(_gapless(spark, sf_dir), 6), "ahead").select("entity", "hour", "ahead")


def tidal_split(spark, sf_dir):
    return _rounded(s.tidal_split(_gapless(spark, sf_dir)), "slow", "fast").select("entity", "hour", "slow", "fast")


def godin_filter(spark, sf_dir):
    filled = s.bridged(_gapless(spark, sf_dir), 6).select("entity", "hour", F.col("bridged").alias("value"))
    return _rounded(s.godin(filled), "residual").select("entity", "hour", "residual")


def short_gaps(spark, sf_dir):
    return _rounded(s.bridged(_gapless(spark, sf_dir), 3), "bridged").select("entity", "hour", "bridged")


def confirmed_3(spark, sf_dir):
    return s.confirmed(_flagged(spark, sf_dir, 15.0), 3).select("entity", "hour", "flag", "confirmed")


def merged_spells(spark, sf_dir):
    return _rounded(s.spells(_flagged(spark, sf_dir), 4, 2), "peak")


def spell_counts(spark, sf_dir):
    return s.rising_edges(_flagged(spark, sf_dir))


def longest_runs(spark, sf_dir):
    return s.longest_run(_flagged(spark, sf_dir, 15.0))


def best_six_hours(spark, sf_dir):
    return _rounded(s.best_window(_gapless(spark, sf_dir), 6), "total")


def deaccumulate(spark, sf_dir):
    return _rounded(s.deaccumulated(_gapless(spark, sf_dir), reach=60.0), "value", "increment")


def record_coverage(spark, sf_dir):
    return s.coverage(_hourly(spark, sf_dir))


def stay_below(spark, sf_dir):
    """Of each spell over the limit, when the series fell below it for six whole hours, or until when that is not known."""
    return _rounded(s.recessions(_gapless(spark, sf_dir), 30.0, 6), "peak")


def last_readings(spark, sf_dir):
    """The five latest readings of each series with change and rate to the reading before."""
    back = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lead("ts").over(back).cast("timestamp"))) / 1e6
    # each task keeps six rows a series before the shuffle
    rows = load(spark, sf_dir, "events").withColumn("back", F.row_number().over(back)).where("back <= 6")
    rows = rows.withColumn("change", F.col("value") - F.lead("value").over(back))
    rows = rows.withColumn("per_hour", F.when(seconds > 0, F.col("change") / seconds * 3600)).where("back <= 5")
    return _rounded(rows.select("event_type", "back", "event_id", "change", "per_hour"), "change", "per_hour", places=3)


def never_rising_profile(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    return _rounded(s.never_rising(rows, "entity", "hour", "value"), "fitted")


def cases_by_hour(spark, sf_dir):
    """Errors of each of the last 48 hours of the log, zero where there were none."""
    events = load(spark, sf_dir, "events")
    end = events.agg(F.date_trunc("hour", F.max("ts")).alias("b"))
    hours = end.select(F.explode(F.sequence(F.expr("b - INTERVAL 47 HOURS"), "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    counted = events.where("event_type = 'error'").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n_cases"))


_H = "h AS (SELECT event_type AS entity, date_trunc('hour', ts) AS hour, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL)"
_G = f"""{_H}, e AS (SELECT entity, min(hour) a, max(hour) b FROM h GROUP BY 1),
sp AS (SELECT entity, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM e),
g AS (SELECT sp.entity, sp.hour, h.value FROM sp LEFT JOIN h USING (entity, hour))"""
_F = lambda limit: f"{_G}, f AS (SELECT *, coalesce(value >= {limit}, false) AS flag FROM g)"
_W = "(PARTITION BY entity ORDER BY hour"
_mean = lambda col, n, share: (
    f"CASE WHEN count({col}) OVER {_W} ROWS BETWEEN {n // 2} PRECEDING AND {n - 1 - n // 2} FOLLOWING) >= {share * n} "
    f"THEN avg({col}) OVER {_W} ROWS BETWEEN {n // 2} PRECEDING AND {n - 1 - n // 2} FOLLOWING) END"
)
_bridge = lambda longest: f"""{_G}, i AS (SELECT *, row_number() OVER {_W}) AS i FROM g),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER {_W} ROWS UNBOUNDED PRECEDING) bi,
  last_value(value IGNORE NULLS) OVER {_W} ROWS UNBOUNDED PRECEDING) bv,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ai,
  first_value(value IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) av FROM i),
br AS (SELECT entity, hour, coalesce(value, CASE WHEN ai - bi - 1 <= {longest} THEN bv + (av - bv) * (i - bi) / (ai - bi) END) AS bridged FROM b)"""  # noqa: E731

QUERIES = {
    f.__name__: f
    for f in (
        hourly_spine, rise_3h, rolling_24h, forward_6h, tidal_split, godin_filter, short_gaps, confirmed_3, merged_spells, spell_counts,
        longest_runs, best_six_hours, deaccumulate, record_coverage, stay_below, last_readings, never_rising_profile, cases_by_hour,
    )
}
ORACLES = {
    "hourly_spine": f"WITH {_G} SELECT entity, hour, round(value, 7) AS value FROM g",
    "rise_3h": f"""WITH {_G}, r AS (SELECT *, value - lag(value, 3) OVER {_W}) AS rise FROM g)
SELECT entity, hour, round(value, 7) AS value, round(rise, 7) AS rise, round(rise / 3, 7) AS rate FROM r""",
    "rolling_24h": f"""WITH {_G}, r AS (SELECT *, count(value) OVER w AS known, sum(value) OVER w AS t FROM g
WINDOW w AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT entity, hour, known, CASE WHEN known >= 21.6 THEN round(t, 7) END AS total FROM r""",
    "forward_6h": f"""WITH {_G} SELECT entity, hour, CASE WHEN count(value) OVER w = 6 THEN round(sum(value) OVER w, 7) END AS ahead FROM g
WINDOW w AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""",
    "tidal_split": f"WITH {_G}, r AS (SELECT *, {_mean('value', 25, 0.8)} AS slow FROM g) SELECT entity, hour, round(slow, 7) AS slow, round(value - slow, 7) AS fast FROM r",
    "godin_filter": f"""WITH {_bridge(6)}, o AS (SELECT *, {_mean('bridged', 24, 1.0)} AS one FROM br), t AS (SELECT *, {_mean('one', 24, 1.0)} AS two FROM o),
l AS (SELECT *, {_mean('two', 25, 1.0)} AS residual FROM t) SELECT entity, hour, round(residual, 7) AS residual FROM l""",
    "short_gaps": f"WITH {_bridge(3)} SELECT entity, hour, round(bridged, 7) AS bridged FROM br",
    "confirmed_3": f"""WITH {_F(15.0)} SELECT entity, hour, flag, bool_and(flag) OVER w AND count(*) OVER w = 3 AS confirmed FROM f
WINDOW w AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "merged_spells": f"""WITH {_F(30.0)}, t AS (SELECT *, CASE WHEN hour - lag(hour) OVER {_W}) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM f WHERE flag),
n AS (SELECT *, sum(new) OVER {_W}) AS spell FROM t)
SELECT entity, min(hour) AS start, max(hour) AS "end", count(*) AS n_rows, round(max(value), 7) AS peak FROM n GROUP BY entity, spell HAVING count(*) >= 2""",
    "spell_counts": f"""WITH {_F(30.0)}, edges AS (SELECT *, flag AND NOT coalesce(lag(flag) OVER {_W}), false) AS edge FROM f)
SELECT entity, count(*) FILTER (edge) AS n_spells FROM edges GROUP BY entity""",
    "longest_runs": f"""WITH {_F(15.0)}, i AS (SELECT *, row_number() OVER {_W}) AS i FROM f),
k AS (SELECT entity, i - row_number() OVER {_W}) AS k FROM i WHERE flag), n AS (SELECT entity, count(*) AS n FROM k GROUP BY entity, k)
SELECT entity, max(n) AS longest FROM n GROUP BY entity""",
    "best_six_hours": f"""WITH {_G}, a AS (SELECT entity, hour, CASE WHEN count(value) OVER w = 6 THEN sum(value) OVER w END AS ahead FROM g
WINDOW w AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ahead DESC, hour) AS r FROM a WHERE ahead IS NOT NULL)
SELECT entity, hour AS start, round(ahead, 7) AS total FROM r WHERE r = 1""",
    "deaccumulate": f"""WITH {_G}, b AS (SELECT *, CASE WHEN value < lag(value) OVER {_W}) OR lag(value) OVER {_W}) IS NULL THEN 1 ELSE 0 END AS brk FROM g WHERE value IS NOT NULL),
r AS (SELECT *, sum(brk) OVER {_W}) AS run FROM b),
n AS (SELECT *, count(*) OVER (PARTITION BY entity, run) AS n, max(value) OVER (PARTITION BY entity, run) AS top, value - lag(value) OVER (PARTITION BY entity, run ORDER BY hour) AS step FROM r)
SELECT entity, hour, round(value, 7) AS value, round(CASE WHEN n >= 3 AND top >= 60 THEN greatest(step, 0.0) ELSE value END, 7) AS increment FROM n""",
    "record_coverage": f"""WITH {_H}, s AS (SELECT *, epoch(hour) - epoch(lag(hour) OVER {_W})) AS step FROM h), m AS (SELECT entity, median(step) AS median_step FROM s GROUP BY 1)
SELECT entity, median_step, min(hour) AS first, max(hour) AS last, count(*) AS n_rows, count(*) FILTER (step > 3 * median_step) AS n_gaps
FROM s JOIN m USING (entity) GROUP BY ALL""",
    "stay_below": f"""WITH {_G}, i AS (SELECT *, row_number() OVER {_W}) AS i, coalesce(value >= 30.0, false) AS flag FROM g),
o AS (SELECT *, min(CASE WHEN value IS NULL OR flag THEN i END) OVER w AS off, count(*) OVER w AS n, lag(hour) OVER {_W}) AS before, lag(value) OVER {_W}) IS NULL AS opens,
  bool_or(value IS NULL) OVER {_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS gap, max(hour) OVER (PARTITION BY entity) AS last
  FROM i WINDOW w AS (PARTITION BY entity ORDER BY hour ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
v AS (SELECT o.*, x.value IS NULL AS off_missing FROM o LEFT JOIN i x ON x.entity = o.entity AND x.i = o.off),
d AS (SELECT *, CASE WHEN value IS NULL OR (NOT flag AND (off IS NULL OR off_missing)) THEN i END AS decisive, value IS NOT NULL AND NOT flag AND off IS NULL AND n = 6 AS fell FROM v),
f AS (SELECT *, min(decisive) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pos FROM d),
t AS (SELECT *, CASE WHEN hour - lag(hour) OVER {_W}) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM f WHERE flag), r AS (SELECT *, sum(new) OVER {_W}) AS spell FROM t),
ep AS (SELECT entity, min(hour) AS start, max(value) AS peak, arg_min(opens, hour) AS opens, arg_max(hour, (value, -i)) AS peak_at, arg_max(gap, (value, -i)) AS gap, arg_max(pos, (value, -i)) AS pos, any_value(last) AS last FROM r GROUP BY entity, spell),
c AS (SELECT ep.*, CASE WHEN ep.opens THEN 'starts_in_gap' WHEN ep.gap THEN 'gap_at_peak' END AS dropped, coalesce(y.fell, false) AS fell, y.hour, y.before FROM ep LEFT JOIN d y ON y.entity = ep.entity AND y.i = ep.pos)
SELECT entity, start, peak_at, round(peak, 7) AS peak, dropped, CASE WHEN dropped IS NULL AND fell THEN hour END AS below,
  CASE WHEN dropped IS NULL THEN CASE WHEN fell THEN hour WHEN pos IS NULL THEN last ELSE before END END AS known, CASE WHEN dropped IS NULL THEN NOT fell END AS censored FROM c""",
    "last_readings": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back,
  value - lag(value) OVER w AS change, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, back, event_id, round(change, 3) AS change, round(CASE WHEN s > 0 THEN change / s * 3600 END, 3) AS per_hour FROM l WHERE back <= 5""",
    "cases_by_hour": """WITH b AS (SELECT date_trunc('hour', max(ts)) AS b FROM events), h AS (SELECT unnest(generate_series(b - INTERVAL 47 HOUR, b, INTERVAL 1 HOUR)) AS hour FROM b),
c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT hour, coalesce(n, 0) AS n_cases FROM h LEFT JOIN c USING (hour)""",
}
# the fit that never rises is, at each place, the least over all starts before it of the largest mean up to an end behind it
ORACLES["never_rising_profile"] = f"""WITH {_H}, o AS (SELECT *, row_number() OVER {_W}) AS i, sum(value) OVER {_W} ROWS UNBOUNDED PRECEDING) AS s FROM h),
p AS (SELECT a.entity, a.i AS a, b.i AS b, (b.s - a.s + a.value) / (b.i - a.i + 1) AS m FROM o a JOIN o b ON a.entity = b.entity AND b.i >= a.i),
x AS (SELECT entity, b, max(m) OVER (PARTITION BY entity, a ORDER BY b DESC) AS top FROM p), y AS (SELECT entity, b, min(top) AS fitted FROM x GROUP BY 1, 2)
SELECT o.entity, hour, round(fitted, 7) AS fitted FROM y JOIN o ON o.entity = y.entity AND o.i = y.b"""
