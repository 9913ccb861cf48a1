"""Figures of the batch science: associations, trends, lags, limits, rasters, networks, sun and tide, over stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import sky
from tidemark.operators import graph, spatial
from tidemark.operators import series as s
from tidemark.plans.places import _A, _B, _KM, _customers, _grid, _pointers, _suppliers, in_three_triangles
from tidemark.plans.registry import registry
from tidemark.plans.series import _G, _gapless, _mean
from tidemark.tables import load

query, QUERIES, ORACLES = registry()


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1),
j AS (SELECT lag, x.a, y.b FROM (SELECT unnest(generate_series(0, 24)) AS lag), h x JOIN h y ON y.hour = x.hour + lag * INTERVAL 1 HOUR), c AS (SELECT lag, count(*) AS n, corr(a, b) AS r FROM j GROUP BY 1)
SELECT lag, n, round(r, 6) AS r FROM c ORDER BY r DESC, lag LIMIT 1""")
def best_lag(spark, sf_dir):
    """The whole-hour lag at which two series go together best: one row, the report itself."""
    events = load(spark, sf_dir, "events")
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    cause = hours.select("a", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("lag"), "hour").withColumn("at", F.col("hour") + F.make_dt_interval(hours=F.col("lag")))
    c = cause.join(hours.select(F.col("hour").alias("at"), "b"), "at").groupBy("lag").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    return c.agg(F.max_by(F.struct("lag", "n", "r"), F.struct("r", -F.col("lag"))).alias("x")).select("x.lag", "x.n", F.round("x.r", 6).alias("r"))


_MONTHS = "m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS i, count(*) AS a, avg(o_totalprice) AS b FROM orders GROUP BY 1)"


@query(f"""WITH {_MONTHS}, r AS (SELECT row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM m),
s AS (SELECT shift, corr(x.ra, y.rb) AS rho FROM (SELECT unnest(generate_series(0, 39)) AS shift), r x JOIN r y ON y.k = (x.k + shift) % x.n GROUP BY 1)
SELECT (SELECT count(*) FROM m) AS n, round(max(rho) FILTER (shift = 0), 6) AS spearman, round(count(*) FILTER (shift > 0 AND abs(rho) >= (SELECT abs(rho) FROM s WHERE shift = 0) - 1e-9) / count(*) FILTER (shift > 0), 6) AS p FROM s""")
def rank_association(spark, sf_dir):
    """Spearman's coefficient of two monthly figures, and the share of 39 turned orders that give as much."""
    orders = load(spark, sf_dir, "orders")
    m = orders.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("i")).agg(F.count("*").alias("a"), F.avg("o_totalprice").alias("b"))
    middle = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2  # noqa: E731  # a row a month
    r = m.select((F.row_number().over(Window.orderBy("i")) - 1).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"), middle("a").alias("ra"), middle("b").alias("rb"))
    turned = r.select("ra", "n", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("shift"), "k").withColumn("k", (F.col("k") + F.col("shift")) % F.col("n"))
    rho = turned.join(r.select("k", "rb"), "k").groupBy("shift").agg(F.corr("ra", "rb").alias("rho"), F.first("n").alias("n"))
    own = F.max(F.when(F.col("shift") == 0, F.col("rho"))).over(Window.partitionBy())
    return rho.withColumn("own", own).agg(
        F.first("n").alias("n"), F.round(F.first("own"), 6).alias("spearman"),
        F.round(F.try_divide(F.count_if((F.col("shift") > 0) & (F.abs("rho") >= F.abs("own") - 1e-9)), F.count_if(F.col("shift") > 0)), 6).alias("p"),
    )


@query("""WITH y AS (SELECT o_custkey % 5 AS area, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT a.area, count(*) AS pairs, round(quantile_cont((b.v - a.v) / (b.y - a.y), 0.5), 4) AS slope, round(sum(sign(b.v - a.v)) / count(*), 6) AS kendall FROM y a JOIN y b ON a.area = b.area AND a.y < b.y GROUP BY 1""")
def yearly_trends(spark, sf_dir):
    """Theil and Sen's slope and Kendall's coefficient over the pairs of an area's years (a few dozen years at most)."""
    y = load(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).alias("area"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    later = y.select("area", F.col("y").alias("y2"), F.col("v").alias("v2"))
    pairs = y.join(later, "area").where("y < y2")
    slope = (F.col("v2") - F.col("v")) / (F.col("y2") - F.col("y"))
    return pairs.groupBy("area").agg(F.count("*").alias("pairs"), F.round(F.median(slope), 4).alias("slope"), F.round(F.sum(F.signum(F.col("v2") - F.col("v"))) / F.count("*"), 6).alias("kendall"))


@query("""WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), o AS (SELECT a.y, a.m, a.v, quantile_cont(b.v, 1/3) AS low, quantile_cont(b.v, 2/3) AS high FROM m a JOIN m b ON a.m = b.m AND a.y <> b.y GROUP BY ALL)
SELECT y, m, CASE WHEN v < low THEN 1 WHEN v > high THEN 3 ELSE 2 END AS third FROM o""")
def thirds_among_others(spark, sf_dir):
    """The third that each month falls in among the same month of all other years."""
    m = load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    others = m.join(m.select(F.col("y").alias("other"), "m", F.col("v").alias("w")), "m").where("y <> other")
    cut = others.groupBy("y", "m", "v").agg(F.expr("percentile(w, array(1/3D, 2/3D))").alias("p"))
    return cut.select("y", "m", F.when(F.col("v") < F.col("p")[0], 1).when(F.col("v") > F.col("p")[1], 3).otherwise(2).alias("third"))


@query("""WITH k AS (SELECT s_suppkey % 3 AS river, (s_suppkey * 7)::DOUBLE AS x, s_acctbal AS y FROM supplier),
s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS xb, lag(y) OVER w AS yb FROM k WINDOW w AS (PARTITION BY river ORDER BY x)),
t AS (SELECT river, CASE WHEN x1 IS NULL THEN xb ELSE x END AS x0, CASE WHEN x1 IS NULL THEN yb ELSE y END AS y0, coalesce(x1, x) AS x1, coalesce(y1, y) AS y1, CASE WHEN xb IS NULL THEN -1e18 ELSE x END AS start FROM s),
p AS (SELECT c_custkey, c_nationkey % 3 AS river, (c_custkey % 97)::DOUBLE AS x FROM customer)
SELECT c_custkey, round(y0 + (y1 - y0) * (p.x - x0) / (x1 - x0), 6) AS y FROM p ASOF JOIN t ON p.river = t.river AND p.x >= t.start""")
def arrival_times(spark, sf_dir):
    """Figures along a river by lines between its known points, the first and last line drawn on beyond the ends."""
    knots = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).cast("double").alias("x"), F.col("s_acctbal").alias("y"), (F.col("s_suppkey") % 3).cast("int").alias("river"))
    points = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).cast("int").alias("river"), (F.col("c_custkey") % 97).cast("double").alias("x"))
    found = s.between_knots(points, knots, "river")
    return found.select("c_custkey", F.round("y", 6).alias("y"))


@query(f"""WITH {_G}, q AS (SELECT quantile_cont(value, 0.9) AS q FROM g WHERE entity = 'view'), o AS (SELECT hour, value >= q AS over FROM g, q WHERE entity = 'view'),
st AS (SELECT hour FROM (SELECT hour, over, max(CASE WHEN over THEN hour END) OVER (ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o) WHERE over AND (before IS NULL OR hour - before > INTERVAL 12 HOUR)),
b AS (SELECT hour, value FROM g WHERE entity = 'purchase' AND value IS NOT NULL), j AS (SELECT st.hour AS start, arg_max(b.hour, (b.value, -epoch(b.hour))) AS peak_at, max(b.value) AS peak FROM st JOIN b ON b.hour > st.hour AND b.hour <= st.hour + INTERVAL 24 HOUR GROUP BY 1)
SELECT start, round(peak, 6) AS peak, (epoch(peak_at) - epoch(start)) / 3600 AS lag_hours FROM j""")
def event_lags(spark, sf_dir):
    """From each flood start upstream (over the 90th percentile after twelve hours without) the hours to the downstream peak of the next day."""
    up = _gapless(spark, sf_dir).where("entity = 'view'")
    limit = up.agg(F.expr("percentile(value, 0.9D)").alias("q"))
    flagged = up.join(F.broadcast(limit), F.lit(True)).withColumn("flag", F.coalesce(F.col("value") >= F.col("q"), F.lit(False)))
    starts = s.spells(flagged, 12).select(F.col("start"))
    ahead = starts.select("start", F.explode(F.sequence(F.col("start") + F.expr("INTERVAL 1 HOUR"), F.col("start") + F.expr("INTERVAL 24 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    down = _gapless(spark, sf_dir).where("entity = 'purchase' AND value IS NOT NULL").select("hour", "value")
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    peak = ahead.join(down, "hour").groupBy("start").agg(F.max_by("hour", F.struct("value", -seconds("hour"))).alias("peak_at"), F.round(F.max("value"), 6).alias("peak"))
    return peak.select("start", "peak", ((seconds("peak_at") - seconds("start")) / 3600).alias("lag_hours"))


@query("""WITH h AS (SELECT floor(o_totalprice / 10000)::INT AS bin, count(*)::DOUBLE AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS w, sum(n * bin) AS s, sum(n * bin * bin) AS q FROM h),
c AS (SELECT bin, sum(n) OVER o AS w0, sum(n * bin) OVER o AS s0, w, s, q FROM h, t WINDOW o AS (ORDER BY bin)), v AS (SELECT *, w0 / w * (w - w0) / w * power(s0 / w0 - (s - s0) / (w - w0), 2) AS b FROM c WHERE w > w0),
x AS (SELECT * FROM v ORDER BY b DESC, bin LIMIT 1)
SELECT bin, round(b / (q / w - power(s / w, 2)), 6) AS eta, round(least(w0, w - w0) / w, 6) AS smaller_share, round((s - s0) / (w - w0) - s0 / w0, 6) AS apart, b / (q / w - power(s / w, 2)) >= 0.6 AND least(w0, w - w0) / w >= 0.1 AS two_modes FROM x""")
def bimodality(spark, sf_dir):
    """Whether a histogram has two modes: the best cut's share of the variance, the smaller side's share and how far the means are apart."""
    h = load(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 10000).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    upto, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # over the bins
    c = h.select("bin", *[F.sum(x).over(w).alias(k) for k, x, w in (("w0", F.col("n"), upto), ("s0", F.col("n") * F.col("bin"), upto), ("w", F.col("n"), every), ("s", F.col("n") * F.col("bin"), every), ("q", F.col("n") * F.col("bin") * F.col("bin"), every))])
    w0, s0, w, t, q = (F.col(x) for x in ("w0", "s0", "w", "s", "q"))
    v = c.where("w > w0").withColumn("b", w0 / w * (w - w0) / w * F.pow(s0 / w0 - (t - s0) / (w - w0), 2))
    v = v.select("bin", "b", (F.col("b") / (q / w - F.pow(t / w, 2))).alias("eta"), (F.least(w0, w - w0) / w).alias("smaller"), ((t - s0) / (w - w0) - s0 / w0).alias("apart"))
    x = v.agg(F.max_by(F.struct("*"), F.struct("b", -F.col("bin"))).alias("x")).select("x.*")
    return x.select("bin", F.round("eta", 6).alias("eta"), F.round("smaller", 6).alias("smaller_share"), F.round("apart", 6).alias("apart"), ((F.col("eta") >= 0.6) & (F.col("smaller") >= 0.1)).alias("two_modes"))


@query("""WITH p AS (SELECT l_partkey % 500 AS cell, year(l_shipdate) AS season, max(l_quantity) >= 48 AS wet FROM lineitem GROUP BY 1, 2)
SELECT cell, count(*) AS valid, count(*) FILTER (wet) AS flooded, round(count(*) FILTER (wet) / count(*), 8) AS frequency FROM p GROUP BY 1""")
def flood_frequency(spark, sf_dir):
    """Of each cell the share of the seasons with a pass in which some pass showed water."""
    passes = load(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 500).alias("cell"), F.year("l_shipdate").alias("season")).agg((F.max("l_quantity") >= 48).alias("wet"))
    return passes.groupBy("cell").agg(F.count("*").alias("valid"), F.count_if("wet").alias("flooded"), F.round(F.count_if("wet") / F.count("*"), 8).alias("frequency"))


@query(f"""WITH {_G}, f AS (SELECT entity, hour, coalesce(value >= 100, false) AS flag FROM g), n AS (SELECT entity, count(*) AS floods FROM (SELECT *, flag AND NOT coalesce(lag(flag) OVER (PARTITION BY entity ORDER BY hour), false) AS edge FROM f) WHERE edge GROUP BY 1),
r AS (SELECT entity, value, value - lag(value, 3) OVER (PARTITION BY entity ORDER BY hour) AS up FROM g), q AS (SELECT entity, quantile_cont(value, 0.97) AS hi, quantile_cont(value, 0.9) AS mid, quantile_cont(up, 0.9) FILTER (up > 0) AS rise, quantile_cont(value, 0.5) AS low FROM r GROUP BY 1)
SELECT q.entity, coalesce(floods, 0) AS floods, CASE WHEN coalesce(floods, 0) >= 3 THEN 'record' ELSE 'rises' END AS basis, round(CASE WHEN coalesce(floods, 0) >= 3 THEN hi ELSE low + rise END, 6) AS evacuate,
round(least(CASE WHEN coalesce(floods, 0) >= 3 THEN mid ELSE low + rise * 0.7 END, CASE WHEN coalesce(floods, 0) >= 3 THEN hi ELSE low + rise END - 5), 6) AS warning,
round(greatest(low, least(CASE WHEN coalesce(floods, 0) >= 3 THEN mid ELSE low + rise * 0.7 END, CASE WHEN coalesce(floods, 0) >= 3 THEN hi ELSE low + rise END - 5) - 20), 6) AS watch FROM q LEFT JOIN n USING (entity)""")
def suggested_limits(spark, sf_dir):
    """Levels of each gauge: from the record's shares where it has three floods, else from its fast rises, in order and with gaps."""
    g = _gapless(spark, sf_dir)
    floods = s.rising_edges(g.withColumn("flag", F.coalesce(F.col("value") >= 100, F.lit(False)))).withColumnRenamed("n_spells", "floods")
    rises = g.withColumn("up", F.col("value") - F.lag("value", 3).over(s.ordered()))
    q = rises.groupBy("entity").agg(F.expr("percentile(value, array(0.5D, 0.9D, 0.97D))").alias("p"), F.expr("percentile(up, 0.9D) FILTER (WHERE up > 0)").alias("rise"))
    both = q.join(floods, "entity", "left").withColumn("floods", F.coalesce("floods", F.lit(0)))
    known = F.col("floods") >= 3
    top = F.when(known, F.col("p")[2]).otherwise(F.col("p")[0] + F.col("rise"))
    warning = F.least(F.when(known, F.col("p")[1]).otherwise(F.col("p")[0] + F.col("rise") * 0.7), top - 5)
    watch = F.greatest(F.col("p")[0], warning - 20)
    return both.select("entity", "floods", F.when(known, "record").otherwise("rises").alias("basis"), F.round(top, 6).alias("evacuate"), F.round(warning, 6).alias("warning"), F.round(watch, 6).alias("watch"))


@query(f"""WITH {_G}, r AS (SELECT *, {_mean('value', 25, 0.8)} AS slow FROM g), f AS (SELECT entity, hour, slow, value - slow AS fast FROM r), m AS (SELECT entity, avg(slow) AS m FROM f GROUP BY 1),
a AS (SELECT f.entity, fast + m > 60 AS over, slow - m AS setup, lag(fast, 3) OVER (PARTITION BY f.entity ORDER BY hour) AS wind FROM f JOIN m USING (entity))
SELECT entity, count(*) FILTER (over) AS over_by_tide, round(corr(setup, sign(wind) * wind * wind), 6) AS wind_link FROM a GROUP BY 1""")
def tide_alone(spark, sf_dir):
    """Hours over a limit by the tide alone, and how the slow part goes with the signed square of what blew three hours before."""
    f = s.tidal_split(_gapless(spark, sf_dir))
    mean = F.avg("slow").over(Window.partitionBy("entity"))
    a = f.select("entity", (F.col("fast") + mean > 60).alias("over"), (F.col("slow") - mean).alias("setup"), F.lag("fast", 3).over(s.ordered()).alias("wind"))
    return a.groupBy("entity").agg(F.count_if("over").alias("over_by_tide"), F.round(F.corr("setup", sky.onshore_stress(F.col("wind"))), 6).alias("wind_link"))


@query("""WITH d AS (SELECT event_type AS entity, CAST(ts AS DATE) AS day, min(value) AS low, max(value) AS high, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT entity, month(day) AS month, count(*) AS days, round(quantile_cont(low, 0.5), 6) AS low_p50, round(quantile_cont(low, 0.9), 6) AS low_p90, round(quantile_cont(high, 0.9), 6) AS high_p90, round(quantile_cont(high - mean, 0.5), 6) AS setup_p50 FROM d GROUP BY 1, 2""")
def season_reference(spark, sf_dir):
    """Percentiles of the daily low, high and set-up of each month of the record."""
    d = load(spark, sf_dir, "events").where("value IS NOT NULL").groupBy(F.col("event_type").alias("entity"), F.to_date("ts").alias("day")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    p = lambda c, q: F.round(F.expr(f"percentile({c}, {q}D)"), 6)
    return d.groupBy("entity", F.month("day").alias("month")).agg(F.count("*").alias("days"), p("low", 0.5).alias("low_p50"), p("low", 0.9).alias("low_p90"), p("high", 0.9).alias("high_p90"), p("high - mean", 0.5).alias("setup_p50"))


@query(f"""WITH {_A}, {_B}, d AS (SELECT a.id, b.id AS village, row_number() OVER (PARTITION BY a.id ORDER BY {_KM}, b.id) AS k FROM a, b)
SELECT village, count(*) AS cells, count(*) FILTER (c_acctbal > 8000) AS high, count(*) FILTER (c_acctbal BETWEEN 4000 AND 8000) AS medium FROM d JOIN customer ON c_custkey = id WHERE k = 1 GROUP BY 1""")
def village_classes(spark, sf_dir):
    """Cells given to their nearest village, counted by class."""
    near = spatial.nearest(_customers(spark, sf_dir), _suppliers(spark, sf_dir), "id", "id", 1, 20.0).select("id", F.col("id_r").alias("village"))
    rows = near.join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id")
    return rows.groupBy("village").agg(F.count("*").alias("cells"), F.count_if(F.col("c_acctbal") > 8000).alias("high"), F.count_if(F.col("c_acctbal").between(4000, 8000)).alias("medium"))


@query(f"""WITH {_A}, {_B}, d AS (SELECT a.id, s_acctbal AS h, row_number() OVER (PARTITION BY a.id ORDER BY {_KM}, b.id) AS k FROM a, b JOIN supplier ON s_suppkey = b.id)
SELECT id, round(quantile_cont(h, 0.5), 6) AS surface FROM d WHERE k <= 3 GROUP BY 1""")
def water_surface(spark, sf_dir):
    """The water surface at each place: the median height of its three nearest edge cells."""
    edge = _suppliers(spark, sf_dir).join(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("h")), "id")
    near = spatial.nearest(_customers(spark, sf_dir), edge, "id", "id", 3, 20.0)
    return near.groupBy("id").agg(F.round(F.median("h_r"), 6).alias("surface"))


_LINE = f"""{_A}, ln AS (SELECT id, id // 50 AS line, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM a WINDOW w AS (PARTITION BY id // 50 ORDER BY id)),
st AS (SELECT *, coalesce(sqrt(power((lon - lon0) * cos(radians((lat0 + lat) / 2)) * 111.32, 2) + power((lat - lat0) * 111.32, 2)), 0) AS step FROM ln),
al AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY id) AS km FROM st)"""


def _along(spark, sf_dir) -> DataFrame:
    """Points of lines of fifty with the way along the line so far."""
    w = Window.partitionBy("line").orderBy("id")
    rows = _customers(spark, sf_dir).withColumn("line", F.floor(F.col("id") / 50)).withColumn("lon0", F.lag("lon").over(w)).withColumn("lat0", F.lag("lat").over(w))
    step = F.coalesce(spatial.flat_km(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), F.lit(0.0))
    return rows.withColumn("km", F.sum(step).over(w))


@query(f"""WITH {_LINE}, t AS (SELECT al.*, n, lon - 99.3 - 0.9 * (n - 1) AS x, lat - 6.4 AS y FROM al, (SELECT unnest([1, 2, 3]) AS n))
SELECT line, n AS area, round(min(km), 6) AS entry_km, count(*) AS points FROM t WHERE y > 0 AND y < 2 * x AND y < 2 * (0.8 - x) GROUP BY 1, 2""")
def line_entries(spark, sf_dir):
    """Where along its way each line first stands in each area."""
    found = in_three_triangles(spark, _along(spark, sf_dir))
    return found.groupBy("line", "area").agg(F.round(F.min("km"), 6).alias("entry_km"), F.count("*").alias("points"))


@query(f"""WITH {_LINE}, sd AS (SELECT *, (lon - 99.5) - 0.5 * (lat - 6) AS side, (lon0 - 99.5) - 0.5 * (lat0 - 6) AS side0 FROM al)
SELECT line, id, CASE WHEN side > 0 THEN 'west to east' ELSE 'east to west' END AS direction, round(km - step * abs(side) / (abs(side) + abs(side0)), 6) AS at_km FROM sd WHERE sign(side) <> sign(side0) AND side <> 0 AND side0 <> 0""")
def line_crossings(spark, sf_dir):
    """Where lines cross a straight road, by the change of the side they are on, with the direction of flow."""
    rows = _along(spark, sf_dir)
    side = lambda lon, lat: (F.col(lon) - 99.5) - 0.5 * (F.col(lat) - 6)
    rows = rows.withColumn("side", side("lon", "lat")).withColumn("side0", side("lon0", "lat0")).where("signum(side) <> signum(side0) AND side <> 0 AND side0 <> 0")
    step = spatial.flat_km(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    at = F.col("km") - step * F.abs("side") / (F.abs("side") + F.abs("side0"))
    return rows.select("line", "id", F.when(F.col("side") > 0, "west to east").otherwise("east to west").alias("direction"), F.round(at, 6).alias("at_km"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS node, p_partkey AS pos, p_size AS h FROM part WHERE p_partkey > 0 UNION ALL SELECT node, pos // 3, h FROM w WHERE pos > 12)
SELECT node, greatest(h - p_size, 0)::BIGINT AS hand FROM w JOIN part ON p_partkey = pos WHERE pos <= 12 AND pos > 0""")
def above_channel(spark, sf_dir):
    """Height of every node above the channel node that it drains to; nodes up to 12 are the channel."""
    nodes = load(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).alias("to"), F.col("p_size").alias("height"))
    return graph.above_drainage(nodes, F.col("node") <= 12).select("node", F.col("hand").cast("long").alias("hand")).where("hand IS NOT NULL")


_CELLS = "c AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col FROM part WHERE p_size >= 32)"


@query(f"""WITH RECURSIVE {_CELLS}, e AS (SELECT a.row * 1000 + a.col AS u, b.row * 1000 + b.col AS v FROM c a JOIN c b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), r AS (SELECT u AS n, u AS m FROM e UNION SELECT r.n, e.v FROM r JOIN e ON e.u = r.m),
k AS (SELECT n, min(m) AS patch FROM r GROUP BY 1), z AS (SELECT *, count(*) OVER (PARTITION BY patch) AS size FROM k) SELECT n // 1000 AS row, n % 1000 AS col, patch // 1000 AS patch_row, patch % 1000 AS patch_col FROM z WHERE size >= 4""")
def wet_patches(spark, sf_dir):
    """Patches of four wet cells or more that touch at their sides."""
    return graph.patches(_grid(spark, sf_dir).where("value >= 32").select("row", "col"), 4).select("row", "col", F.col("patch.row").alias("patch_row"), F.col("patch.col").alias("patch_col"))


@query(f"""WITH {_CELLS} SELECT row, col FROM c WHERE (SELECT count(*) FROM c b WHERE abs(b.row - c.row) + abs(b.col - c.col) = 1) < 4""")
def wet_edges(spark, sf_dir):
    return graph.edge(_grid(spark, sf_dir).where("value >= 32").select("row", "col"))


@query("""WITH g AS (SELECT (p_partkey // 50) // 4 AS row, (p_partkey % 50) // 4 AS col, CASE WHEN p_size >= 45 THEN 3 WHEN p_size >= 30 THEN 2 WHEN p_size >= 15 THEN 1 ELSE 0 END AS cls FROM part), n AS (SELECT row, col, cls, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY row, col ORDER BY cls DESC) / sum(n) OVER (PARTITION BY row, col) AS share FROM n) SELECT row, col, max(cls) AS cls FROM s WHERE share >= 0.25 GROUP BY 1, 2""")
def coarse_classes(spark, sf_dir):
    """Blocks of four by four cells with the highest class that, with those above it, holds a quarter of the block."""
    v = F.col("value")
    cells = _grid(spark, sf_dir).withColumn("cls", F.when(v >= 45, 3).when(v >= 30, 2).when(v >= 15, 1).otherwise(0))
    return graph.coarsened(cells, 4, 0.25)


@query("""WITH g AS (SELECT i AS col, j AS row, 99 + (i + 0.5) * 0.05 AS lon, 6 + (j + 0.5) * 0.05 AS lat FROM (SELECT unnest(generate_series(0, 59)) AS i), (SELECT unnest(generate_series(0, 39)) AS j)),
t AS (SELECT row, col, n, lon - 99.3 - 0.6 * (n - 1) AS x, lat - 6.4 AS y FROM g, (SELECT unnest([1, 2, 3]) AS n)) SELECT row, col, bit_or((1 << (n - 1))::INT) AS years FROM t WHERE y > 0 AND y < 2 * x AND y < 2 * (0.8 - x) GROUP BY 1, 2""")
def burnt_years(spark, sf_dir):
    """Polygons of three years burnt into a grid: of each cell a bit for each year whose polygon holds its centre."""
    ring = F.array(*[F.struct((F.lit(99.3) + 0.6 * (F.col("area") - 1) + dx).alias("x"), F.lit(6.4 + dy).alias("y")) for dx, dy in ((0.0, 0.0), (0.8, 0.0), (0.4, 0.8))])
    areas = spark.range(1, 4).select(F.col("id").cast("int").alias("area")).withColumn("ring", ring)
    cells = spark.range(0, 2400).select((F.col("id") % 60).alias("col"), F.floor(F.col("id") / 60).alias("row"))
    centres = cells.withColumn("lon", 99 + (F.col("col") + 0.5) * 0.05).withColumn("lat", 6 + (F.col("row") + 0.5) * 0.05)
    found = spatial.in_polygons(centres, areas, 0.25)
    return found.groupBy("row", "col").agg(F.bit_or(F.expr("shiftleft(1, area - 1)")).alias("years"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS node, p_partkey AS pos, p_retailprice AS km FROM part WHERE p_partkey > 0 UNION ALL SELECT node, pos // 3, km FROM w WHERE pos > 0)
SELECT pos AS target, count(*) AS reaches, round(sum(km), 4) AS km FROM w WHERE pos IN (2, 7, 30) GROUP BY 1""")
def network_above(spark, sf_dir):
    """How many reaches lie above some points of a network, themselves included, and how long they are together."""
    pointers = _pointers(spark, sf_dir)
    above = graph.upstream(pointers, pointers.where("node IN (2, 7, 30)").select("node"))
    km = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("km"))
    return above.join(km, "node").groupBy("target").agg(F.count("*").alias("reaches"), F.round(F.sum("km"), 4).alias("km"))


@query("""WITH w AS (SELECT p_partkey AS way, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS brk FROM part), c AS (SELECT way, sum(brk) OVER (ORDER BY way) AS grp FROM w) SELECT way, min(way) OVER (PARTITION BY grp) AS chain FROM c""")
def way_chains(spark, sf_dir):
    """Ways joined end to end: at every seventh place a side road ends, too, so no chain goes on there."""
    p = load(spark, sf_dir, "part")
    ways = p.select(F.col("p_partkey").alias("way"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    side = p.where("p_partkey % 7 = 0 AND p_partkey > 0").select((-F.col("p_partkey") - 1).alias("way"), F.col("p_partkey").alias("a"), (-F.col("p_partkey") - 1).alias("b"))
    return graph.chains(ways.union(side)).where("way >= 0")


@query("""WITH b AS (SELECT l_partkey AS cell, ceil(min(l_quantity) / 5)::INT AS band FROM lineitem GROUP BY 1), n AS (SELECT band, count(*) AS n FROM b GROUP BY 1)
SELECT band, n, (sum(n) OVER (ORDER BY band))::BIGINT AS wet FROM n""")
def wet_by_stage(spark, sf_dir):
    """The stage band at which each cell first gets wet, and how many cells are wet by each band."""
    first = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(F.ceil(F.min("l_quantity") / 5).cast("int").alias("band"))
    bands = first.groupBy("band").agg(F.count("*").alias("n"))
    return bands.withColumn("wet", F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)))  # a row a band


@query(f"""WITH {_A}, g AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_size % 9 > 0 THEN p_size END AS value FROM part), p AS (SELECT id, (lon - 99) * 10 AS x, (lat - 6) * 1.2 AS y FROM a),
c AS (SELECT id, (1 - abs(x - col)) * (1 - abs(y - row)) AS w, value FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), g WHERE col = floor(x) + i AND row = floor(y) + j AND value IS NOT NULL)
SELECT id, round(sum(w * value) / sum(w), 6) AS value FROM c GROUP BY 1 HAVING sum(w) > 0""")
def grid_values(spark, sf_dir):
    """Values between the cells of a grid, from those of the four corners that are known."""
    cells = _grid(spark, sf_dir).withColumn("value", F.when(F.col("value") % 9 > 0, F.col("value")))
    points = _customers(spark, sf_dir).select("id", ((F.col("lon") - 99) * 10).alias("x"), ((F.col("lat") - 6) * 1.2).alias("y"))
    return spatial.bilinear(points, cells).select("id", F.round("value", 6).alias("value"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, date_diff('day', DATE '2000-01-01', day) AS n FROM d),
m AS (SELECT *, radians((357.5291 + 0.98560028 * n) - 360 * floor((357.5291 + 0.98560028 * n) / 360)) AS m FROM n), l AS (SELECT *, degrees(m) + 1.9148 * sin(m) + 0.02 * sin(2 * m) + 0.0003 * sin(3 * m) + 180 + 102.9372 AS lam FROM m),
s AS (SELECT *, asin(sin(radians(lam)) * sin(radians(23.4397))) AS dec, 0.0053 * sin(m) - 0.0069 * sin(2 * radians(lam)) - 100.5 / 360 AS noon FROM l),
w AS (SELECT *, degrees(acos((sin(radians(-0.833)) - sin(radians(7.0)) * sin(dec)) / (cos(radians(7.0)) * cos(dec)))) / 360 AS half FROM s)
SELECT day, round((noon - half) * 24 + 12 + 7, 5) AS sunrise, round((noon + half) * 24 + 12 + 7, 5) AS sunset, round((n - 5.26) / 29.530588853 - floor((n - 5.26) / 29.530588853), 6) AS moon_age FROM w""")
def sun_and_moon(spark, sf_dir):
    """Hours of sunrise and sunset on the local clock at one place, and the moon's age as a share of its month."""
    days = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    rise, fall = sky.sun_hours(F.col("day"), 7.0, 100.5, 7)
    return days.select("day", F.round(rise, 5).alias("sunrise"), F.round(fall, 5).alias("sunset"), F.round(sky.moon_age(F.col("day")), 6).alias("moon_age"))


@query("""WITH t AS (SELECT s_suppkey, s_suppkey // 2 AS twin, s_acctbal, s_nationkey FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY twin ORDER BY s_acctbal DESC, s_suppkey) AS r FROM t)
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM k WHERE r = 1""")
def ranked_without_twins(spark, sf_dir):
    """A ranked list of each area in which the lesser of two twins is left out."""
    t = load(spark, sf_dir, "supplier").withColumn("twin", F.floor(F.col("s_suppkey") / 2))
    best = t.withColumn("r", F.row_number().over(Window.partitionBy("twin").orderBy(F.desc("s_acctbal"), "s_suppkey"))).where("r = 1")
    return best.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("place"))


@query(f"""WITH RECURSIVE {_B}, o AS (SELECT b.*, s_acctbal AS weight, row_number() OVER (ORDER BY s_acctbal DESC, id) AS i FROM b JOIN supplier ON s_suppkey = b.id),
n AS (SELECT b.i, list(a.i) FILTER (a.i < b.i AND {_KM} <= 25) AS near FROM o a, o b GROUP BY b.i), w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS picks UNION ALL
SELECT n.i, CASE WHEN near IS NULL OR NOT list_has_any(picks, near) THEN list_append(picks, n.i) ELSE picks END FROM w JOIN n ON n.i = w.i + 1)
SELECT id, weight FROM o WHERE list_contains((SELECT picks FROM w ORDER BY i DESC LIMIT 1), o.i)""")
def spaced_picks(spark, sf_dir):
    """The heaviest places first, none within 25 km of one picked before."""
    heavy = _suppliers(spark, sf_dir).join(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("weight")), "id")
    return spatial.spaced(heavy, "id", "weight", 25.0).select("id", "weight")


_PROFILE = """q AS (SELECT p_partkey % 5 AS river, p_partkey // 100 AS bin, quantile_cont(p_retailprice::DOUBLE, 0.1) AS low FROM part GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY river ORDER BY bin) AS i, sum(low) OVER (PARTITION BY river ORDER BY bin ROWS UNBOUNDED PRECEDING) AS s FROM q),
p AS (SELECT a.river, a.i AS a, b.i AS b, (b.s - a.s + a.low) / (b.i - a.i + 1) AS m FROM o a JOIN o b ON a.river = b.river AND b.i >= a.i),
x AS (SELECT river, b, max(m) OVER (PARTITION BY river, a ORDER BY b DESC) AS top FROM p), y AS (SELECT river, b, min(top) AS fitted FROM x GROUP BY 1, 2),
f AS (SELECT o.river, bin, round(fitted, 6) AS fitted FROM y JOIN o ON o.river = y.river AND o.i = y.b)"""


@query(f"""WITH RECURSIVE {_B}, o AS (SELECT b.*, s_acctbal AS weight, s_nationkey AS area, row_number() OVER (ORDER BY s_acctbal DESC, id) AS i FROM b JOIN supplier ON s_suppkey = b.id),
n AS (SELECT b.i, any_value(b.area) AS area, list(a.i) FILTER (a.i < b.i AND {_KM} <= 25) AS near FROM o a, o b GROUP BY b.i),
w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS picks, []::BIGINT[] AS areas UNION ALL SELECT i, CASE WHEN fits THEN list_append(picks, i) ELSE picks END, CASE WHEN fits THEN list_append(areas, area) ELSE areas END FROM
(SELECT n.i, n.area, picks, areas, (near IS NULL OR NOT list_has_any(picks, near)) AND len(list_filter(areas, lambda x: x = n.area)) < 2 AS fits FROM w JOIN n ON n.i = w.i + 1))
SELECT id, weight, area FROM o WHERE list_contains((SELECT picks FROM w ORDER BY i DESC LIMIT 1), o.i)""")
def spaced_picks_by_area(spark, sf_dir):
    """The heaviest places first, none within 25 km of one picked before, and at most two an area."""
    more = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("weight"), F.col("s_nationkey").alias("area"))
    return spatial.spaced(_suppliers(spark, sf_dir).join(more, "id"), "id", "weight", 25.0, "area", 2).select("id", "weight", "area")


@query(f"WITH {_PROFILE} SELECT river, bin, fitted FROM f")
def river_profile(spark, sf_dir):
    """The river's surface along its way: the lower tenth of each bin's heights, never rising downstream."""
    rows = load(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("river"), F.floor(F.col("p_partkey") / 100).alias("bin"), F.col("p_retailprice").alias("h"))
    low = rows.groupBy("river", "bin").agg(F.expr("percentile(h, 0.1D)").alias("low"))
    return s.never_rising(low, "river", "bin", "low").withColumn("fitted", F.round("fitted", 6))


@query("""SELECT p_partkey, CASE WHEN l - r > 10 THEN 'left' WHEN r - l > 10 THEN 'right' ELSE 'unclear' END AS side, (p_retailprice > 1300 AND l - r > 10) OR (p_retailprice <= 1300 AND r - l > 10) AS agrees
FROM (SELECT p_partkey, p_retailprice, p_size AS l, p_partkey % 50 AS r FROM part)""")
def upstream_side(spark, sf_dir):
    """Which side of a crossing lies upstream by the height of both, and whether the flow says the same."""
    gap = F.col("p_size") - F.col("p_partkey") % 50
    side = F.when(gap > 10, "left").when(gap < -10, "right").otherwise("unclear")
    high = F.col("p_retailprice") > 1300
    return load(spark, sf_dir, "part").select("p_partkey", side.alias("side"), ((high & (gap > 10)) | (~high & (gap < -10))).alias("agrees"))


@query(f"""WITH {_PROFILE}, a AS (SELECT p_partkey, round(p_retailprice - fitted, 6) AS above FROM part JOIN f ON river = p_partkey % 5 AND bin = p_partkey // 100)
SELECT p_partkey, above, CASE WHEN above <= 100 THEN 1 WHEN above <= 300 THEN 2 ELSE 3 END AS zone FROM a""")
def river_zones(spark, sf_dir):
    """Cells by how high they stand above the river's surface in their bin: wet at a rise of 100, or of 300, or dry."""
    profile = river_profile(spark, sf_dir).select("river", "bin", "fitted")
    cells = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("river"), F.floor(F.col("p_partkey") / 100).alias("bin"), F.col("p_retailprice").alias("h"))
    above = cells.join(profile, ["river", "bin"]).withColumn("above", F.round(F.col("h") - F.col("fitted"), 6))
    return above.select("p_partkey", "above", F.when(F.col("above") <= 100, 1).when(F.col("above") <= 300, 2).otherwise(3).alias("zone"))


_REACHES = """g AS (SELECT (p_partkey // 50) // 10 AS reach, p_partkey // 50 AS row, p_partkey % 50 AS col, p_size::DOUBLE AS h FROM part),
w AS (SELECT reach, row, col, h, h AS level FROM g WHERE col = 0 UNION SELECT n.reach, n.row, n.col, n.h, greatest(w.level, n.h) FROM w JOIN g n ON n.reach = w.reach AND abs(n.row - w.row) + abs(n.col - w.col) = 1 WHERE n.col > 0),
j AS (SELECT reach, row, col, any_value(h) AS h, min(level) AS level FROM w GROUP BY ALL)"""


def _reaches(spark, sf_dir) -> DataFrame:
    return _grid(spark, sf_dir).select(F.floor(F.col("row") / 10).alias("reach"), "row", "col", F.col("value").alias("height"), (F.col("col") == 0).alias("channel"))


@query(f"WITH RECURSIVE {_REACHES} SELECT reach, row, col, level FROM g LEFT JOIN j USING (reach, row, col)")
def reach_levels(spark, sf_dir):
    """The water level at which each cell of a reach joins its channel."""
    return graph.join_levels(_reaches(spark, sf_dir)).select("reach", "row", "col", "level")


@query(f"""WITH RECURSIVE {_REACHES}, l AS (SELECT reach, level, count(*) AS n, sum(h) AS s FROM j GROUP BY 1, 2), r AS (SELECT reach, level, sum(n) OVER o AS k, sum(s) OVER o AS s, lead(level) OVER o AS above FROM l WINDOW o AS (PARTITION BY reach ORDER BY level)),
f AS (SELECT reach, greatest((400 + s) / k, level) AS at_level, k, s FROM r WHERE above IS NULL OR greatest((400 + s) / k, level) <= above)
SELECT reach, round(x[1], 4) AS level, round(x[2] * x[1] - x[3], 4) AS volume, x[2]::BIGINT AS cells FROM (SELECT reach, [(x).at_level, (x).k, (x).s] AS x FROM (SELECT reach, struct_pack(at_level := min(at_level), k := arg_min(k, at_level), s := arg_min(s, at_level)) AS x FROM f GROUP BY 1))""")
def filled_reaches(spark, sf_dir):
    """The level at which each reach of a grid holds a volume of 400."""
    return graph.filled_by_levels(_reaches(spark, sf_dir), 400.0, 1.0).withColumns({c: F.round(c, 4) for c in ("level", "volume")})
