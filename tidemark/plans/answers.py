"""Answers of boards and consoles: reports and their neighbours, suggestions, tallies, feeds, pages, retention and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import quantiles
from tidemark.operators import relational as r
from tidemark.plans.registry import registry
from tidemark.tables import load

query, QUERIES, ORACLES = registry()


@query("""WITH e AS (SELECT event_id, user_id, user_id % 40 AS area, ts, value FROM events WHERE event_type = 'error'), d AS (SELECT user_id, user_id % 40 AS area, ts FROM events WHERE event_type = 'signup'),
c AS (SELECT e.event_id, count(DISTINCT d.user_id) AS n FROM e JOIN d ON d.area = e.area AND d.user_id <> e.user_id AND d.ts > e.ts AND d.ts <= e.ts + INTERVAL 6 HOUR GROUP BY 1)
SELECT e.event_id, coalesce(n, 0) AS contradicted_by FROM e LEFT JOIN c USING (event_id) WHERE coalesce(n, 0) < 2""")
def uncontradicted_reports(spark, sf_dir):
    """Reports that fewer than two other people of the area contradicted within six hours.

    Whether two did is told by the next three people after the report, one of whom may be its own: each row is read once, in
    order of time back from the end, by area and a cell of time.
    """
    events = load(spark, sf_dir, "events").withColumn("area", F.col("user_id") % 40)
    cell = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000)
    e = events.where("event_type = 'error'").select("event_id", "user_id", "area", "ts", cell.alias("cell"), F.lit(0).alias("side"))
    d = events.where("event_type = 'signup' AND user_id IS NOT NULL").select("user_id", "area", "ts", F.explode(F.array(cell, cell - 1)).alias("cell"), F.lit(1).alias("side"))
    rows = e.unionByName(d, allowMissingColumns=True)
    back = Window.partitionBy("area", "cell").orderBy(F.desc("ts"), "side", "user_id")
    behind = back.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    # the next row of a contradiction; where another person's begin, that is the second person of all rows of this one in a row
    rows = rows.withColumn("_1", last(F.when(F.col("side") == 1, F.struct("ts", "user_id")), behind))
    other = F.when((F.col("side") == 1) & (F.col("_1.user_id") != F.col("user_id")), F.col("_1"))
    rows = rows.withColumn("_begin", other).withColumn("_2", last("_begin", behind))
    # the third person: behind the second if that is another one than this, else who is the third for both of them
    third = F.when(F.col("_begin").isNotNull() & (F.col("_2.user_id") != F.col("user_id")), F.col("_2"))
    rows = rows.withColumn("_third", third).withColumn("_3", last("_third", behind))
    in_time = lambda c: F.coalesce((F.col(f"{c}.user_id") != F.col("user_id")) & (F.col(f"{c}.ts") <= F.col("ts") + F.expr("INTERVAL 6 HOURS")), F.lit(False)).cast("long")
    n = in_time("_1") + in_time("_2") + in_time("_3")
    return rows.where("side = 0").select("event_id", n.alias("contradicted_by")).where("contradicted_by < 2")


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 3 <> 0)
SELECT c_custkey, coalesce(n_name, r_name, 'unknown') AS place, CASE WHEN n_name IS NOT NULL THEN 'district' WHEN r_name IS NOT NULL THEN 'province' ELSE 'none' END AS level
FROM c LEFT JOIN n ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = c_nationkey % 5""")
def place_or_province(spark, sf_dir):
    """Each record's smallest known area: the district where there is one, else the province, else none."""
    nation = load(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("k"), "n_name")
    region = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("p"), "r_name")
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_nationkey") % 5).alias("p"))
    found = c.join(nation, "k", "left").join(region, "p", "left")
    level = F.when(F.col("n_name").isNotNull(), "district").when(F.col("r_name").isNotNull(), "province").otherwise("none")
    return found.select("c_custkey", F.coalesce("n_name", "r_name", F.lit("unknown")).alias("place"), level.alias("level"))


@query("""WITH s AS (SELECT l_suppkey, avg(l_quantity) AS own FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), z AS (SELECT s_nationkey, avg(s_acctbal) AS zone FROM supplier GROUP BY 1)
SELECT s_suppkey, round(coalesce(own, zone / 100), 6) AS figure, own IS NULL AS fell_back FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey JOIN z USING (s_nationkey)""")
def enriched_suppliers(spark, sf_dir):
    """A list enriched by another one's figure of the same id, else by its zone's."""
    own = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("own"))
    suppliers = load(spark, sf_dir, "supplier")
    zone = suppliers.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("zone"))
    found = suppliers.select("s_suppkey", "s_nationkey").join(own, "s_suppkey", "left").join(zone, "s_nationkey")
    return found.select("s_suppkey", F.round(F.coalesce("own", F.col("zone") / 100), 6).alias("figure"), F.col("own").isNull().alias("fell_back"))


@query("""SELECT p_partkey, round(least(40.0, 20 * log10(1 + p_size)) + least(greatest(p_retailprice / 60, 0), 40) + CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE 0 END, 6) AS score,
CASE WHEN least(40.0, 20 * log10(1 + p_size)) + least(greatest(p_retailprice / 60, 0), 40) + CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE 0 END >= 70 THEN 'high' WHEN least(40.0, 20 * log10(1 + p_size)) + least(greatest(p_retailprice / 60, 0), 40) + CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE 0 END >= 50 THEN 'medium' ELSE 'low' END AS class FROM part""")
def composite_scores(spark, sf_dir):
    """Parts of a score: one on a logarithmic scale, one clamped, one yes or no; their sum cut into classes."""
    size = F.least(F.lit(40.0), 20 * F.log10(1 + F.col("p_size")))
    price = F.least(F.greatest(F.col("p_retailprice") / 60, F.lit(0.0)), F.lit(40.0))
    total = size + price + F.when(F.col("p_partkey") % 4 == 0, 20).otherwise(0)
    cls = F.when(total >= 70, "high").when(total >= 50, "medium").otherwise("low")
    return load(spark, sf_dir, "part").select("p_partkey", F.round(total, 6).alias("score"), cls.alias("class"))


LEVELS = ["quiet", "watch", "warning", "evacuate"]


@query("""WITH z AS (SELECT user_id % 30 AS zone, max(value) FILTER (event_type = 'view') AS level, sum(value) FILTER (event_type = 'click') AS rain, count(*) FILTER (event_type = 'error') AS reports,
  max(value) FILTER (event_type = 'purchase' AND value > 100) AS dam FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR GROUP BY 1),
s AS (SELECT *, CASE WHEN level >= 120 THEN 4 WHEN level >= 80 THEN 3 WHEN level >= 40 THEN 2 WHEN level IS NOT NULL THEN 1 END AS a, CASE WHEN rain >= 150 THEN 3 WHEN rain >= 80 THEN 2 WHEN rain IS NOT NULL THEN 1 END AS b,
  CASE WHEN reports >= 3 THEN 2 ELSE 1 END AS c, CASE WHEN dam IS NOT NULL THEN 3 END AS d FROM z)
SELECT zone, ['quiet', 'watch', 'warning', 'evacuate'][greatest(coalesce(a, 1), coalesce(b, 1), c, coalesce(d, 1))] AS suggested,
concat_ws(',', CASE WHEN a = greatest(coalesce(a, 1), coalesce(b, 1), c, coalesce(d, 1)) AND a > 1 THEN 'level' END, CASE WHEN b = greatest(coalesce(a, 1), coalesce(b, 1), c, coalesce(d, 1)) AND b > 1 THEN 'rain' END,
  CASE WHEN c = greatest(coalesce(a, 1), coalesce(b, 1), c, coalesce(d, 1)) AND c > 1 THEN 'reports' END, CASE WHEN d = greatest(coalesce(a, 1), coalesce(b, 1), c, coalesce(d, 1)) THEN 'dam' END) AS reasons,
concat_ws(',', CASE WHEN a IS NULL THEN 'level' END, CASE WHEN b IS NULL THEN 'rain' END, CASE WHEN d IS NULL THEN 'dam' END) AS not_judged FROM s""")
def suggestions(spark, sf_dir):
    """Per zone the highest level of any rule, the rules that give it and those that could not be judged."""
    events = load(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("INTERVAL 12 HOURS")).alias("since"))
    recent = events.join(F.broadcast(now), F.lit(True)).where("ts >= since")
    of = lambda kind, c: F.when(F.col("event_type") == kind, c)
    z = recent.groupBy((F.col("user_id") % 30).alias("zone")).agg(
        F.max(of("view", F.col("value"))).alias("level"), F.sum(of("click", F.col("value"))).alias("rain"), F.count_if(F.col("event_type") == "error").alias("reports"), F.max(of("purchase", F.when(F.col("value") > 100, F.col("value")))).alias("dam")
    )
    level = F.when(F.col("level") >= 120, 4).when(F.col("level") >= 80, 3).when(F.col("level") >= 40, 2).when(F.col("level").isNotNull(), 1)
    rain = F.when(F.col("rain") >= 150, 3).when(F.col("rain") >= 80, 2).when(F.col("rain").isNotNull(), 1)
    rules = {"level": level, "rain": rain, "reports": F.when(F.col("reports") >= 3, 2).otherwise(1), "dam": F.when(F.col("dam").isNotNull(), 3)}
    judged = z.withColumn("rules", F.array(*[F.struct(F.lit(n).alias("name"), c.alias("rank")) for n, c in rules.items()]))
    judged = judged.withColumn("top", F.greatest(F.array_max(F.transform("rules", lambda x: x["rank"])), F.lit(1)))
    names = lambda keep: F.array_join(F.transform(F.filter("rules", keep), lambda x: x["name"]), ",")
    return judged.select(
        "zone", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("top")).alias("suggested"), names(lambda x: (x["rank"] == F.col("top")) & (x["rank"] > 1)).alias("reasons"), names(lambda x: x["rank"].isNull()).alias("not_judged")
    )


@query("""WITH p AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 10 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 7 AS VARCHAR), 2, '0') AS code, c_custkey FROM customer)
SELECT c_custkey, code, CASE WHEN left(code, 6) = '070301' THEN 'tambon' WHEN left(code, 4) = '0703' THEN 'amphoe' ELSE 'changwat' END AS level FROM p WHERE left(code, 2) = '07'""")
def in_coverage(spark, sf_dir):
    """Everybody under a code of a hierarchy, with the deepest level that still agrees."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    code = F.concat(pad(F.col("c_nationkey")), pad(F.col("c_custkey") % 10), pad(F.col("c_custkey") % 7))
    rows = load(spark, sf_dir, "customer").select("c_custkey", code.alias("code")).where(F.substring("code", 1, 2) == "07")
    return rows.withColumn("level", F.when(F.substring("code", 1, 6) == "070301", "tambon").when(F.substring("code", 1, 4) == "0703", "amphoe").otherwise("changwat"))


_CELLS = """c AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_size AS hand, p_partkey % 11 AS land, p_retailprice AS slope FROM part),
k AS (SELECT *, CASE WHEN land = 0 THEN 0 WHEN hand <= 5 THEN 3 WHEN hand <= 15 AND slope < 1400 THEN 2 WHEN hand <= 30 THEN 1 ELSE 0 END AS cls,
  CASE WHEN land = 0 THEN 'water' WHEN hand <= 5 THEN 'low' WHEN hand <= 15 AND slope < 1400 THEN 'flat' WHEN hand <= 30 THEN 'near' ELSE 'high' END AS basis FROM c)"""


def _classed(spark, sf_dir) -> DataFrame:
    """Cells with the class of the first rule that holds, and which rule it was."""
    cells = load(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_size").alias("hand"), (F.col("p_partkey") % 11).alias("land"), F.col("p_retailprice").alias("slope")
    )
    rules = [(F.col("land") == 0, 0, "water"), (F.col("hand") <= 5, 3, "low"), ((F.col("hand") <= 15) & (F.col("slope") < 1400), 2, "flat"), (F.col("hand") <= 30, 1, "near")]
    cls, basis = F.when(F.lit(False), 0), F.when(F.lit(False), "")
    for test, c, b in rules:
        cls, basis = cls.when(test, c), basis.when(test, b)
    return cells.withColumn("cls", cls.otherwise(0)).withColumn("basis", basis.otherwise("high"))


@query(f"WITH {_CELLS} SELECT row, col, cls, basis FROM k")
def hazard_classes(spark, sf_dir):
    return _classed(spark, sf_dir).select("row", "col", "cls", "basis")


@query(f"WITH {_CELLS} SELECT cls, basis, count(*) AS cells, round(count(*) * 0.0009, 6) AS km2, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM k GROUP BY 1, 2")
def class_areas(spark, sf_dir):
    counts = _classed(spark, sf_dir).groupBy("cls", "basis").agg(F.count("*").alias("cells"))
    every = Window.partitionBy()  # a row for each class and basis
    return counts.select("cls", "basis", "cells", F.round(F.col("cells") * 0.0009, 6).alias("km2"), F.round(F.col("cells") / F.sum("cells").over(every), 8).alias("share"))


@query(f"WITH {_CELLS}, b AS (SELECT row, col, CASE WHEN (row * 7 + col) % 5 = 0 THEN 2 WHEN (row + col) % 3 = 0 THEN 1 ELSE 0 END AS seen FROM c) SELECT cls, seen, count(*) AS n FROM k JOIN b USING (row, col) GROUP BY 1, 2")
def class_crosstab(spark, sf_dir):
    """Two coded grids counted against each other."""
    seen = F.when((F.col("row") * 7 + F.col("col")) % 5 == 0, 2).when((F.col("row") + F.col("col")) % 3 == 0, 1).otherwise(0)
    return _classed(spark, sf_dir).groupBy("cls", seen.alias("seen")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_linestatus AS grp, count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R')::DOUBLE AS h, count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R')::DOUBLE AS m,
count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R')::DOUBLE AS f, count(*) FILTER (l_discount < 0.05 AND l_returnflag <> 'R')::DOUBLE AS q FROM lineitem GROUP BY 1)
SELECT grp, round((h + q) / nullif(h + m + f + q, 0), 6) AS hit_rate, round(2 * (h * q - f * m) / nullif((h + m) * (m + q) + (h + f) * (f + q), 0), 6) AS heidke, round(f / nullif(f + q, 0), 6) AS false_alarm_rate FROM c""")
def forecast_skill(spark, sf_dir):
    """Hit rate, Heidke's score and false alarm rate of a yes or no rule."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), (F.col("l_discount") >= 0.05).alias("said"), (F.col("l_returnflag") == "R").alias("true"))
    c = r.contingency(rows, "grp", F.col("said"), F.col("true"))
    h, m, f, q = (F.col(x).cast("double") for x in ("hits", "misses", "false_alarms", "quiet"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.select("grp", ratio(h + q, h + m + f + q).alias("hit_rate"), ratio(2 * (h * q - f * m), (h + m) * (m + q) + (h + f) * (f + q)).alias("heidke"), ratio(f, f + q).alias("false_alarm_rate"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1), p AS (SELECT year(day) AS y, (dayofyear(day) - 1) // 5 AS pentad, count(*) AS n, sum(v) AS v FROM d GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN count(*) OVER l = 3 AND min(n) OVER l = 5 THEN sum(v) OVER l END AS three FROM p WINDOW l AS (PARTITION BY y ORDER BY pentad RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT y, count(*) FILTER (n = 5) AS whole_pentads, round(sum(v) FILTER (n = 5), 2) AS total, round(max(v) FILTER (n = 5), 2) AS peak_5, round(max(three), 2) AS peak_15 FROM w GROUP BY 1""")
def pentad_seasons(spark, sf_dir):
    """Sums of five days, incomplete ones left out; of each year their total and the peaks over five and fifteen days."""
    days = load(spark, sf_dir, "orders").where("o_custkey % 3 > 0").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    p = days.groupBy(F.year("day").alias("y"), F.floor((F.dayofyear("day") - 1) / 5).alias("pentad")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    last = Window.partitionBy("y").orderBy("pentad").rangeBetween(-2, 0)
    three = F.when((F.count("*").over(last) == 3) & (F.min("n").over(last) == 5), F.sum("v").over(last))
    whole = F.when(F.col("n") == 5, F.col("v"))
    return p.withColumn("three", three).groupBy("y").agg(
        F.count_if(F.col("n") == 5).alias("whole_pentads"), F.round(F.sum(whole), 2).alias("total"), F.round(F.max(whole), 2).alias("peak_5"), F.round(F.max("three"), 2).alias("peak_15")
    )


@query("""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey % 4 AS area, l_suppkey AS station, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT day, coalesce('area ' || area, 'all') AS area, count(*) AS stations, round(avg(v), 6) AS mean FROM s GROUP BY GROUPING SETS ((day, area), (day)) HAVING count(*) >= 3""")
def area_means(spark, sf_dir):
    """Daily means over the stations of each area and of all, where at least three report."""
    rows = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 4).alias("area"), "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    found = rows.groupingSets([["day", "area"], ["day"]], "day", "area").agg(F.count("*").alias("stations"), F.avg("v").alias("mean")).where("stations >= 3")
    return found.select("day", F.coalesce(F.concat(F.lit("area "), F.col("area").cast("string")), F.lit("all")).alias("area"), "stations", F.round("mean", 6).alias("mean"))


@query("""WITH w AS (SELECT user_id, (epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts))) / 3.6e9 AS h FROM events GROUP BY 1), b AS (SELECT least(floor(h / 24), 20)::INT AS days, count(*) AS n FROM w WHERE h IS NOT NULL GROUP BY 1)
SELECT days, n, round(sum(n) OVER (ORDER BY days) / sum(n) OVER (), 8) AS share FROM b""")
def cumulative_waits(spark, sf_dir):
    """How long people waited, in days, and the share that had waited no longer."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    waits = load(spark, sf_dir, "events").groupBy("user_id").agg(((micros(F.min(F.when(F.col("event_type") == "purchase", F.col("ts")))) - micros(F.min("ts"))) / 3.6e9).alias("h")).where("h IS NOT NULL")
    bins = waits.groupBy(F.least(F.floor(F.col("h") / 24), F.lit(20)).cast("int").alias("days")).agg(F.count("*").alias("n"))
    upto, every = Window.orderBy("days").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # 21 rows
    return bins.select("days", "n", F.round(F.sum("n").over(upto) / F.sum("n").over(every), 8).alias("share"))


@query("""WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS points, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, points, (points >= 5)::INT + (points >= 20)::INT + (points >= 40)::INT AS milestones FROM p WHERE points > 0 ORDER BY points DESC, last DESC, user_id LIMIT 12""")
def honours(spark, sf_dir):
    """The twelve with most points and the milestones they passed: the report itself is the limit."""
    p = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("points"), F.max("ts").alias("last")).where("points > 0")
    passed = sum(((F.col("points") >= n).cast("int") for n in (5, 20, 40)), F.lit(0))
    return p.orderBy(F.desc("points"), F.desc("last"), "user_id").limit(12).select("user_id", "points", passed.alias("milestones"))


@query("""WITH p AS (SELECT user_id % 50 AS place, event_type, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1, 2), t AS (SELECT place, sum(n) AS n, max(newest) AS newest FROM p WHERE event_type = 'error' GROUP BY 1)
SELECT place, n::BIGINT AS n, newest, CASE WHEN place IN (3, 4) THEN 'here' WHEN place // 10 = 0 THEN 'district' ELSE 'elsewhere' END AS nearness FROM t""")
def reports_near_me(spark, sf_dir):
    """Reports by place with the newest time, parted in those of my places, the rest of my district, and others."""
    t = load(spark, sf_dir, "events").where("event_type = 'error'").groupBy((F.col("user_id") % 50).alias("place")).agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
    return t.withColumn("nearness", F.when(F.col("place").isin(3, 4), "here").when(F.floor(F.col("place") / 10) == 0, "district").otherwise("elsewhere"))


def stored_and_live(stored: DataFrame, live: DataFrame, day: str) -> DataFrame:
    """Days of a stored roll-up with the running day computed anew; a stored row of a live day gives way."""
    return stored.join(live.select(day).distinct(), day, "left_anti").unionByName(live)


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS people FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 14 GROUP BY 1""")
def days_with_today(spark, sf_dir):
    """The last fourteen days: stored ones, and today from the log."""
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    today = events.agg(F.max("day").alias("today"))
    rows = events.join(F.broadcast(today), F.lit(True))
    rolled = lambda x: x.groupBy("day").agg(F.count("*").alias("views"), F.countDistinct("user_id").alias("people"))
    return stored_and_live(rolled(rows.where("day < today AND day > date_sub(today, 14)")), rolled(rows.where("day = today")), "day")


def page(df: DataFrame, size: int, number: int, *order) -> DataFrame:
    """One page of an ordered list, from 0; sizes are clamped to 1 to 100: the limit is the feature."""
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset(size * max(number, 0)).limit(size)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def people_page(spark, sf_dir):
    return page(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), 25, 2, F.desc("c_acctbal"), "c_custkey")


@query("SELECT event_type AS screen, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY 1 ORDER BY n DESC, screen LIMIT 3")
def top_screens(spark, sf_dir):
    """The most seen screens: three rows, the report itself."""
    found = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("screen")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("people"))
    return found.orderBy(F.desc("n"), "screen").limit(3)


@query("""WITH g AS (SELECT s_suppkey, s_acctbal, s_nationkey, CASE WHEN s_acctbal > 8000 THEN 1 WHEN s_acctbal > 4000 THEN 2 WHEN s_acctbal > 0 THEN 3 ELSE 4 END AS look FROM supplier)
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY look, s_suppkey % 7 <> 0, s_acctbal DESC, s_suppkey) AS place FROM g""")
def gauge_order(spark, sf_dir):
    """Gauges of each basin in the order of a list: how they look, one's own first, by rise, then by code."""
    look = F.when(F.col("s_acctbal") > 8000, 1).when(F.col("s_acctbal") > 4000, 2).when(F.col("s_acctbal") > 0, 3).otherwise(4)
    w = Window.partitionBy("s_nationkey").orderBy(look, F.col("s_suppkey") % 7 != 0, F.desc("s_acctbal"), "s_suppkey")
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.row_number().over(w).alias("place"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'return', l_orderkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50
UNION ALL SELECT 'alarm', event_id, ts FROM events WHERE event_type = 'error' AND value >= 100""")
def decision_feed(spark, sf_dir):
    """Decisions of three tables as one feed."""
    row = lambda df, kind, i, at: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(at).alias("at"))
    orders = row(load(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "order", "o_orderkey", "o_orderdate")
    returns = row(load(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 50"), "return", "l_orderkey", "l_shipdate")
    alarms = row(load(spark, sf_dir, "events").where("event_type = 'error' AND value >= 100"), "alarm", "event_id", "ts")
    return orders.unionByName(returns).unionByName(alarms)


@query("""WITH a AS (SELECT n_name AS name, n_nationkey AS k, 1 AS source FROM nation UNION ALL SELECT upper(r_name), r_regionkey, 2 FROM region UNION ALL SELECT DISTINCT 'NATION_' || (s_nationkey + 5), s_nationkey, 3 FROM supplier)
SELECT name, arg_min(k, (source, k)) AS k, min(source) AS source FROM a GROUP BY 1""")
def merged_places(spark, sf_dir):
    """Place lists merged: of equal names the first list's entry stays."""
    lists = [
        load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), F.lit(1).alias("source")),
        load(spark, sf_dir, "region").select(F.upper("r_name").alias("name"), F.col("r_regionkey").alias("k"), F.lit(2).alias("source")),
        load(spark, sf_dir, "supplier").select(F.concat(F.lit("NATION_"), (F.col("s_nationkey") + 5).cast("string")).alias("name"), F.col("s_nationkey").alias("k"), F.lit(3).alias("source")).distinct(),
    ]
    rows = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return rows.groupBy("name").agg(F.min_by("k", F.struct("source", "k")).alias("k"), F.min("source").alias("source"))


@query("SELECT c_nationkey AS area FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def areas_of_both(spark, sf_dir):
    watched = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("area"))
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area")).intersect(watched)


def retained(rows: DataFrame, ts: str, now: Column, keep_days: int, anonymous_after_days: int, personal: list[str]) -> DataFrame:
    """Rows no older than ``keep_days``; personal columns are emptied after ``anonymous_after_days``."""
    age = lambda days: F.col(ts) < now - F.make_dt_interval(days=F.lit(days))
    return rows.where(~age(keep_days)).withColumns({c: F.when(~age(anonymous_after_days), F.col(c)) for c in personal})


@query("""SELECT event_id, CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN user_id END AS user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY""")
def log_retention(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    rows = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))), F.lit(True))
    return retained(rows, "ts", F.col("now"), 20, 7, ["user_id"]).select("event_id", "user_id", "event_type")


def due(wanted: DataFrame, sent: DataFrame, *key: str) -> DataFrame:
    """What a log of sent notices does not have yet, each key once: appending the result to the log makes each notice go out once."""
    return wanted.dropDuplicates(list(key)).join(sent.select(*key).distinct(), list(key), "left_anti")


@query("""WITH w AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'), s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase')
SELECT * FROM w EXCEPT SELECT * FROM s""")
def notices_due(spark, sf_dir):
    """One notice a person and day with an error, but for those that the log has (here: days with a purchase)."""
    rows = lambda kind: load(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"))
    return due(rows("error"), rows("purchase"), "user_id", "day")


@query("""WITH a AS (SELECT page_id, ['Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) AppleWebKit Version/17.0 Mobile Safari/604.1', 'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36', 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0',
 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Gecko/20100101 Firefox/121.0', 'curl/8.0'][page_id % 5 + 1] AS ua FROM pages)
SELECT page_id, CASE WHEN regexp_matches(ua, 'iPad|Tablet') THEN 'tablet' WHEN regexp_matches(ua, 'Mobi|iPhone|Android') THEN 'phone' WHEN regexp_matches(ua, 'Windows|Macintosh|X11') THEN 'computer' ELSE 'other' END AS device,
CASE WHEN regexp_matches(ua, 'iPhone|iPad') THEN 'ios' WHEN ua LIKE '%Android%' THEN 'android' WHEN ua LIKE '%Windows%' THEN 'windows' WHEN ua LIKE '%Mac OS X%' THEN 'macos' ELSE 'other' END AS os,
CASE WHEN ua LIKE '%Edg/%' THEN 'edge' WHEN ua LIKE '%Firefox/%' THEN 'firefox' WHEN ua LIKE '%Chrome/%' THEN 'chrome' WHEN ua LIKE '%Safari/%' THEN 'safari' ELSE 'other' END AS browser FROM a""")
def user_agents(spark, sf_dir):
    agents = [
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) AppleWebKit Version/17.0 Mobile Safari/604.1", "Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36",
        "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Gecko/20100101 Firefox/121.0", "curl/8.0",
    ]
    rows = load(spark, sf_dir, "pages").select("page_id", F.get(F.array(*[F.lit(x) for x in agents]), (F.col("page_id") % 5).cast("int")).alias("ua"))
    return rows.select("page_id", *[c.alias(n) for n, c in text.agent(F.col("ua")).items()])


@query("""WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part), q AS (SELECT unnest(['part 1', 'part', '12']) AS q)
SELECT q, p_partkey, CASE WHEN name = q THEN 100 WHEN starts_with(name, q) THEN CASE WHEN 2 * length(q) > length(name) THEN 90 ELSE 70 END WHEN contains(name, q) THEN 50 END AS score FROM p, q WHERE contains(name, q)""")
def name_hits(spark, sf_dir):
    """How well each of a few asked-for names is hit by each record's."""
    rows = load(spark, sf_dir, "part").select("p_partkey", text.normal_name(F.col("p_name")).alias("name"), F.explode(F.array(*[F.lit(x) for x in ("part 1", "part", "12")])).alias("q"))
    return rows.select("q", "p_partkey", text.hit_score(F.col("name"), F.col("q")).alias("score")).where("score IS NOT NULL")


@query("""WITH g AS (SELECT o_orderpriority, avg(o_totalprice) / 5000 AS v, quantile_cont(o_totalprice, 0.25) / 5000 AS a, quantile_cont(o_totalprice, 0.75) / 5000 AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, CASE WHEN b <= 12 THEN floor(a)::BIGINT || '-' || ceil(b)::BIGINT || ' h' ELSE printf('%.1f-%.1f d', floor(a / 12) / 2, ceil(b / 12) / 2) END AS range FROM g""")
def typical_ranges(spark, sf_dir):
    """From the lower to the upper quartile, widened outward to whole hours or half days."""
    q = quantiles.percentiles(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"a": 0.25, "b": 0.75})
    return q.select("o_orderpriority", text.range_text(F.col("a") / 5000, F.col("b") / 5000).alias("range"))


@query("SELECT c_custkey, sha256('salt:' || c_custkey) AS anonymous, left(sha256('salt:' || c_custkey), 8) AS short FROM customer")
def anonymous_ids(spark, sf_dir):
    whole = F.sha2(F.concat(F.lit("salt:"), F.col("c_custkey").cast("string")), 256)
    return load(spark, sf_dir, "customer").select("c_custkey", whole.alias("anonymous"), F.left(whole, F.lit(8)).alias("short"))


@query("""WITH t AS (SELECT o_orderkey, 1 + o_totalprice / 100000 AS cand, o_orderpriority = '1-URGENT' AS flood, (o_orderkey % 13)::DOUBLE AS lead FROM orders), c AS (SELECT unnest([1.5, 2.0, 2.5, 3.0, 3.5]) AS limit_at),
s AS (SELECT limit_at, count(*) FILTER (cand >= limit_at AND flood) AS hits, count(*) FILTER (cand < limit_at AND flood) AS misses, count(*) FILTER (cand >= limit_at AND NOT flood) AS fa, quantile_cont(lead, 0.5) FILTER (cand >= limit_at AND flood) AS lead FROM t, c GROUP BY 1)
SELECT limit_at, hits, round(hits / (hits + misses + fa), 6) AS csi, lead FROM s WHERE lead >= 3 ORDER BY hits / (hits + misses + fa) DESC, hits DESC, lead DESC, limit_at LIMIT 1""")
def chosen_limit(spark, sf_dir):
    """The candidate limit with the best score among those with a median lead of three hours: one row, the report itself."""
    t = load(spark, sf_dir, "orders").select((1 + F.col("o_totalprice") / 100000).alias("cand"), (F.col("o_orderpriority") == "1-URGENT").alias("flood"), (F.col("o_orderkey") % 13).cast("double").alias("lead"))
    both = t.withColumn("limit_at", F.explode(F.array(*[F.lit(x) for x in (1.5, 2.0, 2.5, 3.0, 3.5)])))
    said = F.col("cand") >= F.col("limit_at")
    # leads are a few whole hours: their counts give the median
    s = both.groupBy("limit_at").agg(
        F.count_if(said & F.col("flood")).alias("hits"), F.count_if(~said & F.col("flood")).alias("misses"), F.count_if(said & ~F.col("flood")).alias("fa"), F.expr("median(lead) FILTER (WHERE cand >= limit_at AND flood)").alias("lead")
    ).where("lead >= 3")
    csi = F.col("hits") / (F.col("hits") + F.col("misses") + F.col("fa"))
    top = s.withColumn("csi", csi).agg(F.max_by(F.struct("limit_at", "hits", "csi", "lead"), F.struct("csi", "hits", "lead", -F.col("limit_at"))).alias("x")).where("x IS NOT NULL")
    return top.select("x.limit_at", "x.hits", F.round("x.csi", 6).alias("csi"), "x.lead")
