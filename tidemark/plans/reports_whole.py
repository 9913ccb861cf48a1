"""Whole answers: the situation report, the usage dashboard, the case board, the coverage map and feedback figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import relational as r
from tidemark.plans.registry import registry
from tidemark.tables import load

query, QUERIES, ORACLES = registry()


@query("""WITH a AS (SELECT n_nationkey AS area, n_name AS name FROM nation), p AS (SELECT c_nationkey AS area, count(*) AS people, count(*) FILTER (c_acctbal < 0) AS in_need FROM customer GROUP BY 1),
o AS (SELECT c_nationkey AS area, count(*) AS cases, count(*) FILTER (o_orderstatus = 'O') AS open_cases, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS urgent, max(o_orderdate) AS newest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
t AS (SELECT s_nationkey AS area, count(*) AS teams, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS team_list FROM supplier GROUP BY 1), e AS (SELECT user_id % 25 AS area, count(*) AS reports, count(DISTINCT user_id) AS reporters FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT area, name, coalesce(people, 0) AS people, coalesce(in_need, 0) AS in_need, coalesce(cases, 0) AS cases, coalesce(open_cases, 0) AS open_cases, coalesce(urgent, 0) AS urgent, newest, coalesce(teams, 0) AS teams, team_list,
coalesce(reports, 0) AS reports, coalesce(reporters, 0) AS reporters FROM a LEFT JOIN p USING (area) LEFT JOIN o USING (area) LEFT JOIN t USING (area) LEFT JOIN e USING (area)""")
def situation_report(spark, sf_dir):
    """Of every area what is known of people, cases, teams and reports, zeros where there is nothing."""
    area = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("name"))
    customers = load(spark, sf_dir, "customer")
    people = customers.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("people"), F.count_if(F.col("c_acctbal") < 0).alias("in_need"))
    home = customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("area"))
    is_open = F.col("o_orderstatus") == "O"
    cases = load(spark, sf_dir, "orders").join(home, "o_custkey").groupBy("area").agg(
        F.count("*").alias("cases"), F.count_if(is_open).alias("open_cases"), F.count_if(is_open & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent"), F.max("o_orderdate").alias("newest")
    )
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",")
    teams = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.count("*").alias("teams"), listed.alias("team_list"))
    reports = load(spark, sf_dir, "events").where("event_type = 'error'").groupBy((F.col("user_id") % 25).alias("area")).agg(F.count("*").alias("reports"), F.countDistinct("user_id").alias("reporters"))
    whole = reduce(lambda x, y: x.join(y, "area", "left"), (people, cases, teams, reports), area)
    return whole.fillna(0, ["people", "in_need", "cases", "open_cases", "urgent", "teams", "reports", "reporters"])


def _figures(df: DataFrame, figure: str, key, value) -> DataFrame:
    return df.select(F.lit(figure).alias("figure"), key.cast("string").alias("key"), value.cast("double").alias("value"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type, ts FROM events), m AS (SELECT max(day) AS today FROM d),
s AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT 'views of the day' AS figure, CAST(day AS VARCHAR) AS key, count(*)::DOUBLE AS value FROM d, m WHERE day > today - 14 GROUP BY day
UNION ALL SELECT 'people of the day', CAST(day AS VARCHAR), count(DISTINCT user_id)::DOUBLE FROM d, m WHERE day > today - 14 GROUP BY day
UNION ALL SELECT 'views of the screen', event_type, count(*)::DOUBLE FROM d GROUP BY event_type
UNION ALL SELECT 'views of the hour', CAST(hour(ts) AS VARCHAR), count(*)::DOUBLE FROM d GROUP BY hour(ts)
UNION ALL SELECT 'seen in six minutes', 'all', count(*)::DOUBLE FROM s WHERE last >= (SELECT max(ts) FROM events) - INTERVAL 6 MINUTE
UNION ALL SELECT 'people in all', 'all', count(*)::DOUBLE FROM s""")
def usage_dashboard(spark, sf_dir):
    """The figures of the usage page as one table."""
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    end = events.agg(F.max("day").alias("today"), F.max("ts").alias("now"))
    rows = events.join(F.broadcast(end), F.lit(True))
    days = rows.where("day > date_sub(today, 14)").groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("people"))
    screens, hours = (events.groupBy(k).agg(F.count("*").alias("n")) for k in ("event_type", F.hour("ts").alias("hour")))
    people = rows.groupBy("user_id").agg((F.max("ts") >= F.max("now") - F.expr("INTERVAL 6 MINUTES")).alias("live")).agg(F.count_if("live").alias("live"), F.count("*").alias("n"))
    parts = (
        _figures(days, "views of the day", F.col("day"), F.col("n")), _figures(days, "people of the day", F.col("day"), F.col("people")), _figures(screens, "views of the screen", F.col("event_type"), F.col("n")),
        _figures(hours, "views of the hour", F.col("hour"), F.col("n")), _figures(people, "seen in six minutes", F.lit("all"), F.col("live")), _figures(people, "people in all", F.lit("all"), F.col("n")),
    )
    return reduce(DataFrame.unionByName, parts)


@query("""WITH l AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS need, max(l_shipdate) AS last_action, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, c_nationkey AS area, o_orderpriority, coalesce(items, 0) AS items, round(coalesce(need, 0), 4) AS need, last_action,
  least(40, coalesce(items, 0) * 5) + least(30, floor(coalesce(need, 0) / 10)::INT) + CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 20 ELSE 0 END - CASE WHEN returned > 0 THEN 10 ELSE 0 END AS priority
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')
SELECT *, row_number() OVER (PARTITION BY area ORDER BY priority DESC, o_orderkey) AS place FROM b""")
def case_board(spark, sf_dir):
    """Open cases of each area with what they need, the last action, a priority from its parts, and their place in the queue."""
    items = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("items"), F.sum("l_quantity").alias("need"), F.max("l_shipdate").alias("last_action"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )
    home = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("area"))
    rows = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(home, "o_custkey").join(items, "o_orderkey", "left").fillna(0, ["items", "need"])
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 30).when(F.col("o_orderpriority") == "2-HIGH", 20).otherwise(0)
    score = F.least(F.lit(40), F.col("items") * 5) + F.least(F.lit(30), F.floor(F.col("need") / 10).cast("int")) + rank - F.when(F.col("returned") > 0, 10).otherwise(0)
    found = rows.select("o_orderkey", "area", "o_orderpriority", "items", F.round("need", 4).alias("need"), "last_action", score.alias("priority"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("priority"), "o_orderkey")))


@query("""WITH c AS (SELECT c_nationkey AS area, count(*) AS people FROM customer GROUP BY 1), t AS (SELECT s_nationkey AS area, count(*) AS teams, count(*) FILTER (s_acctbal > 2000) AS ready FROM supplier GROUP BY 1)
SELECT n_nationkey AS area, coalesce(people, 0) AS people, coalesce(teams, 0) AS teams, coalesce(ready, 0) AS ready, CASE WHEN coalesce(teams, 0) = 0 THEN 'none' WHEN coalesce(ready, 0) = 0 THEN 'not ready' WHEN people / ready > 60 THEN 'thin' ELSE 'covered' END AS state
FROM nation LEFT JOIN c ON c.area = n_nationkey LEFT JOIN t ON t.area = n_nationkey""")
def coverage_map(spark, sf_dir):
    """How far each area is covered by teams that are ready."""
    people = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("people"))
    teams = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.count("*").alias("teams"), F.count_if(F.col("s_acctbal") > 2000).alias("ready"))
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area")).join(people, "area", "left").join(teams, "area", "left").fillna(0)
    state = F.when(F.col("teams") == 0, "none").when(F.col("ready") == 0, "not ready").when(F.try_divide("people", "ready") > 60, "thin").otherwise("covered")
    return rows.withColumn("state", state)


@query("""WITH f AS (SELECT user_id % 12 AS area, event_type AS choice, user_id FROM events WHERE event_type IN ('click', 'signup', 'purchase')), g AS (SELECT area, choice, count(*) AS n, count(DISTINCT user_id) AS people FROM f GROUP BY 1, 2), t AS (SELECT area, count(DISTINCT user_id) AS asked FROM f GROUP BY 1)
SELECT area, choice, CASE WHEN people >= 5 THEN n END AS n, CASE WHEN people >= 5 THEN round(people / asked, 6) END AS share, asked FROM g JOIN t USING (area)""")
def feedback_figures(spark, sf_dir):
    """Answers by area and choice, withheld under five people, with the share of those asked."""
    f = load(spark, sf_dir, "events").where("event_type IN ('click', 'signup', 'purchase')").select((F.col("user_id") % 12).alias("area"), F.col("event_type").alias("choice"), "user_id")
    g = f.groupBy("area", "choice").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("people"))
    asked = f.groupBy("area").agg(F.countDistinct("user_id").alias("asked"))
    shares = g.join(asked, "area").withColumn("share", F.round(F.col("people") / F.col("asked"), 6))
    return r.suppressed(shares, "people", 5, "n", "share").drop("people")
