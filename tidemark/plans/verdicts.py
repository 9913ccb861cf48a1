"""Votes and agreements over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import votes
from tidemark.plans.registry import registry
from tidemark.tables import load

query, QUERIES, ORACLES = registry()


@query("""WITH c AS (SELECT l_partkey AS crossing, avg((l_returnflag = 'R')::INT) FILTER (l_linenumber % 2 = 0) AS f0, avg((l_returnflag = 'R')::INT) FILTER (l_linenumber % 2 = 1) AS f1,
avg(l_quantity::DOUBLE) FILTER (l_linenumber % 2 = 0) AS h0, avg(l_quantity::DOUBLE) FILTER (l_linenumber % 2 = 1) AS h1 FROM lineitem GROUP BY 1),
s AS (SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size % 3 END AS stream, CASE WHEN abs(f0 - f1) >= 0.1 THEN CASE WHEN f0 > f1 THEN 0 ELSE 1 END END AS f, CASE WHEN abs(h0 - h1) >= 4 THEN CASE WHEN h0 > h1 THEN 0 ELSE 1 END END AS h FROM part LEFT JOIN c ON crossing = p_partkey)
SELECT p_partkey, coalesce(f, stream, h) AS side, CASE WHEN f IS NOT NULL THEN 'flow' WHEN stream IS NOT NULL THEN 'crossing' WHEN h IS NOT NULL THEN 'height' ELSE 'unclear' END AS decided_by, f = h AS agree FROM s""")
def upstream_votes(spark, sf_dir):
    """The upstream side of each crossing by flow, stream and height, each with its margin, and whether flow and height agree."""
    left = F.col("l_linenumber") % 2 == 0
    mean = lambda v, on, name: F.avg(F.when(on, v)).alias(name)
    toward, height = (F.col("l_returnflag") == "R").cast("int"), F.col("l_quantity").cast("double")
    sides = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(mean(toward, left, "f0"), mean(toward, ~left, "f1"), mean(height, left, "h0"), mean(height, ~left, "h1"))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 < 2, F.col("p_size") % 3).cast("int").alias("stream")).join(sides, "p_partkey", "left")
    vote = votes.upstream_vote((F.col("f0"), F.col("f1")), (F.col("h0"), F.col("h1")), F.col("stream"), 0.1, 4.0)
    return rows.select("p_partkey", vote.alias("v")).select("p_partkey", "v.*")


@query("""WITH d AS (SELECT o_orderdate AS day, sum(o_totalprice) FILTER (o_orderkey % 2 = 0) / 20000 AS a, sum(o_totalprice) FILTER (o_orderkey % 2 = 1) / 20000 AS b FROM orders GROUP BY 1)
SELECT day, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(a, b) < 5 OR abs(a - b) < 10 OR greatest(a, b) < least(a, b) * 1.5 THEN 'agree' WHEN greatest(a, b) > least(a, b) * 3 AND abs(a - b) >= 30 THEN 'far apart' ELSE 'differ' END AS verdict FROM d""")
def totals_agreement(spark, sf_dir):
    """Whether two sources' totals of each day would make a reader act alike."""
    total = lambda rest, name: (F.sum(F.when(F.col("o_orderkey") % 2 == rest, F.col("o_totalprice"))) / 20000).alias(name)
    days = load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(total(0, "a"), total(1, "b"))
    return days.select("day", votes.totals_agree(F.col("a"), F.col("b")).alias("verdict"))


@query("""WITH p AS (SELECT l_partkey AS cell, [0, 1, 2, 3, 250, 251, 255][(l_orderkey * 3 + l_linenumber * 5) % 7 + 1] AS code FROM lineitem),
s AS (SELECT cell, count(*) FILTER (code <= 3) AS valid, count(*) FILTER (code BETWEEN 1 AND 3) AS flooded, max(CASE WHEN code IN (1, 3) THEN 1 ELSE 0 END) + 2 * max(CASE WHEN code IN (2, 3) THEN 1 ELSE 0 END) AS bits, bool_or(code = 251) AS water, bool_or(code = 250) AS masked FROM p GROUP BY 1)
SELECT cell, CASE WHEN valid > 0 THEN bits WHEN water THEN 251 WHEN masked THEN 250 ELSE 255 END AS extent, valid, flooded FROM s""")
def passes_union(spark, sf_dir):
    """Of all passes over each cell the union of what they saw, how many saw it, and in how many it was flooded."""
    codes = F.array(*[F.lit(c) for c in (0, 1, 2, 3, 250, 251, 255)])
    code = F.get(codes, ((F.col("l_orderkey") * 3 + F.col("l_linenumber") * 5) % 7).cast("int"))
    return votes.passes_combined(load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), code.alias("code")), "cell")
