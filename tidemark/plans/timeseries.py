"""Queries over the event log as a set of series: entity is the event type."""

from __future__ import annotations

from tidemark.operators import daily
from tidemark.tables import load


def q_daily_floor(spark, sf_dir):
    return daily.daily_floor(load(spark, sf_dir, "events"), "event_type", "ts", "value")


def q_rose_days(spark, sf_dir):
    return daily.rose_days(q_daily_floor(spark, sf_dir))


_FLOOR = """
SELECT event_type AS entity, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_day, min(value) AS floor, count(*) AS n_rows
FROM events WHERE value IS NOT NULL GROUP BY ALL
"""

QUERIES = {"daily_floor": q_daily_floor, "rose_days": q_rose_days}
ORACLES = {
    "daily_floor": _FLOOR,
    "rose_days": f"""
WITH f AS ({_FLOOR}), s AS (
  SELECT *, CASE WHEN date_diff('day', lag(local_day) OVER w, local_day) = 1
            THEN CAST(floor > lag(floor) OVER w AS INT) END AS rose
  FROM f WINDOW w AS (PARTITION BY entity ORDER BY local_day))
SELECT entity, local_day, floor, n_rows,
  CASE WHEN count(rose) OVER l = 7 THEN sum(rose) OVER l END AS rose_days
FROM s WINDOW l AS (PARTITION BY entity ORDER BY local_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""",
}
