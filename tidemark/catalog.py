"""Query name -> builder, and query name -> SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import answers, boards, life_cycle, limits, places, reports, reports_whole, science, series, shapes, states, timeseries, verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (timeseries, series, boards, places, life_cycle, reports, states, answers, science, reports_whole, shapes, limits, verdicts):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
