"""Tidy archive of series, payloads and exports.

An archive is a Parquet folder partitioned by variable and month, columns (entity, variable, ts, value, unit, source).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITIONS = ("variable", "month")


def with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("ts", "yyyy-MM"))


def dealt(rows: DataFrame, parts: int = 16) -> DataFrame:
    """Rows dealt by variable, month and a share of the entities, so a large month is several tasks' work; each is sorted for reading."""
    share = F.pmod(F.xxhash64("entity"), F.lit(parts))
    return rows.repartition(*PARTITIONS, share).sortWithinPartitions(*PARTITIONS, "entity", "ts")


def write_archive(rows: DataFrame, path: str) -> None:
    dealt(with_month(rows)).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


def read_series(spark: SparkSession, path: str, variable: str, start: str, end: str, entities: list | None = None) -> DataFrame:
    """Rows with start <= ts < end: only the partitions of these months are opened, the rest is a pushed filter."""
    rows = spark.read.parquet(path).where((F.col("variable") == variable) & (F.col("month") >= start[:7]) & (F.col("month") <= end[:7]))
    rows = rows.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows if entities is None else rows.where(F.col("entity").isin(entities))


def merge_archive(new: DataFrame, path: str, keys: tuple[str, ...] = ("entity", "variable", "ts"), newest: Column | None = None) -> int:
    """New rows merged into the partitions that they change; of rows with equal keys a new one stays. Returns how many partitions changed.

    Of equal new rows the one with the largest ``newest`` stays, by default the largest value. Partitions in which the new rows
    say nothing new are left alone, so repeats change nothing. Changed partitions are first written whole to a folder of
    their own beside the archive, a new one each time.
    """
    spark = new.sparkSession
    fresh = with_month(new)
    last = Window.partitionBy(*keys).orderBy((F.col("value") if newest is None else newest).desc_nulls_last())
    fresh = fresh.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    old = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    columns = [c for c in old.columns if c in fresh.columns]
    there = old.join(fresh.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi")
    news = fresh.select(*columns).exceptAll(there.select(*columns))
    touched = news.select(*PARTITIONS).distinct()
    fresh = fresh.join(touched, list(PARTITIONS), "left_semi")
    kept = old.join(touched, list(PARTITIONS), "left_semi").join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)
    aside = f"{path.rstrip('/')}_merging_{uuid.uuid4().hex}"
    kept.write.partitionBy(*PARTITIONS).parquet(aside)
    staged = spark.read.schema(kept.schema).parquet(aside)
    changed = staged.select(*PARTITIONS).distinct().count()
    if changed:
        dealt(staged.select(*kept.columns)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    return changed


CLOCK = "Asia/Bangkok"  # payloads have the clock of their place
LEVELS = "data struct<graph_data: array<struct<datetime: string, value: string, discharge: string>>>"
RAIN = "data array<struct<rainfall_datetime: string, rainfall_value: string, date_time: string, rainfall: string>>"
DAM = "data struct<graph_data: array<struct<data: array<struct<date: string, value: string>>>>>"


def _tidy(points: DataFrame, ts: Column, measures: dict[str, tuple[str, Column]], clock: str) -> DataFrame:
    """One tidy row for each measure (variable -> unit, text) that is a number, at a time that is one; zone suffixes are dropped."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), value.try_cast("double").alias("value"), F.lit(u).alias("unit")) for v, (u, value) in measures.items()]))
    moment = F.to_utc_timestamp(F.substring(ts, 1, 19).try_cast("timestamp"), clock)
    rows = points.select("entity", moment.alias("ts"), each.alias("m")).select("entity", "m.variable", "ts", "m.value", "m.unit")
    return rows.where("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")


def level_payload(raw: DataFrame, body: str, entity: str, variable: str = "waterlevel", unit: str = "m", clock: str = CLOCK) -> DataFrame:
    """Tidy rows of level payloads, levels and discharges; values that are no numbers, and times that are none, are left out."""
    points = raw.select(F.col(entity).alias("entity"), F.explode(F.from_json(body, LEVELS)["data"]["graph_data"]).alias("p"))
    return _tidy(points, F.col("p.datetime"), {variable: (unit, F.col("p.value")), "discharge": ("m3/s", F.col("p.discharge"))}, clock)


def rain_payload(raw: DataFrame, body: str, entity: str, variable: str = "rain_daily", clock: str = CLOCK) -> DataFrame:
    """Tidy rows of rain payloads, hourly, daily or monthly: which of them, ``variable`` says."""
    points = raw.select(F.col(entity).alias("entity"), F.explode(F.from_json(body, RAIN)["data"]).alias("p"))
    value = F.coalesce("p.rainfall_value", "p.rainfall")
    return _tidy(points, F.coalesce("p.rainfall_datetime", "p.date_time"), {variable: ("mm", value)}, clock)


def dam_payload(raw: DataFrame, body: str, entity: str, variable: str, clock: str = CLOCK) -> DataFrame:
    """Tidy rows of dam payloads, by hour or by day: one variable a payload, its years one after another."""
    years = raw.select(F.col(entity).alias("entity"), F.explode(F.from_json(body, DAM)["data"]["graph_data"]).alias("y"))
    points = years.select("entity", F.explode("y.data").alias("p"))
    return _tidy(points, F.col("p.date"), {variable: ("m" if variable == "dam_level" else "Mm3", F.col("p.value"))}, clock)


def grid_text(lines: DataFrame, lons: list[float], lats: list[float]) -> DataFrame:
    """(start, mean) of a text of grids: a header line with ``cpt:T=`` begins a grid, then a line of longitudes, then a line for each
    latitude; the mean is over the chosen cells that have a value.

    ``lines`` is (file, no, value), the lines of each file by number.
    """
    order = Window.partitionBy("file").orderBy("no")
    header = F.regexp_extract("value", r"cpt:T=([0-9-]+)", 1)
    fill = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("_start", fill(F.when(header != "", header))).withColumn("_cells", F.split(F.col("value"), "\\t"))
    rows = rows.withColumn("_longitudes", F.coalesce(F.lag(header != "").over(order), F.lit(False)))
    rows = rows.withColumn("_lons", fill(F.when(F.col("_longitudes"), F.col("_cells")))).where(~F.col("_longitudes") & (header == "") & F.col("_start").isNotNull())
    cells = rows.select("file", "_start", F.get("_cells", F.lit(0)).try_cast("double").alias("lat"), F.posexplode("_cells").alias("at", "cell"), "_lons").where("at > 0")
    cells = cells.withColumn("lon", F.get("_lons", F.col("at")).try_cast("double")).withColumn("v", F.col("cell").try_cast("double"))
    return cells.where(F.col("lon").isin(lons) & F.col("lat").isin(lats) & (F.col("v") > -999)).groupBy("file", F.col("_start").alias("start")).agg(F.avg("v").alias("mean"))


def index_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """(season, year, total, anomaly) of a text of seasonal index values; other lines are left out."""
    parts = F.split(F.trim(F.col(value)), r"\s+")
    rows = lines.where(F.trim(F.col(value)).rlike(r"^[A-Z]{3}\s+[0-9]{4}\s+-?[0-9.]+\s+-?[0-9.]+$"))
    return rows.select(parts[0].alias("season"), parts[1].cast("int").alias("year"), parts[2].cast("double").alias("total"), parts[3].cast("double").alias("anomaly"))


def replayed(rows: DataFrame, ts: str, begin: Column, speed: float) -> DataFrame:
    """Archive rows with ``due``, when they come up if the archive is replayed from ``begin`` on at so many times its speed."""
    first = rows.agg(F.min(ts).alias("_first"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    due = micros(begin) + (micros(F.col(ts)) - micros(F.col("_first"))) / speed
    return rows.join(F.broadcast(first), F.lit(True)).withColumn("due", F.timestamp_micros(F.round(due).cast("long"))).drop("_first")


def zipped(df: DataFrame, times: str, values: str, *keep: str) -> DataFrame:
    """Parallel arrays as rows; a missing partner is NULL."""
    pairs = F.explode(F.arrays_zip(F.col(times).alias("ts"), F.col(values).alias("value"))).alias("x")
    return df.select(*keep, pairs).select(*keep, "x.*")


def with_previous(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """A fresh list with what only the old list had, and first_seen from the old one."""
    seen = old.select(key, F.col("first_seen").alias("_seen"))
    current = new.join(seen, key, "left").withColumn("first_seen", F.coalesce("_seen", "first_seen")).drop("_seen")
    return current.unionByName(old.join(new.select(key), key, "left_anti"))


def write_csv(df: DataFrame, path: str) -> None:
    from tidemark.operators.relational import guarded_csv

    safe = guarded_csv(df)
    # spreadsheets take a file for UTF-8 by its byte-order mark, here before the first column's name
    safe.toDF("\ufeff" + safe.columns[0], *safe.columns[1:]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_raw(df: DataFrame, column: str, path: str) -> None:
    """One text a line, gzipped."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def as_feature(lon: Column, lat: Column, *properties: str) -> Column:
    """A GeoJSON point feature; lines of them make a newline-delimited file."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def xml_rows(df: DataFrame, body: str, path: str, fields: dict[str, str]) -> DataFrame:
    """One row for each node at a path like /root/list/node of an XML text, with fields by name of the child element; NULL without it."""
    _, *above, node = path.strip("/").split("/")
    kind = f"{node}: array<struct<{', '.join(f'{tag}: string' for tag in fields.values())}>>"
    for name in reversed(above):
        kind = f"{name}: struct<{kind}>"
    parsed = df.select(F.from_xml(F.col(body), f"struct<{kind}>").alias("_x"))
    rows = parsed.select(F.explode(F.col(".".join(["_x", *above, node]))).alias("n"))
    return rows.select(*[F.col(f"n.{tag}").alias(name) for name, tag in fields.items()])
