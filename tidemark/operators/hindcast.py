"""Warning levels scored against past floods: all candidate levels of all series in one pass over the hours.

An hour stands for each candidate level that it reaches; over (series, level), sorted once, hours make alarms, bridging short
gaps. An alarm is a hit when a flood begins while it stands or within a window of its start; a flood's lead is the time from the
first alarm that catches it. Rows are shared among tasks by series and level, so a long series is as many tasks' work as it has
candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS = 3600


def spells_at(hours: DataFrame, levels: DataFrame, gap_hours: float, least: int = 1) -> DataFrame:
    """(entity, level, start, end, n): runs of hours at or over each level, gaps of up to ``gap_hours`` missing or lower hours bridged.

    ``hours`` is (entity, hour, value), ``levels`` (entity, level).
    """
    over = hours.where(F.col("value").isNotNull()).join(levels, "entity").where("value >= level").select("entity", "level", "hour", F.unix_timestamp(F.col("hour").cast("timestamp")).alias("at"))
    w = Window.partitionBy("entity", "level").orderBy("at")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > (gap_hours + 1) * SECONDS, F.lit(True)).cast("int")
    numbered = over.withColumn("_new", new).withColumn("_spell", F.sum("_new").over(w))
    found = numbered.groupBy("entity", "level", "_spell").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("_spell")


def scores(alarms: DataFrame, onsets: DataFrame, levels: DataFrame, window_hours: float) -> DataFrame:
    """(entity, level, floods, alarms, hits, false_alarms, detected, csi, median_lead_h) of each candidate level.

    ``alarms`` is (entity, level, start, end), ``onsets`` (entity, onset), in seconds.
    """
    floods = onsets.groupBy("entity").agg(F.count("*").alias("floods"))
    until = F.greatest(F.col("end"), F.col("start") + window_hours * SECONDS)
    met = alarms.select("entity", "level", "start", "end").join(onsets, "entity").where((F.col("onset") >= F.col("start")) & (F.col("onset") <= until))
    leads = met.groupBy("entity", "level", "onset").agg(((F.col("onset") - F.min("start")) / SECONDS).alias("lead"))
    leads = leads.groupBy("entity", "level").agg(F.count("*").alias("detected"), F.median("lead").alias("median_lead_h"))
    hits = met.select("entity", "level", "start").distinct().groupBy("entity", "level").agg(F.count("*").alias("hits"))
    said = alarms.groupBy("entity", "level").agg(F.count("*").alias("alarms"))
    rows = levels.select("entity", "level").distinct().join(floods, "entity", "left")
    for part in (said, hits, leads):
        rows = rows.join(part, ["entity", "level"], "left")
    rows = rows.na.fill(0, ["floods", "alarms", "hits", "detected"]).withColumn("false_alarms", F.col("alarms") - F.col("hits"))
    csi = F.when(F.col("floods") > 0, F.round(F.col("detected") / (F.col("floods") + F.col("false_alarms")), 2))
    return rows.withColumn("csi", csi).select("entity", "level", "floods", "alarms", "hits", "false_alarms", "detected", "csi", "median_lead_h")


def chosen(scored: DataFrame, lead_hours: float, allowed: Column) -> DataFrame:
    """(entity, level): of the allowed levels whose median lead is long enough the one with the best share of floods caught to floods and
    false alarms; ties go to more floods caught, then the longer lead, then the higher level."""
    timely = scored.where(allowed & (F.col("detected") > 0) & (F.col("median_lead_h") >= lead_hours))
    return timely.groupBy("entity").agg(F.max_by("level", F.struct("csi", "detected", "median_lead_h", "level")).alias("level"))


def suggested(
    hours: DataFrame, banks: DataFrame, offsets: list[float], warning_lead: float = 6, watch_lead: float = 24, gap_hours: float = 12, flood_gap_hours: float = 72, flood_hours: int = 1,
    window_hours: float = 72, min_floods: int = 3, min_days: float = 3 * 365.25, warning_share: float = 0.03, watch_share: float = 0.06, min_gap: float = 0.2,
) -> DataFrame:
    """(entity, floods, evacuate, warning, watch, method): levels of each series below its bank.

    ``hours`` is (entity, hour, value), ``banks`` (entity, bank). With enough floods and days, warning and watch are the best scoring levels
    that are not reached in more than a share of all hours, the watch at least ``min_gap`` below the warning; a series (or a watch)
    without such a level falls back to how far it rises on its fast days: the 95th percentile of positive rises over the lead.
    """
    hours = hours.where(F.col("value").isNotNull())
    levels = banks.select("entity", F.explode(F.array(*[F.round(F.col("bank") - o, 2) for o in offsets])).alias("level"))
    floods = spells_at(hours, banks.select("entity", F.col("bank").alias("level")), flood_gap_hours, flood_hours)
    onsets = floods.select("entity", F.col("start").alias("onset"))
    scored = scores(spells_at(hours, levels, gap_hours), onsets, levels, window_hours)
    seconds = F.unix_timestamp(F.col("hour").cast("timestamp"))
    record = hours.groupBy("entity").agg(
        ((F.max(seconds) - F.min(seconds)) / 86400).alias("days"),
        F.expr(f"percentile(value, array({1 - warning_share}D, {1 - watch_share}D))").alias("floors"),
    )
    later = hours.select("entity", (seconds).alias("at"), "value")
    fast = record.select("entity")
    for name, lead in (("rise_warning", warning_lead), ("rise_watch", watch_lead)):
        back = later.select("entity", (F.col("at") + int(lead * SECONDS)).alias("at"), F.col("value").alias("before"))
        rises = later.join(back, ["entity", "at"]).withColumn("up", F.col("value") - F.col("before")).where("up > 0")
        fast = fast.join(rises.groupBy("entity").agg(F.expr("percentile(up, 0.95D)").alias(name)), "entity", "left")
    known = banks.join(record, "entity").join(fast, "entity").join(onsets.groupBy("entity").agg(F.count("*").alias("floods")), "entity", "left").na.fill(0, ["floods"])
    enough = (F.col("floods") >= min_floods) & (F.col("days") >= min_days)
    judged = scored.drop("floods").join(known, "entity").where(enough)
    warning = chosen(judged, warning_lead, (F.col("level") <= F.col("bank") - 0.05) & (F.col("level") >= F.col("floors")[0])).withColumnRenamed("level", "warning_hindcast")
    known = known.join(warning, "entity", "left")
    risen = F.when(F.col("rise_warning").isNotNull(), F.round(F.col("bank") - F.greatest(F.lit(0.3), "rise_warning"), 2))
    known = known.withColumn("warning", F.coalesce("warning_hindcast", risen))
    below = judged.join(known.select("entity", "warning"), "entity")
    watch = chosen(below, watch_lead, (F.col("level") <= F.col("warning") - min_gap) & (F.col("level") >= F.col("floors")[1])).withColumnRenamed("level", "watch_hindcast")
    known = known.join(watch, "entity", "left")
    off = F.col("bank") - F.col("warning")
    further = F.greatest(F.lit(0.6), F.coalesce("rise_watch", F.lit(0.0)), off + F.greatest(F.lit(min_gap), off * 0.5))
    found = known.withColumn("watch", F.when(F.col("warning").isNotNull(), F.coalesce("watch_hindcast", F.round(F.col("bank") - further, 2))))
    by_record = F.col("warning_hindcast").isNotNull().cast("int") + F.col("watch_hindcast").isNotNull().cast("int")
    method = F.when(F.col("warning").isNull(), "none").when(by_record == 2, "hindcast").when(by_record == 1, "mixed").otherwise("rise")
    return found.select("entity", "floods", F.col("bank").alias("evacuate"), "warning", "watch", method.alias("method"))
