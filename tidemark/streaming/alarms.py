"""Structured Streaming: readings filtered and kept once, pulses, sessions, a log that takes each row once, and alarms with
confirmation, hysteresis and deadlines.

The alarm machine is one function over a series' readings in order of time and a small state, so a batch and a stream
give the same events. States: quiet; raised after ``confirm`` readings in a row at or over the limit; cleared after
``confirm`` readings in a row under limit - margin, not before ``hold`` seconds have passed. A jump of more than
``spike`` from the reading before counts only if the next reading confirms it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "entity string, ts timestamp, event string, value double"
STATE = "raised boolean, since double, high int, low int, last double"


@dataclass(frozen=True)
class Rule:
    limit: float
    margin: float
    confirm: int = 2
    hold: float = 6 * 3600.0
    spike: float = float("inf")


def plausible(df: DataFrame, ts: str, now, days: int = 7) -> DataFrame:
    """Readings no older than some days and no more than an hour ahead."""
    moment = F.lit(now).cast("timestamp")
    return df.where((F.col(ts) >= moment - F.make_dt_interval(days=F.lit(days))) & (F.col(ts) <= moment + F.expr("INTERVAL 1 HOUR")))


def once(stream: DataFrame, ts: str, *keys: str, late: str = "7 days") -> DataFrame:
    """The first of equal keys within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def pulses(stream: DataFrame, ts: str, kind: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each kind in tumbling windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def steps(rule: Rule, state: tuple, rows: Iterator[tuple]) -> tuple[tuple, list[tuple]]:
    """(new state, events) after readings (ts, value) in order of time; missing values confirm nothing."""
    raised, since, high, low, last = state
    events = []
    for ts, value in rows:
        if value is None or value != value:
            high = low = 0
            continue
        jump = last is not None and last == last and abs(value - last) > rule.spike
        last = value
        if jump:
            high = low = 0
            continue
        high = high + 1 if value >= rule.limit else 0
        low = low + 1 if value < rule.limit - rule.margin else 0
        seconds = ts.timestamp()
        if not raised and high >= rule.confirm:
            raised, since = True, seconds
            events.append((ts, "raised", value))
        elif raised and low >= rule.confirm and seconds - since >= rule.hold:
            raised, since = False, seconds
            events.append((ts, "cleared", value))
    return (raised, since, high, low, last), events


START = (False, 0.0, 0, 0, float("nan"))


def alarms(readings: DataFrame, rule: Rule) -> DataFrame:
    """Alarm events of a table (entity, ts, value); one entity's readings are one task's work, read in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "value"])
        _, events = steps(rule, START, zip(frame["ts"], frame["value"], strict=True))
        return pd.DataFrame([(frame["entity"].iloc[0], *e) for e in events], columns=["entity", "ts", "event", "value"])

    typed = readings.select(F.col("entity").cast("string").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return typed.groupBy("entity").applyInPandas(run, EVENTS)


def alarm_stream(readings: DataFrame, rule: Rule) -> DataFrame:
    """The same over a stream; each entity keeps five numbers of state."""

    def run(key, frames, state: GroupState):
        known = tuple(state.get) if state.exists else START
        rows = pd.concat(list(frames)).sort_values(["ts", "value"])
        known, events = steps(rule, known, zip(rows["ts"], rows["value"], strict=True))
        state.update(known)
        yield pd.DataFrame([(key[0], *e) for e in events], columns=["entity", "ts", "event", "value"])

    typed = readings.select(F.col("entity").cast("string").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return typed.groupBy("entity").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_batches(path: str, *keys: str, newest: str = "value"):
    """For foreachBatch: each batch's row of a key with the largest ``newest`` replaces what the archive at ``path`` holds for it."""
    from pyspark.sql import Window

    from tidemark.sources import archive

    def merge(batch: DataFrame, _: int) -> None:
        last = Window.partitionBy(*keys).orderBy(F.col(newest).desc_nulls_last())
        one = batch.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        try:
            batch.sparkSession.read.parquet(path)
        except AnalysisException:  # the first batch
            archive.write_archive(one, path)
        else:
            archive.merge_archive(one, path, keys, F.col(newest))

    return merge


# The decision machine: what a gauge proposes, what goes out at once, what waits, and what comes back.

DECISIONS = "entity string, ts timestamp, event string, level int, value double"
DECISION_STATE = "level int, since double, pending int, deadline double, low int, last double, last_ts double"


@dataclass(frozen=True)
class Decision:
    """``limits`` rise with the level, 1 first. A reading whose step an hour is over ``spike`` is suspect and waits ``wait`` seconds.

    Between the hours ``quiet`` (local, from and to) only the highest level goes out; the others wait for the end. Below the
    lowest limit by ``margin`` for ``confirm`` readings, and ``hold`` seconds after it went out, an alarm is over. At a deadline a
    reading counts for ``fresh`` seconds.
    """

    limits: tuple[float, ...]
    margin: float
    spike: float = float("inf")
    wait: float = 1800.0
    quiet: tuple[int, int] | None = None
    confirm: int = 3
    hold: float = 6 * 3600.0
    offset_hours: int = 7
    fresh: float = 3 * 3600.0

    def quiet_until(self, seconds: float) -> float | None:
        """When the quiet hours end, if it is quiet now."""
        if self.quiet is None:
            return None
        start, end = self.quiet
        hour = ((seconds + self.offset_hours * 3600) % 86400) / 3600
        inside = start <= hour < end if start < end else hour >= start or hour < end
        return seconds + ((end - hour) % 24) * 3600 if inside else None


NO_DECISION = (0, 0.0, 0, 0.0, 0, float("nan"), float("nan"))


def decide(rule: Decision, state: tuple, rows: Iterator[tuple], until: float | None = None) -> tuple[tuple, list[tuple]]:
    """(new state, events) after readings (ts, value) in order of time and, with ``until``, after the time up to there.

    Events: pending (waits for its deadline), replaced (a higher proposal took a waiting one's place), published (at once or, where it
    was still so at the deadline), superseded (a higher level took an alarm's place), lapsed (not so any more at the deadline, or
    no reading of the last ``fresh`` seconds says so), cleared. Lower levels never take the place of higher ones. A deadline passes
    with time, whether there is a reading or not.
    """
    level, since, pending, deadline, low, last, last_ts = state
    events = []

    def publish(ts, now: float, to: int, value: float) -> None:
        nonlocal level, since, pending, low
        if level:
            events.append((ts, "superseded", level, value))
        level, since, pending, low = to, now, 0, 0
        events.append((ts, "published", to, value))

    def settle(ts, now: float, value: float) -> None:
        """What waits goes out if the value still says so, else it lapses."""
        nonlocal pending
        found = sum(value >= x for x in rule.limits)
        if found >= pending and found > level:
            publish(ts, now, found, value)
        else:
            events.append((ts, "lapsed", pending, value))
            pending = 0

    def silence(to: float) -> None:
        """The deadline, if it passed before ``to`` without a reading."""
        if pending and deadline < to:
            ts = pd.Timestamp(round(deadline * 1e6), unit="us")
            settle(ts, deadline, last if deadline - last_ts <= rule.fresh else float("nan"))

    for ts, value in rows:
        now = ts.timestamp()
        silence(now)
        if value is None or value != value:
            low = 0
            continue
        hours = max((now - last_ts) / 3600, 1.0) if last_ts == last_ts else 1.0
        suspect = last == last and abs(value - last) / hours > rule.spike
        last, last_ts = value, now
        if pending and now >= deadline:
            settle(ts, now, value)
        found = sum(value >= x for x in rule.limits)
        if found > level and found > pending:
            quiet = rule.quiet_until(now) if found < len(rule.limits) else None
            if suspect or quiet is not None:
                if pending:
                    events.append((ts, "replaced", pending, value))
                pending, deadline = found, max(now + rule.wait if suspect else now, quiet or 0.0)
                events.append((ts, "pending", found, value))
            else:
                publish(ts, now, found, value)
        elif pending and found >= pending and not suspect and rule.quiet_until(now) is None:
            publish(ts, now, found, value)
        low = low + 1 if value < rule.limits[0] - rule.margin else 0
        if level and low >= rule.confirm and now - since >= rule.hold:
            events.append((ts, "cleared", level, value))
            level, since, low = 0, now, 0
    if until is not None:
        silence(until + 1e-6)
    return (level, since, pending, deadline, low, last, last_ts), events


def _typed(readings: DataFrame) -> DataFrame:
    return readings.select(F.col("entity").cast("string").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def decisions(readings: DataFrame, rule: Decision, until: float | None = None) -> DataFrame:
    """Decision events of a table (entity, ts, value); one entity's readings are one task's work, read in order.

    ``until``, in seconds since 1970, is how far time has gone on after the last reading; without it only readings move time.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "value"])
        _, events = decide(rule, NO_DECISION, zip(frame["ts"], frame["value"], strict=True), until)
        return pd.DataFrame([(frame["entity"].iloc[0], *e) for e in events], columns=["entity", "ts", "event", "level", "value"])

    return _typed(readings).groupBy("entity").applyInPandas(run, DECISIONS)


class Decisions(StatefulProcessor):
    """One entity's decisions in event time: readings wait until the watermark has passed them and are then read in order.

    State: the machine's seven numbers and the readings that still wait. Timers: one at each waiting reading, one at a deadline, and
    one after which an entity that is silent, quiet and without alarm is forgotten.
    """

    def __init__(self, rule: Decision, forget: float):
        self.rule, self.forget = rule, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", DECISION_STATE)
        self.waiting = handle.getListState("waiting", "ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        moments = set()
        for frame in rows:
            for ts, value in zip(frame["ts"], frame["value"], strict=True):
                if ts.timestamp() * 1000 > watermark:  # older ones come too late
                    self.waiting.appendValue((ts.to_pydatetime(), None if pd.isna(value) else float(value)))
                    moments.add(math.ceil(ts.timestamp() * 1000))
        for at in moments:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        held = [tuple(row) for row in self.waiting.get()]
        due = sorted((row for row in held if row[0].timestamp() <= until), key=lambda row: (row[0], -math.inf if row[1] is None else row[1]))
        known = tuple(self.machine.get()) if self.machine.exists() else NO_DECISION
        before = known
        known, events = decide(self.rule, known, iter(due), until)
        if due:
            left = [row for row in held if row[0].timestamp() > until]
            self.waiting.put(left) if left else self.waiting.clear()
        level, _, pending, deadline, _, _, last_ts = known
        if pending:
            self.handle.registerTimer(math.ceil(deadline * 1000))
        elif not level and last_ts == last_ts:
            if last_ts + self.forget > until:
                self.handle.registerTimer(math.ceil((last_ts + self.forget) * 1000))
            elif len(held) == len(due):
                self.machine.clear()
                known = before = None
        if known != before or due:
            self.machine.update(known) if known else None
        if events:
            yield pd.DataFrame([(key[0], *e) for e in events], columns=["entity", "ts", "event", "level", "value"])

    def close(self) -> None:
        pass


def decision_stream(readings: DataFrame, rule: Decision, late: str = "1 hour", forget_days: float = 30.0) -> DataFrame:
    """The same over a stream, whatever order readings come in: they may be late by up to ``late``.

    Events come out when the watermark has passed them, deadlines too, so a gauge that falls silent lapses or goes out as time goes
    on elsewhere. Needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider (``session.SETTINGS`` has it).
    """
    typed = _typed(readings).withWatermark("ts", late)
    return typed.groupBy("entity").transformWithStateInPandas(Decisions(rule, forget_days * 86400), DECISIONS, "append", "EventTime")


def session_stream(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes", path: str | None = None) -> DataFrame:
    """(key, started, ended, n) of each session once the watermark has closed it; views that are late, but not too late, join theirs.

    With ``path``, also where it began and ended, and how many of its rows were views (rows with a path) and heartbeats (rows without).
    """
    more = []
    if path is not None:
        more = [
            F.min_by(path, F.when(F.col(path).isNotNull(), F.col(ts))).alias("entry"), F.max_by(path, F.when(F.col(path).isNotNull(), F.col(ts))).alias("path"),
            F.count(path).alias("views"), F.count_if(F.col(path).isNull()).alias("beats"),
        ]
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return found.agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"), *more).drop("session_window")


def log_once(path: str, *keys: str):
    """For foreachBatch: rows whose keys the log at ``path`` does not have yet are added to it, each exactly once.

    A batch's rows are one partition of the log, which a repeated batch overwrites with the same rows, so a restart neither loses nor
    repeats one; what other batches logged is left out by an anti join over the keys.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        try:
            logged = spark.read.parquet(path).where(F.col("batch") != number)
        except AnalysisException:  # the first batch
            logged = None
        if logged is not None:
            fresh = fresh.join(logged.select(*keys), list(keys), "left_anti")
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return add
