"""Streams with silence, late and shuffled rows and restarts; the replay source; payloads in their real shapes."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import relational
from tidemark.sources import archive, replay
from tidemark.streaming import alarms

T0 = datetime(2024, 1, 1)
RULE = alarms.Decision(limits=(10.0, 20.0), margin=2.0, spike=8.0, wait=1800.0)
SCHEMA = "entity string, ts timestamp, value double"


def at(hours):
    return T0 + timedelta(hours=hours)


def run(stream, name, path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
    query.processAllAvailable()
    return query


def found(df):
    return sorted((r.entity, r.ts, r.event, r.level, r.value) if r.value == r.value else (r.entity, r.ts, r.event, r.level, None) for r in df.collect())


def feed(spark, path, batches, schema=SCHEMA):
    """A file for each batch, in their order."""
    import os
    import time

    for i, rows in enumerate(batches):
        folder = f"{path}/b{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet"):
                os.makedirs(f"{path}/in", exist_ok=True)
                os.rename(f"{folder}/{f}", f"{path}/in/{i:03d}.parquet")
                os.utime(f"{path}/in/{i:03d}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_a_deadline_passes_in_silence(spark, tmp_path):
    """A gauge jumps and falls silent: its draft goes out at the deadline; one whose last reading is back lapses."""
    rows = [("a", at(0), 1.0), ("a", at(1), 15.0), ("b", at(0), 1.0), ("b", at(1), 15.0), ("b", at(1.25), 3.0), ("clock", at(9), 0.0)]
    expected = [("a", at(1), "pending", 1, 15.0), ("a", at(1.5), "published", 1, 15.0), ("b", at(1), "pending", 1, 15.0), ("b", at(1.5), "lapsed", 1, 3.0)]
    until = at(8).replace(tzinfo=UTC).timestamp()
    assert found(alarms.decisions(spark.createDataFrame(rows, SCHEMA), RULE, until)) == expected
    query = run(alarms.decision_stream(feed(spark, tmp_path, [rows]), RULE), "silence", tmp_path / "c")
    query.stop()
    assert found(spark.table("silence")) == expected


def test_a_stale_reading_says_nothing_at_the_deadline():
    rule = alarms.Decision(limits=(10.0, 20.0), margin=2.0, quiet=(0, 6), offset_hours=0, fresh=3 * 3600)
    seconds = lambda h: at(h).timestamp()
    one = [(at(1), 15.0)]  # waits until six; the reading is five hours old then
    two = [(at(1), 15.0), (at(4), 15.0)]
    events = lambda rows: [e[1] for e in alarms.decide(rule, alarms.NO_DECISION, rows, seconds(7))[1]]
    assert events(one) == ["pending", "lapsed"] and events(two) == ["pending", "published"]
    assert [e[1] for e in alarms.decide(rule, alarms.NO_DECISION, one, seconds(5))[1]] == ["pending"]


def test_late_and_shuffled_rows_give_the_batch_events(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(f"g{g}", at(h / 2), round(rng.uniform(0, 25), 1) if rng.random() > 0.1 else None) for g in range(4) for h in range(40)]
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 110)))
    end = [("clock", at(60), 0.0)]
    stream = feed(spark, tmp_path, [order[i : i + 20] for i in range(0, len(order), 20)] + [end])
    query = run(alarms.decision_stream(stream, RULE, late="2 hours"), "shuffled", tmp_path / "c")
    query.stop()
    until = at(58).replace(tzinfo=UTC).timestamp()
    expected = found(alarms.decisions(spark.createDataFrame(rows + end, SCHEMA), RULE, until))
    assert found(spark.table("shuffled")) == expected and len(expected) > 10


def test_rows_behind_the_watermark_change_nothing_and_restarts_go_on(spark, tmp_path):
    batches = [[("a", at(0), 1.0), ("a", at(1), 12.0)], [("b", at(6), 0.0)], [("a", at(1.5), 25.0), ("a", at(6), 21.0)], [("b", at(12), 0.0)]]
    stream = feed(spark, tmp_path, batches[:2])
    make = lambda: alarms.decision_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), alarms.Decision(limits=(10.0, 20.0), margin=2.0))
    out = str(tmp_path / "out")
    go = lambda: make().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
    query = go()
    query.processAllAvailable()
    query.stop()
    assert found(spark.read.parquet(out)) == [("a", at(1), "published", 1, 12.0)]
    feed(spark, tmp_path / "more", batches[2:])
    for i in (0, 1):
        (tmp_path / "more" / "in" / f"{i:03d}.parquet").rename(tmp_path / "in" / f"{i + 2:03d}.parquet")
    query = go()
    query.processAllAvailable()
    query.stop()
    # the reading of half past one came when the watermark was at five
    assert found(spark.read.parquet(out)) == [("a", at(1), "published", 1, 12.0), ("a", at(6), "published", 2, 21.0), ("a", at(6), "superseded", 1, 21.0)]
    assert stream.isStreaming


def test_silent_entities_are_forgotten(spark, tmp_path):
    batches = [[("a", at(0), 1.0), ("c", at(0), 12.0)], [("b", at(24 * 3), 0.0)], [("b", at(24 * 4), 0.0)], [("b", at(24 * 5), 0.0)]]
    query = run(alarms.decision_stream(feed(spark, tmp_path, batches), RULE, forget_days=1.0), "forgotten", tmp_path / "c")
    query.stop()
    state = spark.read.format("statestore").option("stateVarName", "machine").load(str(tmp_path / "c"))
    assert {r.key.entity for r in state.select("key").collect()} == {"b", "c"}  # an alarm that is out is kept


def test_session_stream_equals_the_batch(spark, tmp_path):
    schema = "user string, ts timestamp, page string"
    minute = lambda m: T0 + timedelta(minutes=m)
    first = [("u", minute(0), "/"), ("u", minute(20), None), ("v", minute(5), "/map"), ("u", minute(100), "/a")]
    late = [("u", minute(95), "/late"), ("v", minute(30), None), ("u", minute(130), "/b"), ("v", minute(101), "/map")]
    stream = feed(spark, tmp_path, [first, late, [("clock", minute(600), "/")], [("clock", minute(700), "/")]], schema)
    query = run(alarms.session_stream(stream, "user", "ts", late="90 minutes", path="page"), "closed", tmp_path / "c")
    query.stop()
    rows = [r for r in spark.table("closed").collect() if r.user != "clock"]
    batch = relational.sessions(spark.createDataFrame(first + late, schema).withColumn("event_id", F.monotonically_increasing_id()), "user", "ts").collect()
    assert sorted((r.user, r.started, r.ended, r.n) for r in rows) == sorted((r.user, r.started, r.ended, r.n) for r in batch)
    assert {(r.user, r.started): (r.entry, r.path, r.views, r.beats) for r in rows}["u", minute(95)] == ("/late", "/b", 3, 0)
    assert {(r.user, r.started): (r.entry, r.path, r.views, r.beats) for r in rows}["v", minute(5)] == ("/map", "/map", 1, 1)


def test_the_log_takes_each_notice_once(spark, tmp_path):
    path, add = str(tmp_path / "log"), alarms.log_once(str(tmp_path / "log"), "event", "kind")
    batch = lambda *rows: spark.createDataFrame(rows, "event long, kind string, text string")
    add(batch((1, "admins", "x"), (1, "public", "x"), (1, "public", "again")), 0)
    for _ in range(2):  # a batch that is repeated after a failure
        add(batch((1, "public", "y"), (2, "public", "y")), 1)
    assert sorted((r.event, r.kind, r.batch) for r in spark.read.parquet(path).collect()) == [(1, "admins", 0), (1, "public", 0), (2, "public", 1)]


def test_replay_goes_on_from_its_checkpoint(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [(e, v, at(h), float(h), "m", "x") for e in ("a", "b") for v in ("level", "rain") for h in range(0, 24 * 62, 12)]
    archive.write_archive(spark.createDataFrame(rows, replay.SCHEMA), path)
    spark.dataSource.register(replay.ReplaySource)
    out = str(tmp_path / "out")

    def go(now):
        source = spark.readStream.format("replay").option("path", path).option("start", "2024-01-02").option("end", "2024-02-20").option("begin", "2030-01-01")
        stream = source.option("speed", "24").option("variables", "level").option("now", now).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(out).collect()

    due = lambda hours: sorted((r[0], r[2]) for r in rows if r[1] == "level" and at(24) <= r[2] < min(at(24 + hours), datetime(2024, 2, 20)))
    for now, hours in (("2030-01-01T10:00", 240), ("2030-01-01T10:00", 240), ("2030-01-02T16:00", 960), ("2031-01-01", 10**5)):
        assert sorted((r.entity, r.ts) for r in go(now)) == due(hours)


RAIN_DAILY = '{"result":"OK","data":[{"rainfall_datetime":"2025-11-01","rainfall_value":null},{"rainfall_datetime":"2025-11-02","rainfall_value":0},{"rainfall_datetime":"2025-11-03","rainfall_value":84.5},{"rainfall_datetime":"?","rainfall_value":1}]}'
RAIN_MONTHLY = '{"result":"OK","data":[{"date_time":"2025-01-31 00:00","rainfall":71.2,"day_count":30},{"date_time":"2025-02-28 00:00","rainfall":null,"day_count":null}]}'
LEVELS = '{"result":"OK","data":{"graph_data":[{"datetime":"2025-11-20 00:00","value":12.28,"discharge":null},{"datetime":"2025-11-20 00:10","value":12.29,"discharge":35.5},{"datetime":"2025-11-20 00:30","value":"12.31","discharge":null},{"datetime":"2025-11-20 00:40","value":"x"}],"min_bank":13.85}}'
DAM = '{"result":"OK","data":{"graph_data":[{"year":2021,"data":[{"date":"2021-01-07T06:00:00Z","value":2.2237},{"date":"2021-01-07T07:00:00Z","value":null},{"date":"2021-01-07T08:00:00+07:00","value":0}]},{"year":2022,"data":[{"date":"2022-01-01","value":1}]}]}}'


def test_payloads_in_the_shapes_of_their_feeds(spark):
    df = spark.createDataFrame([("s", RAIN_DAILY, RAIN_MONTHLY, LEVELS, DAM), ("t", "{}", "[]", '{"data":null}', "?")], "id string, daily string, monthly string, levels string, dam string")
    rows = lambda found: sorted((r.entity, r.variable, r.ts, r.value, r.unit) for r in found.collect())
    utc = lambda *x: datetime(*x) - timedelta(hours=7)
    assert rows(archive.rain_payload(df, "daily", "id")) == [("s", "rain_daily", utc(2025, 11, 2), 0.0, "mm"), ("s", "rain_daily", utc(2025, 11, 3), 84.5, "mm")]
    assert rows(archive.rain_payload(df, "monthly", "id", "rain_monthly")) == [("s", "rain_monthly", utc(2025, 1, 31), 71.2, "mm")]
    assert rows(archive.level_payload(df, "levels", "id")) == [
        ("s", "discharge", utc(2025, 11, 20, 0, 10), 35.5, "m3/s"), *(("s", "waterlevel", utc(2025, 11, 20, 0, m), v, "m") for m, v in ((0, 12.28), (10, 12.29), (30, 12.31))),
    ]
    dam = rows(archive.dam_payload(df, "dam", "id", "dam_spilled_1h"))
    assert dam == [("s", "dam_spilled_1h", utc(2021, 1, 7, 6), 2.2237, "Mm3"), ("s", "dam_spilled_1h", utc(2021, 1, 7, 8), 0.0, "Mm3"), ("s", "dam_spilled_1h", utc(2022, 1, 1), 1.0, "Mm3")]
    assert {r[4] for r in rows(archive.dam_payload(df, "dam", "id", "dam_level"))} == {"m"}


@pytest.mark.parametrize("parts", [1, 4])
def test_a_large_month_is_several_tasks_work(spark, parts):
    rows = spark.range(4000).select(F.concat(F.lit("e"), F.col("id") % 97).alias("entity"), F.lit("level").alias("variable"), F.lit(T0).alias("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = archive.dealt(archive.with_month(rows), parts).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert (tasks > 1) == (parts > 1)
