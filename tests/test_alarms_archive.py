from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import archive
from tidemark.streaming import alarms

T0 = datetime(2024, 1, 1)


def readings(spark, values):
    return spark.createDataFrame([("a", T0 + timedelta(hours=i), v) for i, v in enumerate(values)], "entity string, ts timestamp, value double")


def events(df):
    return [(r.event, r.value) for r in df.orderBy("ts").collect()]


def test_alarm_confirms_holds_and_clears_with_margin(spark):
    rule = alarms.Rule(limit=10, margin=2, confirm=2, hold=3 * 3600)
    values = [11.0, 9.0, 11.0, 12.0, 7.0, 9.0, 7.0, 7.0, None, 7.0, 7.0]
    assert events(alarms.alarms(readings(spark, values), rule)) == [("raised", 12.0), ("cleared", 7.0)]


def test_a_spike_does_not_count(spark):
    rule = alarms.Rule(limit=10, margin=2, confirm=1, spike=20)
    assert events(alarms.alarms(readings(spark, [1.0, 50.0, 1.0]), rule)) == []


def test_stream_gives_the_same_events_as_the_batch(spark, tmp_path):
    rule = alarms.Rule(limit=10, margin=2, confirm=2, hold=0)
    df = readings(spark, [11.0, 12.0, 1.0, 1.0, 12.0, 12.0])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = alarms.alarm_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rule)
    query = stream.writeStream.format("memory").queryName("alarm_events").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert events(spark.table("alarm_events")) == events(alarms.alarms(df, rule))


def test_archive_merge_keeps_the_new_row_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "archive")
    make = lambda rows: spark.createDataFrame(rows, "entity string, variable string, ts timestamp, value double, unit string, source string")
    archive.write_archive(make([("a", "level", T0, 1.0, "m", "x"), ("a", "level", T0 + timedelta(days=40), 2.0, "m", "x")]), path)
    new = make([("a", "level", T0, 9.0, "m", "y"), ("b", "level", T0, 3.0, "m", "y")])
    for _ in range(2):
        archive.merge_archive(new, path)
        found = archive.read_series(spark, path, "level", "2024-01-01", "2024-03-01")
        assert sorted((r.entity, r.value) for r in found.collect()) == [("a", 2.0), ("a", 9.0), ("b", 3.0)]


def test_payload_drops_what_does_not_parse(spark):
    body = '{"result":"OK","data":{"graph_data":[{"datetime":"2024-01-01 00:00","value":"1.5"},{"datetime":"2024-01-01 01:00","value":"x"},{"datetime":"2024-01-01 02:00","value":2}]}}'
    found = archive.level_payload(spark.createDataFrame([("a", body)], "id string, body string"), "body", "id")
    assert sorted(r.value for r in found.collect()) == [1.5, 2.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("081-234 5678", "/th/case/123?x=1", "7°30'0\" S")], "p string, u string, c string")
    row = df.select(text.normal_phone(df.p).alias("p"), text.normal_path(df.u).alias("u"), text.decimal_degrees(df.c).alias("c")).first()
    assert (row.p, row.u, row.c) == ("+66812345678", "/case/:id", -7.5)


def test_a_merge_that_says_nothing_new_changes_no_partition(spark, tmp_path):
    path = str(tmp_path / "archive")
    make = lambda rows: spark.createDataFrame(rows, "entity string, variable string, ts timestamp, value double, unit string, source string")
    archive.write_archive(make([("a", "level", T0, 1.0, "m", "x"), ("a", "level", T0 + timedelta(days=40), 2.0, "m", "x")]), path)
    assert archive.merge_archive(make([("a", "level", T0, 1.0, "m", "x")]), path) == 0
    assert archive.merge_archive(make([("a", "level", T0, 1.5, "m", "x"), ("a", "level", T0 + timedelta(days=40), 2.0, "m", "x")]), path) == 1
    assert sorted(r.value for r in archive.read_series(spark, path, "level", "2024-01-01", "2024-03-01").collect()) == [1.5, 2.0]


def test_upserts_keep_the_last_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "archive")
    upsert = alarms.upsert_batches(path, "entity", "variable", "ts", newest="seq")
    batch = lambda *rows: spark.createDataFrame([("a", "level", T0, v, n) for v, n in rows], "entity string, variable string, ts timestamp, value double, seq long")
    for k, rows in enumerate([[(9.0, 1), (2.0, 2)], [(5.0, 3), (1.0, 4)]]):
        upsert(batch(*rows), k)
        (found,) = spark.read.parquet(path).collect()
        assert (found.value, found.seq) == rows[1]


def test_xml_rows_stay_with_their_node(spark):
    body = "<list><station><code>1</code></station><station><code>2</code><rain>7.5</rain></station></list>"
    deep = "<doc><list><station><code>3</code></station></list></doc>"
    df = spark.createDataFrame([(body, deep)], "a string, b string")
    found = archive.xml_rows(df, "a", "/list/station", {"id": "code", "mm": "rain"}).collect()
    assert [(r.id, r.mm) for r in found] == [("1", None), ("2", "7.5")]
    assert [tuple(r) for r in archive.xml_rows(df, "b", "/doc/list/station", {"id": "code"}).collect()] == [("3",)]


def test_text_readers(spark):
    text_ = ["xmlns:cpt=x", "cpt:T=2024-10, more", "\t99.5\t100.5", "7.5\t1\t2", "6.5\t-999\t4", "cpt:T=2024-11, more", "\t99.5\t100.5", "7.5\t5\t6", "6.5\t7\t8"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text_)], "file string, no int, value string")
    found = {r.start: r.mean for r in archive.grid_text(lines, [99.5, 100.5], [6.5, 7.5]).collect()}
    assert found == {"2024-10": (1 + 2 + 4) / 3, "2024-11": 6.5}
    assert archive.grid_text(lines, [100.5], [6.5]).orderBy("start").first()["mean"] == 4.0
    index = spark.createDataFrame([(" SEAS  YR  TOTAL ANOM",), (" DJF 1950 24.72 -1.53",), ("x",)], "value string")
    assert [tuple(r) for r in archive.index_text(index).collect()] == [("DJF", 1950, 24.72, -1.53)]


def test_replay_keeps_distances_at_its_speed(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(hours=6),)], "ts timestamp")
    begin = F.lit(datetime(2030, 1, 1)).cast("timestamp")
    due = [r.due for r in archive.replayed(df, "ts", begin, 60.0).orderBy("ts").collect()]
    assert due[1] - due[0] == timedelta(minutes=6)


def test_streamed_readings_are_filtered_kept_once_and_counted(spark, tmp_path):
    rows = [("a", T0, "x"), ("a", T0, "x"), ("a", T0 + timedelta(minutes=2), "y"), ("b", T0 + timedelta(days=30), "x"), ("b", T0 - timedelta(days=9), "x")]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    now = T0 + timedelta(hours=1)
    kept = alarms.once(alarms.plausible(stream, "ts", now), "ts", "entity", "ts")
    out = {}
    for name, found, mode in (("kept", kept, "append"), ("pulse", alarms.pulses(stream, "ts", "kind"), "complete")):
        query = found.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        out[name] = spark.table(name).collect()
    assert sorted((r.entity, r.kind) for r in out["kept"]) == [("a", "x"), ("a", "y")]
    assert {(r.start, r.kind): r.n for r in out["pulse"]}[(T0, "x")] == 2


def decided(rule, values, minutes=60):
    return [(e, level) for _, e, level, _ in alarms.decide(rule, alarms.NO_DECISION, [(T0 + timedelta(minutes=minutes * i), v) for i, v in enumerate(values)])[1]]


def test_decisions_publish_wait_supersede_and_clear():
    rule = alarms.Decision(limits=(10.0, 20.0), margin=2.0, spike=8.0, wait=2 * 3600, confirm=2, hold=3600)
    assert decided(rule, [5, 11, 12, 19, 21]) == [("published", 1), ("superseded", 1), ("published", 2)]
    assert decided(rule, [1, 15, 16]) == [("pending", 1), ("published", 1)]  # a jump waits, the next reading confirms it
    assert decided(rule, [1, 15, 1, 1]) == [("pending", 1), ("lapsed", 1)]
    assert decided(rule, [1, 15, 27, 28]) == [("pending", 1), ("replaced", 1), ("pending", 2), ("published", 2)]
    assert decided(rule, [8, 11, 9, 7, 7, 7]) == [("published", 1), ("cleared", 1)]  # above the margin nothing clears
    assert decided(rule, [15, 16, 21, 12, 12]) == [("published", 1), ("superseded", 1), ("published", 2)]  # lower levels change nothing


def test_quiet_hours_hold_all_but_the_highest():
    night = alarms.Decision(limits=(10.0, 20.0), margin=2.0, quiet=(0, 3), offset_hours=0)  # T0 is midnight
    assert decided(night, [11, 12, 12, 12]) == [("pending", 1), ("published", 1)]
    assert decided(night, [21]) == [("published", 2)]
    assert decided(night, [11, 5, 5, 5]) == [("pending", 1), ("lapsed", 1)]


def test_decision_stream_gives_the_same_events_as_the_batch(spark, tmp_path):
    rule = alarms.Decision(limits=(10.0, 20.0), margin=2.0, spike=8.0)
    df = readings(spark, [5.0, 11.0, 30.0, 31.0, 1.0, 1.0, 1.0, 1.0])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = alarms.decision_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rule)
    query = stream.writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    found = lambda d: [(r.event, r.level) for r in d.orderBy("ts").collect()]
    assert found(spark.table("decisions")) == found(alarms.decisions(df, rule)) != []


def test_more_text_functions(spark):
    rows = [("https://maps.example/?q=6.5,101.25", "6PH57VP3+PR", "0812345678"), ("https://x.example/@-6.5,101.2,15z", "6PH57VP3", "12")]
    df = spark.createDataFrame(rows, "u string, code string, phone string")
    lat, lon = text.url_coordinates(F.col("u"))
    plat, plon = text.plus_code_centre(F.col("code"))
    a, b = df.select(lat.alias("a"), lon.alias("b"), plat.alias("c"), plon.alias("d"), text.masked_phone(F.col("phone")).alias("m")).collect()
    assert (a.a, a.b, b.a, b.b) == (6.5, 101.25, -6.5, 101.2)
    assert (round(a.c, 4), round(a.d, 4), b.c) == (1.2868, 103.8546, None) and a.m == "******5678"
    filled = df.limit(1).select(text.fill(F.lit("{n} at {t}"), {"n": F.lit("A"), "t": F.lit(7)}).alias("x")).first().x
    assert filled == "A at 7"


def test_lists_remember_when_things_were_first_seen(spark):
    old = spark.createDataFrame([(1, "jan"), (2, "feb")], "k long, first_seen string")
    new = spark.createDataFrame([(2, "mar"), (3, "mar")], "k long, first_seen string")
    assert sorted(tuple(r) for r in archive.with_previous(new, old, "k").collect()) == [(1, "jan"), (2, "feb"), (3, "mar")]
    pairs = spark.createDataFrame([(1, ["a", "b"], [1.0])], "k long, t array<string>, v array<double>")
    assert [tuple(r) for r in archive.zipped(pairs, "t", "v", "k").collect()] == [(1, "a", 1.0), (1, "b", None)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2.5)], "name string, v double").coalesce(1)
    archive.write_csv(df, str(tmp_path / "csv"))
    text_ = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("*.csv"))
    assert text_ == "﻿name,v\n'=1+1,2.5\n"
    archive.write_raw(df, "name", str(tmp_path / "raw"))
    assert [r.value for r in spark.read.text(str(tmp_path / "raw")).collect()] == ["=1+1"]
    feature = df.select(archive.as_feature(F.lit(100.5), F.lit(7.0), "name").alias("x")).first().x
    assert feature == '{"type":"Feature","geometry":{"type":"Point","coordinates":[100.5,7.0]},"properties":{"name":"=1+1"}}'
