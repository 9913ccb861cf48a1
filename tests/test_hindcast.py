"""Alarms at candidate levels scored against floods: a plain version over random series."""

import random
from datetime import datetime, timedelta
from statistics import median

from tidemark.operators import hindcast

T0 = datetime(2024, 1, 1)


def plain_spells(values, level, gap):
    hours = [h for h, v in values if v is not None and v >= level]
    out = []
    for h in hours:
        if out and h - out[-1][1] <= gap + 1:
            out[-1][1] = h
        else:
            out.append([h, h])
    return out


def test_scores_of_all_levels_equal_the_plain_version(spark):
    rng, rows, series = random.Random(6), [], {}
    for e in "abc":
        x, values = 0.0, []
        for h in range(700):
            x = 0.93 * x + rng.gauss(0, 1) + (6 if rng.random() < 0.012 else 0)
            if rng.random() > 0.05:
                values.append((h, round(x, 2) if rng.random() > 0.02 else None))
        series[e] = values
        rows += [(e, T0 + timedelta(hours=h), v) for h, v in values]
    rows.append(("empty", T0, None))
    hours = spark.createDataFrame(rows, "entity string, hour timestamp, value double")
    bank, levels = 5.0, [4.5, 4.0, 3.0, 1.0, 50.0]
    table = spark.createDataFrame([(e, x) for e in [*series, "empty"] for x in levels], "entity string, level double")
    floods = hindcast.spells_at(hours, spark.createDataFrame([(e, bank) for e in series], "entity string, level double"), 12, 2)
    onsets = floods.select("entity", floods.start.alias("onset"))
    found = {(r.entity, r.level): r for r in hindcast.scores(hindcast.spells_at(hours, table, 3), onsets, table, 24).collect()}
    assert len(found) == 20 and found["empty", 1.0].alarms == 0 and found["empty", 1.0].csi is None
    for e, values in series.items():
        over = {h for h, v in values if v is not None and v >= bank}
        starts = [a for a, b in plain_spells(values, bank, 12) if sum(a <= h <= b for h in over) >= 2]
        assert starts
        for level in levels:
            alarms, lead, hits = plain_spells(values, level, 3), {}, 0
            for a, b in alarms:
                caught = [o for o in starts if a <= o <= max(b, a + 24)]
                hits += bool(caught)
                for o in caught:
                    lead[o] = max(lead.get(o, 0), o - a)
            r = found[e, level]
            assert (r.floods, r.alarms, r.hits, r.false_alarms, r.detected) == (len(starts), len(alarms), hits, len(alarms) - hits, len(lead))
            assert r.median_lead_h == (median(lead.values()) if lead else None)
            assert abs(r.csi - len(lead) / (len(starts) + len(alarms) - hits)) <= 0.005 + 1e-9


def test_short_records_fall_back_to_fast_rises(spark):
    rows = [("a", T0 + timedelta(hours=h), float(h % 50)) for h in range(400)] + [("still", T0 + timedelta(hours=h), 1.0) for h in range(400)]
    hours = spark.createDataFrame(rows, "entity string, hour timestamp, value double")
    banks = spark.createDataFrame([("a", 48.0), ("still", 9.0)], "entity string, bank double")
    found = {r.entity: r for r in hindcast.suggested(hours, banks, [1.0, 5.0, 10.0]).collect()}
    assert (found["a"].method, found["a"].warning, found["a"].watch) == ("rise", 42.0, 24.0) and found["a"].floods == 1  # every fifty hours: one flood
    assert (found["still"].method, found["still"].warning, found["still"].watch) == ("none", None, None)
    long = {r.entity: r for r in hindcast.suggested(hours, banks, [1.0, 5.0, 10.0, 30.0], gap_hours=1, flood_gap_hours=1, min_days=10, warning_share=0.9, watch_share=0.9).collect()}
    assert (long["a"].method, long["a"].warning, long["a"].watch) == ("hindcast", 38.0, 18.0) and long["a"].floods == 8
