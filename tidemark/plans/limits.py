"""Warning levels of series from their own record, scored against their floods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import hindcast
from tidemark.plans.registry import registry
from tidemark.plans.series import _H, _hourly

query, QUERIES, ORACLES = registry()

OFFSETS = [float(x) for x in range(4, 64, 4)]
_SPELLS = lambda levels, gap: f"""(SELECT entity, level, min(moment) AS a, max(moment) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY entity, level ORDER BY moment) AS k FROM
(SELECT entity, level, epoch(hour) AS moment, CASE WHEN epoch(hour) - lag(epoch(hour)) OVER (PARTITION BY entity, level ORDER BY hour) <= {gap + 1} * 3600 THEN 0 ELSE 1 END AS new FROM h JOIN {levels} USING (entity) WHERE value >= level)) GROUP BY entity, level, k)"""  # noqa: E731
_SCORES = f"""{_H}, bk AS (SELECT entity, round(quantile_cont(value, 0.97), 2) AS bank FROM h GROUP BY 1), lv AS (SELECT entity, round(bank - o, 2) AS level FROM bk, (SELECT unnest({OFFSETS}) AS o)), bl AS (SELECT entity, bank AS level FROM bk),
al AS {_SPELLS("lv", 3)}, fl AS {_SPELLS("bl", 12)}, fn AS (SELECT entity, count(*) AS floods FROM fl GROUP BY 1),
me AS (SELECT al.entity, al.level, al.a, fl.a AS onset FROM al JOIN fl ON fl.entity = al.entity AND fl.a >= al.a AND fl.a <= greatest(al.b, al.a + 24 * 3600)), ld AS (SELECT entity, level, onset, (onset - min(a)) / 3600 AS lead FROM me GROUP BY 1, 2, 3),
sc AS (SELECT lv.entity, lv.level, coalesce(floods, 0) AS floods, coalesce(x.n, 0) AS alarms, coalesce(y.n, 0) AS hits, coalesce(x.n, 0) - coalesce(y.n, 0) AS false_alarms, coalesce(z.n, 0) AS detected, z.lead AS median_lead_h FROM (SELECT DISTINCT * FROM lv) lv LEFT JOIN fn USING (entity)
LEFT JOIN (SELECT entity, level, count(*) AS n FROM al GROUP BY 1, 2) x USING (entity, level) LEFT JOIN (SELECT entity, level, count(DISTINCT a) AS n FROM me GROUP BY 1, 2) y USING (entity, level) LEFT JOIN (SELECT entity, level, count(*) AS n, median(lead) AS lead FROM ld GROUP BY 1, 2) z USING (entity, level)),
cs AS (SELECT *, CASE WHEN floods > 0 THEN round(detected / (floods + false_alarms), 2) END AS csi FROM sc)"""


def _banks(hours):
    return hours.groupBy("entity").agg(F.round(F.expr("percentile(value, 0.97D)"), 2).alias("bank"))


@query(f"WITH {_SCORES} SELECT entity, level, floods, alarms, hits, false_alarms, detected, csi, median_lead_h FROM cs")
def level_scores(spark, sf_dir):
    """Floods caught, false alarms and lead of every candidate level below each series' bank."""
    hours = _hourly(spark, sf_dir)
    banks = _banks(hours)
    levels = banks.select("entity", F.explode(F.array(*[F.round(F.col("bank") - o, 2) for o in OFFSETS])).alias("level"))
    onsets = hindcast.spells_at(hours, banks.select("entity", F.col("bank").alias("level")), 12).select("entity", F.col("start").alias("onset"))
    return hindcast.scores(hindcast.spells_at(hours, levels, 3), onsets, levels, 24)


_RISE = lambda h: f"(SELECT x.entity, quantile_cont(x.value - y.value, 0.95) FILTER (x.value > y.value) AS up FROM h x JOIN h y ON x.entity = y.entity AND epoch(x.hour) = epoch(y.hour) + {h} * 3600 GROUP BY 1)"


@query(f"""WITH {_SCORES}, kn AS (SELECT bk.entity, bank, coalesce(floods, 0) AS floods, w0, w1, r.up AS r6, q.up AS r24, coalesce(floods, 0) >= 3 AND days >= 20 AS enough FROM bk LEFT JOIN fn USING (entity)
JOIN (SELECT entity, quantile_cont(value, 0.7) AS w0, quantile_cont(value, 0.4) AS w1, (max(epoch(hour)) - min(epoch(hour))) / 86400 AS days FROM h GROUP BY 1) USING (entity) LEFT JOIN {_RISE(2)} r USING (entity) LEFT JOIN {_RISE(8)} q USING (entity)),
wa AS (SELECT entity, arg_max(level, (csi, detected, median_lead_h, level)) AS hind FROM cs JOIN kn USING (entity) WHERE enough AND detected > 0 AND median_lead_h >= 2 AND level <= bank - 0.05 AND level >= w0 GROUP BY 1),
ww AS (SELECT kn.*, hind, coalesce(hind, CASE WHEN r6 IS NOT NULL THEN round(bank - greatest(0.3, r6), 2) END) AS warning FROM kn LEFT JOIN wa USING (entity)),
wb AS (SELECT entity, arg_max(level, (csi, detected, median_lead_h, level)) AS hind2 FROM cs JOIN ww USING (entity) WHERE enough AND detected > 0 AND median_lead_h >= 8 AND level <= warning - 0.2 AND level >= w1 GROUP BY 1)
SELECT entity, floods, bank AS evacuate, warning, CASE WHEN warning IS NOT NULL THEN coalesce(hind2, round(bank - greatest(0.6, coalesce(r24, 0), (bank - warning) + greatest(0.2, (bank - warning) * 0.5)), 2)) END AS watch,
CASE WHEN warning IS NULL THEN 'none' WHEN hind IS NOT NULL AND hind2 IS NOT NULL THEN 'hindcast' WHEN hind IS NOT NULL OR hind2 IS NOT NULL THEN 'mixed' ELSE 'rise' END AS method FROM ww LEFT JOIN wb USING (entity)""")
def levels_suggested(spark, sf_dir):
    """Watch, warning and evacuate of each series, by the best scoring level or else by its fast rises."""
    hours = _hourly(spark, sf_dir)
    return hindcast.suggested(
        hours, _banks(hours), OFFSETS, warning_lead=2, watch_lead=8, gap_hours=3, flood_gap_hours=12, window_hours=24, min_days=20, warning_share=0.3, watch_share=0.6
    )
