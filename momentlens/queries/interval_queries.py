"""Intervals: merging, inverting, budgets, decay, trims, condensed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens.functions.scalars import segment_label
from momentlens.operators import intervals, manifest, series
from momentlens.plans import moments as plans
from momentlens.queries import sql
from momentlens.sources import adapters as src

R = lambda c, n=6: F.round(c, n).alias(c)
SPAN = 30.0


def w06_interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merged(src.shipments(spark, sf), "source", 2.0, span=SPAN).select("source", R("start"), R("end"), "score", "n")


def w07_strict_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merged(src.shipments(spark, sf), "source", 0.0, strict=True, span=SPAN).select("source", R("start"), R("end"), "score", "n")


def w08_complement(spark: SparkSession, sf: str) -> DataFrame:
    d = src.shipments(spark, sf)
    ends = d.groupBy("source").agg((F.max("end") + 10).alias("duration"))
    return intervals.complement(d, ends, "source", span=SPAN).select("source", R("start"), R("end"))


def w09_offsets(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("duration"))
    return intervals.offsets(d, "l_orderkey", [F.col("l_linenumber"), F.col("duration")]).select("l_orderkey", "l_linenumber", "duration", "offset")


def w10_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Of each supplier's merged shipments, the best within 20 days."""
    m = intervals.merged(src.shipments(spark, sf), "source", 0.0, span=SPAN).withColumn("duration", F.col("end") - F.col("start"))
    return intervals.within_budget(m, "source", 20.0).select("source", R("start"), R("end"), "score")


def w14_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = intervals.merged(src.shipments(spark, sf), "source", 2.0, span=SPAN)
    return manifest.labelled(m, [F.desc("score"), F.col("start")], "source").select("source", R("start"), "rank", "label")


def p13_segment_label(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "customer").select("c_custkey", segment_label(F.col("c_custkey") % 702).alias("label"))


def p02_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A window round each event, open and clamped at the right."""
    d = src.levels(spark, sf)
    last = d.groupBy("asset").agg(F.max("t").alias("duration"))
    a, b = intervals.around(F.col("t"), 15.0)
    c, e = intervals.around_within(F.col("t"), 3.0, 4.0, F.col("duration"))
    return d.join(last, "asset").select("asset", "t", a.alias("start"), b.alias("end"), c.alias("clamped_start"), e.alias("clamped_end"))


def j13_decay(spark: SparkSession, sf: str) -> DataFrame:
    smooth = plans.smoothed(src.hourly(spark, sf), plans.THREE)
    return intervals.decay_end(series.local_maxima(smooth), smooth, 0.45, 20).select("asset", "idx", "end_idx")


def j13_condensed(spark: SparkSession, sf: str) -> DataFrame:
    d = plans.condensed(src.hourly(spark, sf), plans.Condense())
    return d.select("asset", "rank", "label", R("start"), R("end"), R("score"))


def p19_trims(spark: SparkSession, sf: str) -> DataFrame:
    """Trim texts made of orders, applied to merged shipments by label."""
    specs = src.table(spark, sf, "orders").select(F.concat_ws(":", segment_label(F.col("o_orderkey") % 30), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 7).cast("string")).otherwise(""), F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 11).cast("string")).otherwise("")).alias("spec"), F.col("o_orderkey").alias("pos"))
    m = manifest.labelled(intervals.merged(src.shipments(spark, sf), "source", 2.0, span=SPAN), [F.desc("score"), F.col("start")], "source")
    return intervals.trimmed(m, intervals.trims(specs)).select("source", "label", R("start"), R("end"), R("duration"))


QUERIES = {f.__name__: f for f in (w06_interval_merge, w07_strict_merge, w08_complement, w09_offsets, w10_budget, w14_labels, p13_segment_label, p02_windows, j13_decay, j13_condensed, p19_trims)}

_M2 = f"{sql.SHIPMENTS}, {sql.merged('shp', 'source', 2.0, False)}"
_M0 = f"{sql.SHIPMENTS}, {sql.merged('shp', 'source', 0.0, False)}"
_RANK = "rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, s) - 1 AS rank FROM mrg)"
_SE = 'round(s, 6) AS start, round(e, 6) AS "end"'
_THREE = dict(plans.THREE.weights)
_DECAY = """dec AS (SELECT p.asset, p.idx, p.value, coalesce(min(s.idx) FILTER (WHERE s.value < p.value * 0.45) - 1, least(any_value(m.last), p.idx + 20)) AS end_idx
FROM {peaks} p JOIN (SELECT asset, max(idx) AS last FROM smo GROUP BY 1) m USING (asset) LEFT JOIN smo s ON s.asset = p.asset AND s.idx > p.idx AND s.idx <= p.idx + 20 GROUP BY 1, 2, 3)"""
ORACLES = {
    "w06_interval_merge": f"WITH {_M2} SELECT source, {_SE}, score, n FROM mrg",
    "w07_strict_merge": f"WITH {sql.SHIPMENTS}, {sql.merged('shp', 'source', 0.0, True)} SELECT source, {_SE}, score, n FROM mrg",
    "w08_complement": f"""WITH {_M0}, d AS (SELECT source, max(e) + 10 AS duration FROM shp GROUP BY 1),
g AS (SELECT source, coalesce(lag(e) OVER (PARTITION BY source ORDER BY s), 0.0) AS a, s AS b FROM mrg UNION ALL SELECT source, max(e), any_value(duration) FROM mrg JOIN d USING (source) GROUP BY 1)
SELECT source, round(a, 6) AS start, round(b, 6) AS "end" FROM g WHERE b - a > 0.1""",
    "w09_offsets": "SELECT l_orderkey, l_linenumber, l_quantity AS duration, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS \"offset\" FROM lineitem",
    "w10_budget": f"""WITH {_M0}, b AS (SELECT *, sum(e - s) OVER (PARTITION BY source) AS total, coalesce(sum(e - s) OVER (PARTITION BY source ORDER BY score DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mrg)
SELECT source, {_SE}, score FROM b WHERE total <= 40 OR before < 20""",
    "w14_labels": f"WITH {_M2}, {_RANK} SELECT source, round(s, 6) AS start, rank, {sql.label('rank')} AS label FROM rk",
    "p13_segment_label": f"SELECT c_custkey, {sql.label('(c_custkey % 702)')} AS label FROM customer",
    "p02_windows": f"""WITH {sql.LEVELS} SELECT asset, t, greatest(0.0, t - 7.5) AS start, greatest(0.0, t - 7.5) + 15.0 AS "end", greatest(0.0, t - 3.0) AS clamped_start, least(max(t) OVER (PARTITION BY asset), t + 4.0) AS clamped_end FROM lev""",
    "j13_decay": f"WITH RECURSIVE {sql.peaks(_THREE, 4, 0.45, 1)}, {_DECAY.format(peaks='loc')} SELECT asset, idx, end_idx FROM dec",
    "j13_condensed": f"""WITH RECURSIVE {sql.peaks(_THREE, 4, 0.45, 1)}, {_DECAY.format(peaks='pk')},
dr AS (SELECT asset, (max(idx) + 1) / 2.0 AS d FROM smo GROUP BY 1),
g0 AS (SELECT asset, greatest(0.0, idx / 2.0 - 1.5) AS s, least(d - 0.05, end_idx / 2.0 + 2.5) AS e, value AS score, d FROM dec JOIN dr USING (asset)),
g1 AS (SELECT asset, s, CASE WHEN e - s < 3 THEN least(d - 0.05, s + 3.0) ELSE e END AS e, score FROM g0),
g2 AS (SELECT asset, s, CASE WHEN e - s > 10 THEN s + 10.0 ELSE e END AS e, score FROM g1),
{sql.merged('g2', 'asset', 2.0, False)},
b AS (SELECT *, sum(e - s) OVER (PARTITION BY asset) AS total, coalesce(sum(e - s) OVER (PARTITION BY asset ORDER BY score DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mrg),
r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY s) - 1 AS rank FROM b WHERE total <= 240 OR before < 120)
SELECT asset, rank, {sql.label('rank')} AS label, {_SE}, round(score, 6) AS score FROM r""",
    "p19_trims": f"""WITH {_M2}, {_RANK}, sp AS (SELECT o_orderkey AS pos, {sql.label('(o_orderkey % 30)')} AS label, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS ts, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS te FROM orders),
tr AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY label ORDER BY pos DESC) = 1),
j AS (SELECT rk.source, {sql.label('rk.rank')} AS label, s, e FROM rk),
c AS (SELECT source, j.label, s, e, tr.label IS NOT NULL AS cut, te, CASE WHEN tr.label IS NOT NULL THEN greatest(s, least(s + coalesce(ts, 0), e)) ELSE s END AS ns FROM j LEFT JOIN tr USING (label)),
z AS (SELECT source, label, ns, CASE WHEN cut THEN greatest(ns + 0.1, least(coalesce(s + te, e), e)) ELSE e END AS ne FROM c)
SELECT source, label, round(ns, 6) AS start, round(ne, 6) AS "end", round(ne - ns, 6) AS duration FROM z""",
}
