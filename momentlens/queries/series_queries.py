"""Signals, series and moments."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens import profiles
from momentlens.functions.scalars import rating_tier, reasons, strongest
from momentlens.operators import asof, report, series, signals
from momentlens.plans import moments as plans
from momentlens.queries import sql
from momentlens.sources import adapters as src
from momentlens.sources import wav
from momentlens.sources.files import scratch

#: Samples of a WAV file of the queries.
RECORDING = 4096
R = lambda c, n=6: F.round(c, n).alias(c)


def a01_block_rms(spark: SparkSession, sf: str) -> DataFrame:
    d = src.levels(spark, sf).withColumnRenamed("t", "idx")
    return signals.block_rms(d, 8).select("asset", "idx", R("value"))


def s06_wav_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type as samples of recordings: written as WAV files, read back in ranges of bytes, and their energy in blocks."""
    d = src.levels(spark, sf, "event_type").select("asset", F.col("t").alias("idx"), (F.col("value") / 1000 - 0.25).alias("value"))
    path = f"{scratch(spark)}/recordings-{uuid.uuid4().hex}"
    wav.write_recordings(d, path, 8000, RECORDING)
    back = wav.continued(wav.samples(spark, path, mono=True, split_bytes=RECORDING), RECORDING)
    return signals.block_rms(back, 64).select("asset", "idx", R("value", 5))


def a02_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return signals.normalized(src.hourly(spark, sf), ["clip", "panns", "flow", "mae"]).select("asset", "idx", R("clip"), R("panns"), R("flow"), R("mae"))


def a04_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return report.statistics(src.hourly(spark, sf), "clip").select("asset", R("mean"), R("max"), R("min"), R("median"))


def _label_id(step: int, of: int) -> Column:
    """Class numbers of events, spread over the classes of a model."""
    return (F.get_json_object("props", "$.k").cast("int") + step * (F.col("event_id") % of)).cast("int").alias("label_id")


def a06_triggers(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "events").select(F.col("event_type").alias("asset"), src.hour_of(F.col("ts")).alias("idx"), _label_id(400, 2), (F.col("value") / 500).alias("prob"))
    d = d.groupBy("asset", "idx", "label_id").agg(F.max("prob").alias("prob"))
    return signals.triggers(d, profiles.labels(spark, profiles.AUDIO_LABELS | profiles.MORE_AUDIO_LABELS)).select("asset", "name", R("peak"))


def j01_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Hours at which clicks, views and purchases all happen for a user."""
    d = src.table(spark, sf, "events").groupBy(F.col("user_id").alias("asset"), (F.dayofmonth("ts")).cast("long").alias("idx"), F.col("event_type").alias("signal")).agg(F.sum("value").alias("value"))
    return signals.aligned(d, ["click", "view", "purchase"]).select("asset", "idx", R("click"), R("view"), R("purchase"))


def j17_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the last view of the same user at or before it."""
    d = src.table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", F.col("value").alias("seen"))
    joined = asof.as_of(d.where("event_type = 'purchase'").select("event_id", "user_id", "at"), d.where("event_type = 'view'").select("user_id", "at", "seen"), "user_id", "at", ["seen"], 86_400_000_000)
    return joined.where("at_before IS NOT NULL").select("event_id", (F.col("at") - F.col("at_before")).alias("age"), R("seen"))


def j02_labelled_sum(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "events").select(F.col("event_type").alias("asset"), src.hour_of(F.col("ts")).alias("idx"), _label_id(100, 4), F.col("value").alias("prob"))
    return signals.labelled_sum(d, profiles.labels(spark, profiles.ACTION_LABELS), ["asset", "idx"]).select("asset", "idx", R("total"))


def p04_fused(spark: SparkSession, sf: str) -> DataFrame:
    d = signals.normalized(src.hourly(spark, sf), list(plans.FOUR.weights))
    return d.select("asset", "idx", F.round(signals.fused(plans.FOUR.weights), 6).alias("score"))


def w01_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    return series.moving_average(src.hourly(spark, sf).select("asset", "idx", F.col("clip").alias("value")), 6, block=100).select("asset", "idx", R("value"))


def w02_running_median(spark: SparkSession, sf: str) -> DataFrame:
    return series.running_median(src.hourly(spark, sf).select("asset", "idx", F.col("clip").alias("value")), 10, block=100).select("asset", "idx", R("value"))


def w03_rises(spark: SparkSession, sf: str) -> DataFrame:
    return signals.rises(src.hourly(spark, sf).select("asset", "idx", F.col("clip").alias("value"))).select("asset", "idx", R("value"))


def w04_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return plans.moments(src.hourly(spark, sf), plans.FOUR).select("asset", "idx", R("value"))


def w05_low_runs(spark: SparkSession, sf: str) -> DataFrame:
    return series.low_runs(src.levels(spark, sf), 100.0, 2.0)


def w12_hopping_max(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of 16 samples every 8, of series of several lengths; a window's score is the mean of its samples, the last one repeated."""
    d = src.hourly(spark, sf).select("asset", "idx", (F.col("clip") - 50).alias("value"))
    lengths = d.groupBy("asset").agg((F.max("idx") + 1 - F.length("asset")).alias("n"))
    windows = signals.action_windows(lengths)
    at = windows.select("asset", "start", "end", F.explode("places").alias("idx")).join(d, ["asset", "idx"])
    scores = at.groupBy("asset", "start", "end").agg(F.avg("value").alias("score"))
    return signals.hopping_max(scores, lengths).select("asset", "idx", R("score"))


def w13_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = signals.batches(src.levels(spark, sf), 4, idx="t")
    return d.select("asset", "batch", *[F.round(F.get("values", k), 6).alias(f"v{k}") for k in range(4)])


def a17_energy(spark: SparkSession, sf: str) -> DataFrame:
    d = src.hourly(spark, sf).select("asset", "idx", F.col("clip").alias("value"))
    return signals.short_time_energy(d, 21, 10).select("asset", "hop", F.round("energy", 6).alias("energy"))


def t01_top_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The best moments over all assets of four fused signals."""
    d = plans.top(plans.moments(src.hourly(spark, sf), plans.FOUR), 20)
    return d.select("asset", "time_sec", F.round("value", 6).alias("score"), "start", "end")


def t02_first_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The first peaks of each asset with their reasons, strongest signal and rating."""
    d = plans.rated(src.hourly(spark, sf), plans.THREE, 5)
    named = [("audio", F.col("panns")), ("visual", F.col("clip")), ("motion", F.col("flow"))]
    why = reasons(named, F.format_string("combined (%.2f)", "value"))
    return d.select("asset", "idx", F.round("value", 6).alias("score"), strongest(named).alias("primary_signal"), F.size(why).cast("long").alias("n_reasons"), rating_tier(F.col("value")).alias("rating"))


QUERIES = {f.__name__: f for f in (a01_block_rms, s06_wav_energy, a02_minmax, a04_statistics, a06_triggers, j01_aligned, j17_as_of, j02_labelled_sum, p04_fused, w01_moving_average, w02_running_median, w03_rises, w04_peaks, w05_low_runs, w12_hopping_max, w13_batches, a17_energy, t01_top_moments, t02_first_peaks)}

_FOUR, _THREE = dict(plans.FOUR.weights), dict(plans.THREE.weights)
_TAPS = """len AS (SELECT asset, count(*) AS n FROM sig GROUP BY 1),
tap AS (SELECT asset, idx, (((idx + k) % (2 * n)) + 2 * n) % (2 * n) AS j0, n FROM sig JOIN len USING (asset), (SELECT unnest(range({a}, {b})) AS k)),
val AS (SELECT t.asset, t.idx, f.clip AS v FROM tap t JOIN sig f ON f.asset = t.asset AND f.idx = CASE WHEN j0 < n THEN j0 ELSE 2 * n - 1 - j0 END)"""
_EVENTS = f"ev AS (SELECT event_type AS asset, {sql.HOUR} AS idx, CAST(json_extract_string(props, '$.k') AS INTEGER) + {{step}} * (event_id % {{of}}) AS label_id, value FROM events)"
_NAMES = ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in (profiles.AUDIO_LABELS | profiles.MORE_AUDIO_LABELS).items())
ORACLES = {
    "a01_block_rms": f"WITH {sql.LEVELS} SELECT asset, CAST(floor(t / 8) AS BIGINT) AS idx, round(sqrt(avg(value * value)), 6) AS value FROM lev GROUP BY 1, 2 HAVING count(*) = 8",
    "s06_wav_energy": """WITH lev AS (SELECT event_type AS asset, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value FROM events),
q AS (SELECT asset, t, greatest(-32768, least(32767, round_even((value / 1000 - 0.25::DOUBLE) * 32768, 0))) / 32768 AS v FROM lev)
SELECT asset, CAST(t // 64 AS BIGINT) AS idx, round(sqrt(avg(v * v)), 5) AS value FROM q GROUP BY 1, 2 HAVING count(*) = 64""",
    "a02_minmax": f"WITH {sql.SIGNALS}, {sql.normal(['clip', 'panns', 'flow', 'mae'])} SELECT asset, idx, round(clip, 6) AS clip, round(panns, 6) AS panns, round(flow, 6) AS flow, round(mae, 6) AS mae FROM nrm",
    "a04_statistics": f"WITH {sql.SIGNALS} SELECT asset, round(avg(clip), 6) AS mean, round(max(clip), 6) AS max, round(min(clip), 6) AS min, round(median(clip), 6) AS median FROM sig GROUP BY 1",
    "a06_triggers": f"""WITH {_EVENTS.format(step=400, of=2)}, lab AS (SELECT * FROM (VALUES {_NAMES}) AS l(label_id, name)), p AS (SELECT asset, idx, label_id, max(value / 500) AS prob FROM ev SEMI JOIN lab USING (label_id) GROUP BY 1, 2, 3),
s AS (SELECT asset, idx FROM p GROUP BY 1, 2 HAVING sum(prob) > 0.5) SELECT asset, name, round(max(prob), 6) AS peak FROM p JOIN s USING (asset, idx) JOIN lab USING (label_id) WHERE prob > 0.1 GROUP BY 1, 2""",
    "j01_aligned": """WITH d AS (SELECT user_id AS asset, CAST(day(ts) AS BIGINT) AS idx, event_type, sum(value) AS v FROM events GROUP BY 1, 2, 3)
SELECT c.asset, c.idx, round(c.v, 6) AS click, round(w.v, 6) AS "view", round(p.v, 6) AS purchase FROM d c JOIN d w USING (asset, idx) JOIN d p USING (asset, idx) WHERE c.event_type = 'click' AND w.event_type = 'view' AND p.event_type = 'purchase'""",
    "j17_as_of": """WITH v AS (SELECT user_id, epoch_us(ts) AS at, max(value) AS seen FROM events WHERE event_type = 'view' GROUP BY 1, 2), p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase')
SELECT event_id, p.at - v.at AS age, round(seen, 6) AS seen FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.at >= v.at""",
    "j02_labelled_sum": f"WITH {_EVENTS.format(step=100, of=4)} SELECT asset, idx, round(sum(value), 6) AS total FROM ev WHERE label_id IN {tuple(profiles.ACTION_LABELS)} GROUP BY 1, 2",
    "p04_fused": f"WITH {sql.fused(_FOUR)} SELECT asset, idx, round(value, 6) AS score FROM fus",
    "w01_moving_average": f"WITH {sql.SIGNALS}, {_TAPS.format(a=-3, b=3)} SELECT asset, idx, round(avg(v), 6) AS value FROM val GROUP BY 1, 2",
    "w02_running_median": f"WITH {sql.SIGNALS}, {_TAPS.format(a=-5, b=5)} SELECT asset, idx, round(list_sort(list(v))[6], 6) AS value FROM val GROUP BY 1, 2",
    "w03_rises": f"WITH {sql.SIGNALS} SELECT asset, idx, round(greatest(d, 0), 6) AS value FROM (SELECT asset, idx, lead(clip) OVER (PARTITION BY asset ORDER BY idx) - clip AS d FROM sig) WHERE d IS NOT NULL",
    "w04_peaks": f"WITH RECURSIVE {sql.peaks(_FOUR, 6, 0.75, 30)} SELECT asset, idx, round(value, 6) AS value FROM pk",
    "w05_low_runs": f"""WITH {sql.LEVELS}, f AS (SELECT *, value < 100 AS low, coalesce(lead(t) OVER (PARTITION BY asset ORDER BY t), t) AS nt FROM lev),
g AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) - row_number() OVER (PARTITION BY asset, low ORDER BY t) AS run FROM f)
SELECT asset, min(t) AS start, max(nt) AS "end" FROM g WHERE low GROUP BY asset, run HAVING max(nt) - min(t) >= 2""",
    "w12_hopping_max": f"""WITH {sql.SIGNALS}, len AS (SELECT asset, max(idx) + 1 - length(asset) AS n FROM sig GROUP BY 1),
w AS (SELECT asset, n, s, least(s + 16, n) AS e FROM (SELECT asset, n, unnest(range(0, n, 8)) AS s FROM len) WHERE least(s + 16, n) - s >= 4),
sc AS (SELECT w.asset, s, e, (sum(clip - 50) + (16 - (e - s)) * max(CASE WHEN idx = e - 1 THEN clip - 50 END)) / 16 AS score FROM w JOIN sig ON sig.asset = w.asset AND idx >= s AND idx < e GROUP BY 1, 2, 3)
SELECT i.asset, i.idx, round(greatest(0.0, coalesce(max(score), 0.0)), 6) AS score FROM (SELECT asset, unnest(range(0, n)) AS idx FROM len) i LEFT JOIN sc ON sc.asset = i.asset AND i.idx >= s AND i.idx < e GROUP BY 1, 2""",
    "w13_batches": f"""WITH {sql.LEVELS}, b AS (SELECT asset, CAST(floor(t / 4) AS BIGINT) AS batch, list(value ORDER BY t) AS v FROM lev GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT asset, batch, {", ".join(f"round(v[least({k + 1}, len(v))], 6) AS v{k}" for k in range(4))} FROM b""",
    "a17_energy": f"""WITH {sql.SIGNALS}, h AS (SELECT asset, unnest(range(0, CAST((max(idx) + 1 - 21) // 10 + 1 AS BIGINT))) AS hop FROM sig GROUP BY asset)
SELECT h.asset, hop, round(sum(clip * clip), 6) AS energy FROM h JOIN sig s ON s.asset = h.asset AND s.idx BETWEEN hop * 10 AND hop * 10 + 20 GROUP BY 1, 2""",
    "t01_top_moments": f"""WITH RECURSIVE {sql.peaks(_FOUR, 6, 0.75, 30)} SELECT asset, idx / 2.0 AS time_sec, round(value, 6) AS score, greatest(0.0, idx / 2.0 - 7.5) AS start, greatest(0.0, idx / 2.0 - 7.5) + 15.0 AS "end" FROM pk ORDER BY value DESC, asset, idx LIMIT 20""",
    "t02_first_peaks": f"""WITH RECURSIVE {sql.peaks(_THREE, 4, 0.45, 1)}, fp AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY asset ORDER BY idx) <= 5)
SELECT fp.asset, fp.idx, round(value, 6) AS score, CASE WHEN panns >= clip AND panns >= flow THEN 'audio' WHEN clip >= flow THEN 'visual' ELSE 'motion' END AS primary_signal,
  CAST(greatest(1, (panns > 0.5)::INT + (clip > 0.5)::INT + (flow > 0.5)::INT) AS BIGINT) AS n_reasons, CASE WHEN value > 0.6 THEN 'high' WHEN value > 0.4 THEN 'medium' ELSE 'low' END AS rating
FROM fp JOIN nrm ON nrm.asset = fp.asset AND nrm.idx = fp.idx""",
}
