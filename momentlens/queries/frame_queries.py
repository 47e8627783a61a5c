"""Sampled frames, motion, pooled states, ratings, meters and ramps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlens.functions import scalars as fn
from momentlens.operators import displacement, frames, timeline
from momentlens.sources import adapters as src


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as assets of 10 to 59 frames a second and up to 399 frames."""
    return src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset"), (10.0 + F.col("o_orderkey") % 50).alias("fps"), (F.col("o_orderkey") % 400).alias("frames"))


def s07_strided(spark: SparkSession, sf: str) -> DataFrame:
    return frames.strided(_assets(spark, sf), 2.0).select("asset", "idx", F.round("t", 6).alias("t"))


def s08_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return frames.keyframes(_assets(spark, sf), 1.5).select("asset", "idx", F.round("t", 6).alias("t"))


def s11_spread(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset"), (F.col("o_totalprice") / 50000).alias("duration"))
    return frames.spread(d).select("asset", F.col("pos").cast("long").alias("pos"), F.round("t", 9).alias("t"))


def a12_mean_levels(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "embeddings").select("vec_id", F.round(frames.mean_of(F.col("embedding")), 6).alias("mean"))


def a16_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Of each vector, the last value that a mask of growing length keeps."""
    mask = F.transform("embedding", lambda x, i: F.when(i <= F.col("vec_id") % 64, 1).otherwise(0))
    return src.table(spark, sf, "embeddings").select("vec_id", F.round(frames.pooled(F.col("embedding"), mask).cast("double"), 6).alias("state"))


def a19_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d = src.table(spark, sf, "events").select(F.col("event_type").alias("status"), F.lit(1).alias("seconds"))
    return frames.outcomes(d, ("click", "view", "error")).select("click", "view", "error", F.round("rate", 6).alias("rate"))


def a21_motion(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label as frames in order of their ids."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    d = src.table(spark, sf, "embeddings").select(F.col("label").alias("asset"), place.cast("long").alias("idx"), F.col("embedding").alias("pixels"))
    return frames.motion(d).select("asset", "idx", F.round("value", 6).alias("value"))


def a21_displacement(spark: SparkSession, sf: str) -> DataFrame:
    """The same frames, eight pixels wide: the mean displacement of their four blocks."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    d = src.table(spark, sf, "embeddings").select(F.col("label").alias("asset"), place.cast("long").alias("idx"), F.col("embedding").alias("pixels"))
    return displacement.motion(d, 8, side=4, reach=2, levels=1).select("asset", "idx", F.round("value", 6).alias("value"))


def p24_rated(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of four kinds to batches of two to four frames: plain, fenced, without JSON, and with two scores only."""
    k = F.col("event_id")
    scores = [(k * (i + 1) % 11).cast("string") for i in range(4)]
    json = lambda n: F.concat(F.lit('{"scores": ['), F.concat_ws(", ", *scores[:n]), F.lit('], "description": "scene"}'))
    text = F.when(k % 4 == 0, json(4)).when(k % 4 == 1, F.concat(F.lit("Here:\n```json\n"), json(4), F.lit("\n```"))).when(k % 4 == 2, "no scene").otherwise(json(2))
    d = src.table(spark, sf, "events").select(k.alias("asset"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i * 5.0).alias("times"), (2 + k % 3).cast("int").alias("n"), text.alias("text"))
    return frames.rated(d).select("asset", "t", F.col("rating").cast("long").alias("rating"), F.round("score", 6).alias("score"), "description")


def p27_meter(spark: SparkSession, sf: str) -> DataFrame:
    m = fn.meter((F.col("o_orderkey") % 100) / 100)
    return src.table(spark, sf, "orders").select("o_orderkey", m["percent"].alias("percent"), F.round(m["width"], 6).alias("width"), m["colour"].alias("colour"))


def p33_ramps(spark: SparkSession, sf: str) -> DataFrame:
    """Opacities and volume at the frames of a segment, and the frame that a voice starts at."""
    frame = (F.col("o_orderkey") % 90).cast("double")
    at = lambda knots, name: F.round(timeline.ramp(frame, 30, knots), 6).alias(name)
    return src.table(spark, sf, "orders").select("o_orderkey", at(timeline.LABEL_RAMP, "label"), at(timeline.METER_RAMP, "meter"), at(timeline.VOICE_RAMP, "voice"), timeline.voice_delay(30).alias("delay"), timeline.grade().alias("grade"))


QUERIES = {f.__name__: f for f in (s07_strided, s08_keyframes, s11_spread, a12_mean_levels, a16_pooled, a19_outcomes, a21_motion, a21_displacement, p24_rated, p27_meter, p33_ramps)}

_STEPPED = "WITH a AS (SELECT o_orderkey AS asset, 10.0::DOUBLE + o_orderkey % 50 AS fps, o_orderkey % 400 AS frames FROM orders), s AS (SELECT *, greatest(1, CAST(floor({step}) AS BIGINT)) AS step FROM a), u AS (SELECT asset, fps, unnest(range(0, frames, step)) AS idx FROM s) SELECT asset, idx, round(idx / fps, 6) AS t FROM u"
ORACLES = {
    "s07_strided": _STEPPED.format(step="fps / 2.0::DOUBLE"),
    "s08_keyframes": _STEPPED.format(step="fps * 1.5::DOUBLE"),
    "s11_spread": "SELECT o_orderkey AS asset, i AS pos, round(i * (o_totalprice / 50000) / 8, 9) AS t FROM orders, range(0, 8) AS r(i) WHERE o_totalprice / 50000 >= 0.5",
    "a12_mean_levels": "SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mean FROM embeddings",
    "a16_pooled": "SELECT vec_id, round(embedding[vec_id % 64 + 1]::DOUBLE, 6) AS state FROM embeddings",
    "a19_outcomes": "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS rate FROM events",
    "a21_motion": """WITH f AS (SELECT label AS asset, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT asset, idx, round(coalesce(list_avg(list_transform(range(1, len(e) + 1), lambda i: abs(e[i]::DOUBLE - b[i]::DOUBLE))), 0.0), 6) AS value FROM f""",
    "a21_displacement": """WITH f AS (SELECT label AS asset, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT asset, idx, y, x, dy, dx, list_sum(list_transform(range(0, 16), lambda p: abs(e[(y * 4 + p // 4) * 8 + x * 4 + p % 4 + 1]::DOUBLE - b[(y * 4 + dy + p // 4) * 8 + x * 4 + dx + p % 4 + 1]::DOUBLE))) AS off
  FROM f, range(0, 2) AS r1(y), range(0, 2) AS r2(x), range(-2, 3) AS r3(dy), range(-2, 3) AS r4(dx) WHERE b IS NOT NULL AND y * 4 + dy BETWEEN 0 AND 4 AND x * 4 + dx BETWEEN 0 AND 4),
m AS (SELECT asset, idx, y, x, arg_min(sqrt(dy * dy + dx * dx), (off, dy * dy + dx * dx, dy, dx)) AS far FROM c GROUP BY 1, 2, 3, 4)
SELECT f.asset, f.idx, round(coalesce(avg(far), 0.0), 6) AS value FROM f LEFT JOIN m USING (asset, idx) GROUP BY 1, 2""",
    "p24_rated": """WITH r AS (SELECT event_id AS asset, i * 5.0::DOUBLE AS t, event_id * (i + 1) % 11 AS rating FROM events, range(0, 4) AS u(i) WHERE i < 2 + event_id % 3 AND event_id % 4 <> 2 AND (event_id % 4 <> 3 OR i < 2))
SELECT asset, t, rating, round(rating / 10, 6) AS score, 'scene' AS description FROM r WHERE rating >= 5""",
    "p27_meter": """WITH n AS (SELECT o_orderkey, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (o_orderkey % 100 / 100 - 0.3::DOUBLE) / 0.4::DOUBLE)) AS n FROM orders)
SELECT o_orderkey, CAST(floor(n * 100 + 0.5::DOUBLE) AS BIGINT) AS percent, round(n * 100, 6) AS width, CASE WHEN n > 0.7::DOUBLE THEN '#e63946' WHEN n > 0.4::DOUBLE THEN '#f4a261' ELSE '#2a9d8f' END AS colour FROM n""",
    "p33_ramps": """WITH f AS (SELECT o_orderkey, o_orderkey % 90 AS f FROM orders)
SELECT o_orderkey, round(least(1.0::DOUBLE, f / 9.0::DOUBLE), 6) AS label, round(least(0.8::DOUBLE, f / 15.0::DOUBLE * 0.8), 6) AS meter, round(least(0.8::DOUBLE, f / 4.5::DOUBLE * 0.8), 6) AS voice, CAST(15 AS BIGINT) AS delay, 'contrast(1.15) brightness(1.05) saturate(1.1)' AS grade FROM f""",
}
