"""Streams drained over the test tables; the result is what a finished stream has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens.sources import adapters as src
from momentlens.sources.shared import scratch
from momentlens.streaming import stateful, streams


def _drained(stream: DataFrame) -> DataFrame:
    """Each batch's whole result replaces the last one in the shared folder; nothing of it comes to the driver."""
    spark = stream.sparkSession
    out = f"{scratch(spark)}/drained-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(out)
    written = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    written.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders; the table is one file in the folder or a folder of files
    d = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder)
    return d.parquet(path) if status.isDirectory() else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def st1_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events, an hour and up to 49 minutes long, merged as they come."""
    d = _events(spark, sf).select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("start_ts"), (F.lit(3600.0) + (F.col("event_id") % 50) * 60).alias("length"), F.col("value").alias("score"))
    return _drained(streams.merged_intervals(d, 0.0, "40 days")).select("source", "start", "end", "score", "n")


def st1_hopping(spark: SparkSession, sf: str) -> DataFrame:
    d = _events(spark, sf).select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = _drained(streams.hopping(d, "16 hours", "8 hours", "40 days"))
    return out.select("asset", F.unix_seconds("start").alias("start"), "n", F.round("mean", 6).alias("mean"), "max")


def st1_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Merges of an endless stream, by type and a twentieth of the users: events come unordered in two files, and results are appended once nothing can change them; rows of a later time end all."""
    source = F.concat("event_type", F.lit("-"), F.col("user_id") % 20)
    d = src.table(spark, sf, "events").select(source.alias("source"), F.col("ts").cast("timestamp").alias("start_ts"), (F.lit(3600.0) + (F.col("event_id") % 50) * 60).alias("length"), F.col("value").alias("score"), "event_id")
    top = f"{scratch(spark)}/merged-{uuid.uuid4().hex}"
    later = lambda days: d.agg(F.max("start_ts").alias("t")).select(F.lit(None).cast("string").alias("source"), F.timestamp_seconds(F.unix_seconds("t") + days * 86400).alias("start_ts"), F.lit(1.0).alias("length"), F.lit(0.0).alias("score"))
    for part in (d.drop("event_id").repartition(2, "start_ts"), later(100)):
        part.write.mode("append").parquet(f"{top}/in")
        stream = stateful.merged_intervals(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"), 0.0, "40 days")
        stateful.appended(stream, f"{top}/out", f"{top}/state")
    return stateful.results(spark, f"{top}/out", stream.schema).where("source IS NOT NULL").select("source", "start", "end", "score", "n")


QUERIES = {f.__name__: f for f in (st1_sessions, st1_hopping, st1_merged)}
ORACLES = {
    "st1_sessions": """WITH e AS (SELECT user_id AS source, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 3600 + event_id % 50 * 60 AS e, value AS score FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s <= m THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT source, min(s) AS start, max(e) AS "end", max(score) AS score, count(*) AS n FROM g GROUP BY source, g""",
    "st1_hopping": """WITH e AS (SELECT event_type AS asset, epoch(ts) AS t, value FROM events)
SELECT asset, CAST((floor(t / 28800) - k) * 28800 AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM e, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""",
}
ORACLES["st1_merged"] = ORACLES["st1_sessions"].replace("SELECT user_id AS source", "SELECT event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS source")
