"""Streams of intervals, windows and chunks. Batch inputs are the rule; these serve sources that keep growing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds(x: Column) -> Column:
    return F.make_interval(secs=x.cast("decimal(18,6)"))


def merged_intervals(stream: DataFrame, gap: float, late: str, key: str = "source", strict: bool = False) -> DataFrame:
    """Interval merge as sessions: rows (key, start_ts, length in seconds, score); intervals that touch merge unless ``strict``."""
    reach = F.col("length") + F.lit(gap) - F.lit(1e-6 if strict else 0.0)
    d = stream.withWatermark("start_ts", late).groupBy(key, F.session_window("start_ts", seconds(reach)).alias("w"))
    return d.agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("start_ts") / 1e6 + F.col("length")).alias("end")).select(key, (F.unix_micros("w.start") / 1e6).alias("start"), "end", "score", "n")


def hopping(stream: DataFrame, size: str, hop: str, late: str, key: str = "asset", ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, mean and maximum by overlapping windows."""
    d = stream.withWatermark(ts, late).groupBy(key, F.window(ts, size, hop).alias("w"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "max")


def unseen(stream: DataFrame, late: str, key: str = "chunk_id", ts: str = "ts") -> DataFrame:
    """Each chunk once, as far as the watermark reaches."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def indexed(stream: DataFrame, path: str, model: str, checkpoint: str):
    """Add every micro-batch to the chunk index; chunks that are there already are left out, so a batch may be replayed."""
    from momentlens.sources.files import add_chunks

    return stream.writeStream.foreachBatch(lambda batch, _: add_chunks(batch, path, model) and None).option("checkpointLocation", checkpoint).start()
