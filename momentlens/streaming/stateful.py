"""Endless streams with state that ends: intervals are merged and peaks found as rows come, each result once, when nothing can change it any more.

Rows may come late, up to the watermark's delay, and in any order. A key's state holds only what later rows may still change: intervals that a row after the watermark
could touch, and places that a peak's decision still needs. Timers at the event time at which that ends emit results in append mode and drop the state, so it is
bounded by the delay, not by the stream's length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# workers get these classes by value, so they needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OPEN = T.StructType([T.StructField(n, t) for n, t in (("start", T.DoubleType()), ("end", T.DoubleType()), ("score", T.DoubleType()), ("n", T.LongType()))])
_PLACE = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("value", T.DoubleType())])
MERGED = "start double, end double, score double, n long"
PEAK = "t double, value double"


def joined(intervals: list[tuple[float, float, float, int]], gap: float) -> list[tuple[float, float, float, int]]:
    """Intervals (start, end, score, n) in order; those that are at most ``gap`` apart are one."""
    out: list[tuple[float, float, float, int]] = []
    for start, end, score, n in sorted(intervals):
        if out and start <= out[-1][1] + gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], end), max(a[2], score), a[3] + n)
        else:
            out.append((start, end, score, n))
    return out


def maxima(places: list[tuple[float, float]], reach: float, until: float) -> list[tuple[float, float]]:
    """Places (t, value), in order, that are higher than all others within ``reach`` before and at least as high as those after, up to a time."""
    return [(t, v) for i, (t, v) in enumerate(places) if t <= until and all(w < v for u, w in places[:i] if u >= t - reach) and all(w <= v for u, w in places[i + 1 :] if u <= t + reach)]


class _Timed(StatefulProcessor):
    """A list of rows in the state, and one timer for the first of them that ends."""

    schema: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", self.schema)

    def held(self) -> list[tuple]:
        return [tuple(r) for r in self.rows.get()]

    def keep(self, rows: list[tuple], wake: float | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            self.rows.put(rows)
        else:
            self.rows.clear()
        if wake is not None:
            self.handle.registerTimer(int(wake * 1000) + 1)

    def close(self) -> None: ...


class Merging(_Timed):
    schema = _OPEN

    def __init__(self, gap: float):
        self.gap = gap

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(float(s), float(s + w), float(v), 1) for d in rows for s, w, v in zip(d["seconds"], d["length"], d["score"], strict=True)]
        merged = joined(self.held() + new, self.gap)
        yield from self._out(key, merged, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(key, self.held(), timerValues)

    def _out(self, key, rows: list[tuple], timers) -> Iterator[pd.DataFrame]:
        # what begins from the watermark on can't touch an interval that ended more than the gap before
        now = timers.getCurrentWatermarkInMs() / 1000
        done = [r for r in rows if r[1] + self.gap < now]
        left = [r for r in rows if r[1] + self.gap >= now]
        self.keep(left, min((r[1] for r in left), default=0.0) + self.gap if left else None)
        if done:
            yield pd.DataFrame({"series": [key[0]] * len(done), **{c: [r[i] for r in done] for i, c in enumerate(("start", "end", "score", "n"))}})


class Peaks(_Timed):
    schema = _PLACE

    def __init__(self, reach: float):
        self.reach = reach

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(float(t), float(v)) for d in rows for t, v in zip(d["seconds"], d["value"], strict=True)]
        yield from self._out(key, sorted(self.held() + new), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(key, sorted(self.held()), timerValues)

    def _out(self, key, rows: list[tuple], timers) -> Iterator[pd.DataFrame]:
        # a place is decided when no more can come within its reach; those decided stay while others need them
        now = timers.getCurrentWatermarkInMs() / 1000
        sure, before = now - self.reach, self.last()
        found = [(t, v) for t, v in maxima(rows, self.reach, sure - 1e-9) if t > before]
        left = [r for r in rows if r[0] >= sure - self.reach]
        waiting = [t for t, _ in left if t >= sure]
        self.keep(left, min(waiting) + self.reach if waiting else (max(t for t, _ in left) + 2 * self.reach if left else None))
        if left:
            self.decided.update((max(before, sure - 1e-9),))
        else:
            self.decided.clear()
        if found:
            yield pd.DataFrame({"series": [key[0]] * len(found), "t": [t for t, _ in found], "value": [v for _, v in found]})

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.decided = handle.getValueState("decided", "t double")

    def last(self) -> float:
        return self.decided.get()[0] if self.decided.exists() else float("-inf")


def _seconds(d: DataFrame, ts: str) -> DataFrame:
    return d.withColumn("seconds", F.unix_micros(ts) / 1e6)


def _run(stream: DataFrame, key: str, ts: str, late: str, columns: list[str], processor: StatefulProcessor, result: str) -> DataFrame:
    kind = stream.schema[key].dataType.simpleString()
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # names that a named tuple may have
    d = _seconds(stream.withWatermark(ts, late), ts).select(F.col(key).alias("series"), ts, "seconds", *columns)
    out = d.groupBy("series").transformWithStateInPandas(processor, outputStructType=f"series {kind}, {result}", outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("series", key)


def merged_intervals(stream: DataFrame, gap: float, late: str, key: str = "source", ts: str = "start_ts") -> DataFrame:
    """(key, start, end, score, n) in append mode: intervals (key, start_ts, length in seconds, score) that overlap or are at most ``gap`` apart as one, once later rows can't touch it. Sets the session's state store to RocksDB, which timers need."""
    return _run(stream.select(key, ts, F.col("length").cast("double").alias("length"), F.col("score").cast("double").alias("score")), key, ts, late, ["length", "score"], Merging(gap), MERGED)


def peaks(stream: DataFrame, reach: float, late: str, key: str = "asset", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, t, value) in append mode: samples that are highest within ``reach`` seconds on both sides, of equal ones the first, once no more can come within reach. Rows of a key have different times."""
    return _run(stream.select(key, ts, F.col(value).cast("double").alias("value")), key, ts, late, ["value"], Peaks(reach), PEAK)


def appended(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there now, appending its results to a table; run again, it goes on where it was."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the stream has written."""
    return spark.read.schema(schema).parquet(path)
