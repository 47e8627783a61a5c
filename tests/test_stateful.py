"""Endless merges and peaks against the batch answer, for late and unordered rows; state that ends."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from momentlens.streaming import stateful, streams


def run(spark, rows, schema, make, batches, far, ts):
    """Rows by micro-batches, then one of a later time for another key, so that all ends. ``make`` gives the stream's result."""
    top = f"/tmp/momentlens-stateful-{uuid.uuid4().hex}"
    for k in range(batches + 2):
        part = rows[k::batches] if k < batches else [far]
        if k == batches + 1:
            part = [(far[0], far[1] + 1e6, *far[2:])]
        d = spark.createDataFrame(part, schema).withColumn(ts, F.timestamp_seconds(F.col(ts)))
        d.coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = make(spark.readStream.schema(d.schema).parquet(f"{top}/in"))
        stateful.appended(stream, f"{top}/out", f"{top}/state")
    return stateful.results(spark, f"{top}/out", stream.schema), top


def test_merges_equal_the_batch(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 4000)), float(rng.randint(1, 30)), rng.random()) for _ in range(150)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 900))  # late by up to 900 seconds
    chunks = [rows[i : i + 50] for i in range(0, 150, 50)]
    order = [chunks[k % 3][k // 3] for k in range(150)]  # run() takes every third
    got, _ = run(spark, order, "source string, start_ts double, length double, score double", lambda s: stateful.merged_intervals(s, 5.0, "1000 seconds"), 3, ("z", 1e6, 1.0, 0.0), "start_ts")
    want = []
    for k in "ab":
        want += [(k, *x) for x in stateful.joined([(s, s + w, v, 1) for a, s, w, v in rows if a == k], 5.0)]
    assert sorted((r["source"], r["start"], r["end"], r["score"], r["n"]) for r in got.collect() if r["source"] != "z") == sorted(want)


def test_peaks_equal_the_batch(spark):
    rng = random.Random(2)
    rows = [(a, float(t), float(rng.randint(0, 20))) for a in "ab" for t in rng.sample(range(3000), 90)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 200))
    chunks = [rows[i : i + 60] for i in range(0, 180, 60)]
    order = [chunks[k % 3][k // 3] for k in range(180)]
    got, _ = run(spark, order, "asset string, ts double, value double", lambda s: stateful.peaks(s, 40.0, "300 seconds"), 3, ("z", 1e6, 1.0), "ts")
    want = [(k, *p) for k in "ab" for p in stateful.maxima(sorted((t, v) for a, t, v in rows if a == k), 40.0, 1e9)]
    assert sorted((r["asset"], r["t"], r["value"]) for r in got.collect() if r["asset"] != "z") == sorted(want)


def test_state_is_bounded_by_the_delay(spark):
    """A stream of ten thousand intervals, in order, keeps only those that the delay still reaches."""
    top = f"/tmp/momentlens-stateful-{uuid.uuid4().hex}"
    for k in range(3):
        d = spark.range(k * 400, (k + 1) * 400).selectExpr("concat('s', id % 4) AS source", "timestamp_seconds(id * 60D) AS start_ts", "10D AS length", "1D AS score")
        d.coalesce(1).write.mode("append").parquet(f"{top}/in")
        stateful.appended(stateful.merged_intervals(spark.readStream.schema(d.schema).parquet(f"{top}/in"), 0.0, "10 minutes"), f"{top}/out", f"{top}/state")
        out = stateful.results(spark, f"{top}/out", stateful.merged_intervals(spark.readStream.schema(d.schema).parquet(f"{top}/in"), 0.0, "10 minutes").schema)
        left = (k + 1) * 400 - out.count()
        assert 0 < left < 40


def test_each_chunk_once_and_indexed(spark, tmp_path):
    """``unseen`` and ``indexed`` over batches that repeat chunks."""
    from momentlens.sources import files

    top = str(tmp_path)
    for k in range(3):
        d = spark.range(k * 5, k * 5 + 10).selectExpr("concat('c', id) AS chunk_id", "timestamp_seconds(id + 1000) AS ts", "concat('/v', id % 3, '.mp4') AS source", "id * 25D AS start", "id * 25D + 30 AS end", "array(cast(id AS float)) AS embedding")
        d.coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(d.schema).parquet(f"{top}/in")
        streams.unseen(stream, "1 hour").writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/s1").trigger(availableNow=True).start().awaitTermination()
        q = streams.indexed(stream.drop("ts", "chunk_id"), f"{top}/index", "m", f"{top}/s2")
        q.processAllAvailable()
        q.stop()
    ids = [r["chunk_id"] for r in spark.read.parquet(f"{top}/out").collect()]
    assert sorted(ids) == sorted(f"c{i}" for i in range(20))
    assert files.indexed_chunks(spark, f"{top}/index").count() == 20


@pytest.mark.parametrize("gap", [0.0, 3.0])
def test_joined(gap):
    x = [(0.0, 5.0, 0.1, 1), (5.0, 6.0, 0.9, 2), (8.0, 9.0, 0.2, 1), (1.0, 2.0, 0.3, 1)]
    assert stateful.joined(x, gap) == ([(0.0, 6.0, 0.9, 4), (8.0, 9.0, 0.2, 1)] if gap == 0 else [(0.0, 9.0, 0.9, 5)])
    assert stateful.joined([], gap) == []
