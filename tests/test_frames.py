"""Frame operators against small cases by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens.operators import frames


def test_steps(spark):
    d = spark.createDataFrame([("a", 30.0, 61), ("slow", 1.0, 3), ("none", 30.0, 0), ("odd", 0.0, 9), ("null", None, 9)], "asset string, fps double, frames int")
    got = [(r["asset"], r["idx"]) for r in frames.strided(d, 2.0).orderBy("asset", "idx").collect()]
    assert got == [("a", i) for i in range(0, 61, 15)] + [("slow", i) for i in range(3)]
    got = [(r["asset"], r["idx"], r["t"]) for r in frames.keyframes(d, 2.0).orderBy("asset", "idx").collect()]
    assert got == [("a", 0, 0.0), ("a", 60, 2.0), ("slow", 0, 0.0), ("slow", 2, 2.0)]


def test_spread_leaves_out_short_ones(spark):
    d = spark.createDataFrame([("a", 4.0), ("b", 0.4), ("c", None)], "asset string, duration double")
    assert [(r["asset"], r["t"]) for r in frames.spread(d, 4).orderBy("pos").collect()] == [("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 3.0)]


@pytest.mark.parametrize("n", [1, 3, 4, 11])
def test_motion_over_blocks(spark, n):
    x = np.random.default_rng(n).integers(0, 255, (n, 6))
    d = spark.createDataFrame([("a", i, row.tolist()) for i, row in enumerate(x)], "asset string, idx long, pixels array<int>")
    want = [0.0] + [float(np.abs(x[i] - x[i - 1]).mean()) for i in range(1, n)]
    assert np.allclose([r["value"] for r in frames.motion(d, block=3).orderBy("idx").collect()], want)


def test_motion_of_empty_frames(spark):
    d = spark.createDataFrame([("a", 0, []), ("a", 1, []), ("a", 2, None)], "asset string, idx long, pixels array<int>")
    assert [r["value"] for r in frames.motion(d).collect()] == [0.0, 0.0, 0.0]


def test_pooled(spark):
    d = spark.createDataFrame([([1, 2, 3], [1, 1, 0]), ([1, 2, 3], [0, 0, 0]), ([], []), (None, None)], "s array<int>, m array<int>")
    assert [r[0] for r in d.select(frames.pooled(F.col("s"), F.col("m"))).collect()] == [2, None, None, None]


def test_rated(spark):
    rows = [("a", [0.0, 1.0, 2.0, 2.0], 3, '{"scores": [5, 4, 9, 9], "description": "d"}'), ("b", [0.0, 1.0, 1.0, 1.0], 2, "x {\"scores\": [7]} y"), ("c", [0.0], 1, "none"), ("d", [0.0], 1, None), ("e", None, None, '{"scores": [9]}')]
    d = spark.createDataFrame(rows, "asset string, times array<double>, n int, text string")
    got = [tuple(r) for r in frames.rated(d).orderBy("asset", "t").collect()]
    assert got == [("a", 0.0, 5, 0.5, "d"), ("a", 2.0, 9, 0.9, "d"), ("b", 0.0, 7, 0.7, "")]


def test_outcomes_of_nothing(spark):
    d = spark.createDataFrame([], "status string, seconds double")
    assert tuple(frames.outcomes(d, ("done", "still")).first()) == (0, 0, None)
