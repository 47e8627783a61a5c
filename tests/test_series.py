"""Series operators against loops over small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens.operators import series, signals


def frame(spark, values, asset="a"):
    return spark.createDataFrame([(asset, i, float(v)) for i, v in enumerate(values)], "asset string, idx long, value double")


def values(df):
    return [r["value"] for r in df.orderBy("asset", "idx").collect()]


@pytest.mark.parametrize("n", [1, 2, 5, 7, 60])
@pytest.mark.parametrize("size", [4, 6])
def test_smoothing_reflects(spark, n, size):
    x = np.random.default_rng(n).normal(size=n)
    at = [[(i + k) % (2 * n) for k in range(-(size // 2), size - size // 2)] for i in range(n)]
    seen = [[x[j] if j < n else x[2 * n - 1 - j] for j in row] for row in at]
    assert np.allclose(values(series.moving_average(frame(spark, x), size, block=3)), [np.mean(s) for s in seen])
    assert np.allclose(values(series.running_median(frame(spark, x), size, block=3)), [sorted(s)[size // 2] for s in seen])


def maxima(x):
    out, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


@pytest.mark.parametrize("x", [[], [1], [1, 1, 1], [1, 2, 3], [3, 2, 1], [0, 2, 2, 2, 0], [2, 2, 0, 1, 1], [0, 3, 0, 3, 3, 1, 5, 0]])
def test_plateaus_and_edges(spark, x):
    assert [r["idx"] for r in series.local_maxima(frame(spark, x)).orderBy("idx").collect()] == maxima(x)


@pytest.mark.parametrize("seed", range(4))
def test_spacing_is_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(200, 40, replace=False))
    height = rng.integers(0, 6, 40).astype(float)
    kept = []
    for y, i in sorted(zip(height, at, strict=True), reverse=True):
        if all(abs(i - k) >= 9 for k in kept):
            kept.append(i)
    d = spark.createDataFrame([("a", int(i), float(y)) for i, y in zip(at, height, strict=True)], "asset string, idx long, value double")
    assert [r["idx"] for r in series.spaced(d, 9).orderBy("idx").collect()] == sorted(kept)


def test_prominence(spark):
    x = [0, 5, 3, 4, 1, 9, 2, 3, 0]
    s = frame(spark, x)
    got = {r["idx"]: r["prominence"] for r in series.prominent(series.local_maxima(s), s, F.lit(0.0)).collect()}
    assert got == {1: 4.0, 3: 1.0, 5: 9.0, 7: 1.0}


@pytest.mark.parametrize("block", [1, 4, 512])
def test_prominence_over_blocks(spark, block):
    x = np.random.default_rng(block).integers(0, 12, 90).astype(float)
    want = {}
    for i in maxima(x):
        left = max([j for j in range(i) if x[j] > x[i]], default=-1)
        right = min([j for j in range(i, len(x)) if x[j] > x[i]], default=len(x))
        want[i] = x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min())
    s = frame(spark, x)
    got = series.prominent(series.local_maxima(s).withColumn("least", F.lit(2.0)), s, F.col("least"), block=block)
    assert {r["idx"]: r["prominence"] for r in got.collect()} == {k: v for k, v in want.items() if v >= 2}


def test_normalized_flat_and_empty(spark):
    d = frame(spark, [2, 2 + 1e-9, 2])
    assert values(signals.normalized(d, ["value"])) == [0.0, 0.0, 0.0]
    assert signals.normalized(d.limit(0), ["value"]).count() == 0


def test_low_runs(spark):
    rows = [("a", float(t), v) for t, v in enumerate([10, 10, 90, 10, 90, 10, 10, 10], 0)]
    d = spark.createDataFrame(rows, "asset string, t double, value int")
    assert [(r["start"], r["end"]) for r in series.low_runs(d, 35, 1.5).orderBy("start").collect()] == [(0.0, 2.0), (5.0, 7.0)]


def test_batches_pad_and_drop(spark):
    got = {r["batch"]: r["values"] for r in signals.batches(frame(spark, [1, 2, 3, 4, 5, 6]), 4).collect()}
    assert got == {0: [1.0, 2.0, 3.0, 4.0], 1: [5.0, 6.0, 6.0, 6.0]}
    assert signals.batches(frame(spark, [1, 2, 3, 4, 5]), 4).count() == 1


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_agree(spark, block):
    """Maxima and low runs are the same however short the blocks are."""
    rng = random.Random(block)
    for n in (1, 2, 40):
        x = [float(rng.randint(0, 3)) for _ in range(n)]
        assert sorted(r["idx"] for r in series.local_maxima(frame(spark, x), block=block).collect()) == maxima(x)
        t = sorted(rng.sample(range(100), n))
        d = spark.createDataFrame([("a", float(a), v) for a, v in zip(t, x, strict=True)], "asset string, t double, value double")
        want, start = [], None
        for k, v in enumerate(x):
            if v < 2 and start is None:
                start = t[k]
            if v >= 2 and start is not None:
                want.append((start, t[k]))
                start = None
        if start is not None:
            want.append((start, t[-1]))
        got = [(r["start"], r["end"]) for r in series.low_runs(d, 2, 1.0, span=block).orderBy("start").collect()]
        assert got == [(a, b) for a, b in want if b - a >= 1]


def test_action_windows(spark):
    """Samples of 16 every 8, the last one repeated, none of fewer than four; what none covers is 0."""
    lengths = spark.createDataFrame([("a", 19), ("b", 3), ("c", 12), ("d", 11), ("e", 0)], "asset string, n long")
    w = signals.action_windows(lengths)
    got = {(r["asset"], r["start"]): (r["end"], r["places"]) for r in w.collect()}
    assert set(got) == {("a", 0), ("a", 8), ("c", 0), ("c", 8), ("d", 0)}
    assert got["a", 8] == (19, [*range(8, 19), *[18] * 5]) and got["c", 8] == (12, [8, 9, 10, 11, *[11] * 12])
    scores = w.select("asset", "start", "end", F.when(F.col("start") == 8, -1.0).otherwise(0.5).alias("score"))
    top = {(r["asset"], r["idx"]): r["score"] for r in signals.hopping_max(scores, lengths).collect()}
    assert len(top) == 19 + 3 + 12 + 11 and top["a", 15] == 0.5 and top["a", 18] == 0.0 and top["b", 2] == 0.0


@pytest.mark.parametrize("rounds", [0, 1, 3])
@pytest.mark.parametrize("block", [1, 50])
def test_spacing_by_rounds(spark, rounds, block):
    """Rounds in short blocks keep what one greedy pass over the peaks keeps."""
    rng = random.Random(rounds + block)
    at = sorted(rng.sample(range(400), 150))
    peaks = [(float(rng.randint(0, 12)), i) for i in at] + [(float(i), i) for i in range(400, 440)]  # rising ones make a long chain
    kept = []
    for v, i in sorted(peaks, key=lambda x: (-x[0], -x[1])):
        if all(abs(i - k) >= 5 for k in kept):
            kept.append(i)
    d = spark.createDataFrame([("a", i, v) for v, i in peaks], "asset string, idx long, value double")
    assert sorted(r["idx"] for r in series.spaced(d, 5, block=block, rounds=rounds).collect()) == sorted(kept)
