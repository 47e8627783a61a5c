"""Spacing, prominence and percentiles over many blocks and rounds against plain versions."""

import random

import numpy as np
import pytest

from momentlens.operators import peaks, ranks, series


def greedy(found, distance):
    kept = []
    for v, i in sorted(found, key=lambda x: (-x[0], -x[1])):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("block", [8, 40, 300, 10**6])
def test_spacing_of_long_chains(spark, block):
    rng = random.Random(block)
    chosen = {
        "rising": [(float(i), i) for i in range(0, 2000, 2)],  # one chain over all blocks
        "falling": [(float(-i), i) for i in range(0, 2000, 2)],
        "flat": [(1.0, i) for i in range(0, 900, 3)],
        "random": [(float(rng.randint(0, 9)), i) for i in sorted(rng.sample(range(3000), 900))],
        "one": [(5.0, 1700)],
    }
    d = spark.createDataFrame([(a, i, v) for a, x in chosen.items() for v, i in x], "asset string, idx long, value double")
    got = {}
    for r in peaks.spaced(d, 7, "asset", "idx", "value", block=block).collect():
        got.setdefault(r["asset"], []).append(r["idx"])
    assert {a: sorted(x) for a, x in got.items()} == {a: greedy(x, 7) for a, x in chosen.items()}
    assert peaks.spaced(d.limit(0), 7, "asset", "idx", "value", block=block).count() == 0


def test_undecided_only_where_others_may_decide():
    at, y = np.array([0, 3, 6, 9, 30]), np.array([1.0, 2.0, 3.0, 4.0, 1.0])
    assert peaks.kept(at, y, 5, -np.inf, np.inf).tolist() == [0, 1, 0, 1, 1]
    assert peaks.kept(at, y, 5, -np.inf, 12).tolist() == [-1, -1, -1, -1, -1]  # what is behind 12 may be higher
    assert peaks.kept(at, y, 5, -np.inf, 34).tolist() == [0, 1, 0, 1, -1]


def prominence(x, i):
    left = max([j for j in range(i) if x[j] > x[i]], default=-1)
    right = min([j for j in range(i, len(x)) if x[j] > x[i]], default=len(x))
    return x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min())


@pytest.mark.parametrize("block", [1, 3, 16, 100, 10**6])
def test_prominence_of_any_walls(spark, block, monkeypatch):
    monkeypatch.setattr(peaks, "ASKED", 5)  # several parts for each asset and block
    rng = np.random.default_rng(block)
    walk = np.cumsum(rng.integers(-2, 3, 400)).astype(float)
    chosen = {"walk": walk, "rising": np.arange(60.0) + 3 * (np.arange(60) % 2), "low": rng.integers(0, 3, 150).astype(float), "flat": np.zeros(20), "top": np.concatenate((walk[:90], [1e9], walk[90:180]))}
    s = spark.createDataFrame([(a, i, float(v)) for a, x in chosen.items() for i, v in enumerate(x)], "asset string, idx long, value double")
    found = series.local_maxima(s)
    want = {(r["asset"], r["idx"]): prominence(chosen[r["asset"]], r["idx"]) for r in found.collect()}
    assert len(want) > 100
    got = peaks.prominences(found, s, "asset", "idx", "value", block=block)
    assert {(r["asset"], r["idx"]): r["prominence"] for r in got.collect()} == want


def test_sparse_table():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 9, 37).astype(float), rng.integers(-9, 0, 37).astype(float)
    t = peaks.SparseTable(high, low)
    for end in range(38):
        for y in range(-1, 10):
            wall = max([j for j in range(end) if high[j] > y], default=-1)
            at, least = t.before(np.array([end]), np.array([float(y)]), np.array([5.0]))
            assert (at[0], least[0]) == (wall, min([5.0, *low[wall + 1 : end]]))


@pytest.mark.parametrize("p", [0.0, 0.45, 0.5, 0.75, 0.85, 1.0])
def test_percentiles_by_rounds(spark, p):
    rng = np.random.default_rng(7)
    chosen = {
        "normal": rng.normal(size=500), "ties": rng.integers(0, 4, 300).astype(float), "equal": np.full(50, 3.25), "outlier": np.concatenate((rng.random(99), [1e300, -1e308])),
        "close": 1 + rng.integers(0, 50, 80) * np.finfo(float).eps, "two": np.array([1.0, 2.0]), "one": np.array([7.0]),
    }
    rows = [(a, float(v)) for a, x in chosen.items() for v in x] + [("normal", None), ("normal", float("nan")), ("none", None)]
    d = spark.createDataFrame(rows, "asset string, value double").repartition(5)
    for few, bins in ((0, 8), (60, 3), (10**6, 8)):
        got = {r["asset"]: r["percentile"] for r in ranks.percentiles(d, p, "asset", "value", few=few, bins=bins).collect()}
        for a, x in chosen.items():
            assert got[a] == pytest.approx(np.percentile(x, 100 * p), rel=1e-12), (a, few)
            assert got[a] in x or (len(x) - 1) * p % 1 != 0
        assert got.get("none") is None


def test_percentile_equals_spark(spark):
    """To the last bit, as rows at the percentile itself are kept."""
    d = spark.range(1000).selectExpr("id % 3 AS k", "sin(id) AS v")
    want = {r["k"]: r["q"] for r in d.selectExpr("k", "v").groupBy("k").agg({"v": "count"}).join(d.selectExpr("k AS kk", "v").groupBy("kk").agg({"v": "median"}).toDF("kk", "q"), d["k"] == d["k"]).where("k = kk").collect()}
    assert {r["k"]: r["percentile"] for r in ranks.percentiles(d, 0.5, "k", "v", few=0, bins=16).collect()} == want
