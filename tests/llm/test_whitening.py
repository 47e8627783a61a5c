"""Whitening against numpy's eigen-solver on all rows in memory, and its parts."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from momentlens.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, most=16):
    """{(id, component)}: values by numpy; ``rows``: (id, list)."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, row in x.items():
        dev = int(((n * np.array(row, object) - sums) ** 2).sum())
        out[i] = (n, dev, ((n * np.array(row, object) - sums).astype(float) / n) @ axes[:, :most] / np.sqrt(e[:most]), e[:most] / np.trace(v))
    return out


def agree(got, want, k):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(want)
    for i, (n, dev, white, explained) in want.items():
        assert sorted(by[i]) == list(range(1, k + 1))
        for c, r in by[i].items():
            assert (r["n"], r["deviation"]) == (n, dev)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(white[c - 1]), abs=1e-8)
            assert r["identity_error"] < 1e-9
    # one sign for each component
    for c in range(1, k + 1):
        signs = {np.sign(by[i][c]["whitened"] * want[i][2][c - 1]) for i in want if abs(want[i][2][c - 1]) > 1e-6}
        assert len(signs) == 1


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=20).astype(np.float32) * np.arange(1, 21)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies: fitted once
    rows += [(2000, None), (2001, [None] + [0.0] * 19), (2002, [math.nan] + [0.0] * 19), (2003, [math.inf] + [0.0] * 19), (2004, []), (2005, [1.0])]
    got = w.whitened(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    agree(got, plain([r for r in rows if r[0] < 2000]), 16)
    assert len(got) == 500 * 16


def test_whole_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    agree(w.query(spark, sf).collect(), plain(rows), 16)


def test_few_and_none(spark):
    assert w.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert w.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []  # no variance
    got = w.whitened(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [2.0, 2.0])], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 3  # one dimension has all variance
    assert [r["explained"] for r in got] == pytest.approx([1.0] * 3)


def test_other_types_and_columns(spark):
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("w_x", T.IntegerType()), T.StructField("component", T.StringType())])
    rows = [(str(i), [float(i), float(i * i), 1.0 / (i + 1)], i, "x") for i in range(9)]
    got = w.whitened(spark.createDataFrame(rows, schema), "key", "v")
    assert got.columns == ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 27 and {r["key"] for r in got.collect()} == {str(i) for i in range(9)}


def test_large_entries(spark):
    big = 2.0**44
    got = w.whitened(spark.createDataFrame([(1, [big, 0.0]), (2, [0.0, 1.0]), (3, [2.0**47, 0.0])], SCHEMA)).collect()
    assert {r["vec_id"] for r in got} == {1, 2}
    assert all(r["deviation"] is None for r in got)  # (2^51)^2 isn't a long


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40, 64])
def test_eigen(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(np.arange(n) // 2).astype(float), np.ones((n, n)), np.zeros((n, n))):
        a = (a + a.T) / 2
        values, q = w.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-10)
        assert np.allclose(q.T @ q, np.eye(n), atol=1e-12)
        assert np.allclose(q * values @ q.T, a, atol=1e-10)


def test_merge_equals_one_stream():
    x = np.random.default_rng(1).normal(size=(100, 5)) + 1e6
    whole, left, right = w.Moments(5), w.Moments(5), w.Moments(5)
    for i, row in enumerate(x):
        whole.add(row)
        (left if i < 37 else right).add(row)
    left.merge(right)
    left.merge(w.Moments(5))
    assert left.n == 100 and np.allclose(left.covariance(), whole.covariance(), rtol=1e-9) and np.allclose(left.covariance(), np.cov(x.T, bias=True), rtol=1e-8)
    again = w.Moments.of(left.batch().to_pylist()[0])
    assert (again.products == left.products).all() and again.sums == left.sums


def test_exact_sums_and_deviations():
    x = np.array([[2**52, -(2**52)], [2**52 - 1, 7], [3, 2**50]], np.int64)
    assert w._sums(x) == [sum(int(v) for v in c) for c in x.T]
    small = np.array([[5, 6], [7, -8]], np.int64)
    assert w._deviations(small, 3, [10, 11]) == [(15 - 10) ** 2 + (18 - 11) ** 2, (21 - 10) ** 2 + (-24 - 11) ** 2]
    assert w._deviations(np.array([[2**40]], np.int64), 2, [0]) == [None]


def test_distinct_before_the_shuffle(spark, sf):
    d = w.integers(spark.read.parquet(f"{sf}/embeddings.parquet")).select("w_x").distinct()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
