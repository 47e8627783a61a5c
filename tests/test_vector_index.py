"""The vector index against all pairs; how much it compares; growth and odd vectors."""

import uuid

import numpy as np
import pytest

from momentlens.operators import vector_index as vi

SCHEMA = "vec_id long, embedding array<float>"


def folder():
    return f"/tmp/momentlens-index-{uuid.uuid4().hex}"


def clustered(n, dims=16, groups=12, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    return (centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA)


def pairs(x, asked, least):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u[asked] @ u.T
    return {(int(asked[i]), int(j)): s[i, j] for i, j in zip(*np.nonzero(s >= least), strict=True)}


@pytest.mark.parametrize("least", [0.97, 0.5, -1.0])
@pytest.mark.parametrize("kind", ["clustered", "spread"])
def test_all_near_pairs(spark, least, kind, monkeypatch):
    monkeypatch.setattr(vi, "ASKED", 7)
    x = clustered(600) if kind == "clustered" else np.random.default_rng(2).normal(size=(400, 16)).astype(np.float32)
    d, path = frame(spark, x), folder()
    vi.build(d, path, "vec_id")
    asked = list(range(0, len(x), 40))
    q = d.where("vec_id % 40 = 0")
    want = pairs(x, np.array(asked), least)
    got = {(r["_q"], r["_id"]): r["similarity"] for r in vi.within(q, path, least, "vec_id").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if (kind, least) == ("clustered", 0.97):
        assert len(want) <= vi.compared(q, path, least, "vec_id") < 0.3 * len(asked) * len(x)


def test_nearest(spark):
    x = np.concatenate((clustered(500), clustered(3)[:1].repeat(30, axis=0)))  # with copies
    d, path = frame(spark, x), folder()
    vi.build(d, path, "vec_id", lists=20)
    asked = np.arange(0, len(x), 25)
    s = pairs(x, asked, -2)
    for k in (1, 7, 1000):
        got = {}
        for r in vi.nearest(d.where("vec_id % 25 = 0"), path, k, "vec_id").collect():
            got.setdefault(r["_q"], {})[r["place"]] = (r["_id"], r["similarity"])
        for q in asked.tolist():
            want = sorted(((-round(s[q, j], 9), j) for j in range(len(x))))[:k]
            assert [got[q][p + 1][0] for p in range(len(want))] == [j for _, j in want]
            assert len(got[q]) == len(want)


def test_growth_and_odd_vectors(spark):
    x = clustered(200)
    path = folder()
    odd = [(1000, None), (1001, []), (1002, [1.0]), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [0.0] * 16)]
    vi.build(frame(spark, x[:120]).unionByName(spark.createDataFrame(odd, SCHEMA)), path, "vec_id", lists=10)
    for _ in range(2):  # the second time adds nothing
        vi.add(frame(spark, x[100:], 100), path, "vec_id")
    q = frame(spark, x[:5])
    got = sorted((r["_q"], r["_id"]) for r in vi.within(q, path, 0.9, "vec_id").collect())
    assert got == sorted(pairs(x, np.arange(5), 0.9))
    zero = {r["_id"]: r["similarity"] for r in vi.within(q.where("vec_id = 0"), path, -1.0, "vec_id").collect()}
    assert len(zero) == 201 and zero[1005] == 0.0


def test_empty(spark):
    path = folder()
    vi.build(spark.createDataFrame([], SCHEMA), path, "vec_id")
    assert vi.within(frame(spark, clustered(3)), path, 0.1, "vec_id").count() == 0
    assert vi.nearest(frame(spark, clustered(3)), path, 3, "vec_id").count() == 0


def test_recall_is_whole_and_lists_are_even(spark, sf):
    """Of the given vectors, all are indexed and each finds itself."""
    d, path = spark.read.parquet(f"{sf}/embeddings.parquet"), folder()
    vi.build(d, path, "vec_id")
    got = vi.nearest(d, path, 1, "vec_id")
    assert got.where("_q = _id").count() == d.count()
    assert spark.read.parquet(f"{path}/shards").select("_list").distinct().count() > 5


def test_a_group_stays_small(spark, monkeypatch):
    """Copies have one angle, so ranges don't part them; shards and groups are cut all the same."""
    monkeypatch.setattr(vi, "MEMBERS", 50, raising=False)
    monkeypatch.setattr(vi, "PAIRS", 400, raising=False)
    real = vi._comparer

    def watched(most, counted):
        compare = real(most, counted)

        def watch(table):
            asked = table.column("_of").to_numpy().sum()
            assert len(table) - asked <= 50 and asked * (len(table) - asked) <= 1600, "a large group"
            return compare(table)

        return watch

    monkeypatch.setattr(vi, "_comparer", watched)
    d, path = frame(spark, clustered(3)[:1].repeat(700, axis=0)), folder()
    vi.build(d, path, "vec_id")
    q = d.where("vec_id % 10 = 0")
    assert vi.within(q, path, 0.5, "vec_id").count() == 70 * 700
    assert [r["_id"] for r in vi.nearest(q.where("vec_id = 690"), path, 3, "vec_id").orderBy("place").collect()] == [0, 1, 2]
