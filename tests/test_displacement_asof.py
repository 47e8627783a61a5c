"""Displacements of shifted patterns, and as-of joins against a plain scan."""

import random

import numpy as np
import pytest

from momentlens.operators import asof, displacement


def shifted(x, dy, dx):
    return np.roll(x, (dy, dx), axis=(0, 1))


@pytest.mark.parametrize(("levels", "side", "reach"), [(1, 8, 4), (2, 8, 3), (3, 4, 2)])
def test_a_shift_is_found(levels, side, reach):
    rng = np.random.default_rng(levels)
    coarse = rng.random((16, 24))
    x = np.kron(coarse, np.ones((4, 4)))  # smooth enough to be found on coarse levels
    for dy, dx in ((0, 0), (4, -4), (-4, 0), (0, 4)):
        moved = displacement.displacements(shifted(x, dy, dx)[None], x[None], side, reach, levels)
        inner = moved[0, 1:-1, 1:-1]
        assert (np.median(inner.reshape(-1, 2), axis=0) == (-dy, -dx)).all(), (dy, dx)


def test_ties_go_to_the_shortest():
    flat = np.ones((1, 16, 16))
    assert not displacement.displacements(flat, flat, 4, 2, 2).any()


def test_frames_over_blocks(spark):
    rng = np.random.default_rng(1)
    x = [rng.random(16 * 12)]
    for _ in range(20):
        x.append(np.roll(x[-1].reshape(12, 16), (0, 1), axis=(0, 1)).reshape(-1))
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 0, [1.0] * 16), ("b", 1, [1.0] * 32), ("b", 2, None), ("b", 3, [1.0] * 16), ("b", 4, [None] * 16), ("c", 0, [0.0] * 7), ("c", 1, [0.0] * 7), ("d", 0, [0.5] * 32), ("d", 1, [0.5] * 32)]
    d = spark.createDataFrame(rows, "asset string, idx long, pixels array<double>")
    want = displacement.displacements(np.array(x[1:]).reshape(-1, 12, 16), np.array(x[:-1]).reshape(-1, 12, 16), 4, 2, 1)
    mean = np.sqrt((want**2).sum(axis=3)).mean(axis=(1, 2))
    for block in (1, 4, 4096):
        got = {(r["asset"], r["idx"]): r["value"] for r in displacement.motion(d, 16, side=4, reach=2, levels=1, block=block).collect()}
        assert got["a", 0] == 0 and [got["a", i + 1] for i in range(20)] == pytest.approx(mean.tolist())
        assert [got["b", i] for i in range(5)] == [0.0, None, None, 0.0, None]
        assert got["c", 1] is None and got["d", 1] == 0.0
    assert mean.mean() > 0.6


@pytest.mark.parametrize("span", [1, 7, 1000])
@pytest.mark.parametrize("within", [None, 5])
def test_as_of(spark, span, within):
    rng = random.Random(span)
    left = [(rng.choice("ab"), rng.randint(-50, 200), i) for i in range(150)] + [(None, 5, -1), ("a", None, -2), ("only left", 5, -3)]
    right = [(rng.choice("ab"), rng.randint(-20, 150), rng.choice([None, *range(9)]), "x") for _ in range(60)] + [(None, 1, 1, "y"), ("b", None, 1, "y"), ("only right", 1, 1, "y")]
    want = {}
    for k, t, i in left:
        older = [(rt, (v is not None, v or 0), v, n) for rk, rt, v, n in right if k is not None and rk == k and t is not None and rt is not None and rt <= t and (within is None or True)]
        best = max(older) if older else None
        if best and within is not None and t - best[0] > within:
            best = None
        want[i] = (k, t, best and best[0], best and best[2], best and best[3])
    a = spark.createDataFrame(left, "k string, t long, n long").repartition(3)
    b = spark.createDataFrame(right, "k string, t long, v long, n string").repartition(2)
    got = asof.as_of(a, b, "k", "t", ["v", "n"], span, within)
    assert got.columns == ["k", "t", "n", "t_before", "v", "n_before"]
    assert {r["n"]: (r["k"], r["t"], r["t_before"], r["v"], r["n_before"]) for r in got.collect()} == want
    assert asof.as_of(a, b.limit(0), "k", "t", ["v"], span).where("v IS NOT NULL").count() == 0
