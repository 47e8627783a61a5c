"""Links of fingerprints that share many bits without being alike."""

import time
from itertools import combinations

import numpy as np
import pytest

from momentlens.llm import near_duplicates as nd


def skewed(n, seed, templates=1, near=0):
    """Fingerprints that have the low 32 bits of a template; some of them come again with a few bits turned."""
    r = np.random.default_rng(seed)
    low = r.integers(0, 2**32, templates, dtype=np.uint64)
    fps = r.integers(0, 2**32, n, dtype=np.uint64) << np.uint64(32) | low[r.integers(0, templates, n)]
    for k in range(near):
        flips = r.choice(64, int(r.integers(1, 7)), replace=False)
        fps[k] = fps[n - 1 - k] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
    return np.unique(fps)


def frame(spark, fps):
    return spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "s_fp long")


def roots(pairs, nodes):
    up = {int(x): int(x) for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(int(a)), top(int(b))
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("templates", [1, 5])
def test_equal_to_all_pairs(spark, templates):
    fps = skewed(3000, 3, templates, near=400)
    x = fps.view(np.int64)
    want = [(x[i], y) for i in range(len(x)) for y in x[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4]]
    assert len(want) > 200
    got = [(r["a"], r["b"]) for r in nd.links(frame(spark, fps), 4, 256, len(fps)).collect()]
    assert all(int(np.uint64(a & 2**64 - 1) ^ np.uint64(b & 2**64 - 1)).bit_count() <= 4 for a, b in got)
    assert roots(got, x) == roots(want, x)


def test_near_copies_are_not_split():
    r = np.random.default_rng(1)
    alike = sum(r.random(64) < 0.03 for _ in range(20_000)).astype(float)
    assert nd._finer(20_000, alike, 4, 2048) == []
    unlike = np.concatenate([np.full(32, 10_000.0), np.zeros(32)])
    masks = nd._finer(20_000, unlike, 4, 2048)
    assert masks and all(max(m) < 32 for m in masks)
    # bits of any four groups may differ: some choice of the others is left whole
    for gone in combinations(range(0, 32, 5), 4):
        assert any(not set(gone) & set(m) for m in masks)


def test_50_000_with_32_constant_bits(spark):
    even = np.unique(np.random.default_rng(2).integers(0, 2**64, 50_000, dtype=np.uint64))
    took = []
    for fps in (even, skewed(50_000, 2)):
        began = time.perf_counter()
        nd.links(frame(spark, fps), 4, nd.TILE, len(fps)).count()
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0] + 20, took
