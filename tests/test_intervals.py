"""Interval operators: properties and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens.functions import scalars as fn
from momentlens.operators import intervals, manifest, vectors
from momentlens.plans import moments as plans


def frame(spark, rows):
    return spark.createDataFrame([("k", float(a), float(b), float(s)) for a, b, s in rows], "source string, start double, end double, score double")


def pairs(df):
    return [(r["start"], r["end"]) for r in df.orderBy("start").collect()]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("strict", [False, True])
def test_merge_matches_a_loop(spark, seed, strict):
    rng = np.random.default_rng(seed)
    rows = [(a, a + n, 1) for a, n in zip(rng.integers(0, 100, 60).tolist(), rng.integers(1, 5, 60).tolist(), strict=True)]
    out = []
    for a, b, _ in sorted(rows):
        if out and (a < out[-1][1] + 1 if strict else a <= out[-1][1] + 1):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    for span in (None, 7.0):
        assert pairs(intervals.merged(frame(spark, rows), "source", 1.0, strict, span)) == out


def test_complement_covers_the_rest(spark):
    d = frame(spark, [(2, 4, 0), (3, 5, 0), (8, 9, 0), (9.05, 10, 0)])
    length = spark.createDataFrame([("k", 12.0), ("none", 3.0)], "source string, duration double")
    got = intervals.complement(d, length, "source").orderBy("source", "start").collect()
    assert [tuple(r) for r in got] == [("k", 0.0, 2.0), ("k", 5.0, 8.0), ("k", 10.0, 12.0), ("none", 0.0, 3.0)]


def test_budget_keeps_the_crossing_segment(spark):
    d = frame(spark, [(0, 4, 3), (10, 14, 2), (20, 24, 1)]).withColumn("duration", F.col("end") - F.col("start"))
    assert pairs(intervals.within_budget(d, "source", 5.0)) == [(0.0, 4.0), (10.0, 14.0)]
    assert len(pairs(intervals.within_budget(d, "source", 6.0))) == 3


@pytest.mark.parametrize("target", [0.0, 7.0, 90.0, 100000.0])
def test_budget_of_a_large_key_matches_a_loop(spark, target):
    rng = np.random.default_rng(5)
    rows = [(10 * k, 10 * k + n, s) for k, (n, s) in enumerate(zip(rng.integers(0, 6, 800).tolist(), rng.integers(0, 9, 800).tolist(), strict=True))]
    total, kept, spent = sum(b - a for a, b, _ in rows), [], 0.0
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if total <= 2 * target or spent < target:
            kept.append((a, b))
        spent += b - a
    d = frame(spark, rows).withColumn("duration", F.col("end") - F.col("start"))
    assert pairs(intervals.within_budget(d, "source", target)) == sorted(kept)


def test_complement_by_stretches_is_the_same(spark):
    rng = np.random.default_rng(6)
    d = frame(spark, [(a, a + n, 0) for a, n in zip(rng.integers(0, 300, 80).tolist(), rng.integers(1, 9, 80).tolist(), strict=True)])
    length = spark.createDataFrame([("k", 320.0)], "source string, duration double")
    assert pairs(intervals.complement(d, length, "source", span=20.0)) == pairs(intervals.complement(d, length, "source"))


def test_numbers_over_all_rows(spark):
    values = np.random.default_rng(7).permutation(3000).tolist()
    d = spark.createDataFrame([(v, v % 7) for v in values], "v long, k long").repartition(5)
    order = sorted(values, key=lambda v: (-(v % 7), v))
    got = plans.numbered(d, [F.desc("k"), F.col("v")]).orderBy("rank").collect()
    assert [(r["v"], r["rank"]) for r in got] == list(zip(order, range(3000), strict=True))
    assert plans.numbered(d.limit(0), [F.col("v")]).count() == 0


def test_trims(spark):
    specs = spark.createDataFrame([("d:0:3", 0), ("F:2:", 1), ("A::1", 2), ("B", 3), ("d:1:2", 4)], "spec string, pos int")
    segments = spark.createDataFrame([(x, 10.0, 14.0) for x in "ABCDF"], "label string, start double, end double")
    got = {r["label"]: (r["start"], r["end"]) for r in intervals.trimmed(segments, intervals.trims(specs)).collect()}
    assert got == {"A": (10.0, 11.0), "B": (10.0, 14.0), "C": (10.0, 14.0), "D": (11.0, 12.0), "F": (12.0, 14.0)}


def test_labels_and_durations(spark):
    d = spark.createDataFrame([(k,) for k in (0, 25, 26, 701, 702)], "k int")
    assert [r[0] for r in d.select(fn.segment_label(F.col("k"))).collect()] == ["A", "Z", "AA", "ZZ", "[A"]
    d = spark.createDataFrame([(45.9,), (125.0,), (3720.0,)], "s double")
    assert [r[0] for r in d.select(fn.human_duration(F.col("s"))).collect()] == ["45s", "2m05s", "1h02m"]


def test_chunks(spark):
    d = spark.createDataFrame([("a", 0.5), ("b", 1.9), ("c", 30.0), ("d", 31.0), ("e", 56.0)], "source string, duration double")
    got = {}
    for r in vectors.chunks(d).collect():
        got.setdefault(r["source"], []).append((r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {"c": [(0.0, 30.0), (25.0, 30.0)], "d": [(0.0, 30.0), (25.0, 31.0)], "e": [(0.0, 30.0), (25.0, 55.0), (50.0, 56.0)]}


def test_tolerant_json(spark):
    d = spark.createDataFrame([('{"scores": [1, 2]}',), ('```json\n{"scores": [3]}\n```',), ("no",), (None,)], "t string")
    default = F.struct(F.array(F.lit(0)).alias("scores"))
    assert [r[0]["scores"] for r in d.select(manifest.tolerant_json(F.col("t"), "scores array<int>", default, "scores")).collect()] == [[1, 2], [3], [0], [0]]


def test_clip_lengths_and_rounding_are_the_sqls(spark):
    d = spark.createDataFrame([("k", 36.7, 192.09), ("k", 37.5, 90.29), ("k", 99.1, 1.0)], "asset string, t double, strength double")
    got = intervals.adaptive_clips(d, spark.createDataFrame([("k", 99.1)], "asset string, duration double")).orderBy("start").collect()
    # 36.6 + 0.8 is 37.4, where the second one starts: strictly, they only touch
    assert [round(r["end"], 6) for r in got] == [37.4, 37.882024]
    assert spark.range(1).select(fn.rounded(F.lit(98.82) / 192.0)).first()[0] == 0.514687
    assert spark.range(1).select(fn.rounded(F.lit(None).cast("double"))).first()[0] is None


def test_focal_point_shuffles_a_row_for_each_frame(spark):
    rows = [("a", [1.0, 0.0, 3.0]), ("a", [None, 2.0, 1.0]), ("a", [4.0, 4.0]), ("b", [None, None]), ("c", []), ("c", None), ("d", [0.0, 0.0])]
    d = spark.createDataFrame(rows, "label string, grid array<double>")
    # means of "a": 1, 1, 2 of three columns and 4, 4 of two
    want = {"a": round((0.5 + 2 + 4) / 12, 3), "b": 0.8, "d": 0.5}
    assert dict(vectors.focal_point(d).collect()) == dict(vectors.focal_point(d, columns=3).collect()) == want
    assert "Generate" not in vectors.focal_point(d, columns=3)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="more than 2 columns"):
        vectors.focal_point(d, columns=2).collect()
