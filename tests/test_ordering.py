"""Running totals and places by ranges equal those of one window."""

import random

import pytest
from pyspark.sql import functions as F

from momentlens.operators import intervals, ordering, signals


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_running(spark, few):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.random(), i, float(rng.randint(0, 9))) for i in range(300)] + [("one", 0.5, 300, 2.0)]
    d = spark.createDataFrame(rows, "k string, s double, i long, x double").repartition(5)
    for keys in (["k"], []):
        got = ordering.running(d, keys, [F.desc("s"), F.col("i")], {"before": F.col("x"), "place": F.lit(1)}, few)
        want, groups = {}, {}
        for r in sorted(rows, key=lambda r: (-r[1], r[2])):
            total, n = groups.get(r[0] if keys else 0, (0.0, 0))
            want[r[2]] = (total, n)
            groups[r[0] if keys else 0] = (total + r[3], n + 1)
        assert {r["i"]: (r["before"], r["place"]) for r in got.collect()} == want
        assert got.columns == ["k", "s", "i", "x", "before", "place"]
    assert ordering.places(d.limit(0), ["k"], [F.col("i")], "p", few).count() == 0


def test_operators_by_ranges(spark, monkeypatch):
    d = spark.range(500).selectExpr("if(id % 5 = 0, 'b', 'a') AS asset", "id AS idx", "id % 4 + 1D AS value", "id % 3 + 1D AS duration")
    small = sorted(map(str, intervals.offsets(d, "asset", [F.col("idx")]).collect())), sorted(map(str, signals.batches(d, 4).collect()))
    monkeypatch.setattr(ordering, "FEW", 10)
    assert (sorted(map(str, intervals.offsets(d, "asset", [F.col("idx")]).collect())), sorted(map(str, signals.batches(d, 4).collect()))) == small
