"""Table functions in SQL against the DataFrame operators."""

import random

import pytest

from momentlens.functions import tables
from momentlens.operators import intervals


@pytest.fixture(scope="module")
def segments(spark):
    tables.register(spark)
    rng = random.Random(1)
    rows = [(rng.choice("abc"), float(rng.randint(0, 300)), float(rng.randint(1, 9)), rng.random()) for _ in range(120)]
    d = spark.createDataFrame(rows, "source string, start double, len double, score double").selectExpr("source", "start", "start + len AS end", "score", "len AS duration")
    d.createOrReplaceTempView("segments")
    return d


@pytest.mark.parametrize("gap", [0.0, 2.5])
def test_merge_equals_the_operator(spark, segments, gap):
    got = spark.sql(f"SELECT start, end, n FROM merge_intervals(TABLE(segments) PARTITION BY source ORDER BY (start), {gap}D)")
    want = intervals.merged(segments, "source", gap).select("start", "end", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_timeline(spark, segments):
    got = sorted(tuple(r) for r in spark.sql("SELECT rank, label, offset, duration FROM timeline(TABLE(SELECT * FROM segments WHERE source = 'a') PARTITION BY source ORDER BY (start, end))").collect())
    rows = sorted((r["start"], r["end"], r["duration"]) for r in segments.where("source = 'a'").collect())
    assert [r[0] for r in got] == list(range(len(rows)))
    assert got[0][1] == "A" and got[26][1] == "AA" and got[5][2] == sum(x[2] for x in rows[:5])
    assert sum(r[3] for r in got) == sum(x[2] for x in rows)


def test_analysis(spark, segments):
    with pytest.raises(Exception, match="needs a number end"):
        spark.sql("SELECT * FROM merge_intervals(TABLE(SELECT source, start FROM segments) PARTITION BY source ORDER BY (start), 1D)")
    with pytest.raises(Exception, match="must be in order"):
        spark.sql("SELECT * FROM merge_intervals(TABLE(segments) PARTITION BY source ORDER BY (start DESC), 1D)").collect()
    schema = spark.sql("SELECT * FROM merge_intervals(TABLE(segments) PARTITION BY source ORDER BY (start), 1D)").schema
    assert schema.names == ["start", "end", "n"]
    assert spark.sql("SELECT * FROM merge_intervals(TABLE(SELECT * FROM segments WHERE false) PARTITION BY source ORDER BY (start), 1D)").count() == 0
    assert spark.sql("SELECT * FROM merge_intervals(TABLE(SELECT 1 AS start, cast(null AS int) AS end) WITH SINGLE PARTITION, 1D)").count() == 0
