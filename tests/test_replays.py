"""Additions that are repeated, overlap or break off leave each row once; sketches of increments equal those of all rows."""

import pytest
from pyspark.sql import functions as F

from momentlens.operators import sketches
from momentlens.sources import files


def chunks(spark, names, starts, shift=0.0):
    rows = [(n, float(s), s + 30.0, [float(s), shift]) for n in names for s in starts]
    return spark.createDataFrame(rows, "source string, start double, end double, embedding array<float>")


def ids(spark, path, model=None):
    return sorted((r["source"], r["start"]) for r in files.indexed_chunks(spark, path, model).collect())


def test_repeated_and_overlapping_additions(spark, tmp_path):
    path = str(tmp_path / "index")
    assert files.add_chunks(chunks(spark, "ab", range(0, 500, 25)), path, "m", buckets=4) == 40
    assert files.add_chunks(chunks(spark, "ab", range(0, 500, 25)), path, "m", buckets=4) == 0
    assert files.add_chunks(chunks(spark, "bc", range(250, 750, 25), 9.0), path, "m", buckets=4) == 30
    want = sorted([("a", float(s)) for s in range(0, 500, 25)] + [("b", float(s)) for s in range(0, 750, 25)] + [("c", float(s)) for s in range(250, 750, 25)])
    assert ids(spark, path) == want
    # what was there first stays as it was
    assert files.indexed_chunks(spark, path).where("source = 'b' AND start < 500 AND embedding[1] = 9").count() == 0
    assert files.add_chunks(chunks(spark, "a", [0, 25]), path, "other", buckets=4) == 2
    assert ids(spark, path, "m") == want and len(ids(spark, path)) == len(want) + 2
    by = {r["source"]: (r["chunks"], r["first"], r["last"]) for r in files.indexed_sources(spark, path, "m").collect()}
    assert by == {"a": (20, 0.0, 505.0), "b": (30, 0.0, 755.0), "c": (20, 250.0, 755.0)}


def test_interrupted_addition(spark, tmp_path):
    """A write whose rows can't be made changes nothing, and its repetition adds all."""
    path = str(tmp_path / "index")
    files.add_chunks(chunks(spark, "a", range(0, 100, 25)), path, "m", buckets=4)
    before = ids(spark, path)
    broken = chunks(spark, "b", range(0, 1000, 25)).withColumn("end", F.when(F.col("start") == 975, F.raise_error(F.lit("gone"))).otherwise(F.col("end")))
    with pytest.raises(Exception, match="gone"):
        files.add_chunks(broken, path, "m", buckets=4)
    assert ids(spark, path) == before
    files.add_chunks(chunks(spark, "b", range(0, 1000, 25)), path, "m", buckets=4)
    assert len(ids(spark, path)) == 44 == len(set(ids(spark, path)))


def test_a_replay_after_a_partial_write(spark, tmp_path):
    """Rows that a writer without buckets' care left twice don't stay twice in what is rewritten, nor are they added again."""
    path = str(tmp_path / "index")
    files.add_chunks(chunks(spark, "a", range(0, 200, 25)), path, "m", buckets=1)
    assert files.add_chunks(chunks(spark, "a", range(100, 300, 25)), path, "m", buckets=1) == 4
    assert files.add_chunks(chunks(spark, "a", range(100, 300, 25)), path, "m", buckets=1) == 0
    assert len(ids(spark, path)) == 12


def test_signal_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    d = spark.createDataFrame([(a, s, i, float(i)) for a in "abc" for s in ("clip", "flow") for i in range(5)], "asset string, signal string, idx long, value double")
    assert files.cache_signals(d.where("asset <> 'c'"), path, buckets=2) == 4
    assert files.cache_signals(d, path, buckets=2) == 2
    assert files.cache_signals(d, path, buckets=2) == 0
    assert files.cached_signals(spark, path, ["clip"]).count() == 15
    assert "bucket" not in files.cached_signals(spark, path, ["clip"]).columns


@pytest.mark.parametrize("n", [1, 300, 40_000])
def test_merged_sketches(spark, n):
    d = spark.range(n).selectExpr("id % 7 AS part", "cast(id AS string) AS name", "cast(pmod(id * 7919, 100003) AS double) AS x")
    one = sketches.merged(sketches.sketched(d, [], "name", "x")).select("n", "least", "highest", sketches.distinct_count().alias("c"), sketches.quantile(0.5).alias("q"))
    many = sketches.merged(sketches.sketched(d, ["part"], "name", "x")).select("n", "least", "highest", sketches.distinct_count().alias("c"), sketches.quantile(0.5).alias("q"))
    a, b = one.first(), many.first()
    assert (a["n"], a["least"], a["highest"], a["c"]) == (b["n"], b["least"], b["highest"], b["c"])  # HyperLogLog unions are exact merges
    assert abs(b["c"] / n - 1) <= sketches.COUNT_ERROR
    for r in (a, b):
        rank = d.where(F.col("x") <= r["q"]).count() / n
        assert abs(rank - 0.5) <= sketches.RANK_ERROR + 1 / n


def test_sketches_of_nothing(spark):
    d = spark.createDataFrame([("a", None, None)], "k string, name string, x double")
    r = sketches.merged(sketches.sketched(d, ["k"], "name", "x"), ["k"]).select("n", "least", sketches.distinct_count().alias("c"), sketches.quantile(0.5).alias("q")).first()
    assert (r["n"], r["least"], r["c"], r["q"]) == (1, None, 0, None)
