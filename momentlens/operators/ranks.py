"""Exact percentiles of keys of any size, by narrowing histograms.

A round counts each open key's values by ranges between its least and highest one, as a partial aggregate; only the range that holds the
rank goes on, from its own least to its own highest value, until one value is left. No aggregate holds a key's
values, and rounds are few: each divides the range by ``BINS``, and gaps between values cost none. Keys of at most ``FEW`` values are
aggregated as they are, which gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlens.sources.shared import written

FEW = 100_000
BINS = 1024


def percentiles(df: DataFrame, p: float, key: str, value: str, few: int = FEW, bins: int = BINS, most: int | None = None) -> DataFrame:
    """(key, percentile): the interpolated percentile of each key's values; null and NaN don't count. ``most``: a bound of a key's rows, if one is known."""
    if not 0 <= p <= 1:
        raise ValueError("a percentile is from 0 to 1")
    d = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    plain = lambda x: x.groupBy("_k").agg(F.percentile("_v", F.lit(p)).alias("percentile"))
    if most is None or most > few:
        sizes = written(d.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
        most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= few:
        return plain(d).withColumnRenamed("_k", key)
    small = plain(d.join(sizes.where(F.col("_n") <= few).select("_k"), "_k", "left_semi"))
    large = sizes.where(F.col("_n") > few).withColumn("_at", F.lit(p) * (F.col("_n") - 1))
    # the rank, the values below the range, those in it, and the least value above it
    state = large.select("_k", "_at", F.floor("_at").alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"), "_lo", "_hi", F.lit(None).cast("double").alias("_above"))
    settled = []
    while True:
        settled.append(state.where("_lo = _hi"))
        state = state.where("_lo < _hi")
        if state.isEmpty():
            break
        # halves, as the whole range may be beyond a double
        part = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))
        inside = d.join(state.select("_k", "_lo", "_hi"), "_k").where("_v >= _lo AND _v <= _hi")
        counts = inside.groupBy("_k", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = Window.partitionBy("_k").orderBy("_part")
        counts = counts.withColumns({"_to": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_a").over(w)})
        held = counts.join(state, "_k").where("_below + _to - _c <= _rank AND _rank < _below + _to")
        state = held.select("_k", "_at", "_rank", (F.col("_below") + F.col("_to") - F.col("_c")).alias("_below"), F.col("_c").alias("_in"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.coalesce("_next", "_above").alias("_above"))
        state = written(state, "percentile-ranges")
    found = settled[0]
    for x in settled[1:]:
        found = found.unionByName(x)
    upper = F.when((F.col("_rank") + 1 < F.col("_below") + F.col("_in")) | (F.col("_at") == F.col("_rank")), F.col("_lo")).otherwise(F.col("_above"))
    value_ = F.when(upper == F.col("_lo"), upper).otherwise((F.col("_rank") + 1 - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.col("_rank")) * upper)
    return small.unionByName(found.select("_k", value_.alias("percentile"))).withColumnRenamed("_k", key)
