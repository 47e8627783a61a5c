"""Statistics of a growing index: a sketch for each increment, merged for the report.

Distinct counts are HyperLogLog sketches of 2^``LG_K`` registers, with a standard error of 1.04 / 2^(LG_K / 2), quantiles are KLL sketches whose ranks are off by
at most ``RANK_ERROR`` with a probability of 0.99. Both are a few kilobytes, whatever an increment's size, and merging sketches gives what one
sketch of all rows gives within the same bounds, so a report never reads the index's rows again. Counts, least and highest values are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
KLL_K = 400
#: Of KLL sketches of ``KLL_K``, and of the estimate of distinct counts at three standard errors.
RANK_ERROR, COUNT_ERROR = 0.01, 3 * 1.04 / 2 ** (LG_K / 2)


def sketched(rows: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """One row for each of ``keys``: rows ``n``, ``least``, ``highest``, and the sketches ``ids`` of a column's distinct values and ``spread`` of numbers; nulls don't count in sketches."""
    d = rows.groupBy(*keys)
    return d.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(value).cast("double")).alias("least"), F.max(F.col(value).cast("double")).alias("highest"), F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(LG_K)).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("spread"))


def merged(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of increments as one for each of ``keys``, or as one of all."""
    d = sketches.groupBy(*keys)
    return d.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("highest").alias("highest"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("spread", F.lit(KLL_K)).alias("spread"))


def distinct_count(ids: str = "ids") -> Column:
    return F.hll_sketch_estimate(ids)


def quantile(p: float, spread: str = "spread") -> Column:
    """The value at a rank from 0 to 1, null without values."""
    return F.when(F.kll_sketch_get_n_double(spread) > 0, F.kll_sketch_get_quantile_double(spread, F.lit(p)))
