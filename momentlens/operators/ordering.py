"""Running totals and places in an order, for keys of any size.

Keys of at most ``FEW`` rows are each ordered by one task. Beyond that, ranges of (key, order) are cut, each is ordered apart, and only the ranges' totals
meet for a key, so one key, or a whole table without keys, is ordered by many tasks. The results are the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.sources.shared import written

FEW = 100_000


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], few: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``sums``, the total of its column over the rows before in the order of the row's key, 0 for the first. The order must be total."""
    keys, order = list(keys), list(order)
    until = (Window.unboundedPreceding, -1)
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= (FEW if few is None else few):
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(*until)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    # written, so that ranges aren't drawn anew for their totals
    d = df.withColumns({f"_s_{n}": c for n, c in sums.items()}).repartitionByRange(*map(F.col, keys), *order).withColumn("_range", F.spark_partition_id())
    d = written(d, "ranges")
    totals = d.groupBy(*keys, "_range").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_range").rowsBetween(*until)
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*until)
    d = d.join(totals, same).withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_s_{n}").over(own), F.lit(0)) for n in sums})
    return d.select(*df.columns, *sums)


def places(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, few: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of its key."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, few)
