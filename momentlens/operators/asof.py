"""As-of joins: with each row the last row of the other side at or before its time.

Both sides are dealt into stretches of time, and within a stretch a window carries the last row of the other side on. What a stretch carries to the
next ones, one row each, is passed on by a window over stretches, so that a key of any length is ordered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, values: Sequence[str], span: float, within: float | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` (key, t, values) at or before its time, and ``<t>_before``, that row's time; null if there is none.

    Of right rows at the same time the one with the greatest values counts. With ``within``, rows that are more than that older don't count. Rows
    without a key or a time are joined with none. Times are numbers and ``span`` the length of a stretch; it changes no result.
    """
    stretch = F.floor(F.col(t) / span).cast("long")
    theirs = right.where(F.col(key).isNotNull() & F.col(t).isNotNull()).select(F.col(key).alias("_k"), stretch.alias("_b"), F.struct(F.col(t).alias("t"), F.struct(*values).alias("v")).alias("_r"))
    ours = left.select(F.col(key).alias("_k"), stretch.alias("_b"), F.col(t).alias("_t"), F.struct(*left.columns).alias("_l"))
    # what each stretch hands on, and which stretches ask
    last = theirs.groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    some = last.unionByName(ours.select("_k", "_b").distinct(), allowMissingColumns=True).groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    earlier = F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = some.select("_k", "_b", earlier.alias("_earlier"))
    rows = theirs.select("_k", "_b", F.col("_r.t").alias("_t"), F.lit(0).alias("_side"), "_r").unionByName(ours.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    d = rows.join(carried, rows["_k"].eqNullSafe(carried["_k"]) & rows["_b"].eqNullSafe(carried["_b"]), "left").drop(carried["_k"], carried["_b"])
    found = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_r", "_earlier"))
    if within is not None:
        found = F.when(F.col("_t") - found["t"] <= within, found)
    return d.select("_l.*", found.alias("_found")).select(*left.columns, F.col("_found.t").alias(f"{t}_before"), *[F.col(f"_found.v.{c}").alias(f"{c}_before" if c in left.columns else c) for c in values])
