"""Series: smoothing, peaks and runs within each asset.

Smoothing deals an asset's places out in blocks with a halo, so that an asset of any length spreads over
tasks. Maxima and runs are found in blocks, too; of each block only the runs that touch its ends, two at most, meet
those of the asset's other blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.operators import peaks as by_blocks
from momentlens.operators import ranks

BLOCK = 50_000


def _haloed(df: DataFrame, size: int, key: str, idx: str, value: str, block: int) -> DataFrame:
    """Places with both edges reflected (d c b a | a b c d | d c b a), in blocks that hold what their windows reach."""
    before, after = size // 2, size - size // 2 - 1
    n = df.groupBy(key).agg((F.max(idx) + 1).alias("_n"))
    d = df.select(key, idx, value).join(n, key)
    turns = F.ceil(F.lit(size) / (2 * F.col("_n"))).cast("int") + 1
    mirrored = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(F.col(idx) + 2 * F.col("_n") * k, -1 - F.col(idx) + 2 * F.col("_n") * k)))
    d = d.withColumn("_p", F.explode(F.filter(mirrored, lambda p: (p >= -before) & (p < F.col("_n") + after))))
    first, last = F.greatest(F.lit(0), F.floor((F.col("_p") - after) / block)), F.least(F.floor((F.col("_n") - 1) / block), F.floor((F.col("_p") + before) / block))
    return d.withColumn("_b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _core(d: DataFrame, value: str, result: Column, key: str, idx: str, block: int) -> DataFrame:
    inside = (F.col("_p") >= 0) & (F.col("_p") < F.col("_n")) & (F.floor(F.col("_p") / block) == F.col("_b"))
    return d.withColumn("_r", result).where(inside).select(key, F.col("_p").cast("long").alias(idx), F.col("_r").alias(value))


def moving_average(df: DataFrame, size: int, key: str = "asset", idx: str = "idx", value: str = "value", block: int = BLOCK) -> DataFrame:
    """Centred mean over ``size`` places, one more before than after if that is even; edges reflect. Places are dense from 0."""
    w = Window.partitionBy(key, "_b").orderBy("_p").rowsBetween(-(size // 2), size - size // 2 - 1)
    return _core(_haloed(df, size, key, idx, value, block), value, F.avg(value).over(w), key, idx, block)


def running_median(df: DataFrame, size: int, key: str = "asset", idx: str = "idx", value: str = "value", block: int = BLOCK) -> DataFrame:
    """Centred median with reflected edges; of an even number, the upper one."""
    w = Window.partitionBy(key, "_b").orderBy("_p").rowsBetween(-(size // 2), size - size // 2 - 1)
    middle = F.get(F.sort_array(F.collect_list(value).over(w)), F.lit(size // 2))
    return _core(_haloed(df, size, key, idx, value, block), value, middle, key, idx, block)


def local_maxima(df: DataFrame, key: str = "asset", idx: str = "idx", value: str = "value", block: int = BLOCK) -> DataFrame:
    """Runs of equal values that are higher than both neighbours, at their middle (rounded down); ends of a series are none."""
    w = Window.partitionBy(key, "_b").orderBy(idx)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    d = df.select(key, idx, value, F.floor(F.col(idx) / block).alias("_b"))
    runs = d.withColumn("_run", F.sum(changed).over(w)).groupBy(key, "_b", "_run").agg(F.min(idx).alias("_l"), F.max(idx).alias("_r"), F.first(value).alias(value))
    r = Window.partitionBy(key, "_b").orderBy("_run")
    runs = runs.withColumns({"_before": F.lag(value).over(r), "_after": F.lead(value).over(r)})
    middle = F.floor((F.col("_l") + F.col("_r")) / 2).cast("long").alias(idx)
    high = (F.col("_before") < F.col(value)) & (F.col("_after") < F.col(value))
    # runs at the ends of blocks: the last of one and the first of the next may be one run, and are neighbours else
    ends, a = runs.where("_before IS NULL OR _after IS NULL"), Window.partitionBy(key).orderBy("_l")
    meets = F.lag("_after").over(a).isNull() & F.col("_before").isNull()
    ends = ends.withColumns({"_left": F.coalesce("_before", F.when(meets, F.lag(value).over(a))), "_same": F.coalesce(meets & (F.lag(value).over(a) == F.col(value)), F.lit(False))})
    ends = ends.withColumn("_right", F.coalesce("_after", F.lead(value).over(a))).withColumn("_run", F.sum((~F.col("_same")).cast("int")).over(a))
    whole = ends.groupBy(key, "_run").agg(F.min("_l").alias("_l"), F.max("_r").alias("_r"), F.first(value).alias(value), F.min_by("_left", "_l").alias("_before"), F.max_by("_right", "_l").alias("_after"))
    return runs.where(high).select(key, middle, value).unionByName(whole.where(high).select(key, middle, value))


def above_percentile(df: DataFrame, of: DataFrame, p: float, key: str = "asset", value: str = "value", where: Column | None = None, most: int | None = None) -> DataFrame:
    """Rows of ``df`` at or above the exact, interpolated percentile of ``of`` (of the values that ``where`` picks) in their asset. ``most``: a bound of an asset's rows, if one is known."""
    x = F.col(value) if where is None else F.when(where, F.col(value))
    floors = ranks.percentiles(of.select(key, x.alias("_x")), p, key, "_x", most=most)
    return df.join(floors, key).where(F.col(value) >= F.col("percentile")).drop("percentile")


def spaced(peaks: DataFrame, distance: int, key: str = "asset", idx: str = "idx", value: str = "value", block: int = BLOCK, rounds: int = 0, last: int | None = None) -> DataFrame:
    """Peaks that no higher kept peak is nearer to than ``distance``; of equal ones the later goes first.

    They are decided in blocks; those that depend on peaks outside of their block go through larger ones. With ``rounds``, windows come first: in blocks with a halo of what rounds
    reach, each round keeps the peaks that are highest within ``distance`` of those left, and drops the others there. ``last``: the last place of any asset, if it is known.
    """
    if distance <= 1:
        return peaks.select(key, idx, value)
    if not rounds:
        return by_blocks.spaced(peaks, distance, key, idx, value, block, last)
    halo = 2 * rounds * distance
    size = max(block, 2 * halo)
    d = peaks.select(key, idx, value, F.explode(F.sequence(F.floor((F.col(idx) - halo) / size), F.floor((F.col(idx) + halo) / size))).alias("_b")).withColumn("_kept", F.lit(None).cast("boolean"))
    w = Window.partitionBy(key, "_b").orderBy(idx).rangeBetween(1 - distance, distance - 1)
    for _ in range(rounds):
        open_ = F.col("_kept").isNull()
        d = d.withColumn("_won", open_ & (F.max(F.when(open_, F.struct(value, idx))).over(w)[idx] == F.col(idx)))
        d = d.withColumn("_kept", F.when(F.col("_won"), True).when(open_ & F.max("_won").over(w), False).otherwise(F.col("_kept"))).drop("_won")
    d = d.where(F.floor(F.col(idx) / size) == F.col("_b")).drop("_b")
    return d.where("_kept").select(key, idx, value).unionByName(by_blocks.spaced(d.where("_kept IS NULL"), distance, key, idx, value, block, last))


def prominent(peaks: DataFrame, series: DataFrame, least: Column, key: str = "asset", idx: str = "idx", value: str = "value", block: int = BLOCK) -> DataFrame:
    """``peaks`` with their prominence, where it is at least ``least`` (a column of ``peaks``). A peak's walls are the nearest higher places on both sides."""
    return by_blocks.prominent(peaks, series, least, key, idx, value, block)


def low_runs(df: DataFrame, below: float, shortest: float, key: str = "asset", t: str = "t", value: str = "value", span: float = BLOCK) -> DataFrame:
    """Intervals in which the value stays below a threshold: to the first time that it doesn't, or to the last time; short ones go. Times are dealt into blocks of ``span``."""
    w, block = Window.partitionBy(key, "_b").orderBy(t), Window.partitionBy(key, "_b")
    d = df.select(key, t, (F.col(value) < below).alias("_low"), F.floor(F.col(t) / span).alias("_b"))
    d = d.withColumns({"_next": F.lead(t).over(w), "_first": F.min(t).over(block), "_run": F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "_b", "_low").orderBy(t))})
    runs = d.where("_low").groupBy(key, "_b", "_run").agg(F.min(t).alias("start"), F.max(t).alias("_last"), F.max_by("_next", t).alias("_next"), F.first("_first").alias("_first"))
    # the time after a block is the first one of the asset's next block
    a = Window.partitionBy(key).orderBy("_b")
    blocks = df.select(key, t).groupBy(key, F.floor(F.col(t) / span).alias("_b")).agg(F.min(t).alias("_t")).select(key, "_b", F.lead("_t").over(a).alias("_then"))
    open_ = F.col("_next").isNull()
    touching = runs.where(open_ | (F.col("start") == F.col("_first"))).join(blocks, [key, "_b"]).withColumn("end", F.coalesce("_next", "_then", "_last"))
    b = Window.partitionBy(key).orderBy("start")
    goes_on = F.coalesce(F.lag("_next").over(b).isNull() & (F.lag("end").over(b) == F.col("start")), F.lit(False))
    touching = touching.withColumn("_g", F.sum((~goes_on).cast("int")).over(b)).groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
    inside = runs.where(~open_ & (F.col("start") != F.col("_first"))).select(key, "start", F.col("_next").alias("end"))
    return inside.unionByName(touching).where(F.col("end") - F.col("start") >= shortest)
