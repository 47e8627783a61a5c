"""Signals: (asset, idx, value) rows, joined, normalised, fused and windowed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.operators import ordering


def block_rms(samples: DataFrame, size: int, key: str = "asset", idx: str = "idx", value: str = "value") -> DataFrame:
    """Root mean square of each whole block of ``size`` samples; a partial last block goes."""
    d = samples.groupBy(key, F.floor(F.col(idx) / size).cast("long").alias(idx))
    return d.agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias(value), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).drop("_n")


def aligned(signals: DataFrame, names: Sequence[str], key: str = "asset", idx: str = "idx", name: str = "signal", value: str = "value") -> DataFrame:
    """Long to wide: the places that all named signals have, so that each asset is cut to its shortest signal and one that lacks a signal goes."""
    wide = signals.where(F.col(name).isin(*names)).groupBy(key, idx).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])
    return wide.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))


def normalized(df: DataFrame, columns: Sequence[str], key: str = "asset", flat: float = 1e-8) -> DataFrame:
    """Min-max scaling within each asset; a range below ``flat`` gives 0. Extremes are pre-aggregated, so a large asset isn't gathered."""
    stats = df.groupBy(key).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.when(F.col(f"_hi_{c}") - F.col(f"_lo_{c}") < flat, 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))) for c in columns}
    return df.join(stats, key).withColumns(scaled).select(*df.columns)


def fused(weights: Mapping[str, float]) -> Column:
    """The weighted sum of columns."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(float(w))
    return total


def rises(df: DataFrame, key: str = "asset", idx: str = "idx", value: str = "value") -> DataFrame:
    """Positive parts of first differences; one row fewer for each asset."""
    step = F.lead(value).over(Window.partitionBy(key).orderBy(idx)) - F.col(value)
    return df.withColumn("_d", step).where("_d IS NOT NULL").withColumn(value, F.greatest(F.col("_d"), F.lit(0.0))).drop("_d")


def labelled_sum(probabilities: DataFrame, labels: DataFrame, keys: Sequence[str], label: str = "label_id", value: str = "prob") -> DataFrame:
    """The total of the classes that ``labels`` lists; places with none of them are absent."""
    return probabilities.join(labels.select(label).distinct(), label, "left_semi").groupBy(*keys).agg(F.sum(value).alias("total"))


def triggers(probabilities: DataFrame, labels: DataFrame, key: str = "asset", idx: str = "idx", label: str = "label_id", value: str = "prob", total: float = 0.5, single: float = 0.1) -> DataFrame:
    """Each asset's highest probability of a listed class, where the step's total and the class itself are above thresholds."""
    listed = probabilities.join(labels.select(label, "name").distinct(), label)
    steps = listed.groupBy(key, idx).agg(F.sum(value).alias("_total")).where(F.col("_total") > total)
    return listed.where(F.col(value) > single).join(steps, [key, idx], "left_semi").groupBy(key, "name").agg(F.max(value).alias("peak"))


def window_bounds(duration: Column, step: Column, seconds: float = 2.0, hop: float = 0.5) -> tuple[Column, Column]:
    """Start and end of the window centred on a hop: the left edge is clamped and shifts the window, the right edge is cut."""
    start = F.greatest(F.lit(0.0), step * hop + hop / 2 - seconds / 2)
    return start, F.least(duration, start + seconds)


def action_windows(lengths: DataFrame, size: int = 16, hop: int = 8, least: int = 4, key: str = "asset") -> DataFrame:
    """(key, start, end, places) of the windows that start at each hop of a series of ``n`` samples.

    A window ends with the series at most; one of fewer than ``least`` samples goes; ``places`` are ``size``, the last one repeated.
    """
    d = lengths.where("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(hop).cast("long"))).alias("start"))
    d = d.withColumn("end", F.least(F.col("start") + size, F.col("n"))).where(F.col("end") - F.col("start") >= least)
    return d.select(key, "start", "end", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.least(F.col("start") + k, F.col("end") - 1)).alias("places"))


def hopping_max(windows: DataFrame, lengths: DataFrame, key: str = "asset", value: str = "score") -> DataFrame:
    """Each of a series' ``n`` samples with its highest score among the windows (key, start, end, score) that cover it, and at least 0."""
    every = lengths.where("n > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("idx"), F.lit(0.0).alias(value))
    covered = windows.where(F.col("end") > F.col("start")).select(key, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx"), value)
    return every.unionByName(covered).groupBy(key, "idx").agg(F.max(value).alias(value))


def batches(df: DataFrame, size: int, key: str = "asset", idx: str = "idx", value: str = "value", least: int = 2) -> DataFrame:
    """Consecutive values in arrays of ``size``; a short last one repeats its last value, one below ``least`` goes."""
    d = ordering.places(df, [key], [F.col(idx)], "_p").groupBy(key, F.floor(F.col("_p") / size).cast("long").alias("batch"))
    d = d.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", value))), lambda x: x[value]).alias("values")).where(F.size("values") >= least)
    return d.withColumn("values", F.concat("values", F.array_repeat(F.element_at("values", -1), F.lit(size) - F.size("values"))))


def short_time_energy(samples: DataFrame, window: int = 441, hop: int = 220, key: str = "asset", idx: str = "idx", value: str = "value") -> DataFrame:
    """Sum of squares over ``window`` samples at each hop, whole windows only.

    Each sample goes to the one to three hops whose windows hold it, and sums are pre-aggregated, so no asset is ordered or gathered.
    """
    last = F.floor(F.col(idx) / hop)
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - window + 1) / hop))
    d = samples.withColumn("hop", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return d.groupBy(key, "hop").agg(F.sum(F.col(value) * F.col(value)).alias("energy"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == window).drop("_n")
