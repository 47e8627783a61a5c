"""Whole plans: fused moments, condensed segments, transients, searched segments."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlens.functions.scalars import reasons, segment_label, strongest
from momentlens.operators import intervals, manifest, ordering, ranks, series, signals
from momentlens.operators.vectors import nearest
from momentlens.sources.files import written


@dataclass(frozen=True)
class Profile:
    """Weights and windows of a detector."""

    weights: Mapping[str, float]
    fps: float = 2.0
    smooth: int = 6
    percentile: float = 0.75
    distance: int = 30


#: Fusion weights of two, three and four signals.
TWO = Profile({"clip": 0.5, "panns": 0.5})
THREE = Profile({"panns": 0.40, "clip": 0.35, "flow": 0.25}, smooth=4, percentile=0.45, distance=1)
FOUR = Profile({"panns": 0.35, "clip": 0.25, "flow": 0.15, "mae": 0.25})


@dataclass(frozen=True)
class Condense:
    """Lengths in seconds of segments grown from peaks."""

    target: float = 120.0
    shortest: float = 3.0
    longest: float = 10.0
    gap: float = 2.0
    before: float = 1.5
    after: float = 2.5
    decay: float = 0.45
    profile: Profile = field(default_factory=lambda: THREE)


def smoothed(wide: DataFrame, profile: Profile) -> DataFrame:
    """(asset, idx, value): normalised, fused and smoothed; rounded, so that equal neighbours stay equal in any order of addition."""
    d = signals.normalized(wide, list(profile.weights)).select("asset", "idx", signals.fused(profile.weights).alias("value"))
    return series.moving_average(d, profile.smooth).withColumn("value", F.round("value", 9))


def _shared(df: DataFrame, last: int, name: str) -> DataFrame:
    """What several branches read: written for long series; Spark reuses the exchanges of short ones."""
    return df if last < ranks.FEW else written(df, name)


def _last(df: DataFrame) -> int:
    """The last place of any asset."""
    return df.agg(F.max("idx")).first()[0] or 0


def moments(wide: DataFrame, profile: Profile) -> DataFrame:
    """(asset, idx, value) of the spaced peaks above each asset's percentile."""
    last = _last(wide)
    return _spaced_peaks(_shared(smoothed(wide, profile), last, "smoothed"), profile, last)


def _spaced_peaks(smooth: DataFrame, profile: Profile, last: int) -> DataFrame:
    peaks = series.above_percentile(series.local_maxima(smooth), smooth, profile.percentile, most=last + 1)
    return series.spaced(peaks, profile.distance, last=last)


def top(found: DataFrame, n: int, fps: float = 2.0, width: float = 15.0) -> DataFrame:
    """The best ``n`` moments over all assets with their windows."""
    start, end = intervals.around(F.col("idx") / fps, width)
    return found.withColumns({"time_sec": F.col("idx") / fps, "start": start, "end": end}).orderBy(F.desc("value"), "asset", "idx").limit(n)


def condensed(wide: DataFrame, c: Condense) -> DataFrame:
    """(asset, rank, label, start, end, score): segments that follow each peak's decay, merged, within the budget, in order of time."""
    fps = c.profile.fps
    last = _last(wide)
    smooth = written(smoothed(wide, c.profile), "smoothed")  # read four times
    peaks = _spaced_peaks(smooth, c.profile, last)
    grown = intervals.decay_end(peaks, smooth, c.decay, int(c.longest * fps))
    length = smooth.groupBy("asset").agg(((F.max("idx") + 1) / fps).alias("duration"))
    d = grown.join(length, "asset")
    limit = F.col("duration") - 0.05
    d = d.withColumn("start", F.greatest(F.lit(0.0), F.col("idx") / fps - c.before)).withColumn("end", F.least(limit, F.col("end_idx") / fps + c.after))
    d = d.select("asset", "start", intervals.enforced(F.col("start"), F.col("end"), c.shortest, c.longest, limit).alias("end"), F.col("value").alias("score"))
    m = intervals.merged(d, "asset", c.gap).withColumn("duration", F.col("end") - F.col("start"))
    kept = intervals.within_budget(m, "asset", c.target)
    return manifest.labelled(kept, [F.col("start")], "asset")


def transients(energy: DataFrame, median: int = 100, smooth: int = 4, distance: int = 60, percentile: float = 0.85) -> DataFrame:
    """(asset, idx, value): sudden rises of energy over the running background, prominent and spaced."""
    rise = signals.rises(energy)
    background = series.running_median(rise, median).withColumnRenamed("value", "_m")
    d = rise.join(background, ["asset", "idx"]).select("asset", "idx", F.greatest(F.col("value") - F.col("_m"), F.lit(0.0)).alias("value"))
    d = written(series.moving_average(d, smooth).withColumn("value", F.round("value", 9)), "onsets")
    last = _last(d)
    floors = ranks.percentiles(d.where("value > 0"), percentile, "asset", "value", most=last + 1).withColumnRenamed("percentile", "floor")
    peaks = series.local_maxima(d).join(floors, "asset").where("value >= floor").select("asset", "idx", "value")
    kept = _shared(series.spaced(peaks, distance, last=last), last, "spaced-peaks").join(floors, "asset")
    return series.prominent(kept, d, F.col("floor") * 0.5).drop("floor")


def searched(index: DataFrame, durations: DataFrame, query: list[float], n: int, threshold: float = 0.30, gap: float = 5.0, pad: float = 2.0, shortest: float = 3.0, longest: float = 30.0) -> DataFrame:
    """The best ``n`` segments round the chunks that are near a query vector: padded, merged, cut, ranked and labelled."""
    hits = nearest(index, query, n * 5).where(F.col("similarity") >= threshold).join(durations, "source")
    first, last = intervals.around_within(F.col("start"), pad, 0.0, F.col("duration"))[0], F.least(F.col("duration"), F.col("end") + pad)
    d = hits.select("source", first.alias("start"), last.alias("end"), F.col("similarity").alias("score"))
    m = intervals.merged(d, "source", gap).join(durations, "source")
    m = m.withColumn("end", intervals.enforced(F.col("start"), F.col("end"), shortest, longest, F.col("duration"))).drop("duration")
    best = m.orderBy(F.desc("score"), "source", "start").limit(n)
    return manifest.labelled(best, [F.desc("score"), F.col("source"), F.col("start")])


def reported(wide: DataFrame, profile: Profile, n: int, triggers: DataFrame, width: float = 15.0) -> DataFrame:
    """Each asset's report: its first ``n`` peaks with their windows, signals and reasons, and the labels heard (asset, name, peak)."""
    from momentlens.operators import report

    stats = smoothed(wide, profile).groupBy("asset").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), (F.max("idx") + 1).alias("frames_analyzed"))
    stats = stats.withColumns({"duration": F.col("frames_analyzed") / profile.fps, "file": F.col("asset")})
    named = [("audio", F.col("panns")), ("visual", F.col("clip")), ("motion", F.col("flow"))]
    d = rated(wide, profile, n).join(stats.select("asset", F.col("duration").alias("_d")), "asset").withColumn("peak_time", F.col("idx") / profile.fps)
    start, end = intervals.around_within(F.col("peak_time"), width / 2, width / 2, F.col("_d"))
    why = reasons(named, F.concat(F.lit("combined signals ("), strongest(named), F.lit(" dominant)")))
    highlights = d.select("asset", F.round(start, 2).alias("start"), F.round(end, 2).alias("end"), F.round(end - start, 2).alias("duration"), F.round("peak_time", 2).alias("peak_time"), F.round("value", 3).alias("hybrid_score"), *[F.round(c, 3).alias(f"{c}_score") for c in ("clip", "panns", "flow")], strongest(named).alias("primary_signal"), why.alias("reasons"))
    return report.nested(stats, highlights, triggers)


def rated(wide: DataFrame, profile: Profile, n: int, length: Column | None = None) -> DataFrame:
    """Each asset's first ``n`` peaks with the signals at them."""
    from momentlens.operators.report import first_of_each

    normal = signals.normalized(wide, list(profile.weights))
    return first_of_each(moments(wide, profile), n).join(normal, ["asset", "idx"])


def numbered(segments: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``label`` and ``rank`` (from 0) in a total order of all of them."""
    d = ordering.places(segments, [], order, "rank")
    return d.withColumn("label", segment_label(F.col("rank")))
