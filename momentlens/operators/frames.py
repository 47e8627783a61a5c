"""Frames: which ones to sample, motion between them, pooled states, rated batches and the counters of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlens.operators.displacement import BLOCK, with_before
from momentlens.operators.manifest import tolerant_json


def _stepped(assets: DataFrame, step: Column, key: str) -> DataFrame:
    d = assets.where("fps > 0 AND frames > 0").withColumn("_step", F.greatest(F.lit(1), F.floor(step)).cast("long"))
    d = d.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1, F.col("_step"))))
    return d.select(key, "idx", (F.col("idx") / F.col("fps")).alias("t"))


def strided(assets: DataFrame, rate: float, key: str = "asset") -> DataFrame:
    """(key, idx, t): about ``rate`` frames a second of each asset (key, fps, frames), as whole steps of frames; every frame of a slower asset."""
    return _stepped(assets, F.col("fps") / rate, key)


def keyframes(assets: DataFrame, seconds: float, key: str = "asset") -> DataFrame:
    """(key, idx, t): a frame for each ``seconds`` of each asset (key, fps, frames), with its own time."""
    return _stepped(assets, F.col("fps") * seconds, key)


def spread(assets: DataFrame, n: int = 8, shortest: float = 0.5, key: str = "asset") -> DataFrame:
    """(key, pos, t): ``n`` evenly spaced times of each asset (key, duration); one below ``shortest`` has none."""
    d = assets.where(F.col("duration") >= shortest).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.select(key, "pos", (F.col("pos") * F.col("duration") / n).alias("t"))


def mean_of(values: Column) -> Column:
    """The mean of an array of numbers; null if it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.try_divide(total, F.size(values))


def motion(frames: DataFrame, key: str = "asset", idx: str = "idx", pixels: str = "pixels", block: int = BLOCK) -> DataFrame:
    """(key, idx, value): mean absolute difference of each sampled frame to the one before, 0 for the first. Places are dense from 0.

    Blocks also get the frame before their first one, so that a long asset spreads over tasks.
    """
    d = with_before(frames, key, idx, pixels, block)
    change = F.zip_with(F.col(pixels), F.col("_before"), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return d.select(key, idx, F.coalesce(mean_of(change), F.lit(0.0)).alias("value"))


def pooled(states: Column, mask: Column) -> Column:
    """The state at the last place that ``mask`` keeps (1); null if it keeps none."""
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.struct(s.alias("s"), m.alias("m"))), lambda z: z["m"] == 1)
    return F.try_element_at(kept, F.lit(-1))["s"]


def rated(replies: DataFrame, size: int = 4, least: int = 5, key: str = "asset", text: str = "text") -> DataFrame:
    """(key, t, rating, score, description): frames that a rater gave ``least`` of 10 or more.

    ``replies``: a batch each, with the times of its ``size`` frames (``times``), how many of them aren't padding (``n``) and
    the reply. A reply without scores counts as zeros; frames that it has no score for go.
    """
    none = F.struct(F.array_repeat(F.lit(0), size).alias("scores"), F.lit("").alias("description"))
    d = replies.withColumn("_reply", tolerant_json(F.col(text), "scores array<int>, description string", none, "scores"))
    frames = F.transform(F.slice("times", F.lit(1), F.least(F.col("n"), F.lit(size))), lambda t, i: F.struct(t.alias("t"), F.get(F.col("_reply.scores"), i).alias("rating")))
    d = d.withColumn("_f", F.explode(F.filter(frames, lambda f: f["rating"] >= least)))
    return d.select(key, F.col("_f.t").alias("t"), F.col("_f.rating").alias("rating"), (F.col("_f.rating") / 10.0).alias("score"), F.coalesce("_reply.description", F.lit("")).alias("description"))


def outcomes(steps: DataFrame, kinds: Sequence[str], status: str = "status", seconds: str = "seconds") -> DataFrame:
    """One row: how many steps ended in each of ``kinds``, and how many of the first kind there were a second."""
    d = steps.agg(*[F.count_if(F.col(status) == k).alias(k) for k in kinds], F.sum(seconds).alias("_s"))
    return d.withColumn("rate", F.try_divide(F.col(kinds[0]), F.col("_s"))).drop("_s")
