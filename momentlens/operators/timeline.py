"""Timelines: frames, transitions, camera moves, overlays and sound cues of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.functions.scalars import intensity, interpolated

TRANSITION = 10


def framed(segments: DataFrame, fps: int = 30, key: str = "source", order: str = "rank", transition: int = TRANSITION) -> DataFrame:
    """Segments with their frames, source frames and first frame on the timeline; neighbours overlap by a transition."""
    w = Window.partitionBy(key).orderBy(order)
    d = segments.withColumns({"frames": F.ceil((F.col("end") - F.col("start")) * fps), "from_frame": F.floor(F.col("start") * fps), "to_frame": F.floor(F.col("end") * fps)})
    before = F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("timeline_start", before - transition * (F.row_number().over(w) - 1))


def length(segments: DataFrame, fps: int = 30, key: str = "source", transition: int = TRANSITION) -> DataFrame:
    """Frames of each timeline, at least 1."""
    frames = F.sum(F.ceil((F.col("end") - F.col("start")) * fps))
    return segments.groupBy(key).agg(F.greatest(F.lit(1), frames - F.greatest(F.lit(0), F.count(F.lit(1)) - 1) * transition).cast("long").alias("frames"))


def zoom(frame: Column, frames: Column, score: Column, fps: int = 30, easing: Column | None = None) -> Column:
    """How far the picture is enlarged: intense segments punch in (by ``easing``, 0 to 1, a linear second unless given) and pull back; others creep."""
    n = intensity(score)
    punch, hold, creep = 1 + 0.35 * n, 1 + 0.15 * n, 1 + 0.12 * F.greatest(F.lit(0.3), n)
    eased = F.least(F.lit(1.0), frame / fps) if easing is None else easing
    back = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (frame - 0.8 * fps) / F.greatest(frames - 0.8 * fps, F.lit(1e-9))))
    return F.when(n > 0.5, 1 + eased * (punch - 1) - back * (punch - hold)).otherwise(1 + F.least(F.lit(1.0), frame / frames) * (creep - 1))


def vertical_zoom(frame: Column, frames: Column, score: Column, fps: int = 30) -> Column:
    """The same for an upright picture, without pulling back."""
    n = intensity(score)
    return F.when(n > 0.5, 1 + 0.25 * n * F.least(F.lit(1.0), frame / fps)).otherwise(1 + 0.1 * n * F.least(F.lit(1.0), frame / frames))


def drift(frame: Column, frames: Column, score: Column) -> tuple[Column, Column]:
    """Horizontal and vertical shift in percent; the direction follows the score."""
    amount = 3 * F.greatest(F.lit(0.3), intensity(score)) * F.when(score > 0.45, 1).otherwise(-1)
    part = F.least(F.lit(1.0), frame / frames)
    return amount * (part - 0.5), amount * 0.3 * (1 - 2 * part)


def focal_offset(focal_x: Column) -> Column:
    return (F.coalesce(focal_x, F.lit(0.5)) - 0.5) * -18


def ramp(frame: Column, fps: int, knots: list[tuple[float, float]]) -> Column:
    """A ramp over seconds, clamped on both sides."""
    return interpolated(frame, [(t * fps, v) for t, v in knots], clamp_left=True, clamp_right=True)


#: Opacities over seconds.
LABEL_RAMP = [(0.0, 0.0), (0.3, 1.0)]
CALLOUT_RAMP = [(0.0, 0.0), (0.3, 1.0), (1.2, 1.0), (1.8, 0.0)]
METER_RAMP = [(0.0, 0.0), (0.5, 0.8)]
VOICE_RAMP = [(0.0, 0.0), (0.15, 0.8)]


#: The colour grade of all pictures.
GRADE = {"contrast": 1.15, "brightness": 1.05, "saturate": 1.1}


def grade() -> Column:
    return F.lit(" ".join(f"{k}({v})" for k, v in GRADE.items()))


def voice_delay(fps: int) -> Column:
    """The frame of a segment that its voice starts at: after half a second."""
    return F.lit(int(0.5 * fps)).cast("long")


def callout(score: Column, label: Column, low: list[str], high: list[str]) -> Column:
    """A short text by intensity and the label's first character; none for quiet segments."""
    n = intensity(score)
    at = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.ascii(label) % len(options) + 1).cast("int"))
    return F.when(n < 0.4, None).when(n > 0.7, at(high)).otherwise(at(low))


def progress(frame: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), frame / total * 100)


def sound_cues(segments: DataFrame, fps: int = 30) -> DataFrame:
    """Cues of each segment: a whoosh in, an impact for intense ones, a whip out for long ones; quiet segments have none."""
    n, frames = intensity(F.col("score")), F.ceil((F.col("end") - F.col("start")) * fps)
    volume = 0.1 + 0.25 * n
    cue = lambda name, at, v: F.struct(F.lit(name).alias("cue"), at.cast("long").alias("at"), v.cast("double").alias("volume"))
    cues = F.array(
        F.when(n >= 0.15, cue("whoosh", F.lit(0), volume * 0.7)),
        F.when(n > 0.5, cue("impact", F.lit(int(0.1 * fps)), volume)),
        F.when((n >= 0.15) & (frames > 3 * fps), cue("whip", F.greatest(F.lit(0), frames - int(0.5 * fps)), volume * 0.5)),
    )
    return segments.select("*", F.explode(F.filter(cues, lambda c: c.isNotNull())).alias("_c")).select(*segments.columns, "_c.cue", "_c.at", "_c.volume")
