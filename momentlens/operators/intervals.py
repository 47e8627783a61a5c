"""Intervals: (key, start, end, score) rows, merged, inverted, cut, budgeted and placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.operators import ordering


def _merged(df: DataFrame, keys: list[str], gap: float, strict: bool, aggregates: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) + F.lit(gap)
    apart = (F.col("start") >= reach) if strict else (F.col("start") > reach)
    d = df.withColumn("_g", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggregates).drop("_g")


def merged(df: DataFrame, key: str, gap: float = 0.0, strict: bool = False, span: float | None = None) -> DataFrame:
    """Intervals that overlap, touch (unless ``strict``) or are at most ``gap`` apart become one, with the highest ``score`` and the count ``n``.

    Intervals are first merged within stretches of ``span``, each a task's own, so that of a key with very many
    intervals only the merged ones are ordered together; the result is the same.
    """
    d = df.select(key, F.col("start"), F.col("end"), F.col("score"), F.lit(1).cast("long").alias("n"))
    both = [F.max("score").alias("score"), F.sum("n").alias("n")]
    if span:
        d = _merged(d.withColumn("_s", F.floor(F.col("start") / span)), [key, "_s"], gap, strict, both).drop("_s")
    return _merged(d, [key], gap, strict, both)


def complement(df: DataFrame, durations: DataFrame, key: str, shortest: float = 0.1, span: float | None = None) -> DataFrame:
    """What the intervals leave of [0, duration]; remnants up to ``shortest`` go. ``durations``: (key, duration).

    With ``span`` intervals are merged within stretches first, as by ``merged``.
    """
    covered = df.select(key, "start", "end")
    if span:
        covered = _merged(covered.withColumn("_s", F.floor(F.col("start") / span)), [key, "_s"], 0.0, False, []).drop("_s")
    covered = _merged(covered, [key], 0.0, False, [])
    w = Window.partitionBy(key).orderBy("start")
    gaps = covered.select(key, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("_a"), F.col("start").alias("_b"))
    tails = durations.join(covered.groupBy(key).agg(F.max("end").alias("_last")), key, "left").select(key, F.coalesce("_last", F.lit(0.0)).alias("_a"), F.col("duration").alias("_b"))
    return gaps.unionByName(tails).where(F.col("_b") - F.col("_a") > shortest).select(key, F.col("_a").alias("start"), F.col("_b").alias("end"))


def offsets(df: DataFrame, key: str, order: list[Column], duration: str = "duration") -> DataFrame:
    """``df`` with ``offset``, the total duration of the rows before."""
    return ordering.running(df, [key], order, {"offset": F.col(duration)})


def within_budget(df: DataFrame, key: str, target: float, ratio: float = 2.0) -> DataFrame:
    """The best-scored rows until their durations reach ``target``, with the one that crosses it; all rows if the total is at most ``ratio * target``.

    Durations aren't negative. A key's rows are dealt out, and of each part go first those that come after more than both limits in their part
    alone: the budget doesn't reach them, and what stays of the part still exceeds the total. So a key of any size is ordered by many tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(ratio, 1.0) * target * (1 + 1e-9)
    best, until = [F.desc("score"), F.col("start")], (Window.unboundedPreceding, -1)
    own = Window.partitionBy(key, "_part").orderBy(*best).rowsBetween(*until)
    d = df.withColumn("_part", F.pmod(F.xxhash64("score", "start"), F.lit(parts)))
    d = d.withColumn("_before", F.coalesce(F.sum("duration").over(own), F.lit(0.0))).where(F.col("_before") <= limit)
    total = F.sum("duration").over(Window.partitionBy(key))
    before = F.coalesce(F.sum("duration").over(Window.partitionBy(key).orderBy(*best).rowsBetween(*until)), F.lit(0.0))
    return d.withColumns({"_total": total, "_before": before}).where((F.col("_total") <= ratio * target) | (F.col("_before") < target)).drop("_total", "_before", "_part")


def decay_end(peaks: DataFrame, series: DataFrame, factor: float, reach: int, key: str = "asset", idx: str = "idx", value: str = "value") -> DataFrame:
    """``peaks`` with ``end_idx``: the place before the first value within ``reach`` that is below ``factor`` of the peak, or the last place in reach.

    Places are dealt into buckets of ``reach``; a peak looks into its own and the next one, so the join is by equal keys.
    """
    n = series.groupBy(key).agg(F.max(idx).alias("_last"))
    p = peaks.join(n, key).withColumn("_bucket", F.explode(F.array(F.floor(F.col(idx) / reach), F.floor(F.col(idx) / reach) + 1)))
    s = series.select(key, F.floor(F.col(idx) / reach).alias("_bucket"), F.col(idx).alias("_i"), F.col(value).alias("_y"))
    hit = (F.col("_i") > F.col(idx)) & (F.col("_i") <= F.col(idx) + reach) & (F.col("_y") < F.col(value) * factor)
    d = p.join(s, [key, "_bucket"], "left").groupBy(*peaks.columns, "_last").agg(F.min(F.when(hit, F.col("_i"))).alias("_first"))
    return d.withColumn("end_idx", F.coalesce(F.col("_first") - 1, F.least(F.col("_last"), F.col(idx) + reach))).drop("_first", "_last")


def around(t: Column, width: float) -> tuple[Column, Column]:
    """A window of ``width`` round a moment; the start is at least 0 and the end follows it."""
    start = F.greatest(F.lit(0.0), t - width / 2)
    return start, start + width


def around_within(t: Column, before: float, after: float, duration: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), t - before), F.least(duration, t + after)


def enforced(start: Column, end: Column, shortest: float, longest: float, limit: Column | None = None) -> Column:
    """An end that makes the interval at least ``shortest`` (up to ``limit``) and at most ``longest``."""
    longer = start + shortest if limit is None else F.least(limit, start + shortest)
    grown = F.when(end - start < shortest, longer).otherwise(end)
    return F.when(grown - start > longest, start + longest).otherwise(grown)


def trims(specs: DataFrame, column: str = "spec") -> DataFrame:
    """(label, trim_start, trim_end) of LABEL:START:END texts with a place ``pos``; blanks are null, the last of a label wins."""
    parts = F.split(F.col(column), ":")
    number = lambda k: F.expr(f"try_cast(nullif(trim(get(split(`{column}`, ':'), {k})), '') as double)")
    d = specs.select(F.upper(F.trim(F.get(parts, 0))).alias("label"), number(1).alias("trim_start"), number(2).alias("trim_end"), "pos")
    return d.groupBy("label").agg(F.max_by(F.struct("trim_start", "trim_end"), "pos").alias("t")).select("label", "t.trim_start", "t.trim_end")


def trimmed(segments: DataFrame, trim: DataFrame) -> DataFrame:
    """Segments with the trims of their label, both counted from the old start: end = max(start + 0.1, min(end, old end))."""
    d = segments.join(trim.withColumn("_cut", F.lit(True)), "label", "left").withColumns({"_s": F.col("start"), "_e": F.col("end")})
    start = F.greatest(F.col("_s"), F.least(F.col("_s") + F.coalesce("trim_start", F.lit(0.0)), F.col("_e")))
    d = d.withColumn("start", F.when(F.col("_cut"), start).otherwise(F.col("_s")))
    end = F.greatest(F.col("start") + 0.1, F.least(F.coalesce(F.col("_s") + F.col("trim_end"), F.col("_e")), F.col("_e")))
    d = d.withColumn("end", F.when(F.col("_cut"), end).otherwise(F.col("_e")))
    return d.withColumn("duration", F.col("end") - F.col("start")).drop("_s", "_e", "_cut", "trim_start", "trim_end")


def adaptive_clips(peaks: DataFrame, durations: DataFrame, key: str = "asset", shortest: float = 0.2, longest: float = 0.8, before: float = 0.1, edge: float = 0.1, tail: float = 0.5) -> DataFrame:
    """Short clips round peaks (key, t, strength), longer for stronger ones, within the asset; overlapping ones merge, late ones go."""
    top = peaks.groupBy(key).agg(F.max("strength").alias("_top"))
    d = peaks.join(top, key).join(durations, key)
    norm = F.when(F.col("_top") > 0, F.col("strength") / F.col("_top")).otherwise(1.0)
    d = d.withColumn("score", norm).withColumn("_len", shortest + F.col("score") * round(longest - shortest, 12))  # 0.8 - 0.2 is 0.6, not 0.6000000000000001
    d = d.withColumn("end", F.least(F.col("duration") - edge, F.greatest(F.lit(0.0), F.col("t") - before) + F.col("_len")))
    d = d.withColumn("start", F.greatest(F.lit(0.0), F.col("end") - F.col("_len")))
    return merged(d.select(key, "start", "end", "score"), key, 0.0, strict=True).join(durations, key).where(F.col("start") < F.col("duration") - tail).drop("duration")


def frames_within(segments: DataFrame, frames: DataFrame, fps: float, key: str = "source") -> DataFrame:
    """Segments with the frames (key, idx) that lie in [floor(start * fps), floor(end * fps)); joined by key and second, not by range alone."""
    a, b = F.floor(F.col("start") * fps), F.floor(F.col("end") * fps)
    s = segments.withColumns({"_a": a, "_b": b}).where("_b > _a").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / 100), F.floor((F.col("_b") - 1) / 100))))
    return s.join(frames.withColumn("_bin", F.floor(F.col("idx") / 100)), [key, "_bin"]).where((F.col("idx") >= F.col("_a")) & (F.col("idx") < F.col("_b"))).drop("_a", "_b", "_bin")
