"""Reports: per-asset statistics, first and best moments, texts, cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.functions.scalars import rating_tier
from momentlens.operators import ordering, ranks


def first_of_each(df: DataFrame, n: int, key: str = "asset", order: list[Column] | None = None) -> DataFrame:
    """The first ``n`` rows of each key: by time unless another order is given."""
    w = Window.partitionBy(key).orderBy(*(order or [F.col("idx")]))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def statistics(df: DataFrame, value: str, key: str = "asset", most: int | None = None) -> DataFrame:
    """Mean, extremes and exact median of each key's values. ``most``: a bound of a key's rows, if one is known."""
    median = ranks.percentiles(df, 0.5, key, value, most=most).withColumnRenamed("percentile", "median")
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min")).join(median, key, "left")


def top_entries(m: Column, n: int = 10) -> Column:
    """The largest entries of a map, the key settling ties, as a map."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.map_from_entries(F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct(e["k"], -e["v"])))


def sampling_cost(assets: DataFrame, interval: float = 5.0, per_call: int = 4, price: float = 0.004) -> DataFrame:
    """Frames, calls and price of rating a frame for each interval."""
    d = assets.agg(F.coalesce(F.sum(F.floor(F.col("duration") / interval)), F.lit(0)).cast("long").alias("frames"))
    return d.withColumn("calls", F.ceil(F.col("frames") / per_call).cast("long")).withColumn("cost", F.col("calls") * F.lit(price))


def index_stats(chunks: DataFrame, source: str = "source_name") -> DataFrame:
    return chunks.groupBy(source).agg(F.count(F.lit(1)).alias("chunks"))


def nested(stats: DataFrame, highlights: DataFrame, triggers: DataFrame, most: int = 10) -> DataFrame:
    """A report for each asset, as ``REPORT``.

    ``stats``: asset, file, duration, frames_analyzed, mean, max, min; ``highlights``: asset and the fields of a highlight;
    ``triggers``: asset, name, peak, of which the highest ``most`` are shown, the highest first.
    """
    fields = [f.name for f in REPORT["highlights"].dataType.elementType]
    h = highlights.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("peak_time", *[c for c in fields if c != "peak_time"]))).alias("h"))
    h = h.select("asset", F.transform("h", lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("highlights"))
    t = first_of_each(triggers, most, order=[F.desc("peak"), F.col("name")]).groupBy("asset").agg(F.array_sort(F.collect_list(F.struct((-F.col("peak")).alias("y"), F.col("name").alias("name")))).alias("t"))
    t = t.select("asset", F.transform("t", lambda x: F.struct(x["name"].alias("name"), (-x["y"]).alias("peak"))).alias("audio_triggers"))
    d = stats.join(h, "asset", "left").join(t, "asset", "left")
    score = F.struct(*[F.round(c, 3).alias(f"hybrid_{c}") for c in ("mean", "max", "min")])
    columns = {"name": F.col("asset"), "duration": F.round("duration", 1), "score_stats": score, "audio_triggers": F.coalesce("audio_triggers", F.array()), "highlights": F.coalesce("highlights", F.array()), "rating": rating_tier(F.col("max"))}
    return d.withColumns(columns).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REPORT])


_HIGHLIGHT = T.StructType([*[T.StructField(n, T.DoubleType()) for n in ("start", "end", "duration", "peak_time", "hybrid_score", "clip_score", "panns_score", "flow_score")], T.StructField("primary_signal", T.StringType()), T.StructField("reasons", T.ArrayType(T.StringType()))])
#: A report of one asset; its JSON form has these names.
REPORT = T.StructType(
    [
        T.StructField("file", T.StringType()), T.StructField("name", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("frames_analyzed", T.LongType()),
        T.StructField("score_stats", T.StructType([T.StructField(f"hybrid_{n}", T.DoubleType()) for n in ("mean", "max", "min")])),
        T.StructField("audio_triggers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("peak", T.DoubleType())]))),
        T.StructField("highlights", T.ArrayType(_HIGHLIGHT)), T.StructField("rating", T.StringType()),
    ]
)


def markdown(reports: DataFrame) -> DataFrame:
    """(part, place, value) of the report as text: totals (part 0), a table by best score (1) and each asset's section by name (2). There is a row for each asset; parts and places give the order."""
    names = lambda n: F.array_join(F.transform(F.slice("audio_triggers", 1, n) if n else F.col("audio_triggers"), lambda x: x["name"]), ", ")
    n = F.size("highlights")
    top = F.col("score_stats.hybrid_max")
    totals = reports.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("h")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.format_string("Assets: %d. Highlights: %d.", "n", "h").alias("value"))
    line = F.format_string("| %s | %.0fs | %s | %.3f | %d | %s |", F.right("name", F.lit(15)), "duration", "rating", top, n, F.when(F.size("audio_triggers") > 0, names(3)).otherwise("none"))
    ranked = ordering.places(reports.select("name", top.alias("top"), line.alias("line")), [], [F.desc("top"), F.col("name")], "place").withColumn("place", F.col("place") + 1)
    shown = F.transform(
        "highlights",
        lambda x, k: F.format_string("%d. %.1fs - %.1fs (%.3f), %s; audio %.3f, visual %.3f, motion %.3f; %s", k + 1, x["start"], x["end"], x["hybrid_score"], x["primary_signal"], x["panns_score"], x["clip_score"], x["flow_score"], F.array_join(x["reasons"], "; ")),
    )
    head = F.format_string("### %s\n%.1fs, rated %s, scores %.3f to %.3f", "name", "duration", "rating", F.col("score_stats.hybrid_min"), top)
    heard = F.when(F.size("audio_triggers") > 0, F.concat(F.lit("\nHeard: "), names(0))).otherwise("")
    section = F.concat(head, heard, F.when(n > 0, F.concat(F.lit("\n"), F.array_join(shown, "\n"))).otherwise("\nNo highlights."))
    sections = ordering.places(reports.select("name", section.alias("value")), [], [F.col("name")], "place").select(F.lit(2).alias("part"), (F.col("place") + 1).alias("place"), "value")
    table = ranked.select(F.lit(1).alias("part"), "place", F.concat(F.lit("| "), F.col("place").cast("string"), F.lit(" "), "line").alias("value"))
    return totals.unionByName(table).unionByName(sections)
