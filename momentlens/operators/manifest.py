"""Manifests: labelled segments, selected, edited, joined with files and nested for the sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.functions.scalars import segment_label, side

SEGMENT = T.StructType([T.StructField(n, t) for n, t in (("label", T.StringType()), ("source", T.StringType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("duration", T.DoubleType()), ("score", T.DoubleType()), ("focal_x", T.DoubleType()))])
SINGLE = T.StructType([T.StructField("source", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT))])
MULTI = T.StructType([T.StructField("query", T.StringType()), T.StructField("created", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT))])


def labelled(segments: DataFrame, order: list[Column], key: str | None = None) -> DataFrame:
    """Segments with ``label`` and ``rank`` (from 0) in an order that must be total.

    Without a key the rows of one manifest are ordered together: a ranked, limited selection.
    """
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(*order)
    return segments.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).withColumn("label", segment_label(F.col("rank")))


def selected(segments: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Labels that are listed, without those that are excluded; either list may be empty."""
    d = segments
    if include:
        d = d.where(F.col("label").isin([x.strip().upper() for x in include]))
    if exclude:
        d = d.where(~F.col("label").isin([x.strip().upper() for x in exclude]))
    return d


def with_voiceover(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with the file of their label, if any. ``files``: (label, file, pos); the last of a label wins."""
    return segments.join(files.groupBy("label").agg(F.max_by("file", "pos").alias("file")), "label", "left")


def enriched(segments: DataFrame, focal: DataFrame, default: float = 0.5) -> DataFrame:
    """Segments with the ``focal_x`` of their label, or the default, and its ``side``; an older one is replaced. ``focal``: (label, focal_x), a row for each label."""
    d = segments.drop("focal_x", "side").join(focal.select("label", "focal_x"), "label", "left").withColumn("focal_x", F.coalesce("focal_x", F.lit(default)))
    return d.withColumn("side", side(F.col("focal_x")))


def accepted(segments: DataFrame, files: DataFrame, order: list[str], least: int = 1000) -> DataFrame:
    """Ranked segments whose clip exists and is larger than ``least`` bytes, back in order of time. ``files``: (rank, length)."""
    return segments.join(files.where(F.col("length") > least).select("rank"), "rank", "left_semi").orderBy(*order)


def nested(segments: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """A row for each key with its segments as an ordered array of structs."""
    d = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns))).alias("segments"))
    return d.withColumn("segments", F.transform("segments", lambda s: F.struct(*[s[c].alias(c) for c in columns])))


def flattened(reports: DataFrame, array: str = "highlights") -> DataFrame:
    return reports.select("*", F.posexplode(array).alias("pos", "item")).drop(array)


def voiceover_manifests(narrations: DataFrame, key: str, speaker: str) -> DataFrame:
    """(key, speaker, narrations, files) of narrations (key, label, text, pos): their texts in order, and the file of each label; the last text of a label counts. Empty texts have no file."""
    last = narrations.where(F.col("label").isNotNull() & (F.coalesce("text", F.lit("")) != "")).groupBy(key, "label").agg(F.max_by(F.struct("text", "pos"), "pos").alias("t"))
    each = F.struct(F.col("t.pos").alias("pos"), "label", F.col("t.text").alias("text"))
    d = last.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("all"))
    file = lambda x: F.struct(x["label"], F.concat(F.lit("vo_"), x["label"], F.lit(".wav")))
    return d.select(key, F.lit(speaker).alias("speaker"), F.transform("all", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("narrations"), F.map_from_entries(F.transform("all", file)).alias("files"))


def render_props(manifests: DataFrame, voiceovers: DataFrame, key: str, fps: int = 30, labels: bool = True, source: str = "source.mp4") -> DataFrame:
    """(key, props): what a renderer is handed of each manifest (key, segments), as JSON: its segments, the rate, whether labels are shown, and the voice files (label, file) if there are any."""
    spoken = F.transform(F.map_entries("files"), lambda e: F.struct(e["key"].alias("label"), F.concat(F.lit("voiceover/"), e["value"]).alias("file")))
    d = manifests.join(voiceovers.select(key, spoken.alias("voiceovers")), key, "left")
    return d.select(key, F.to_json(F.struct(F.lit(source).alias("source"), "segments", F.lit(fps).alias("fps"), F.lit(labels).alias("showLabels"), "voiceovers")).alias("props"))


#: A whole string, a brace, or what is neither.
_TOKEN = r'(?s)"(?:[^"\\]|\\.)*"|[{}]|[^{}"]+|"'


def outermost(text: Column) -> Column:
    """The whole objects of a text, each from a brace to the one that closes it; braces in strings don't count. One for each brace that is ever closed, in order."""
    braces = F.greatest(F.lit(0), F.size(F.split(text, r"\{")) - 1)
    rest = F.when(braces > 0, F.transform(F.sequence(F.lit(1), braces), lambda k: F.concat(F.lit("{"), F.call_function("substring_index", text, F.lit("{"), k - braces - 1))))

    def step(s: Column, token: Column) -> Column:
        depth = s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        place = s["place"] + F.length(token)
        return F.struct(depth.alias("depth"), place.alias("place"), F.when(s["end"] > 0, s["end"]).when(depth == 0, place).otherwise(0).alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("place"), F.lit(0).alias("end"))
    end = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(_TOKEN), F.lit(0)), start, step)["end"]
    whole = F.transform(rest, lambda x: F.left(x, end(x)))
    return F.coalesce(F.filter(whole, lambda x: x != ""), F.array().cast("array<string>"))


def tolerant_variant(text: Column, required: str) -> Column:
    """The whole text as JSON of any shape, else the first of its objects that parses and has the required field, else null."""
    has = lambda v: F.try_variant_get(v, f"$.{required}", "variant").isNotNull()
    whole = F.try_parse_json(text)
    inner = F.filter(F.transform(outermost(text), F.try_parse_json), has)
    return F.when(F.coalesce(has(whole), F.lit(False)), whole).otherwise(F.get(inner, F.lit(0)))


def tolerant_json(text: Column, schema: str, default: Column, required: str) -> Column:
    """The fields of ``schema`` from the whole text as JSON, else from its first object that has them, else a default; a field of another type than the schema's is null."""
    fields = T.StructType.fromDDL(schema).fields
    found = lambda v: F.struct(*[F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields])
    # one value for all fields: a variant isn't parsed again for each
    got = F.transform(F.array(tolerant_variant(text, required)), found)[0]
    return F.when(got[required].isNotNull(), got).otherwise(default)
