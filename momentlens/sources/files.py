"""Catalogues of media files, manifests, cached signals and the chunk index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.functions.scalars import chunk_id, file_name, suffix
from momentlens.operators.manifest import MULTI, SINGLE
from momentlens.operators.report import REPORT
from momentlens.sources.shared import scratch, written  # noqa: F401

#: Parts of each model or signal, so that an addition rewrites only those it touches.
BUCKETS = 64
EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".webm")
#: ffprobe's output, as far as it is used.
PROBE = T.StructType(
    [
        T.StructField("format", T.StructType([T.StructField("duration", T.StringType())])),
        T.StructField("streams", T.ArrayType(T.StructType([T.StructField("r_frame_rate", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
    ]
)


def catalogue(spark: SparkSession, folder: str, pattern: str | None = None, extensions: tuple[str, ...] = EXTENSIONS, least: int = 0) -> DataFrame:
    """(path, name, length) of a folder's files, by a glob of exact case or by extensions of any case; contents aren't read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    d = reader.load(folder).select("path", "length").withColumn("name", file_name(F.col("path")))
    if not pattern:
        d = d.where(suffix(F.col("path")).isin(*extensions))
    return d.where(F.col("length") > least).select("path", "name", "length").orderBy("name")


def probed(texts: DataFrame, column: str = "json") -> DataFrame:
    """Duration, frame rate and size from probe texts; frame rates are fractions."""
    from momentlens.functions.scalars import rational

    d = texts.withColumn("_p", F.from_json(column, PROBE))
    stream = F.filter("_p.streams", lambda s: s["width"].isNotNull())[0]
    return d.select("*", F.col("_p.format.duration").cast("double").alias("duration"), rational(stream["r_frame_rate"]).alias("fps"), stream["width"].alias("width"), stream["height"].alias("height")).drop("_p", column)


def read_manifest(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """Segments of manifests, one row each; a broken file fails the read."""
    d = spark.read.schema(MULTI if multi else SINGLE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return d.select(*[c for c in d.columns if c not in ("segments", "source")], *([] if multi else ["source"]), F.posexplode("segments").alias("pos", "_s")).select("*", *[F.col(f"_s.{f.name}") for f in (MULTI if multi else SINGLE)["segments"].dataType.elementType if multi or f.name != "source"]).drop("_s")


def write_manifest(segments: DataFrame, path: str, key: str, columns: list[str], order: str) -> None:
    """One JSON line for each key, its segments nested in order."""
    from momentlens.operators.manifest import nested

    nested(segments, key, columns, order).write.mode("overwrite").json(path)


def enrich_manifest(spark: SparkSession, path: str, focal: DataFrame, out: str) -> None:
    """The manifest with focal points, written to another path, so that a failed job leaves the old one whole."""
    from momentlens.operators.manifest import enriched

    columns = [f.name for f in SINGLE["segments"].dataType.elementType if f.name != "source"]
    write_manifest(enriched(read_manifest(spark, path), focal), out, "source", columns, "pos")


def write_report(reports: DataFrame, path: str) -> None:
    """One JSON line for each asset's report."""
    reports.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports with their nested highlights; a broken file fails the read."""
    return spark.read.schema(REPORT).option("mode", "FAILFAST").json(path)


def concat_list(files: DataFrame, path: str, order: str = "rank") -> None:
    """The list file of a concatenation: one line for each clip of one timeline, in order."""
    line = F.concat(F.lit("file '"), F.replace("file", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    files.orderBy(order).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder that only Spark may be able to read is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _merged(new: DataFrame, path: str, key: list[str], parts: list[str], where: Column | None = None) -> DataFrame:
    """Add to the table at ``path`` the rows of ``new`` whose ``key`` it lacks; the keys that are added.

    ``parts``, the last of them ``bucket``, depend on the key. Only buckets that get rows are rewritten, each as a whole with what it has, so a write that is
    repeated, in whole or in part, leaves each key once, and so does one that was interrupted and is run again. Of writers to the same bucket at the same time the last one's
    bucket stays; what the other added there is added by its replay.
    """
    spark = new.sparkSession
    keys = new.select(*dict.fromkeys([*key, *parts])).distinct()
    there = exists(spark, path)
    if there:
        old = spark.read.parquet(path)
        old = old if where is None else old.where(where)
        keys = keys.join(old.select(*key).distinct(), key, "left_anti")
    keys = written(keys, "new-keys")
    fresh_rows = new.join(keys.select(*key), key, "left_semi")
    if not there:
        fresh_rows.write.partitionBy(*parts).parquet(path)
    elif not keys.isEmpty():
        touched = old.join(keys.select(*parts).distinct(), parts, "left_semi")
        both = touched.select(*fresh_rows.columns).unionByName(fresh_rows)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return keys


def cache_signals(signals: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Add the series (asset, signal, idx, value) that the cache lacks, partitioned by signal and bucket of the asset; returns how many are new. May be repeated."""
    d = signals.withColumn("bucket", F.pmod(F.xxhash64(F.col("asset").cast("string")), F.lit(buckets)).cast("int"))
    return _merged(d, path, ["signal", "asset"], ["signal", "bucket"]).select("signal", "asset").distinct().count()


def cached_signals(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Only the partitions of the named signals are read."""
    return spark.read.parquet(path).where(F.col("signal").isin(*names)).drop("bucket")


def add_chunks(chunks: DataFrame, path: str, model: str, buckets: int = BUCKETS) -> int:
    """Add the chunks (source, start, end, embedding) that the index lacks for a model, with their ``source_name`` and ``duration``; returns how many. May be repeated."""
    new = chunks.withColumn("chunk_id", chunk_id(F.col("source"), F.col("start"))).dropDuplicates(["chunk_id"])
    new = new.withColumns({"source_name": file_name(F.col("source")), "duration": F.col("end") - F.col("start"), "indexed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "model": F.lit(model), "bucket": F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")})
    # written, as embeddings may come from a model, which mustn't run again for each use
    return _merged(written(new, "chunks"), path, ["chunk_id"], ["model", "bucket"], F.col("model") == model).count()


def indexed_chunks(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The index's rows, of one model or of all."""
    d = spark.read.parquet(path).drop("bucket")
    return d if model is None else d.where(F.col("model") == model)


def indexed_sources(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(source, source_name, chunks, first, last) of each source of the index, by name."""
    d = indexed_chunks(spark, path, model).groupBy("source", "source_name")
    return d.agg(F.count(F.lit(1)).alias("chunks"), F.min("start").alias("first"), F.max("end").alias("last")).orderBy("source_name", "source")
