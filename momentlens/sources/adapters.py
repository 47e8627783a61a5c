"""Engine inputs made of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_DAY = "2024-01-01"
#: Values of the events' `k` that count as labelled classes.
CLASSES = tuple(range(0, 100, 7))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of(ts: Column) -> Column:
    return (F.datediff(F.to_date(ts), F.lit(FIRST_DAY)) * 24 + F.hour(ts)).cast("long")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset (event type), idx (hour), clip, panns, flow, mae; hours without events have zeros, up to the last hour of any."""
    k = F.get_json_object("props", "$.k").cast("int")
    d = table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), hour_of(F.col("ts")).alias("idx"), "value", k.alias("k"))
    some = d.groupBy("asset", "idx").agg(
        F.avg("value").alias("clip"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("panns"), F.count(F.lit(1)).cast("double").alias("flow"),
        F.coalesce(F.sum(F.when(F.col("k").isin(*CLASSES), F.col("value"))), F.lit(0.0)).alias("mae"),
    )
    last = d.agg(F.max("idx").alias("last")).first()["last"]
    spine = d.select("asset").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))))
    return spine.join(some, ["asset", "idx"], "left").fillna(0.0)


def levels(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """asset (user, or another ``key``), t (number of the event in time), value. Events are numbered within an asset's day; only days' counts meet for all of an asset."""
    d = table(spark, sf_dir, "events").select(F.col(key).alias("user_id"), F.to_date("ts").alias("day"), "ts", "event_id", "value")
    before = Window.partitionBy("_user").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = d.groupBy(F.col("user_id").alias("_user"), F.col("day").alias("_day")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_earlier", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    d = d.join(days, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("day").eqNullSafe(F.col("_day")))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return d.select(F.col("user_id").alias("asset"), (F.col("_earlier") + F.row_number().over(w) - 1).cast("double").alias("t"), "value")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (supplier), start (days since 1992), end (start + quantity / 10), score (discount)."""
    d = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01")).cast("double")
    return d.select(F.col("l_suppkey").alias("source"), start.alias("start"), (start + F.col("l_quantity") / 10).alias("end"), F.col("l_discount").alias("score"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (label as text), start, end, embedding, chunk_id: one 30-second chunk each 25 seconds."""
    w = Window.partitionBy("label").orderBy("vec_id")
    d = table(spark, sf_dir, "embeddings").withColumn("start", 25.0 * (F.row_number().over(w) - 1))
    return d.select(F.concat(F.lit("video"), F.col("label").cast("string")).alias("source"), "start", (F.col("start") + 30).alias("end"), F.col("vec_id").alias("chunk_id"), "embedding")


def durations(index: DataFrame) -> DataFrame:
    return index.groupBy("source").agg(F.max("end").alias("duration"))
