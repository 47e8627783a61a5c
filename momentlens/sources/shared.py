"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only where it is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="momentlens-"))
    return _fallback[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read back: what several branches of a plan read is computed once and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
