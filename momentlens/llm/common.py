"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one task holds decoded at a time.
CHUNK_BYTES = 8 << 20

#: Rows that Spark hands to a task at once; it stops at this size, so that long texts don't add up.
BATCH_BYTES = 16 << 20

_fallback: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, wherever the driver has it from. Once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="momentlens-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with this package at hand and batches of a bounded size, which holds for the session from then on, as plans read it when they run."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only where it is unset and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="momentlens-"))
    return _fallback[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that no later job recomputes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in fold -1, which no split names."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with their texts as UTF-8; each holds ``most`` bytes or one text. Null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]
        start = held = 0
        for i, t in enumerate(texts):
            if i > start and held + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(t)
        yield batch.slice(start), texts[start:]
