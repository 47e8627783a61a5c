"""Corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes all that its predecessor kept and returns the columns of ``documents``, the last one the
places of the packed pieces. Nulls, blank texts, ties, repeated rows and empty tables are treated as the
operators' docstrings say; the near-duplicate stage keeps one of equal rows and judges different texts of the same id apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens.llm import decontaminate, near_duplicates, packing, personal_data, quality_rules
from momentlens.llm.common import documents, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, confirmed similarity of 0.8 or more."""
    return near_duplicates.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents of nothing else go."""
    return _counted(decontaminate.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(personal_data.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece in sequences of 4096."""
    return packing.packed(docs, packing.vocabulary_path())


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", privacy),
    ("packing", packed),
]

#: SimHash components, the trained span classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
