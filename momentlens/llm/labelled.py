"""Bounded samples of labelled rows, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(labels: DataFrame, label_col: str, usable: Column, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``per_class`` ids of each label, the first by a hash of the id.

    Null labels and ids are left out; an id with both labels counts as label 1.
    """
    one = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    parts = [one.where(F.col("label") == k).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])
