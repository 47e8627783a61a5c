"""Chunks and their vectors: cutting, incremental indexing, search, contrast with prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.functions.scalars import chunk_id
from momentlens.functions.vectors import cosine, dot, unit


def chunks(assets: DataFrame, length: int = 30, overlap: int = 5, shortest: float = 2.0, source: str = "source") -> DataFrame:
    """Overlapping chunks of each asset (source, duration) from whole seconds on; assets below a second have none."""
    d = assets.where(F.floor("duration") >= 1)
    d = d.withColumn("start", F.explode(F.sequence(F.lit(0), (F.floor("duration") - 1).cast("int"), F.lit(length - overlap))))
    d = d.withColumn("start", F.col("start").cast("double")).withColumn("end", F.least(F.col("start") + length, F.col("duration"))).where(F.col("end") - F.col("start") >= shortest)
    return d.withColumn("chunk_id", chunk_id(F.col(source), F.col("start")))


def fresh(new: DataFrame, indexed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that the index doesn't have."""
    return new.join(indexed.select(key), key, "left_anti")


def contrast(vectors: DataFrame, prompts: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean similarity to positive prompts minus that to negative ones. ``prompts``: (polarity, vec), unit vectors.

    A mean of dot products is the dot product with the mean, so prompts are averaged first and nothing is crossed.
    """
    means = {p: _mean(prompts.where(F.col("polarity") == s), "vec") for p, s in (("pos", 1), ("neg", -1))}
    scored = vectors.withColumn("_u", unit(F.col(vector)))
    for name, mean in means.items():
        scored = scored.withColumn(name, dot(F.col("_u"), F.array(*[F.lit(x) for x in mean])))
    return scored.select(*keys, (F.col("pos") - F.col("neg")).alias("score"))


def _mean(df: DataFrame, vector: str) -> list[float]:
    """The mean vector, as long as one vector."""
    rows = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def centroid(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean of unit vectors by key, scaled to length 1 again."""
    parts = df.select(*keys, F.posexplode(unit(F.col(vector))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    gathered = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_v"))
    return gathered.select(*keys, unit(F.col("_v")).alias("centroid"))


def nearest(index: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """The ``k`` rows of the highest cosine similarity to one vector, exactly; each task keeps its own best before they meet."""
    return index.withColumn("similarity", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).orderBy(F.desc("similarity"), tie).limit(k)


def still(sizes: Column, threshold: float = 0.98) -> Column:
    """Whether frame sizes hardly differ; fewer than two are still."""
    return F.coalesce(F.when(F.size(sizes) >= 2, F.array_min(sizes) / F.array_max(sizes) >= threshold), F.lit(True))


def focal_point(frames: DataFrame, key: str = "label", grid: str = "grid", low: float = 0.2, high: float = 0.8, default: float = 0.5, columns: int | None = None) -> DataFrame:
    """Where the motion of a segment's frames is, over columns of a grid from 0 to 1; ``default`` with hardly any motion.

    Frames meet as one row of means, not one for each column. ``columns``: those of the widest grid, if they are known; else they are counted first.
    """
    frames = frames.where(F.size(grid) > 0)
    if columns is None:
        columns = frames.agg(F.max(F.size(grid))).first()[0] or 1
    names = [f"_x{i}" for i in range(columns)]
    means = frames.groupBy(key, (F.size(grid) - 1).alias("m")).agg(*[F.avg(F.get(grid, F.lit(i))).alias(x) for i, x in enumerate(names)])
    total = lambda terms: F.when(F.coalesce(*names).isNotNull(), sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)))
    w = F.when(F.col("m") >= columns, F.raise_error(F.lit(f"a grid has more than {columns} columns"))).otherwise(total(map(F.col, names)))
    d = means.groupBy(key).agg(F.sum(w).alias("w"), F.sum(total(F.col(x) * i / F.col("m") for i, x in enumerate(names))).alias("s"))
    x = F.when(F.col("w") < 1e-6, default).otherwise(F.col("s") / F.col("w"))
    return d.select(key, F.round(F.greatest(F.lit(low), F.least(F.lit(high), x)), 3).alias("focal_x"))


def numbered(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
