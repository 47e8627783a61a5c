"""Embedding whitening: streaming covariance on Spark, an eigen-solve of one small matrix, and the projection of every row.

Entries become integers (64ths, with an offset), so that sums are exact and equal vectors are found by equality. Equal vectors are
fitted once: they meet in each task before they are shuffled. Each partition's iterator takes a vector at a time into Welford's mean and
matrix of products by a rank-one update; the partitions' results are merged by the parallel formula, first in
groups on Spark, then the few groups' on the driver. The driver holds d x d matrices, no rows. The symmetric matrix is brought to
tridiagonal form by reflections and solved by the implicit QR method. ``identity_error`` is measured: whitened vectors of the
fit list go through the same streaming covariance.

Defined cases: rows whose vector is null, or holds null, NaN or infinite entries, are left out; so are entries of
``LIMIT`` or more, which 64-bit integers can't carry through exact sums, and vectors of another length than most rows
have (of equally many the longer one), as they have no covariance with the others; repeated rows and ids give repeated results;
equal eigenvalues have any orthonormal vectors of their space, the same for all rows; components without variance (at most
d times the double precision of the largest) are left out, so a table of one distinct vector has none; an empty table gives no rows; deviations
beyond a long are null; further input columns stay out of the result and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlens.llm.common import in_arrow, written

SCALE = 64
OFFSET = 1_000_000
LIMIT = 2.0**46
COMPONENTS = 16
#: Groups in which partitions' results meet before the driver.
GROUPS = 32
_MOMENTS = "w_n long, w_sums string, w_mean binary, w_products binary"


class Moments:
    """Count, exact sums of integers, mean and centred products of vectors."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, [0] * dims
        self.mean, self.products = np.zeros(dims), np.zeros((dims, dims))

    def add(self, x: np.ndarray) -> None:
        """Welford's update by one vector."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.products += np.outer(before, x - self.mean)

    def merge(self, other: "Moments") -> None:
        """The parallel formula."""
        if not other.n:
            return
        n, apart = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def batch(self) -> pa.RecordBatch:
        # sums of integers have any size
        return pa.RecordBatch.from_pydict({"w_n": [self.n], "w_sums": [",".join(map(str, self.sums))], "w_mean": [self.mean.tobytes()], "w_products": [self.products.tobytes()]}, pa.schema([("w_n", pa.int64()), ("w_sums", pa.string()), ("w_mean", pa.binary()), ("w_products", pa.binary())]))

    @classmethod
    def of(cls, row: dict) -> "Moments":
        out = cls(0)
        out.n, out.sums, out.mean = row["w_n"], [int(s) for s in row["w_sums"].split(",")], np.frombuffer(row["w_mean"]).copy()
        out.products = np.frombuffer(row["w_products"]).reshape(len(out.mean), -1).copy()
        return out

    def covariance(self) -> np.ndarray:
        """Divided by the count; symmetric."""
        return (self.products + self.products.T) / (2 * self.n)


def rotation(a: float, b: float) -> tuple[float, float]:
    """(c, s) with c * a + s * b the length of (a, b), and -s * a + c * b = 0."""
    r = np.hypot(a, b)
    return (1.0, 0.0) if r == 0 else (a / r, b / r)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and orthogonal q with a = q t q'."""
    a, n = a.copy(), len(a)
    q, least = np.eye(n), np.finfo(float).eps * np.linalg.norm(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length <= least:  # no more than rounding leaves of a zero
            a[k + 1 :, k] = 0
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        # reflections from both sides, as one symmetric update of rank two
        inner = a[k + 1 :, k + 1 :]
        p = 2 * inner @ v
        p -= v * (p @ v)
        inner -= np.outer(p, v) + np.outer(v, p)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit vectors as columns, by implicit QR steps with Wilkinson's shift."""
    d, e, q = tridiagonal(np.asarray(a, float))
    tiny, end = np.finfo(float).eps, len(d) - 1
    while end > 0:
        small = np.abs(e[:end]) <= tiny * (np.abs(d[:end]) + np.abs(d[1 : end + 1])) + np.finfo(float).tiny
        e[:end][small] = 0
        if small[end - 1]:
            end -= 1
            continue
        cuts = np.flatnonzero(small)
        start = int(cuts[-1]) + 1 if len(cuts) else 0
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):  # the bulge goes down the band
            c, s = rotation(x, z)
            if k > start:
                e[k - 1] = c * x + s * z
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            left = q[:, k].copy()
            q[:, k] = c * left + s * q[:, k + 1]
            q[:, k + 1] = c * q[:, k + 1] - s * left
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def integers(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with ``w_x``, the entries as integers, without the rows that have none."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False))) & (F.size(v) > 0)
    d = vectors.where(v.isNotNull() & usable)
    dims = d.groupBy(F.size(v).alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    d = d.where(F.size(v) == (dims["n"] if dims else 0))
    return d.withColumn("w_x", F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long")))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("w_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def moments(vectors: DataFrame, projected: tuple[np.ndarray, np.ndarray] | None = None) -> Moments | None:
    """Of all ``w_x``, less the offset; with ``projected`` (mean, matrix) of what these give. Without vectors there is nothing."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch) - OFFSET
            points = x.astype(float) if projected is None else (x - projected[0]) @ projected[1]
            found = found or Moments(points.shape[1])
            for p in points:
                found.add(p)
            if projected is None:
                found.sums = [a + int(b) for a, b in zip(found.sums, _sums(x), strict=True)]
        if found is not None:
            yield found.batch()

    def merged(table: pa.Table) -> pa.Table:
        found = None
        for row in table.select(["w_n", "w_sums", "w_mean", "w_products"]).to_pylist():
            one = Moments.of(row)
            if found is None:
                found = one
            else:
                found.merge(one)
        return pa.Table.from_batches([found.batch()])

    parts = in_arrow(vectors.select("w_x"), stream, _MOMENTS)
    grouped = parts.groupBy(F.pmod(F.xxhash64("w_sums", "w_mean"), F.lit(GROUPS)).alias("g")).applyInArrow(merged, _MOMENTS)
    out = None
    for row in sorted(grouped.collect(), key=lambda r: r["w_sums"]):  # GROUPS rows at most
        one = Moments.of({**row.asDict(), "w_mean": bytes(row["w_mean"]), "w_products": bytes(row["w_products"])})
        if out is None:
            out = one
        else:
            out.merge(one)
    return out


def _sums(x: np.ndarray) -> list[int]:
    """Column sums, exact: high and low halves apart, so that no batch overflows."""
    return [(int(h) << 32) + int(l) for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond a long. ``x`` and ``sums`` have the same offset."""
    rough = ((n * x.astype(float) - np.array(sums, float)) ** 2).sum(axis=1)
    total = np.array(sums, object)
    out = []
    if n * max(1.0, float(np.abs(x).max(initial=0))) < 2.0**62 and rough.max(initial=0) < 2.0**62:
        exact = n * x - np.array(sums, np.int64)
        return (exact * exact).sum(axis=1).tolist()
    for row in x.astype(object):
        value = int(((n * row - total) ** 2).sum())
        out.append(value if value < 2**63 else None)
    return out


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component, see the module."""
    d = integers(vectors.select(F.col(id_col).alias("w_id"), F.col(vector_col).alias("w_v")), "w_v").select("w_id", "w_x")
    # equal vectors meet in each task first; written, as it is read twice
    distinct = written(d.select("w_x").distinct(), "distinct-vectors")
    found = moments(distinct)
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    values, axes = eigen(found.covariance())
    rank = int((values > len(values) * np.finfo(float).eps * max(values[0], 0.0)).sum())
    kept = min(most, rank)
    n, sums = found.n, found.sums
    mean = np.array([s // n + (s % n) / n for s in sums])
    matrix = axes[:, :kept] / np.sqrt(values[:kept])
    explained = values[:kept] / values.sum()
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    error = float(np.abs(moments(distinct, (mean, matrix)).covariance() - np.eye(kept)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch) - OFFSET
            rows = batch.num_rows
            many = np.repeat(np.arange(rows), kept)
            columns = [
                batch.column("w_id").take(pa.array(many)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)), pa.array(np.full(rows * kept, n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(many)), pa.array(((x - mean) @ matrix).reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * kept, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_arrow(d, project, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the whitened components of every usable embedding."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
