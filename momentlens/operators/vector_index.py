"""Vector search by inverted lists, exact.

Vectors are dealt to the nearest of some centroids, fitted by k-means on Spark, and stored in order of (list, angle to the centroid), in shards cut by
ranges, so that a list of any size spreads. By the triangle inequality a vector whose angle to its centroid differs from the query's by more than
the angle searched for can't be near enough: shards beyond that are never met, and of a shard only the members within it are
compared, as one product of matrices. Nothing is lost by that. What it saves depends on the data: for near vectors and clusters nearly
everything, for wide angles in vectors without any structure little.

Vectors that are null, empty, of another length than most or not finite aren't indexed; a zero vector has similarity 0 to all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlens.sources.shared import written

# workers get these functions by value, so they needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lists of an index at most; tasks hold their centroids.
MOST_LISTS = 1024
#: Members of a shard at most.
MEMBERS = 2048
#: Queries and pairs that are compared in one group at most: what a Python worker holds doesn't grow with the tables.
ASKED, PAIRS = 4096, 1 << 20
#: Rows that are held against all centroids at a time, and bytes of a batch of routed queries, about.
PIECE, ROUTED = 1024, 1 << 23
#: Angles are known to about this.
SLACK = 1e-6


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


def _pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, most) for at in range(0, batch.num_rows, most))


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> tuple[DataFrame, int]:
    """(_id, _v) of the vectors that can be compared, and their length."""
    v = F.col("_v")
    d = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    d = d.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    if dims is None:
        most = d.groupBy(F.size(v).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
        dims = most["n"] if most else 0
    return d.where(F.size(v) == dims), dims


def centroids(d: DataFrame, lists: int, rounds: int) -> np.ndarray:
    """Unit vectors of ``lists`` clusters of ``d`` (_id, _v): vectors picked by a hash of their ids, then ``rounds`` of k-means over all rows. Only centroids come to the driver."""
    first = d.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(lists).select("_v").toArrow()
    c = np.unique(_units(first.column("_v")), axis=0) if first.num_rows else np.zeros((0, 0))
    for _ in range(rounds if len(c) > 1 else 0):

        def sums(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for batch in _pieces(batches):
                u = _units(batch.column("_v"))
                of = (u @ c.T).argmax(axis=1)
                np.add.at(total, of, u)
                n += np.bincount(of, minlength=len(c))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"_c": pa.array(some, pa.int32()), "_s": pa.array([x.tobytes() for x in total[some]], pa.binary())})

        def added(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in table.column("_s").to_pylist())
            return pa.table({"_c": table.column("_c")[:1], "_s": pa.array([total.tobytes()], pa.binary())})

        for row in d.select("_v").mapInArrow(sums, "_c int, _s binary").groupBy("_c").applyInArrow(added, "_c int, _s binary").collect():
            mean = np.frombuffer(bytes(row["_s"]))
            length = np.linalg.norm(mean)
            if length > 0:
                c[row["_c"]] = mean / length
    return c


def listed(d: DataFrame, c: np.ndarray) -> DataFrame:
    """``d`` with ``_list`` and ``_angle``, the nearest centroid and the angle to it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            near = _units(batch.column("_v")) @ c.T
            of = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(of)), of], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32()), pa.array(angle)], names=[*batch.schema.names, "_list", "_angle"])

    return d.mapInArrow(deal, f"_id {d.schema['_id'].dataType.simpleString()}, _v array<double>, _list int, _angle double")


def build(vectors: DataFrame, path: str, id_col: str, vector_col: str = "embedding", lists: int | None = None, rounds: int = 2) -> None:
    """Write an index: ``lists`` (by default about the root of the rows, ``MOST_LISTS`` at most) of clusters and all vectors by list and angle."""
    d, _ = usable(vectors, id_col, vector_col)
    lists = min(MOST_LISTS, lists or int(d.count() ** 0.5) + 1)
    c = centroids(d, lists, rounds)
    spark = vectors.sparkSession
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    _append(listed(d, c), path)


def _append(d: DataFrame, path: str) -> None:
    """One more run of shards."""
    ranged = d.repartitionByRange("_list", "_angle").sortWithinPartitions("_list", "_angle")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # from 0 in each partition
    ranged.withColumn("_shard", F.concat_ws("-", F.lit(_run(d.sparkSession, path)), F.spark_partition_id(), F.floor(place / MEMBERS))).write.mode("append").parquet(f"{path}/shards")


def _run(spark: SparkSession, path: str) -> int:
    """How many runs there are."""
    try:
        return spark.read.parquet(f"{path}/shards").agg(F.max(F.split("_shard", "-")[0].cast("int"))).first()[0] + 1
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def add(vectors: DataFrame, path: str, id_col: str, vector_col: str = "embedding") -> None:
    """Deal vectors whose ids the index lacks to its lists; centroids stay, so results stay exact and lists only get less even."""
    spark = vectors.sparkSession
    c = _centroids(spark, path)
    d, _ = usable(vectors, id_col, vector_col, c.shape[1])
    d = d.dropDuplicates(["_id"]).join(spark.read.parquet(f"{path}/shards").select("_id"), "_id", "left_anti")
    _append(listed(d, c), path)


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
    return np.array([r["centroid"] for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _routed(asked: DataFrame, c: np.ndarray, first: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """``asked`` (_q, _u, _least) for each list, with the angles (_from, _to) that a near enough member has to its centroid.

    ``first``: the lists' sizes and a number; then only for the nearest lists that hold so many members together.
    """
    step = max(1, ROUTED // max(1, c.size * 8 + len(c) * 64))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, step):
            angle = np.arccos(np.clip(_units(part.column("_u")) @ c.T, -1, 1))
            within = np.arccos(np.clip(part.column("_least").to_numpy(), -1, 1))[:, None] + SLACK
            chosen = np.ones(angle.shape, bool)
            if first is not None:
                sizes, k = first
                order = angle.argsort(axis=1, kind="stable")
                before = sizes[order].cumsum(axis=1) - sizes[order]
                np.put_along_axis(chosen, order, (before < k) & (sizes[order] > 0), axis=1)
            rows, lists = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(rows)) for x in part.columns), pa.array(lists, pa.int32()), pa.array((angle - within)[chosen]), pa.array((angle + within)[chosen])], names=[*part.schema.names, "_list", "_from", "_to"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(route, f"{fields}, _list int, _from double, _to double")


def _comparer(most: int | None, counted: bool):
    def compare(table: pa.Table) -> pa.Table:
        asked = table.column("_of").to_numpy()
        members, rest = table.filter(pa.array(asked == 0)).sort_by("_from"), table.filter(pa.array(asked != 0))
        low = np.searchsorted(members.column("_from").to_numpy(), rest.column("_from").to_numpy(), side="left")
        high = np.searchsorted(members.column("_from").to_numpy(), rest.column("_to").to_numpy(), side="right")
        q, least = rest.column("_q"), rest.column("_least").to_numpy()
        if counted:
            return pa.table({"_q": q, "_id": pa.nulls(len(q), members.column("_id").type), "similarity": (high - low).astype(float)})
        x, y = _units(members.column("_u")), _units(rest.column("_u"))
        rows, found, near = [], [], []
        for k in range(len(y)):
            s = x[low[k] : high[k]] @ y[k]
            hit = np.flatnonzero(s >= least[k])
            if most is not None and len(hit) > most:  # with those that are as near as the last one
                hit = hit[s[hit] >= np.partition(s[hit], -most)[-most] - 1e-12]
            rows.append(np.full(len(hit), k))
            found.append(hit + low[k])
            near.append(s[hit])
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        return pa.table({"_q": q.take(pa.array(join(rows, np.int64))), "_id": members.column("_id").take(pa.array(join(found, np.int64))), "similarity": join(near, float)})

    return compare


def _compared(asked: DataFrame, path: str, c: np.ndarray, most: int | None = None, counted: bool = False, first: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(_q, _id, similarity) of all members that are at least ``_least`` near to a query (_q, _u, _least); with ``first`` only of the nearest lists, as in ``_routed``."""
    spark = asked.sparkSession
    members = spark.read.parquet(f"{path}/shards")
    shards = members.groupBy("_shard", "_list").agg(F.min("_angle").alias("_low"), F.max("_angle").alias("_high"), F.count(F.lit(1)).alias("_members"))
    routed = _routed(asked, c, first).join(shards, "_list").where("_low <= _to AND _high >= _from").drop("_low", "_high")
    queries = F.count(F.lit(1))
    parts = routed.groupBy("_shard", "_list").agg(F.greatest(F.ceil(queries / ASKED), F.ceil(queries * F.max("_members") / PAIRS)).cast("int").alias("_n"))
    routed = routed.drop("_members")
    routed = routed.join(parts, ["_shard", "_list"]).withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_n")).cast("int")).drop("_n")
    there = members.join(parts, ["_shard", "_list"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    there = there.select("_shard", "_list", "_part", F.lit(0).alias("_of"), "_id", F.col("_v").alias("_u"), F.col("_angle").alias("_from"))
    both = there.unionByName(routed.withColumn("_of", F.lit(1)), allowMissingColumns=True)
    schema = f"_q {asked.schema['_q'].dataType.simpleString()}, _id {members.schema['_id'].dataType.simpleString()}, similarity double"
    return both.groupBy("_shard", "_list", "_part").applyInArrow(_comparer(most, counted), schema)


def _asked(queries: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    return usable(queries, id_col, vector_col, dims)[0].select(F.col("_id").alias("_q"), F.col("_v").alias("_u"))


def within(queries: DataFrame, path: str, least: float, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """(_q, _id, similarity) of all indexed vectors of a cosine similarity of at least ``least`` to a query."""
    c = _centroids(queries.sparkSession, path)
    return _compared(_asked(queries, id_col, vector_col, c.shape[1]).withColumn("_least", F.lit(float(least))), path, c)


def compared(queries: DataFrame, path: str, least: float, id_col: str, vector_col: str = "embedding") -> int:
    """How many pairs ``within`` compares."""
    c = _centroids(queries.sparkSession, path)
    d = _compared(_asked(queries, id_col, vector_col, c.shape[1]).withColumn("_least", F.lit(float(least))), path, c, counted=True)
    return int(d.agg(F.sum("similarity")).first()[0] or 0)


def nearest(queries: DataFrame, path: str, k: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """(_q, _id, similarity, place) of the ``k`` indexed vectors that are most similar to each query, of equally similar ones the smaller id.

    The nearest lists that hold ``k`` members tell how near the k-th one is at least, and then all lists are searched for what is as near.
    """
    spark = queries.sparkSession
    c = _centroids(spark, path)
    asked = _asked(queries, id_col, vector_col, c.shape[1])
    sizes = np.zeros(len(c), np.int64)
    for row in spark.read.parquet(f"{path}/shards").groupBy("_list").count().collect():  # MOST_LISTS at most
        sizes[row["_list"]] = row["count"]
    some = _best(_compared(asked.withColumn("_least", F.lit(-1.0)), path, c, k, first=(sizes, k)), k)
    least = written(some.groupBy("_q").agg(F.min("similarity").alias("_s"), F.count(F.lit(1)).alias("_n")).select("_q", F.when(F.col("_n") >= k, F.col("_s") - 1e-9).otherwise(-1.0).alias("_least")), "least-similarities")
    return _best(_compared(asked.join(least, "_q"), path, c, k), k)


def _best(d: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_q").orderBy(F.desc(F.round("similarity", 9)), "_id")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
