"""Merkle manifest of a dataset: one digest for all rows, and for each row the path that leads to it.

A row's leaf is the SHA-256 of its fields, each with its length in bytes. Within a group (a source) leaves stand
in order of their id, and runs of ``FAN`` nodes become their parent until one node is left, the group's subroot; subroots, by
group, make the root in the same way. Each level is a window: rows are partitioned by group and parent, and the ordered
whole frame's list is the parent's preimage and has the siblings of each of its nodes. Of each run one row goes on, so the next
level has a sixteenth of the rows. Paths come down by joins of nodes with their parents, at most ``FAN`` to one.

A group of any size is spread: rows are numbered in ranges of (group, id), whose counts alone meet for a group, and runs
of sixteen are dealt out by their number. Texts are hashed where they are read and never shuffled.

Defined cases: a null field is ``-``, which no value gives; a null group is a group of its own, the first; null ids stand
first in their group; rows that share an id stand in order of their leaves, so equal rows may be exchanged
without any effect; very long texts are hashed whole; an empty table has no root and gives no rows; further input columns aren't
part of leaves, and those named like the operator's own (``m_*``) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentlens.llm.common import documents, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of some fields, in hexadecimal digits."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(d: DataFrame, order: Sequence[str]) -> DataFrame:
    """``d`` with ``m_pos``, the place from 0 in its ``m_group`` in some order, and ``m_n``, the group's rows."""
    # what is equal in all of the order is dealt out by chance, so that no range holds more than the others
    ranged = d.withColumn("m_tie", F.rand(7)).repartitionByRange("m_group", *order, "m_tie").withColumn("m_range", F.spark_partition_id()).drop("m_tie")
    ranged = written(ranged, "merkle-ranges")
    of_group = Window.partitionBy("m_group")
    before = F.sum("m_in").over(of_group.orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy("m_group", "m_range").agg(F.count(F.lit(1)).alias("m_in"))
    counts = counts.select("m_group", "m_range", F.coalesce(before, F.lit(0)).alias("m_before"), F.sum("m_in").over(of_group).alias("m_n"))
    own = Window.partitionBy("m_group", "m_range").orderBy(*order)
    d = ranged.join(counts, ["m_group", "m_range"]).withColumn("m_pos", F.col("m_before") + F.row_number().over(own) - 1)
    return written(d.drop("m_range", "m_before"), "merkle-places")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The parents of ``nodes`` (m_group, m_pos, m_n, m_digest), their parents and so on, with their ``m_children``; groups of one node have none."""
    found = []
    most = nodes.agg(F.max("m_n")).first()[0] or 0
    while most > 1:
        run = Window.partitionBy("m_group", "m_parent").orderBy("m_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = nodes.where("m_n > 1").select("m_group", _parent().alias("m_parent"), "m_pos", "m_n", "m_digest")
        d = d.withColumn("m_children", F.collect_list("m_digest").over(run)).where(F.col("m_pos") % FAN == 0)
        parents = d.select("m_group", F.col("m_parent").alias("m_pos"), F.ceil(F.col("m_n") / FAN).cast("long").alias("m_n"), F.sha2(F.array_join("m_children", ""), 256).alias("m_digest"), "m_children")
        nodes = written(parents, "merkle-level")
        found.append(nodes)
        most = -(-most // FAN)
    return found


def _parent() -> Column:
    return F.floor(F.col("m_pos") / FAN).cast("long")


def tops(nodes: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """(m_group, m_digest) of the node that is left of each group."""
    alone = [x.where("m_n = 1").select("m_group", "m_digest") for x in (nodes, *parents)]
    out = alone[0]
    for x in alone[1:]:
        out = out.unionByName(x)
    return out


def _with_paths(nodes: DataFrame, parents: list[DataFrame], above: DataFrame) -> DataFrame:
    """``nodes`` with the columns of ``above`` (of each group: m_group, m_path, ...), where ``m_path`` has got the siblings on the way to the group's top, lowest first."""
    carried = [c for c in above.columns if c not in ("m_group", "m_path")]

    def down(d: DataFrame, up: DataFrame | None) -> DataFrame:
        top = d.where("m_n = 1").join(above, "m_group")
        if up is None:
            return top
        up = up.select("m_group", F.col("m_pos").alias("m_parent"), F.col("m_children").alias("m_run"), F.col("m_path").alias("m_up"), *carried)
        at = (F.col("m_pos") % FAN).cast("int")
        own = F.struct(F.array_join(F.slice("m_run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("m_run", at + 2, F.lit(FAN)), "").alias("after"))
        inner = d.where("m_n > 1").withColumn("m_parent", _parent()).join(up, ["m_group", "m_parent"])
        inner = inner.withColumn("m_path", F.concat(F.array(own), F.col("m_up"))).drop("m_parent", "m_run", "m_up")
        return top.unionByName(inner)

    up = None
    for level in reversed(parents):
        up = down(level, up)
    return down(nodes, up)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "source", id_col: str = "doc_id", carried: Mapping[str, Column] | None = None) -> DataFrame:
    """For each row its id as ``m_id``, ``m_leaf``, ``m_path``, ``m_subroot``, ``m_root``, and what ``carried`` names, made of the row's columns where it is read.

    ``m_path`` has for each level, the lowest first, the joined digests of the siblings ``before`` and ``after``.
    """
    carried = dict(carried or {})
    group = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))  # in order of bytes, null first
    d = docs.select(group.alias("m_group"), F.col(id_col).alias("m_id"), leaf([F.col(c) for c in fields]).alias("m_digest"), *[c.alias(k) for k, c in carried.items()])
    d = numbered(d, ["m_id", "m_digest"])
    parents = levels(d)
    subroots = numbered(tops(d, parents).select(F.lit("").alias("m_group"), F.col("m_group").alias("m_key"), "m_digest"), ["m_key"])
    over = levels(subroots)
    root = tops(subroots, over).first()
    none = F.array().cast("array<struct<before:string,after:string>>")
    top = docs.sparkSession.range(1).select(F.lit("").alias("m_group"), none.alias("m_path"), F.lit(root and root["m_digest"]).cast("string").alias("m_root"))
    above = _with_paths(subroots, over, top).select(F.col("m_key").alias("m_group"), "m_path", F.col("m_digest").alias("m_subroot"), "m_root")
    return _with_paths(d, parents, above).select("m_id", F.col("m_digest").alias("m_leaf"), "m_path", "m_subroot", "m_root", *carried)


def proof(path: str = "m_path") -> Column:
    """All siblings on a path, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(digest: Column, path: str = "m_path") -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: each document's leaf, roots and proof, and whether its text, lower-cased in every fifth document, still gives the root."""
    docs = documents(spark, sf_dir).select(*FIELDS)
    lower = F.translate("text", _UPPER, _LOWER)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf([*map(F.col, FIELDS[:-1]), lower]))
    d = manifest(docs, carried={"m_changed": changed}).withColumn("folded_root", folded(F.coalesce("m_changed", "m_leaf")))
    return d.select(
        F.col("m_id").alias("doc_id"), F.col("m_leaf").alias("leaf"), F.col("m_subroot").alias("subroot"), F.col("m_root").alias("root"),
        F.sha2(proof(), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("m_root")).alias("verified"),
    )


def _sql_field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_levels(leaves: str, name: str) -> str:
    """``name`` (lv, g, pos, n, d): all nodes over ``leaves`` (g, pos, n, d)."""
    return f"""{name} AS (SELECT 0 AS lv, g, pos, n, d FROM {leaves}
  UNION ALL SELECT lv + 1, g, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lv, g, pos // 16, n)"""


def _sql_siblings(nodes: str, leaves: str, name: str) -> str:
    """``name`` (g, pos, lv, b, a): of each leaf and level that isn't its group's top, the joined siblings before and after."""
    return f"""{name} AS (SELECT l.g, l.pos, s.lv, coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos < l.pos // (16 ** s.lv)::BIGINT), '') AS b, coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos > l.pos // (16 ** s.lv)::BIGINT), '') AS a
  FROM {leaves} l JOIN {nodes} s ON s.g = l.g AND s.n > 1 AND s.pos // 16 = l.pos // (16 ** (s.lv + 1))::BIGINT GROUP BY 1, 2, 3)"""


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_HEAD = " || ".join(map(_sql_field, FIELDS[:-1]))
ORACLE = f"""
WITH RECURSIVE raw AS (SELECT coalesce('+' || source, '') AS g, doc_id, sha256({_HEAD} || {_sql_field('text')}) AS d,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_HEAD} || {_sql_field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS t FROM documents),
l0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, d, t, doc_id FROM raw),
{_sql_levels("l0", "nod")},
s0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d, g AS k FROM nod WHERE n = 1),
{_sql_levels("s0", "top")},
{_sql_siblings("nod", "l0", "sib")},
{_sql_siblings("top", "s0", "above")},
path AS (SELECT g, pos, list(struct_pack(b := b, a := a) ORDER BY lv) AS p FROM sib GROUP BY 1, 2),
up AS (SELECT s0.k AS g, s0.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, coalesce((SELECT list(struct_pack(b := b, a := a) ORDER BY lv) FROM above WHERE above.pos = s0.pos), []) AS p FROM s0),
every AS (SELECT l0.*, subroot, root, list_concat(coalesce(path.p, []), up.p) AS p FROM l0 JOIN up USING (g) LEFT JOIN path ON path.g = l0.g AND path.pos = l0.pos),
fold AS (SELECT *, list_reduce(list_prepend({{'b': coalesce(t, d), 'a': ''}}, p), lambda x, s: {{'b': sha256(s.b || x.b || s.a), 'a': ''}}).b AS folded_root FROM every)
SELECT doc_id, d AS leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s.b || s.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fold
"""
