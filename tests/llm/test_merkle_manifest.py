"""Merkle manifests against a plain tree, proofs and tampering."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from momentlens.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The last node, and for each first node its (before, after) on the way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            run, i = nodes[at[k] // 16 * 16 : at[k] // 16 * 16 + 16], at[k] % 16
            p.append(("".join(run[:i]), "".join(run[i + 1 :])))
            at[k] //= 16
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = []
    for g in sorted(groups):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    if not trees:
        return []
    root, above = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), up in zip(trees, above, strict=True):
        for r, p in zip(own, paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            d = leaf((*r[:4], r[4] and r[4].translate(LOWER))) if changed else leaf(r)
            for a, b in (*p, *up):
                d = digest(a, d, b)
            out.append((r[0], leaf(r), subroot, root, digest(*[a + b for a, b in (*p, *up)]), d, d == root))
    return sorted(map(repr, out))


def as_query(spark, rows, parts=6):
    path = f"/tmp/momentlens-merkle-{random.getrandbits(60)}"
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{path}/documents.parquet")
    return sorted(repr(tuple(r)) for r in mm.query(spark, path).collect())


def test_sizes_of_groups(spark):
    """Groups of 1, of whole and cut runs, of three levels, and more groups than one run."""
    rng, rows, i = random.Random(2), [], 0
    for g, n in enumerate([1, 2, 15, 16, 17, 33, 256, 257, 600, *[1] * 20]):
        for _ in range(n):
            i += rng.randint(1, 3)
            rows.append((i, f"src{g}é", rng.choice(("en", None)), i % 7, f"Text Ä {i}"))
    rng.shuffle(rows)
    assert as_query(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (1, None, "", 0, ""), (1, None, "", 0, "other"), (2, "", "en", 3, "A" * 300_000), (-3, "-", None, -1, "-"), (3, "+", "x", 1, "1:a"), (4, "Ω", "x", 1, None), (5, "z", "x", 1, "Z")]
    assert as_query(spark, rows) == plain(rows)
    assert as_query(spark, []) == []
    assert as_query(spark, rows[3:4]) == plain(rows[3:4])  # a lone leaf is the root


def test_many_equal_rows(spark):
    rows = [(7, "src", "en", 1, "Same")] * 300 + [(i, "src", "en", 1, "Other") for i in range(40)]
    assert as_query(spark, rows) == plain(rows)


def test_hot_group_is_spread(spark):
    docs = spark.range(20_000, numPartitions=8).selectExpr("id AS doc_id", "if(id % 10 < 8, 'hot', 'cold') AS source", "'en' AS lang", "id AS n_chars", "cast(id AS string) AS text")
    d = mm.numbered(docs.select(F.col("source").alias("m_group"), F.col("doc_id").alias("m_id"), mm.leaf([F.col(c) for c in mm.FIELDS]).alias("m_digest")), ["m_id", "m_digest"])
    got = d.groupBy("m_group").agg(F.count(F.lit(1)).alias("n"), F.max("m_n").alias("m"), F.countDistinct("m_pos").alias("p"), F.max("m_pos").alias("last")).collect()
    assert sorted(tuple(r) for r in got) == [("cold", 4000, 4000, 4000, 3999), ("hot", 16000, 16000, 16000, 15999)]
    w = d.orderBy("m_group", "m_id").select("m_group", "m_id", "m_pos").collect()
    assert all(b["m_pos"] == a["m_pos"] + 1 for a, b in zip(w, w[1:], strict=False) if a["m_group"] == b["m_group"])


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"text {i}") for i in range(100)], SCHEMA)
    kept = mm.manifest(docs).cache()
    later = docs.withColumn("text", F.when(F.col("doc_id") == 42, "forged").otherwise(F.col("text")))
    checked = later.withColumn("now", mm.leaf([F.col(c) for c in mm.FIELDS])).join(kept, F.col("doc_id") == F.col("m_id"))
    assert [r["doc_id"] for r in checked.where(mm.folded(F.col("now")) != F.col("m_root")).collect()] == [42]
    kept.unpersist()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "t", i, "x") for i in range(20)], SCHEMA + ", m_pos int, m_group string")
    assert mm.manifest(docs).where(mm.folded(F.col("m_leaf")) == F.col("m_root")).count() == 20
