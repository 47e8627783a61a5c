"""Blocks of long near copies are bounded by bytes, and links don't depend on that."""

import numpy as np
import pytest

from momentlens.llm import near_duplicates as nd


def copies(n, words, seed):
    """Texts of many words, of which each changes some of the words of the one before."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 10**9, words)
    out = []
    for _ in range(n):
        base = base.copy()
        at = rng.integers(0, words, max(1, words // 60))
        base[at] = rng.integers(0, 10**9, len(at))
        out.append(" ".join(map(str, base)))
    return out


def jaccard_components(texts):
    sets = [set(nd.shingle_set(t.encode(), nd.SHINGLE).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("tile_bytes", [1, 20_000, 16 << 20])
def test_links_by_any_tiles(spark, tile_bytes, monkeypatch):
    monkeypatch.setattr(nd, "TILE_BYTES", tile_bytes)
    texts = copies(25, 600, 1) + copies(12, 300, 2) + copies(3, 2000, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["s_component"] for r in nd.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_components(texts)


def test_bytes_of_a_block(spark, monkeypatch):
    """What one task compares is a few tiles at most, however many long copies there are."""
    monkeypatch.setattr(nd, "TILE_BYTES", 200_000)
    seen = []
    plain = nd._compared

    def watched(blocks, radius, similarity):
        if similarity is not None:
            sizes = blocks.selectExpr("block", "octet_length(s_set) AS n").groupBy("block").sum("n").collect()
            seen.append(max(r[1] for r in sizes))
        return plain(blocks, radius, similarity)

    monkeypatch.setattr(nd, "_compared", watched)
    texts = copies(60, 4000, 4)  # 32 kB of hashes each, two million bytes in all
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert nd.representatives(docs).count() == len(set(jaccard_components(texts)))
    assert seen and max(seen) < 4 * 200_000


def test_sets(spark):
    d = spark.createDataFrame([(1, "A b c d e f"), (2, None), (3, " "), (4, "a  b C d e F")], "s_node long, s_text string")
    got = {r["s_node"]: (bytes(r["s_set"]), r["s_bytes"]) for r in nd.with_sets(d).collect()}
    assert got[1] == got[4] and got[1][1] == 16 == len(got[1][0])
    assert got[2] == got[3] == (b"", 0)
