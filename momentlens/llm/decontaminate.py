"""Benchmark decontamination: an FM-index per shard of training text, searched for benchmark windows.

A shard is a bounded slice of documents, turned into word numbers. Words that no benchmark item has are
unique separators, so runs of them shrink to one. The suffix array comes from prefix doubling, its
Burrows-Wheeler transform is kept as a wavelet matrix, windows are found by backward search through its
ranks, and occurrences are located by walking back to sampled suffix positions. Overlapping occurrences
merge into removal spans. Nothing is shuffled. The benchmark's texts go to the tasks in blocks of ``BLOCK_BYTES`` and at most one item more,
one pass over the documents each, and one is held at a time; each worker process makes windows of a block once.

Defined cases: null and blank texts have no words and no hits; an item without words has no window; an
item of fewer words than a window is one window; items that share a window all count; repeated documents
are judged row by row; repeated items count once by their id; items without an id are searched and count as one item, which no list of ids shows;
very long texts are indexed whole, in pieces that overlap; empty tables give no rows or no hits.
Input columns named like the operator's own (``d_*``) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.common import documents, in_arrow, text_chunks, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words of one index; longer texts are indexed in pieces that overlap by a window.
SHARD_WORDS = 1_500_000
SAMPLE = 16
#: A-Z to a-z, and every byte that is no part of a word to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _in_order(items: set[str | None]) -> list[str | None]:
    """Items by id; without one last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


class Windows:
    """The distinct windows of some items, as word numbers from 1."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.length = np.array([len(k) for k in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for row, k in zip(self.symbols, found, strict=True):
            row[: len(k)] = k
        self.items = [_in_order(v) for v in found.values()]


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Of numbers 0..sigma, where each 0 is a separator of its own, smaller than all words; 0 ends the text."""
    m, zero = len(text), text == 0
    counts = np.bincount(text, minlength=sigma + 1)
    rank = (np.cumsum(counts) - counts)[text]
    rank[zero] = np.arange(np.count_nonzero(zero))
    open_, h = np.flatnonzero(~zero & (counts[text] > 1)), 1
    while len(open_):
        key = rank[open_] * m + rank[open_ + h]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        old = key // m
        index = np.arange(len(open_))
        new_group = np.concatenate(([True], old[1:] != old[:-1]))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        rank[open_] = old + np.maximum.accumulate(np.where(new_key, index, 0)) - np.maximum.accumulate(np.where(new_group, index, 0))
        open_ = open_[~(new_key & np.concatenate((new_key[1:], [True])))]
        h *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        for shift in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            bit = (seq >> shift & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bool))), bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            zeros = len(bit) - int(np.count_nonzero(bit))
            self.levels.append((shift, packed, before, zeros))
            seq = np.concatenate((seq[~bit], seq[bit]))

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        start = np.zeros_like(at)
        for shift, packed, before, zeros in self.levels:
            a, s = self._ones(packed, before, at), self._ones(packed, before, start)
            one = (symbol >> shift & 1).astype(bool)
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + s, start - s)
        return at - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``at`` and how often it stands before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for shift, packed, before, zeros in self.levels:
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, s = self._ones(packed, before, at), self._ones(packed, before, start)
            symbol |= one.astype(np.int64) << shift
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + s, start - s)
        return symbol, at - start


class Shard:
    """The FM-index of a text of word numbers that ends in 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        sa = suffix_array(text, sigma)
        counts = np.bincount(text, minlength=sigma + 1)
        self.first = np.cumsum(counts) - counts
        self.ranks = WaveletMatrix(text[sa - 1], sigma)
        # sampled: every SAMPLE-th position, and all behind a separator, which are never stepped over
        self.sampled = (sa % SAMPLE == 0) | (text[sa - 1] == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.position = sa[self.sampled]
        self.size = len(text)

    def find(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all occurrences, and the windows they are of."""
        at = np.arange(len(windows.length))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size, np.int64)
        for step in range(windows.symbols.shape[1]):
            more = windows.length[at] > step
            c = windows.symbols[at[more], windows.length[at[more]] - 1 - step]
            low[more] = self.first[c] + self.ranks.rank(c, low[more])
            high[more] = self.first[c] + self.ranks.rank(c, high[more])
            held = low < high
            at, low, high = at[held], low[held], high[held]
        n = high - low
        window = np.repeat(at, n)
        row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        position, steps, left = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(left):
            done = self.sampled[row]
            position[left[done]] = self.position[self.place[row[done]]] + steps
            left, row = left[~done], row[~done]
            symbol, rank = self.ranks.symbol_and_rank(row)
            row, steps = self.first[symbol] + rank, steps + 1
        return position, window


def occurrences(numbers: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place of the first word and window of all occurrences in some documents."""
    sigma, found, held, total = len(windows.words), [], [], 0

    def search() -> None:
        ends = np.cumsum([len(x) + 1 for _, _, x in held])
        text = np.concatenate([y for _, _, x in held for y in (x, [0])])
        kept = np.flatnonzero((text != 0) | np.concatenate(([True], text[:-1] != 0)))
        position, window = Shard(text[kept], sigma).find(windows)
        position = kept[position]
        piece = np.searchsorted(ends, position, side="right")
        starts = ends - [len(x) + 1 for _, _, x in held]
        doc, offset = np.array([(d, o) for d, o, _ in held], np.int64).T
        found.append((doc[piece], position - starts[piece] + offset[piece], window))

    for doc, ids in enumerate(numbers):
        step = SHARD_WORDS - windows.symbols.shape[1]
        for start in range(0, max(1, len(ids)), step):
            piece = ids[start : start + SHARD_WORDS]
            if total + len(piece) > SHARD_WORDS and held:
                search()
                held, total = [], 0
            if piece.any():
                held.append((doc, start, piece))
                total += len(piece)
    if held:
        search()
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty, empty)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ADDED = T.StructType(
    [
        T.StructField("d_n_words", T.LongType()),
        T.StructField("d_words", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("d_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("d_items", T.ArrayType(T.StringType())),
    ]
)


@lru_cache(maxsize=1)
def _windows(items: tuple[tuple[str | None, str], ...], window: int) -> Windows:
    """One for each worker process and block."""
    return Windows([(item, text.encode()) for item, text in items], window)


def _searcher(shared: Broadcast, window: int, names: list[str], text_col: str, found_before: bool):
    lists = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared.value, window)
        get = windows.words.get
        for batch, texts in text_chunks(batches, text_col):
            numbers = [np.array([get(w, 0) for w in words_of(t)], np.int64) for t in texts]
            doc, place, found = occurrences(numbers, windows)
            words = batch.column("d_words").to_pylist() if found_before else [[] for _ in texts]
            items = [set(x) for x in batch.column("d_items").to_pylist()] if found_before else [set() for _ in texts]
            spans = batch.column("d_spans").to_pylist() if found_before else [[] for _ in texts]
            order = np.lexsort((place, doc))
            doc, place, found = doc[order], place[order], found[order]
            for d in np.unique(doc):
                a, b = np.searchsorted(doc, [d, d + 1])
                words[d] = merged([*map(tuple, words[d]), *zip(place[a:b].tolist(), (place[a:b] + windows.length[found[a:b]]).tolist(), strict=True)])
                for w in np.unique(found[a:b]):
                    items[d].update(windows.items[w])
                at = [m.span() for m in _WORD.finditer(texts[d].decode(errors="surrogateescape"))]
                spans[d] = [(at[x][0], at[y - 1][1]) for x, y in words[d]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in names), pa.array([len(x) for x in numbers], pa.int64()), pa.array(words, lists), pa.array(spans, lists), pa.array([_in_order(x) for x in items], pa.list_(pa.string()))],
                names=[*names, *_ADDED.names],
            )

    return run


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``d_n_words``, ``d_words`` and ``d_spans`` (merged hits in words and in code points) and ``d_items``."""
    docs = docs.drop(*_ADDED.names)
    names = docs.columns
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    d = docs
    for k in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(tuple((r["item"], r["text"]) for r in items.where(block == k).toLocalIterator()))
        d = in_arrow(d, _searcher(shared, window, names, text_col, k > 0), T.StructType([*docs.schema.fields, *_ADDED.fields]))
        if k + 1 < blocks:  # a pass of its own, so that no task holds two blocks
            d = written(d, "scanned")
    return d


def removed(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the found passages; documents of which no word is left go, others keep all else."""
    d = scan(docs, benchmark, text_col)
    bounds = F.array_sort(F.flatten("d_spans"))
    ends = F.concat(F.array(F.lit(0)), bounds, F.array(F.length(text_col)))
    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size("d_spans")), lambda i: F.substring(F.col(text_col), F.get(F.col("d_ends"), 2 * i) + 1, F.get(F.col("d_ends"), 2 * i + 1) - F.get(F.col("d_ends"), 2 * i))), "")
    hit = F.size("d_spans") > 0
    n_hit = F.aggregate("d_words", F.lit(0).cast("long"), lambda s, x: s + F.get(x, 1) - F.get(x, 0))
    d = d.where(~hit | (n_hit < F.col("d_n_words"))).withColumn("d_ends", F.when(hit, ends))
    return d.withColumn(text_col, F.when(hit, left).otherwise(F.col(text_col))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the words of each document that benchmark windows cover, and the items they are of."""
    d = scan(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("d_words", F.lit(0).cast("long"), lambda s, x: s + F.get(x, 1) - F.get(x, 0))
    return d.select(
        "doc_id", F.col("d_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("d_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("d_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), 10) AS k, ws[i:i+9] AS win FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM w),
g AS (SELECT r, i, k, ws[i:i+k-1] AS win FROM d, ks, unnest(range(1, len(ws) - k + 2)) AS u(i) WHERE len(ws) >= k),
h AS (SELECT g.r, g.i, g.k, w.item FROM g JOIN w ON g.k = w.k AND g.win = w.win),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, k)) AS o(j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
