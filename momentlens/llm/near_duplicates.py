"""SimHash near-duplicates: bit-sliced comparison of fingerprints in blocks, then connected components.

Fingerprints come from whole texts. Documents that are alike in all that is compared are one node, so
copies are never paired. In a block, fingerprints stand as bit planes, one lane each; every lane is
compared with the lane d places on, for all d, by carry-save counters that add whole words of 64 lanes,
and words in which every lane exceeds the radius are abandoned. Lanes that are connected already aren't compared.
Only links that join two components go on, so that a block gives fewer links than members. Components come from
alternating large-star and small-star rounds.

A block of more than ``TILE`` members, or of more than ``TILE_BYTES`` where shingle sets are compared, is dealt out as tiles, each member to one of them. What the links inside of tiles leave
outside a block's largest component is then compared with all of the block, tile by tile. So a large group of near copies, which
its tiles connect, costs as much as its members, and no link is lost.

``grouped`` links by distance alone and loses none: two fingerprints within ``radius`` differing bits agree
on at least g - ``radius`` of g groups of bits, and blocks are formed by every such choice of groups; g grows with the
logarithm of the fingerprints, so that blocks of unrelated ones stay small. Fingerprints that share many bits without being alike (of short texts, of templates) make
large blocks nevertheless; such a block is split once more in the same way, by groups of the bits in which its own members differ, if that takes less work
than comparing it, and so are its parts.
``similar`` links texts whose shingle sets have a Jaccard similarity of at least ``SIMILARITY``. Sets that
alike differ in about ten of 64 bits, for which no group of bits need agree; so blocks come from bands of
min-hashes (a pair at 0.8 misses all of ``BANDS`` with 0.002), and fingerprints have ``WIDE_BITS`` bits, in which each
shingle votes once, so that ``WIDE`` differing bits tell 0.8 from less (39 expected at 0.8, with a standard deviation
of 5.7; 69 at 0.5). The bit-sliced comparison forms candidate components; in each of those it is made
once more over all members, and a pair is linked if the distinct 64-bit shingle hashes of its texts have that Jaccard
similarity exactly. Only texts of candidate components are read again for that, and only their hashes are compared, so that a task holds
two tiles of hashes and no texts.

Defined cases: a null or blank text has no shingles and fingerprint zero, which links like any other; very long texts are read whole; repeated rows and
ids get the same answer; ties resolve to the smallest id; a null id never names a component while
another id is reachable; an empty table gives an empty result; further input columns stay as they are
and those named like the operator's own (``s_*``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.common import documents, in_arrow, text_chunks, written

BITS = 64
SHINGLE = 5
RADIUS = 4
#: Members of a block that one task compares with each other.
TILE = 2048
#: Sending a member to one more block, against comparing it with a tile.
COPY = 0.02
#: How often parts of a large block are split again.
SPLITS = 3
SIMILARITY = 0.8
#: The same where shingle sets are compared, and the bytes of their hashes.
TEXT_TILE = 256
TILE_BYTES = 16 << 20
WIDE_BITS = 256
WIDE = 60
BANDS, ROWS = 12, 4
HASHES = BANDS * ROWS
_ODD = np.random.default_rng(17).integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Factors that make further hashes out of one.
_MIX = np.random.default_rng(18).integers(0, 2**63, WIDE_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted together.
_PART = 1 << 16


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all shingles, repeats included, in parts; fewer words are one shingle, none give nothing."""
    words = text.translate(_LOWER).split()
    if not words:
        return
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _PART):
        a = starts[at : min(at + _PART, n)]
        b = ends[min(at + shingle, len(words)) - 1 :][: len(a)]
        yield np.fromiter((digest(line[x:y], 42) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(parts: list[np.ndarray]) -> int:
    """Bit b is 1 if over half of the hashes have it; no hashes give 0."""
    votes, n = np.zeros(BITS, np.int64), 0
    for h in parts:
        votes += _votes(h)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The same of ``WIDE_BITS`` bits, from further hashes of distinct ones."""
    votes = np.zeros((len(_MIX), 64), np.int64)
    for at in range(0, len(hashes), _PART):
        part = hashes[at : at + _PART]
        for k, factor in enumerate(_MIX):
            mixed = (part ^ (part >> np.uint64(29))) * factor
            votes[k] += _votes(mixed ^ (mixed >> np.uint64(32)))
    return np.packbits(2 * votes.reshape(-1) > len(hashes), bitorder="little").tobytes()


def minima(hashes: np.ndarray) -> np.ndarray:
    """Smallest values of the hashes under ``HASHES`` permutations."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 2048):
        out = np.minimum(out, (high[at : at + 2048, None] * _ODD).min(axis=0))
    return out


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``s_fp``, a signed long of the 64 bits."""
    docs = docs.drop("s_fp")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text_col):
            fp = np.array([fingerprint(list(shingle_hashes(t, shingle))) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*names, "s_fp"])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("s_fp", T.LongType())]))


def signatures(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, with ``s_node`` (a hash of the shingle set), ``s_fp`` (``WIDE_BITS`` bits) and the keys ``s_bands``."""
    docs = docs.drop("s_node", "s_fp", "s_bands")
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text_col):
            node, fp, bands = [], [], []
            for t in texts:
                hashes = shingle_set(t, shingle)
                low = minima(hashes)
                node.append(xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63)
                fp.append(wide_fingerprint(hashes))
                bands.append([xxhash.xxh64_intdigest(low[ROWS * b : ROWS * (b + 1)].tobytes(), b) - 2**63 for b in range(BANDS)])
            added = [pa.array(node, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *added], names=[*names, "s_node", "s_fp", "s_bands"])

    added = [T.StructField("s_node", T.LongType()), T.StructField("s_fp", T.BinaryType()), T.StructField("s_bands", T.ArrayType(T.LongType()))]
    return in_arrow(docs, run, T.StructType([*(f for f in docs.schema.fields if f.name != text_col), *added]))


def near(fps: np.ndarray, group: np.ndarray, radius: int, of: "Components | None" = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of fingerprints (of one or more 64-bit words) within ``radius`` bits in the same group; equal groups stand together.

    With ``of``, pairs that it has joined meanwhile are left out.
    """
    n, fps = len(fps), fps.reshape(len(fps), -1)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    last = np.repeat(starts + sizes - 1, sizes)  # of each lane's group
    width = n + (-n) % 64 + 64
    planes = []
    for word in fps.T:
        bits = np.zeros((BITS, width), bool)
        for b in range(BITS):
            bits[b, :n] = word >> np.uint64(b) & np.uint64(1)
        planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    planes = np.concatenate(planes) if planes else np.zeros((0, width // 64), np.uint64)
    lanes = np.arange(n)
    for d in range(1, int(sizes.max(initial=1))):
        lanes = lanes[lanes + d <= last[lanes]]
        apart = lanes
        if of is not None:
            if d & (d - 1) == 0:  # now and then, groups that are one component are left
                whole = np.repeat(np.minimum.reduceat(of.label, starts) == np.maximum.reduceat(of.label, starts), sizes)
                lanes = lanes[~whole[lanes]]
            apart = lanes[of.label[lanes] != of.label[lanes + d]]
        if not len(lanes):
            return
        if not len(apart):
            continue
        open_ = np.zeros(width, bool)
        open_[apart] = True
        mask = np.packbits(open_, bitorder="little").view(np.uint64)
        at = np.flatnonzero(mask)
        mask = mask[at]
        counter = np.zeros((int(radius).bit_length() + 1, len(at)), np.uint64)  # a plane for each binary digit
        over = np.zeros(len(at), np.uint64)
        jump, shift = d >> 6, np.uint64(d & 63)
        for b in range(0, len(planes), 2):
            right = np.minimum(at + jump, planes.shape[1] - 1), np.minimum(at + jump + 1, planes.shape[1] - 1)
            x, y = (planes[k, at] ^ (planes[k, right[0]] >> shift | (planes[k, right[1]] << (np.uint64(64) - shift) if shift else np.uint64(0))) for k in (b, b + 1))
            # carry-save: three bits of weight one become one of weight one and one of weight two
            ones = counter[0]
            carry = (ones & x) | (ones & y) | (x & y)
            counter[0] = ones ^ x ^ y
            for plane in counter[1:]:
                plane[:], carry = plane ^ carry, plane & carry
            over |= carry
            if b % 8 == 6:
                mask &= ~(over | _exceeds(counter, radius))
                alive = np.flatnonzero(mask)
                if len(alive) < len(at):
                    at, mask, over, counter = at[alive], mask[alive], over[alive], counter[:, alive]
                if not len(at):
                    break
        if len(at):
            hit = np.unpackbits(mask.view(np.uint8), bitorder="little").reshape(-1, 64)
            word, bit = np.nonzero(hit)
            i = at[word] * 64 + bit
            yield i, i + d


def _exceeds(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counters are above ``radius``, compared from the highest digit."""
    above, same = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            above |= same & counter[k]
            same &= ~counter[k]
    return above


class Components:
    """Union-find over the places of an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def joined(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """The links that join two components, in turn."""
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            # each component's smallest neighbour takes it over; every link used joins two components
            best = np.full(len(self.label), len(self.label))
            np.minimum.at(best, high, low)
            used = np.flatnonzero(best[high] == low)
            _, once = np.unique(high[used], return_index=True)
            for k in used[once]:
                yield int(i[k]), int(j[k])
            parent = np.arange(len(self.label))
            took = best < len(self.label)
            parent[took] = best[took]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]


def _groups(radius: int, n: int, tile: int) -> list[tuple[int, ...]]:
    """Masks of the bits that a block shares: each choice of g - radius out of g groups of bits; g is least so that blocks of ``n`` unrelated fingerprints fit a tile."""
    g = radius + 2
    while g < radius + 5 and n >> (BITS * (g - radius) // g) > tile:
        g += 1
    cuts = np.array_split(np.arange(BITS), g)
    return [tuple(int(x) for x in np.concatenate(some)) for some in combinations(cuts, g - radius)]


def _signed(bits: tuple[int, ...]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _confirmed(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float, of: Components) -> Iterator[tuple[int, int]]:
    """The pairs whose sets have a Jaccard similarity of ``similarity`` or more; those that are joined meanwhile aren't compared."""
    sizes = np.array([len(x) for x in sets])
    close = np.minimum(sizes[i], sizes[j]) + 1e-9 >= similarity * np.maximum(sizes[i], sizes[j])
    i, j = i[close], j[close]
    for at in range(0, len(i), 64):
        a, b = i[at : at + 64], j[at : at + 64]
        apart = of.label[a] != of.label[b]
        a, b = a[apart], b[apart]
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        alike = common + 1e-9 >= similarity * (sizes[a] + sizes[b] - common)
        yield from of.joined(a[alike], b[alike])


def with_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``texts`` with ``s_set`` in place of ``s_text``: the distinct hashes of its shingles in order, eight bytes each, and ``s_bytes``."""
    names = [c for c in texts.columns if c != "s_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in text_chunks(batches, "s_text"):
            sets = [shingle_set(t, shingle).tobytes() for t in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(sets, pa.binary()), pa.array(list(map(len, sets)), pa.int64())], names=[*names, "s_set", "s_bytes"])

    return in_arrow(texts, run, T.StructType([*(texts.schema[k] for k in names), T.StructField("s_set", T.BinaryType()), T.StructField("s_bytes", T.LongType())]))


def _compared(blocks: DataFrame, radius: int, similarity: float | None) -> DataFrame:
    """Links (a, b) of nodes that connect what is linked inside of each ``block``; with ``similarity`` by the sets in ``s_set``."""
    binary = isinstance(blocks.schema["s_fp"].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come whole and in order; the last one of a batch may go on in the next."""
        held = None

        def linked(table: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
            node = table.column("s_node").to_numpy()
            fp = np.frombuffer(b"".join(table.column("s_fp").to_pylist()), np.uint64).reshape(len(node), -1) if binary else table.column("s_fp").to_numpy().view(np.uint64)
            sets = None
            of, pairs = Components(len(node)), []
            for i, j in near(fp, block, radius, of):
                if similarity is not None and sets is None:
                    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("s_set")]
                pairs.extend(of.joined(i, j) if sets is None else _confirmed(sets, i, j, similarity, of))
            if pairs:
                at = np.array(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            block = held.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield from linked(held.slice(0, cut), block[:cut])
                held = held.slice(cut)
        if held is not None:
            yield from linked(held, held.column("block").to_numpy())

    return in_arrow(blocks.repartition("block").sortWithinPartitions("block"), run, "a long, b long").distinct()


def _tiles(n: str, size: str | None, tile: int) -> Column:
    """How many tiles hold ``n`` members of ``size`` bytes."""
    by_members = F.ceil(F.col(n) / tile)
    return (by_members if size is None else F.greatest(by_members, F.ceil(F.col(size) / TILE_BYTES))).cast("int")


def _finer(n: int, ones: np.ndarray, radius: int, tile: int) -> list[tuple[int, ...]]:
    """Choices of bits that split a block of ``n`` members, ``ones`` of which have each bit; none if comparing the whole is less work.

    Two members agree in a bit with the probability p * p + q * q. Bits are dealt to groups so that agreeing is as improbable in each.
    """
    share = ones / n
    told = -np.log2(share**2 + (1 - share) ** 2)
    best, work = [], n / tile
    for g in range(radius + 2, radius + 6):
        groups, sums = [[] for _ in range(g)], np.zeros(g)
        for b in np.argsort(-told, kind="stable"):
            if told[b] > 0:
                k = int(sums.argmin())
                groups[k].append(int(b))
                sums[k] += told[b]
        choices = list(combinations(range(g), g - radius))
        its = sum(COPY + n * 2.0 ** -sums[list(c)].sum() / tile for c in choices)
        if its < work:
            best, work = [tuple(b for k in c for b in groups[k]) for c in choices], its
    return best


def _split(keyed: DataFrame, large: DataFrame, radius: int, tile: int) -> tuple[DataFrame, DataFrame, bool]:
    """``keyed`` and its ``large`` blocks, with those large blocks whose members differ in many bits split by choices of groups of these bits; and whether any was."""
    ones = F.array(*[F.sum(F.getbit("s_fp", F.lit(b)).cast("long")) for b in range(BITS)])
    bits = keyed.join(large.select("key"), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[_signed(m) for m in _finer(n, np.array(of), radius, tile)] for n, of in zip(batch.column("n").to_pylist(), batch.column("ones").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["key", "masks"])

    masks = written(in_arrow(bits, run, "key long, masks array<long>").where(F.size("masks") > 0), "finer-blocks")
    if masks.isEmpty():
        return keyed, large, False
    own = lambda d: d.withColumn("key", F.when(F.col("m").isNull(), F.col("key")).otherwise(F.xxhash64("key", "m", F.col("s_fp").bitwiseAND(F.col("m"))))).select(*keyed.columns)
    split = own(keyed.join(masks, "key").withColumn("m", F.explode("masks")))
    counts = split.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", _tiles("n", None, tile).alias("tiles")).where("tiles > 1")
    return own(keyed.join(masks, "key", "left").withColumn("m", F.explode_outer("masks"))), written(large.join(masks, "key", "left_anti").unionByName(counts), "large-blocks"), True


def _linked(keyed: DataFrame, radius: int, tile: int, similarity: float | None = None) -> DataFrame:
    """Links (a, b) of nodes in ``keyed`` (key, s_node, s_fp and, with ``similarity``, s_set and s_bytes) that connect all that are linked in a block."""
    weighed = similarity is not None
    own_size = [F.sum("s_bytes").alias("size")] if weighed else []
    weight = ["s_bytes"] if weighed else []
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *own_size)
    large = written(counts.select("key", _tiles("n", "size" if weighed else None, tile).alias("tiles")).where("tiles > 1"), "large-blocks")
    for _ in range(SPLITS if isinstance(keyed.schema["s_fp"].dataType, T.LongType) else 0):
        if large.isEmpty():
            break
        keyed, large, more = _split(keyed, large, radius, tile)
        if not more:
            break
    dealt = keyed.join(large, "key", "left")
    own = F.pmod(F.xxhash64("s_node"), F.coalesce("tiles", F.lit(1)))
    inside = _compared(dealt.withColumn("block", F.xxhash64("key", own)).drop("key", "tiles", *weight), radius, similarity)
    if large.isEmpty():
        return inside
    inside = written(inside, "tile-links")
    roots = components(inside)
    hot = keyed.select("key", "s_node", *weight).join(large, "key").join(roots, F.col("s_node") == F.col("node"), "left").select("key", "tiles", "s_node", *weight, F.coalesce("root", "s_node").alias("root"))
    hot = written(hot, "large-block-members")
    most = hot.groupBy("key", "root").agg(F.count(F.lit(1)).alias("of_root")).groupBy("key").agg(F.max_by("root", F.struct("of_root", "root")).alias("main"))
    rest = written(hot.join(most, "key").where("root != main").select("key", "tiles", "s_node", *weight), "rest-of-large-blocks")
    if rest.isEmpty():
        return inside
    size = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("tiles").alias("tiles"), *own_size)
    size = written(size.select("key", "tiles", _tiles("n", "size" if weighed else None, tile).alias("rests")), "large-block-sizes")
    number = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    members = keyed.join(size, "key")
    spot = lambda k: F.pmod(F.xxhash64("s_node", F.lit(1)), F.col(k)).cast("int")
    all_ = members.withColumns({"x": spot("tiles"), "y": F.explode(number("rests"))})
    few = members.join(rest.select("key", "s_node"), ["key", "s_node"], "left_semi").withColumns({"x": F.explode(number("tiles")), "y": spot("rests")})
    pairs = all_.unionByName(few.select(all_.columns)).withColumn("block", F.xxhash64("key", "x", "y", F.lit(2))).drop("key", "tiles", "rests", "x", "y", *weight)
    return inside.union(_compared(pairs, radius, similarity)).distinct()


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, n: int = 0) -> DataFrame:
    """Links (a, b) between distinct ``s_fp``, about ``n``, that connect all fingerprints within ``radius`` of each other."""
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6")
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(_groups(radius, n, tile))])
    keyed = fps.select("s_fp", F.explode(masks).alias("g"))
    return _linked(keyed.select(F.xxhash64("g.k", F.col("s_fp").bitwiseAND(F.col("g.m"))).alias("key"), F.col("s_fp").alias("s_node"), "s_fp"), radius, tile)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); root: the smallest node reachable. Star contraction in rounds."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: every greater neighbour of u goes to the smallest of u and its neighbours
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: u and every smaller neighbour go to the smallest one
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        small = written(small, "small-star")
        before, after = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, small))
        edges = small
        if before == after:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _components_of(d: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """``d`` (with ``s_node``) with ``s_component``, the smallest id that ``edges`` between nodes reach."""
    nodes = d.groupBy("s_node").agg(F.min(id_col).alias("s_min"))
    roots = components(edges)
    linked = nodes.join(roots, nodes["s_node"] == roots["node"], "left").select("s_node", "s_min", F.coalesce("root", "s_node").alias("s_root"))
    # written, so that the join below has exchanges of its own, whose large partitions Spark can split
    smallest = written(linked.groupBy("s_root").agg(F.min("s_min").alias("s_component")), "components")
    return d.join(linked.join(smallest, "s_root").select("s_node", "s_component"), "s_node")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the text, with ``s_fp`` and ``s_component``: fingerprints within ``radius`` bits are linked."""
    d = written(fingerprints(docs, text_col, shingle).drop(text_col, "s_component").withColumn("s_node", F.col("s_fp")), "fingerprints")
    fps = written(d.select("s_fp").distinct(), "distinct-fingerprints")
    return _components_of(d, links(fps, radius, n=fps.count()), id_col)


def _exact_links(docs: DataFrame, d: DataFrame, text_col: str, shingle: int, similarity: float, tile: int) -> DataFrame:
    """Links between the nodes of ``d``, signatures of ``docs`` with ``s_hash`` of each text."""
    nodes = written(d.groupBy("s_node").agg(F.first("s_fp").alias("s_fp"), F.first("s_bands").alias("s_bands"), F.min("s_hash").alias("s_hash")), "nodes")
    roots = components(_linked(nodes.select(F.explode(F.array_distinct("s_bands")).alias("key"), "s_node", "s_fp"), WIDE, TILE))
    members = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct().select(F.col("node").alias("s_node"), F.col("root").alias("key"))
    members = nodes.select("s_node", "s_fp", "s_hash").join(members, "s_node")
    # one text of each node; equal texts meet in each task before they are shuffled
    texts = docs.select(F.xxhash64(text_col).alias("s_hash"), F.col(text_col).alias("s_text")).dropDuplicates(["s_hash"])
    # written, so that texts are dealt out once and not for the sizes of components again
    candidates = written(with_sets(members.join(texts, "s_hash").drop("s_hash"), shingle), "candidates")
    return _linked(candidates, WIDE, tile, similarity)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TEXT_TILE) -> DataFrame:
    """``docs`` without the text, with ``s_hash`` of it and ``s_component``: shingle sets of a similarity of ``similarity`` or more are linked."""
    d = written(signatures(docs.drop("s_component").withColumn("s_hash", F.xxhash64(text_col)), text_col, shingle), "signatures")
    return _components_of(d.drop("s_bands", "s_fp"), _exact_links(docs, d, text_col, shingle, similarity, tile), id_col)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of ``similar`` texts: that of the smallest id (none comes last), and of rows that share it, that of the smallest hash of its text.

    Of rows of equal ids and texts one stays; rows that share an id but not a text are judged apart.
    """
    keys = docs.select(id_col, text_col).withColumn("s_hash", F.xxhash64(text_col))
    d = written(signatures(keys, text_col, shingle), "signatures")
    roots = components(_exact_links(docs, d, text_col, shingle, similarity, TEXT_TILE))
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("s_id"), F.col("s_hash").alias("s_least")))
    nodes = d.groupBy("s_node").agg(first.alias("s_first"))  # copies meet in each task first
    nodes = nodes.join(roots, nodes["s_node"] == roots["node"], "left").select(F.coalesce("root", "s_node").alias("s_root"), "s_first")
    chosen = written(nodes.groupBy("s_root").agg(F.min("s_first").alias("s_first")).select("s_first.s_id", "s_first.s_least"), "chosen")
    one = docs.withColumn("s_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "s_hash"])
    return one.join(chosen, F.col(id_col).eqNullSafe(F.col("s_id")) & F.col("s_hash").eqNullSafe(F.col("s_least")), "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: each document's fingerprint and the smallest id of its component."""
    d = grouped(documents(spark, sf_dir).select("doc_id", "text"), shingle=4, radius=4)
    return d.select("doc_id", F.lower(F.lpad(F.hex("s_fp"), 16, "0")).alias("fingerprint"), F.col("s_component").alias("component_id"))
