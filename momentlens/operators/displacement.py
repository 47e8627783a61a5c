"""Motion between frames by displacement: blocks of a frame are looked for in the frame before, from coarse to fine.

Frames are arrays of brightness, row by row. Both frames are halved ``levels`` - 1 times; on the coarsest level each block is compared with all
places up to ``reach`` away, and each finer level doubles the displacement and looks one place around. A block goes where the sum of
absolute differences is least, of equal ones to the shortest displacement; places outside of the frame before aren't considered. The value of a frame is
the mean length of its blocks' displacements in pixels.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# workers get these functions by value, so they needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Places of an asset that one task orders, and frames that are compared at once.
BLOCK, FRAMES = 4096, 64


def with_before(frames: DataFrame, key: str, idx: str, pixels: str, block: int = BLOCK) -> DataFrame:
    """``frames`` with ``_before``, the pixels of the sampled frame before, null for the first. Blocks also get the frame before their first one, so that a long asset spreads over tasks."""
    own, after = F.floor(F.col(idx) / block), F.floor((F.col(idx) + 1) / block)
    d = frames.withColumn("_b", F.explode(F.array_distinct(F.array(own, after))))
    before = F.lag(pixels).over(Window.partitionBy(key, "_b").orderBy(idx))
    return d.withColumn("_before", before).where(own == F.col("_b")).drop("_b")


def halved(x: np.ndarray) -> np.ndarray:
    """Means of two by two pixels; an odd last row or column goes."""
    h, w = x.shape[1] // 2 * 2, x.shape[2] // 2 * 2
    return x[:, :h, :w].reshape(len(x), h // 2, 2, w // 2, 2).mean(axis=(2, 4))


def displacements(now: np.ndarray, before: np.ndarray, side: int, reach: int, levels: int) -> np.ndarray:
    """(frames, block rows, block columns, 2): how far down and right each block of ``now`` lies in ``before``. Blocks have ``side`` pixels on the coarsest level and twice that on each finer one, so that they are the same blocks."""
    pyramid = [(now, before)]
    for _ in range(levels - 1):
        pyramid.append(tuple(map(halved, pyramid[-1])))
    rows, columns = pyramid[-1][0].shape[1] // side, pyramid[-1][0].shape[2] // side
    moved = np.zeros((len(now), rows, columns, 2), np.int64)
    ring = lambda r: sorted(((y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)), key=lambda p: (p[0] ** 2 + p[1] ** 2, p))
    for level in range(levels - 1, -1, -1):
        a, b = pyramid[level]
        size = side << (levels - 1 - level)
        moved *= 1 if level == levels - 1 else 2
        best, chosen, length = np.full(moved.shape[:3], np.inf), moved.copy(), np.full(moved.shape[:3], np.inf)
        inner = np.arange(size)
        y0, x0 = np.arange(rows)[:, None] * size, np.arange(columns)[None, :] * size
        block = a[:, : rows * size, : columns * size].reshape(len(a), rows, size, columns, size).transpose(0, 1, 3, 2, 4)
        for dy, dx in ring(reach if level == levels - 1 else 1):
            to = moved + (dy, dx)
            y, x = y0 + to[..., 0], x0 + to[..., 1]
            inside = (y >= 0) & (x >= 0) & (y + size <= b.shape[1]) & (x + size <= b.shape[2])
            ys, xs = np.where(inside, y, 0)[..., None, None] + inner[:, None], np.where(inside, x, 0)[..., None, None] + inner
            off = np.abs(block - b[np.arange(len(b))[:, None, None, None, None], ys, xs]).sum(axis=(3, 4))
            far = (to**2).sum(axis=3)
            better = inside & ((off < best) | ((off == best) & (far < length)))
            best, length = np.where(better, off, best), np.where(better, far, length)
            chosen = np.where(better[..., None], to, chosen)
        moved = chosen
    return moved


def motion(frames: DataFrame, width: int, side: int = 8, reach: int = 4, levels: int = 2, key: str = "asset", idx: str = "idx", pixels: str = "pixels", block: int = BLOCK) -> DataFrame:
    """(key, idx, value): the mean displacement of each sampled frame's blocks, 0 for an asset's first frame; places are dense from 0.

    A frame that isn't whole rows of ``width``, holds null or has another size than the one before has null, one that is smaller than a block 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[float | None] = [0.0] * batch.num_rows
            sizes: dict[int, list[int]] = {}
            now, before = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if not before[i].is_valid:
                    continue
                a, b = now[i].values if now[i].is_valid else None, before[i].values
                if a is None or len(a) != len(b) or a.null_count or b.null_count or not len(a) or len(a) % width:
                    values[i] = None
                else:
                    sizes.setdefault(len(a), []).append(i)
            for n, rows in sizes.items():
                for at in range(0, len(rows), FRAMES):
                    some = rows[at : at + FRAMES]
                    stack = lambda c, some=some, n=n: np.stack([c[i].values.to_numpy(zero_copy_only=False) for i in some]).astype(float).reshape(-1, n // width, width)
                    moved = displacements(stack(now), stack(before), side, reach, levels)
                    if moved.shape[1] * moved.shape[2]:
                        for i, v in zip(some, np.sqrt((moved**2).sum(axis=3)).mean(axis=(1, 2)).tolist(), strict=True):
                            values[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=[key, idx, "value"])

    d = with_before(frames.select(key, idx, F.col(pixels).cast("array<double>").alias(pixels)), key, idx, pixels, block).select(key, idx, pixels, "_before")
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return d.mapInArrow(run, f"`{key}` {kinds[key]}, `{idx}` {kinds[idx]}, value double")
