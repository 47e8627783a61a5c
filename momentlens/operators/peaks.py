"""Peaks of series of any length: spacing and prominence, in blocks of places.

Each block is a task's own and its work is linear. Spacing is decided in a block as far as the block shows what decides it: a peak that depends on
others outside stays open, and open peaks go through larger blocks. Prominence needs the nearest higher places on both
sides: monotone stacks find those within a block; for peaks without one there, a sparse table over the extremes of the asset's blocks tells
the block that has it, which is asked for it. So a peak meets its own block and at most two more, whatever the asset's length.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlens.sources.shared import written

# workers get these functions by value, so they needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 50_000
#: Times that blocks grow for peaks that are still open.
GROWTH = 16
#: Peaks that are looked up in one task.
ASKED = 50_000


def kept(at: np.ndarray, height: np.ndarray, distance: int, first: float, last: float, known: np.ndarray | None = None) -> np.ndarray:
    """1 where a peak stays, 0 where it goes and -1 where places before ``first`` or after ``last``, which aren't shown, may decide.

    Peaks in order of their place. The highest goes first, of equal ones the later; one stays if none that stays is nearer than ``distance``.
    ``known``: peaks that stay, as is known already.
    """
    state, gone, waits = np.full(len(at), -1, np.int8), np.zeros(len(at), bool), np.zeros(len(at), bool)
    low, high = np.searchsorted(at, at - distance + 1), np.searchsorted(at, at + distance - 1, side="right")
    hidden = (at - distance < first) | (at + distance > last)
    for i in np.lexsort((-at, -height)).tolist():
        near = slice(low[i], high[i])
        if known is not None and known[i]:
            state[i] = 1
            gone[near] = True
        elif gone[i]:
            state[i] = 0
        elif hidden[i] or waits[i]:
            waits[near] = True
        else:
            state[i] = 1
            gone[near] = True
    return state


def _decider(distance: int, block: int, halo: int, whole: bool):
    def decide(table: pa.Table) -> pa.Table:
        b = table.column("_b")[0].as_py()
        table = table.sort_by("_i")
        at, y = table.column("_i").to_numpy(), table.column("_y").to_numpy()
        known = table.column("_s").to_numpy(zero_copy_only=False).astype(bool)
        low, high = b * block, (b + 1) * block
        # an asset begins at 0, and its end isn't known here
        state = kept(at, y, distance, -np.inf if low <= halo else low - halo, np.inf if whole else high + halo - 1, known)
        own = pa.array((at >= low) & ((at < high) | whole) & ~known)
        return pa.table({"_k": table.column("_k"), "_i": at, "_y": y, "_kept": state.astype(np.int32)}).filter(own)

    return decide


def spaced(peaks: DataFrame, distance: int, key: str, idx: str, value: str, block: int = BLOCK, last: int | None = None) -> DataFrame:
    """(key, idx, value) of the peaks that no higher kept peak is nearer to than ``distance``; of equal ones the later goes first. ``last``: the last place of any asset, if it is known."""
    schema = f"_k {peaks.schema[key].dataType.simpleString()}, _i long, _y double, _kept int"
    d = peaks.select(F.col(key).alias("_k"), F.col(idx).cast("long").alias("_i"), F.col(value).cast("double").alias("_y"), F.lit(False).alias("_s"))
    if last is None:
        last = d.agg(F.max("_i")).first()[0] or 0
    done = None
    while True:
        halo, whole = max(block // 8, 4 * distance), last < block
        blocks = F.array(F.lit(0).cast("long")) if whole else F.sequence(F.floor(F.greatest(F.lit(0), F.col("_i") - halo) / block), F.floor((F.col("_i") + halo) / block))

        found = d.withColumn("_b", F.explode(blocks)).groupBy("_k", "_b").applyInArrow(_decider(distance, block, halo, whole), schema)
        if not whole:
            found = written(found, "spaced-peaks")
        stay = found.where("_kept = 1")
        done = stay if done is None else done.unionByName(stay)
        if whole:
            break
        d = found.where("_kept = -1").select("_k", "_i", "_y", F.lit(False).alias("_s"))
        if d.isEmpty():
            break
        # a block may not have shown that a peak of the next one stays, so those come along
        d = d.unionByName(done.select("_k", "_i", "_y", F.lit(True).alias("_s")))
        block *= GROWTH
    return done.select(F.col("_k").alias(key), F.col("_i").alias(idx), F.col("_y").alias(value))


def walls(y: list[float], picked: list[int]) -> tuple[list[float], list[bool]]:
    """For some places the least value back to the nearest higher one, or to the first, and whether there is a higher one."""
    stack, low, found, picks = [], [], [], iter(picked)
    pick = next(picks, None)
    for i, v in enumerate(y):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        if i == pick:
            low.append(least)
            found.append(bool(stack))
            pick = next(picks, None)
        stack.append((v, least))
    return low, found


class SparseTable:
    """Extremes of any stretch of blocks by those of stretches of powers of two."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = [high], [low]
        while 2 ** len(self.high) <= len(high):
            half = 2 ** (len(self.high) - 1)
            self.high.append(np.maximum(self.high[-1][:-half], self.high[-1][half:]))
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))

    def before(self, end: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last block before ``end`` whose highest value is above y, or -1, and the least value of the blocks between, or ``least``."""
        end, least = end.copy(), least.copy()
        for level in range(len(self.high) - 1, -1, -1):
            step = 2**level
            at = np.maximum(end - step, 0)
            go = (end >= step) & (self.high[level][np.minimum(at, len(self.high[level]) - 1)] <= y)
            least[go] = np.minimum(least[go], self.low[level][at[go]])
            end[go] -= step
        return end - 1, least


def prominences(peaks: DataFrame, series: DataFrame, key: str, idx: str, value: str, block: int = BLOCK) -> DataFrame:
    """(key, idx, prominence) of ``peaks``, places of ``series``: the height above the higher one of the least values on both sides, up to the nearest higher places."""
    kind = series.schema[key].dataType.simpleString()
    places = series.select(F.col(key).alias("_k"), F.floor(F.col(idx) / block).alias("_b"), F.col(idx).cast("long").alias("_i"), F.col(value).cast("double").alias("_y"))
    asked = peaks.select(F.col(key).alias("_k"), F.floor(F.col(idx) / block).alias("_b"), F.col(idx).cast("long").alias("_i"), F.col(value).cast("double").alias("_y"), F.lit(True).alias("_p")).distinct()

    def within(table: pa.Table) -> pa.Table:
        p = table.column("_p").to_numpy(zero_copy_only=False).astype(bool)
        i, y = table.column("_i").to_numpy(), table.column("_y").to_numpy()
        want = np.sort(i[p])
        order = np.argsort(i[~p])
        at, line = i[~p][order], y[~p][order]
        picked = np.searchsorted(at, want)
        sides = []
        for side in (-1, 1):
            values, picks = (line, picked) if side < 0 else (line[::-1], len(line) - 1 - picked[::-1])
            low, found = walls(values.tolist(), picks.tolist())
            sides.append((low, found) if side < 0 else (low[::-1], found[::-1]))
        n, k = len(want), table.column("_k")[0]
        return pa.table({"_k": pa.array([k.as_py()] * (2 * n), k.type), "_b": np.repeat(table.column("_b")[0].as_py(), 2 * n), "_i": np.tile(want, 2), "_side": np.repeat(np.array([-1, 1], np.int32), n), "_y": np.tile(line[picked], 2), "_low": np.concatenate([s[0] for s in sides]).astype(float), "_walled": pa.array([*sides[0][1], *sides[1][1]], pa.bool_())})

    columns = f"_k {kind}, _b long, _i long, _side int, _y double, _low double"
    # only blocks that have peaks
    some = places.join(asked.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi").withColumn("_p", F.lit(False))
    found = some.unionByName(asked).groupBy("_k", "_b").applyInArrow(within, columns + ", _walled boolean")
    lows = found
    if (series.agg(F.max(idx)).first()[0] or 0) >= block:
        found = written(found, "peak-sides")
        open_ = written(_beyond(found.where("NOT _walled").drop("_walled"), places, kind, columns), "peak-blocks")
        lows = found.where("_walled").unionByName(open_.where("_wall IS NULL"), allowMissingColumns=True).select("_k", "_i", "_low")
        lows = lows.unionByName(_in_block(open_.where("_wall IS NOT NULL"), places, kind).select("_k", "_i", "_low"))
    low = lows.groupBy("_k", "_i").agg(F.max("_low").alias("_low"))
    d = asked.join(low, ["_k", "_i"])
    return d.select(F.col("_k").alias(key), F.col("_i").alias(idx), (F.col("_y") - F.col("_low")).alias("prominence"))


def _dealt(asked: DataFrame, with_: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part``: at most about ``ASKED`` of the first in a part, each with all of the second."""
    n = asked.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_n"))
    left = asked.join(n, on).withColumn("_part", F.pmod(F.xxhash64("_i", "_side"), F.col("_n")).cast("int")).drop("_n")
    right = with_.join(n, on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left, right


def _beyond(asked: DataFrame, places: DataFrame, kind: str, columns: str) -> DataFrame:
    """``asked`` with ``_wall``, the nearest block that is higher, or null, and the least value of what lies between."""
    extremes = places.groupBy("_k", "_b").agg(F.max("_y").alias("_y"), F.min("_y").alias("_low"))

    def look(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        blocks, rest = table.filter(pa.array(side == 0)).sort_by("_b"), table.filter(pa.array(side != 0))
        ids = blocks.column("_b").to_numpy()
        high, low = blocks.column("_y").to_numpy(), blocks.column("_low").to_numpy()
        of, y = rest.column("_side").to_numpy(), rest.column("_y").to_numpy()
        own = np.searchsorted(ids, rest.column("_b").to_numpy())
        least, wall = rest.column("_low").to_numpy().copy(), np.full(len(y), -1)
        for s in (-1, 1):
            pick = of == s
            forward = SparseTable(high, low) if s < 0 else SparseTable(high[::-1], low[::-1])
            end = own[pick] if s < 0 else len(ids) - 1 - own[pick]
            at, least[pick] = forward.before(end, y[pick], least[pick])
            wall[pick] = np.where(at < 0, -1, at if s < 0 else len(ids) - 1 - at)
        there = pa.array(np.where(wall < 0, 0, ids[np.maximum(wall, 0)]), pa.int64(), mask=wall < 0)
        return rest.select(["_k", "_b", "_i", "_side", "_y"]).append_column("_low", pa.array(least)).append_column("_wall", there)

    asked, extremes = _dealt(asked, extremes.withColumns({"_i": F.lit(0).cast("long"), "_side": F.lit(0)}), ["_k"])
    return asked.unionByName(extremes).groupBy("_k", "_part").applyInArrow(look, columns + ", _wall long")


def _in_block(asked: DataFrame, places: DataFrame, kind: str) -> DataFrame:
    """(_k, _i, _side, _low) with the least value on the near side of the wall that a block has."""

    def look(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        line, rest = table.filter(pa.array(side == 0)).sort_by("_i").column("_y").to_numpy(), table.filter(pa.array(side != 0))
        of, y, least = rest.column("_side").to_numpy(), rest.column("_y").to_numpy(), rest.column("_low").to_numpy().copy()
        for s in (-1, 1):
            pick = of == s
            near = line[::-1] if s < 0 else line  # from the peak's side on
            first = np.searchsorted(np.maximum.accumulate(near), y[pick], side="right")
            passed = np.concatenate(([np.inf], np.minimum.accumulate(near)))
            least[pick] = np.minimum(least[pick], passed[first])
        return rest.select(["_k", "_i", "_side"]).append_column("_low", pa.array(least))

    asked = asked.select("_k", F.col("_wall").alias("_b"), "_i", "_side", "_y", "_low")
    hit = places.join(asked.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi")
    asked, hit = _dealt(asked, hit.withColumns({"_side": F.lit(0), "_low": F.lit(0.0)}), ["_k", "_b"])
    return asked.unionByName(hit).groupBy("_k", "_b", "_part").applyInArrow(look, f"_k {kind}, _i long, _side int, _low double")


def prominent(peaks: DataFrame, series: DataFrame, least: Column, key: str, idx: str, value: str, block: int = BLOCK) -> DataFrame:
    """``peaks`` with their prominence, where it is at least ``least``, a column of theirs."""
    d = peaks.join(prominences(peaks, series, key, idx, value, block), [key, idx])
    return d.where(F.col("prominence") >= least).select(*peaks.columns, "prominence")
