"""Table functions for SQL: operators over a TABLE argument, by partition.

``register`` makes them known to a session, for example::

    SELECT * FROM merge_intervals(TABLE(segments) PARTITION BY source ORDER BY (start), 2.0)

They take tables of any further columns, which ``analyze`` sees when a query is planned: it says what comes out and what is missing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf

# workers get these classes by value, so they needn't have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _numbers(table: AnalyzeArgument, names: tuple[str, ...]) -> None:
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    for n in names:
        if not isinstance(kinds.get(n), T.NumericType):
            raise ValueError(f"the table needs a number {n}")


@dataclass
class _Plan(AnalyzeResult):
    gap: float = 0.0


class MergeIntervals:
    """(start, end, n) of each partition's intervals that overlap, touch or are at most ``gap`` apart. The table has start and end, in order of start; a row without one of them is left out."""

    @staticmethod
    def analyze(table: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        _numbers(table, ("start", "end"))
        if gap.value is None:
            raise ValueError("the gap must be a constant number")
        fields = [T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("n", T.LongType())]
        return _Plan(T.StructType(fields), select=[SelectedColumn("start"), SelectedColumn("end")], gap=float(gap.value))

    def __init__(self, plan: _Plan):
        self.gap, self.start, self.end, self.n = plan.gap, None, None, 0

    def eval(self, row, gap) -> Iterator[tuple]:
        start, end = row["start"], row["end"]
        if start is None or end is None:
            return
        start, end = float(start), float(end)
        if self.n and start < self.start:
            raise ValueError("intervals must be in order: ORDER BY start")
        if self.n and start <= self.end + self.gap:
            self.end, self.n = max(self.end, end), self.n + 1
            return
        if self.n:
            yield self.start, self.end, self.n
        self.start, self.end, self.n = start, end, 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.start, self.end, self.n


class Timeline:
    """(rank, label, offset, duration) of each partition's segments in the order given: the place, its letters, and the total of the durations before."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _numbers(table, ("duration",))
        kinds = (("rank", T.LongType()), ("label", T.StringType()), ("offset", T.DoubleType()), ("duration", T.DoubleType()))
        return AnalyzeResult(T.StructType([T.StructField(n, k) for n, k in kinds]), select=[SelectedColumn("duration")])

    def __init__(self):
        self.rank, self.offset = 0, 0.0

    def eval(self, row) -> Iterator[tuple]:
        duration = float(row["duration"] or 0.0)
        i = self.rank
        yield i, chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26), self.offset, duration
        self.rank, self.offset = i + 1, self.offset + duration


def register(spark: SparkSession) -> None:
    """``merge_intervals(TABLE, gap)`` and ``timeline(TABLE)`` for the session's SQL."""
    spark.udtf.register("merge_intervals", udtf(MergeIntervals))
    spark.udtf.register("timeline", udtf(Timeline))
