"""Sets and frames of positions: what an axis is selected by when a list would be too long for a driver.

Ranges are sorted, disjoint runs, so a mask of any length is as long as its changes; they are cut, joined and sliced by their
ends alone. Taken is a frame of positions in an order, with repeats, that never leaves the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Ranges:
    """Positions as runs [start, stop)."""

    starts: np.ndarray
    stops: np.ndarray

    #: With more runs than these a selection is a join rather than a condition.
    MANY = 200

    @staticmethod
    def of(*runs: tuple[int, int]) -> Ranges:
        """From runs in any order, which may overlap or touch."""
        found = np.array(sorted((a, z) for a, z in runs if z > a), np.int64).reshape(-1, 2)
        if not len(found):
            return Ranges(found[:, 0], found[:, 1])
        most = np.maximum.accumulate(found[:, 1])
        new = np.append(True, found[1:, 0] > most[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)
        return Ranges(found[new, 0], most[last])

    @staticmethod
    def of_mask(mask: Any) -> Ranges:
        edges = np.diff(np.asarray(mask, bool).astype(np.int8), prepend=0, append=0)
        return Ranges(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))

    def __len__(self) -> int:
        return int((self.stops - self.starts).sum())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Ranges) and np.array_equal(self.starts, other.starts) and np.array_equal(self.stops, other.stops)

    __hash__ = None

    def __or__(self, other: Ranges) -> Ranges:
        return Ranges.of(*zip(self.starts.tolist(), self.stops.tolist()), *zip(other.starts.tolist(), other.stops.tolist()))

    def beside(self, n: int) -> Ranges:
        """Those of 0 to n - 1 that aren't here."""
        a, z = np.append(0, self.stops), np.append(self.starts, n)
        return Ranges(a[z > a], z[z > a])

    def __and__(self, other: Ranges) -> Ranges:
        n = int(max([0, *self.stops[-1:], *other.stops[-1:]]))
        return (self.beside(n) | other.beside(n)).beside(n)

    def sliced(self, start: int, stop: int) -> Ranges:
        """The start-th to the stop-th (left out) of the positions."""
        before = np.cumsum(self.stops - self.starts) - (self.stops - self.starts)
        a = self.starts + np.maximum(start - before, 0)
        z = np.minimum(self.stops, self.starts + np.maximum(stop - before, 0))
        return Ranges(a[z > a], z[z > a])

    def within(self, base: range) -> Ranges:
        """Positions in a slice, as positions of what was sliced (a step makes runs of one)."""
        if base.step == 1:
            return Ranges(self.starts + base.start, self.stops + base.start)
        at = base.start + base.step * np.concatenate([np.zeros(0, np.int64), *(np.arange(a, z) for a, z in zip(self.starts, self.stops))])
        return Ranges.of(*((p, p + 1) for p in at.tolist()))

    def rows(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of df whose position is here: by a condition, or a join with the runs spread out where they lie."""
        c = F.col(column)
        if not len(self.starts):
            return df.where(F.lit(False))
        df = df.where((c >= int(self.starts[0])) & (c < int(self.stops[-1])))
        if len(self.starts) == 1:
            return df
        if len(self.starts) <= self.MANY:
            hit = F.lit(False)
            for a, z in zip(self.starts.tolist(), self.stops.tolist()):
                hit = hit | ((c >= a) & (c < z))
            return df.where(hit)
        return df.join(self.frame(df.sparkSession, column), column, "left_semi").select(*df.columns)

    def frame(self, spark: SparkSession, column: str) -> DataFrame:
        """A row a position."""
        import pandas as pd

        runs = spark.createDataFrame(pd.DataFrame({"a": self.starts, "z": self.stops}))
        return runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a").select(F.explode(F.sequence("a", F.col("z") - 1)).alias(column))


@dataclass(frozen=True)
class Taken:
    """Rows to take: a frame (new, at) of new and old places; new counts from 0."""

    frame: DataFrame

    @staticmethod
    def of(frame: DataFrame, new: str | Column, at: str | Column) -> Taken:
        c = lambda x: F.col(x) if isinstance(x, str) else x
        return Taken(frame.select(c(new).cast("long").alias("new"), c(at).cast("long").alias("at")))
