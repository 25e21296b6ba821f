"""Elements aligned to axes: matrices, arrays per row, and graphs over one axis."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, Axis, fingerprint
from gridlake.operators.ragged import cut, sizes
from gridlake.session import settings


NUMBERS = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class Matrix:
    """Cells (o, v, value). In a sparse matrix an absent cell is zero; a dense one has every cell."""

    df: DataFrame
    sparse: bool = True

    @staticmethod
    def of(df: DataFrame, o: str | Column, v: str | Column, value: str | Column, sparse: bool = True) -> Matrix:
        c = lambda x: F.col(x) if isinstance(x, str) else x
        return Matrix(df.select(c(o).alias("o"), c(v).alias("v"), c(value).alias("value")), sparse)

    @staticmethod
    def coerced(spark: SparkSession, x: Any) -> Matrix:
        """A matrix from what holds one: cells in a DataFrame (o, v, value), a pandas frame, a numpy array, or a sparse array that knows tocoo().

        Numbers and booleans in two dimensions; anything else is refused."""
        if isinstance(x, Matrix):
            return x
        if isinstance(x, DataFrame):
            if sorted(x.columns) != ["o", "v", "value"]:
                raise TypeError(f"cells are o, v and value, not {x.columns}")
            kind = dict(x.dtypes)["value"]
            if kind not in NUMBERS and not kind.startswith("decimal"):
                raise TypeError(f"a matrix holds numbers, not {kind}")
            return Matrix(x.select("o", "v", "value"))
        if hasattr(x, "to_numpy"):  # a frame: every column, one common type
            x = x.to_numpy()
        if not hasattr(x, "shape") or not hasattr(x, "dtype"):
            raise TypeError(f"no matrix: {type(x).__name__}")
        if len(x.shape) != 2:
            raise ValueError(f"a matrix has two dimensions, not {len(x.shape)}")
        if x.dtype.kind not in "biuf":
            raise TypeError(f"a matrix holds numbers, not {x.dtype}")
        kind = {"b": "boolean", "f": "double"}.get(x.dtype.kind, "long")
        sparse = hasattr(x, "tocoo")
        if sparse:
            c = x.tocoo()
            o, v, values = c.row, c.col, c.data
        else:
            o, v, values = np.repeat(np.arange(x.shape[0]), x.shape[1]), np.tile(np.arange(x.shape[1]), x.shape[0]), np.ravel(x)
        cells = pd.DataFrame({"o": np.asarray(o, np.int64), "v": np.asarray(v, np.int64), "value": np.asarray(values).astype({"boolean": bool, "double": float, "long": np.int64}[kind])})
        return Matrix(spark.createDataFrame(cells, f"o long, v long, value {kind}"), sparse)

    def axes(self) -> tuple[Axis, Axis]:
        """Axes of just the keys that cells name."""
        side = lambda c: Axis.of(self.df.select(c).distinct(), c)
        return side("o"), side("v")

    def view(self, obs: Axis, var: Axis) -> Matrix:
        return replace(self, df=var.keep(obs.keep(self.df, "o"), "v"))

    def transposed(self) -> Matrix:
        return replace(self, df=self.df.select(F.col("v").alias("o"), F.col("o").alias("v"), "value"))

    def nonzero(self) -> Matrix:
        """The sparse form: explicit zeros go."""
        return Matrix(self.df.where((F.col("value") != 0) | F.col("value").isNull()), True)

    def densified(self, obs: Axis, var: Axis, fill=0.0) -> Matrix:
        """Every cell of the two axes. The output is the product of the axes by definition; more than max_filled_cells raise."""
        if obs.count() * var.count() > settings().max_filled_cells:
            raise ValueError(f"{obs.count()} x {var.count()} cells; raise max_filled_cells to allow it")
        cells = obs.rows.select(F.col(KEY).alias("o")).crossJoin(var.rows.select(F.col(KEY).alias("v")))
        return Matrix(cells.join(self.df, ["o", "v"], "left").select("o", "v", F.coalesce("value", F.lit(fill)).alias("value")), False)

    def tally(self, *by: Column) -> DataFrame:
        """How often each value stands in each group of rows: the columns that `by` makes of o, value, n."""
        return self.df.groupBy(*by, "value").agg(F.count("*").alias("n"))

    def same_as(self, other: Matrix) -> bool:
        """Equal values: an explicit zero equals an absent cell of a sparse matrix, NaN equals NaN."""
        if dict(self.df.dtypes) == dict(other.df.dtypes):
            # Cells that count: in sparse matrices none is zero or null, beside a sparse one a dense one needs no zeros, and two dense ones may lack nulls.
            zeros, value = self.sparse or other.sparse, F.col("value")

            def cells(m: Matrix) -> DataFrame:
                df = m.df.select("o", "v", "value")
                if m.sparse:
                    return df.where(F.coalesce(value, F.lit(0)) != 0)
                return df.where(value.isNull() | (value != 0)) if zeros else df.where(value.isNotNull())

            return fingerprint(cells(self)) == fingerprint(cells(other))
        a, b = self.df.withColumnRenamed("value", "a"), other.df.withColumnRenamed("value", "b")
        zero = lambda c, sparse: F.coalesce(c, F.lit(0)) if sparse else F.col(c)
        j = a.join(b, ["o", "v"], "full_outer")
        return j.where(~zero("a", self.sparse).eqNullSafe(zero("b", other.sparse))).limit(1).count() == 0


@dataclass(frozen=True)
class Fill:
    """One value wherever a row of o meets a column of v."""

    o: DataFrame
    v: DataFrame
    value: float


class Filled(Matrix):
    """A matrix some of whose cells are fills. They stay two lists of keys each, through views and tallies; only df makes them, guarded by max_filled_cells."""

    def __init__(self, df: DataFrame, sparse: bool = True, fills: tuple[Fill, ...] = ()):
        for k, x in (("own", df), ("sparse", sparse), ("fills", fills), ("_whole", None)):
            object.__setattr__(self, k, x)

    @property
    def df(self) -> DataFrame:
        if self._whole is None:
            if sum(f.o.count() * f.v.count() for f in self.fills) > settings().max_filled_cells:
                raise ValueError("a fill value other than zero would make too many cells; raise max_filled_cells to allow it")
            # by definition every row of an input meets every label that the input lacks
            made = [f.o.crossJoin(f.v).select("o", "v", F.lit(f.value).cast("double").alias("value")) for f in self.fills]
            object.__setattr__(self, "_whole", reduce(lambda a, b: a.unionByName(b), [self.own, *made]))
        return self._whole

    def view(self, obs: Axis, var: Axis) -> Matrix:
        fills = tuple(Fill(obs.keep(f.o, "o"), var.keep(f.v, "v"), f.value) for f in self.fills)
        return Filled(var.keep(obs.keep(self.own, "o"), "v"), self.sparse, fills)

    def transposed(self) -> Matrix:
        fills = tuple(Fill(f.v.withColumnRenamed("v", "o"), f.o.withColumnRenamed("o", "v"), f.value) for f in self.fills)
        return Filled(Matrix(self.own).transposed().df, self.sparse, fills)

    def tally(self, *by: Column) -> DataFrame:
        own = Matrix(self.own).tally(*by)
        names = own.columns[:-2]
        n = lambda f: f.o.groupBy(*by).agg(F.count("*").alias("_o")).crossJoin(f.v.agg(F.count("*").alias("_v")))
        made = [n(f).where("_v > 0").select(*names, F.lit(f.value).cast("double").alias("value"), (F.col("_o") * F.col("_v")).alias("n")) for f in self.fills]
        return reduce(lambda a, b: a.unionByName(b), [own, *made]).groupBy(*names, "value").agg(F.sum("n").alias("n"))


def from_rows(df: DataFrame, key: str, values: str, sparse: bool = False) -> Matrix:
    """A matrix from one array per row; v is the place in the array."""
    cells = df.select(F.col(key).alias("o"), F.posexplode(values).alias("p", "value")).select("o", F.col("p").cast("long").alias("v"), "value")
    return Matrix(cells).nonzero() if sparse else Matrix(cells, False)


def to_rows(m: Matrix, obs: Axis, width: int) -> DataFrame:
    """One array of that width per row of the axis; v must be places 0..width-1. Absent cells are zero."""
    lists = m.df.groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct(F.col("v").cast("int"), F.col("value").cast("double")))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return obs.rows.select(F.col(KEY)).join(lists, F.col(KEY) == F.col("o"), "left").select(KEY, filled.alias("values"))


@dataclass(frozen=True)
class Aligned:
    """One value per row of an axis: an array of a fixed width, an array of any length, or a struct."""

    df: DataFrame  # _key, value
    width: int | None = None

    @staticmethod
    def of(df: DataFrame, key: str, value: str | Column, width: int | None = None) -> Aligned:
        return Aligned(df.select(F.col(key).alias(KEY), (F.col(value) if isinstance(value, str) else value).alias("value")), width)

    def view(self, axis: Axis) -> Aligned:
        return replace(self, df=axis.keep(self.df, KEY))

    def length(self, dim: int = 0) -> int | None:
        """Rows (0), or how long the values are (1), the lists in them (2) and so on: None where that differs."""
        if dim == 0:
            return self.df.count()
        if dim == 1 and self.width is not None:
            return self.width
        r = sizes(self.df, dim).agg(F.min("size").alias("a"), F.max("size").alias("z")).first()
        return r.a if r.a == r.z else None

    def cut(self, *at: slice | int) -> Aligned:
        """Places within the values, for each depth a slice or a number."""
        return replace(self, df=self.df.select(KEY, cut(F.col("value"), self.df.schema["value"].dataType, *at).alias("value")), width=None)

    def column(self, i: int | str) -> DataFrame:
        """(_key, value) of one place (or struct field)."""
        if isinstance(i, int):
            if self.width is not None and not -self.width <= i < self.width:
                raise IndexError(f"place {i} of {self.width}")
            i = i if i >= 0 or self.width is None else i + self.width
            return self.df.select(KEY, F.get("value", i).alias("value"))
        return self.df.select(KEY, F.col(f"value.{i}").alias("value"))

    def to_df(self, key: str, axis: Axis) -> DataFrame:
        """Columns key1, key2, ... for each row of the axis."""
        if self.width is None:
            raise ValueError("an array of no fixed width has no columns")
        cols = [F.get("value", i).alias(f"{key}{i + 1}") for i in range(self.width)]
        return axis.rows.select(KEY, "_name").join(self.df, KEY, "left").select(KEY, "_name", *cols)

    def resized(self, width: int, fill) -> Aligned:
        n = F.lit(width)
        v = F.slice("value", 1, n) if self.width is not None and self.width >= width else F.concat("value", F.array_repeat(F.lit(fill).cast("double"), width - (self.width or 0)))
        return Aligned(self.df.select(KEY, v.alias("value")), width)


@dataclass(frozen=True)
class Pairs:
    """A square matrix over one axis as edges (i, j, value)."""

    df: DataFrame

    @staticmethod
    def of(df: DataFrame, i: str, j: str, value: str | Column) -> Pairs:
        return Pairs(df.select(F.col(i).alias("i"), F.col(j).alias("j"), (F.col(value) if isinstance(value, str) else value).alias("value")))

    def view(self, axis: Axis) -> Pairs:
        return Pairs(axis.keep(axis.keep(self.df, "i"), "j"))
