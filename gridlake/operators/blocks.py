"""Dense matrices as blocks of rows: the values of a run of rows end to end, in one array.

A cell of the long form takes its row key, its column key and its value, and every operation moves each cell by itself. A
block takes eight bytes a value (and its rows' keys once), a take or a slice moves rows, a change of columns rewrites arrays
where they lie, and concatenation along the rows is a union. The columns of a dense matrix are as long as one of its rows, so
their keys are kept beside the frame.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, ORD, Axis, with_positions
from gridlake.operators.element import Matrix
from gridlake.session import materialise

#: Values in a block.
VALUES = 1 << 15


def _ints(values: list[int]) -> Column:
    """A constant array; an expression for each number would swell the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>") if values else F.array().cast("array<int>")


@dataclass(frozen=True)
class Blocks:
    """Blocks (start, keys, values) of rows in order: start is the first row's place, values hold len(keys) x len(columns) numbers."""

    blocks: DataFrame
    columns: tuple[Any, ...]
    sparse = False

    # Construction
    @staticmethod
    def of_rows(df: DataFrame, key: str, values: str, columns: list | tuple, per_block: int = VALUES) -> Blocks:
        """From one array for each row; rows stand in the order of the key."""
        placed = with_positions(df.select(F.col(key).alias(KEY), F.col(values).alias("_row")))
        return Blocks(_gathered(placed.select(F.col(ORD).alias("_at"), KEY, "_row"), len(columns), per_block), tuple(columns))

    @staticmethod
    def of_matrix(m: Matrix, obs: Axis, var: Axis, per_block: int = VALUES, fill=0.0) -> Blocks:
        """From cells; those that are absent are filled. Columns stand in the order of their keys."""
        columns = [r[0] for r in var.rows.orderBy(KEY).select(KEY).collect()]  # as many as a row has values
        place = materialise(with_positions(var.rows.select(KEY))).select(F.col(KEY).alias("v"), F.col(ORD).cast("int").alias("_p"))
        kind = m.df.schema["value"].dataType.simpleString()
        cells = m.df.join(place, "v").groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct("_p", "value"))).alias("_m"))
        row = F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(fill).cast(kind))) if columns else F.array().cast(f"array<{kind}>")
        rows = obs.rows.select(F.col(KEY)).join(cells, F.col(KEY) == F.col("o"), "left").select(KEY, row.alias("_row"))
        return Blocks.of_rows(rows, KEY, "_row", columns, per_block)

    # What it holds
    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def kind(self) -> str:
        return self.blocks.schema["values"].dataType.elementType.simpleString()

    def count(self) -> int:
        return self.blocks.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]

    def rows(self) -> DataFrame:
        """(_at, _key, _row): place, key and array of each row."""
        w = self.width
        one = self.blocks.select("start", F.posexplode("keys").alias("_i", KEY), "values")
        return one.select((F.col("start") + F.col("_i")).alias("_at"), KEY, F.slice("values", F.col("_i") * w + 1, F.lit(w)).alias("_row"))

    @property
    def df(self) -> DataFrame:
        """The long form: o, v and value of each cell."""
        names = self.blocks.sparkSession.createDataFrame(list(enumerate(self.columns)), f"_p int, v {self._column_type()}")
        cells = self.rows().select(F.col(KEY).alias("o"), F.posexplode("_row").alias("_p", "value"))
        return cells.join(names, "_p").select("o", "v", "value")

    def _column_type(self) -> str:
        kinds = {type(c) for c in self.columns}
        return "long" if kinds <= {int} else "string" if kinds <= {str} else "double"

    def matrix(self) -> Matrix:
        return Matrix(self.df, False)

    # As elements of a grid
    def view(self, obs: Axis, var: Axis) -> Blocks | Matrix:
        return self if obs.full and var.full else self.matrix().view(obs, var)

    def transposed(self) -> Matrix:
        return self.matrix().transposed()

    def nonzero(self) -> Matrix:
        return self.matrix().nonzero()

    def same_as(self, other: Blocks | Matrix) -> bool:
        return self.matrix().same_as(other.matrix() if isinstance(other, Blocks) else other)

    # Rows
    def sliced(self, start: int, stop: int) -> Blocks:
        """Rows by place: blocks beside the slice are skipped, those at its edges trimmed; nothing moves."""
        n, w = F.size("keys"), self.width
        low, high = F.greatest(F.lit(start) - F.col("start"), F.lit(0)), F.least(F.lit(stop) - F.col("start"), n)
        hit = self.blocks.where((F.col("start") < stop) & (F.col("start") + n > start)).where(high > low)
        cut = hit.select((F.col("start") + low - start).alias("start"), F.slice("keys", (low + 1).cast("int"), (high - low).cast("int")).alias("keys"),
                         F.slice("values", (low * w + 1).cast("int"), ((high - low) * w).cast("int")).alias("values"))
        return replace(self, blocks=cut)

    def taken(self, want: DataFrame, per_block: int = VALUES) -> Blocks:
        """want (_new, _key): rows by key, in any order and with repeats; _new is the place, and the new key."""
        rows = self.rows().join(want.select("_new", KEY), KEY).select(F.col("_new").alias("_at"), F.col("_new").alias(KEY), "_row")
        return Blocks(_gathered(rows, self.width, per_block), self.columns)

    def padded(self, keys: DataFrame, fill: float = float("nan"), per_block: int = VALUES) -> Blocks:
        """A row for every key of a frame (first column), in their order; rows that are new here are filled."""
        k = keys.columns[0]
        placed = with_positions(keys.select(F.col(k).alias(KEY)))
        empty = F.array_repeat(F.lit(fill).cast(self.kind), self.width)
        rows = placed.join(self.rows().drop("_at"), KEY, "left").select(F.col(ORD).alias("_at"), KEY, F.coalesce("_row", empty).alias("_row"))
        return Blocks(_gathered(rows, self.width, per_block), self.columns)

    def chunked(self, size: int) -> DataFrame:
        """(chunk, start, end, keys, values) of every `size` rows: blocks are cut at chunks, and pieces of one chunk joined."""
        n, w = F.size("keys"), self.width
        pieces = self.blocks.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + n - 1) / size))))
        low, high = F.greatest(F.col("chunk") * size - F.col("start"), F.lit(0)), F.least((F.col("chunk") + 1) * size - F.col("start"), n)
        pieces = pieces.select("chunk", F.struct((F.col("start") + low).alias("at"), F.slice("keys", (low + 1).cast("int"), (high - low).cast("int")).alias("keys"),
                                                 F.slice("values", (low * w + 1).cast("int"), ((high - low) * w).cast("int")).alias("values")).alias("piece"))
        whole = pieces.groupBy("chunk").agg(F.sort_array(F.collect_list("piece")).alias("p"))  # `size` rows
        start = F.col("chunk") * size
        keys = F.flatten(F.transform("p", lambda x: x["keys"]))
        return whole.select("chunk", start.alias("start"), (start + F.size(keys)).alias("end"), keys.alias("keys"), F.flatten(F.transform("p", lambda x: x["values"])).alias("values"))

    def reblocked(self, rows: int) -> Blocks:
        return replace(self, blocks=self.chunked(rows).select("start", "keys", "values"))

    # Columns
    def reindexed(self, columns: list | tuple, fill: float = float("nan")) -> Blocks:
        """These columns, in this order; those that are new here are filled. Arrays are rewritten where they lie."""
        if tuple(columns) == self.columns:
            return self
        place = {c: i for i, c in enumerate(self.columns)}
        index, w = [place.get(c, -1) for c in columns], self.width
        kind = self.kind if -1 not in index or self.kind in ("float", "double") or fill == fill and float(fill) == int(fill) else "double"
        one = lambda r: lambda j: F.when(j < 0, F.lit(fill).cast(kind)).otherwise(F.try_element_at("values", r * w + j + 1).cast(kind))
        values = F.flatten(F.transform(F.sequence(F.lit(0), F.size("keys") - 1), lambda r: F.transform(_ints(index), one(r))))
        return Blocks(self.blocks.select("start", "keys", values.alias("values")), tuple(columns))

    def mapped(self, f) -> Blocks:
        """f(Column) of every value."""
        return replace(self, blocks=self.blocks.withColumn("values", F.transform("values", f)))

    # Of several
    def shifted(self, by: int, key=None) -> Blocks:
        """`by` rows further on; key(Column) makes new keys."""
        keys = F.col("keys") if key is None else F.transform("keys", key)
        return replace(self, blocks=self.blocks.select((F.col("start") + by).alias("start"), keys.alias("keys"), "values"))


def _gathered(rows: DataFrame, width: int, per_block: int) -> DataFrame:
    """Rows (_at, _key, _row), whose places are 0, 1, ..., as blocks."""
    n = max(1, per_block // max(1, width))
    found = rows.groupBy(F.floor(F.col("_at") / n).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_at", KEY, "_row"))).alias("r"))  # a block's rows
    return found.select((F.col("_b") * n).alias("start"), F.transform("r", lambda x: x[KEY]).alias("keys"), F.flatten(F.transform("r", lambda x: x["_row"])).alias("values"))


def stacked(parts: list[Blocks], keys: list | None = None) -> Blocks:
    """Blocks one after another; they need the same columns. keys: for each, a function of its keys. A union: nothing moves."""
    kinds = {p.kind for p in parts}
    kind = kinds.pop() if len(kinds) == 1 else "double"
    out, n = None, 0
    for i, p in enumerate(parts):
        if p.columns != parts[0].columns:
            raise ValueError("blocks have different columns")
        b = p.shifted(n, keys[i] if keys else None).blocks.withColumn("values", F.col("values").cast(f"array<{kind}>"))
        out = b if out is None else out.unionByName(b)
        n += p.count() if i + 1 < len(parts) else 0
    return Blocks(out, parts[0].columns)
