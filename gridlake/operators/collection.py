"""Several grids seen as one, and mini-batches over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, NAME, ORD, with_positions
from gridlake.operators.concat import concat, concat_aligned
from gridlake.operators.grid import Grid, drawn

Convert = Callable[[Column], Column] | Mapping[str, Any] | None

WIDTH = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")


def chosen(convert: Convert, *path: str) -> Callable[[Column], Column] | None:
    """The converter for an attribute and key: one for all, or nested mappings."""
    for p in path:
        if not isinstance(convert, Mapping):
            return convert
        convert = convert.get(p)
    return convert if callable(convert) else None


def composed(*converters: Callable[[Column], Column] | None) -> Callable[[Column], Column]:
    """First to last; nothing is the identity."""
    def run(c: Column) -> Column:
        for f in converters:
            c = f(c) if f else c
        return c
    return run


def harmonised(grids: list[Grid]) -> list[Grid]:
    """Numeric columns that inputs hold in several types get the widest; of long and float that is double."""
    out = list(grids)
    for side in ("obs",):
        types: dict[str, set[str]] = {}
        for g in grids:
            for c, t in g.axis(side).df.dtypes:
                types.setdefault(c, set()).add(t)
        wide = {}
        for c, ts in types.items():
            if len(ts) > 1 and ts <= set(WIDTH):
                wide[c] = "double" if ts & {"float", "double"} and ts & {"int", "bigint"} else max(ts, key=WIDTH.index)
        for i, g in enumerate(out):
            axis = g.axis(side)
            casts = {c: F.col(c).cast(t) for c, t in wide.items() if c in axis.df.columns}
            out[i] = replace(g, **{side: replace(axis, df=axis.df.withColumns(casts))}) if casts else g
    return out


@dataclass(frozen=True)
class Collection:
    grid: Grid
    convert: Convert = None
    #: Keep the order (and repeats) of positions in a selection; without it, rows stay in the axis's order.
    indices_strict: bool = True

    @staticmethod
    def of(grids: list[Grid] | Mapping[str, Grid], *, join_vars: str | None = None, join_obs: str = "inner", join_obsm: str | None = "inner", indices_strict: bool = True, label: str | None = None, keys: list[str] | None = None,
           index_unique: str | None = None, convert: Convert = None, harmonise: bool = True) -> Collection:
        """Var axes must hold the same labels unless join_vars is `inner`."""
        if isinstance(grids, Mapping):
            keys, grids = list(grids), list(grids.values())
        if join_vars not in (None, "inner"):
            raise ValueError("join_vars is inner or nothing")
        if join_obsm not in (None, "inner", "outer"):
            raise ValueError("join_obsm is inner, outer or nothing")
        if join_vars is None and any(g.var is not grids[0].var for g in grids):
            first = grids[0].var.rows.select(NAME)
            for g in grids[1:]:
                names = g.var.rows.select(NAME)
                if first.exceptAll(names).limit(1).count() or names.exceptAll(first).limit(1).count():
                    raise ValueError("var labels differ; join_vars='inner' takes what they share")
        gs = harmonised(grids) if harmonise else list(grids)
        g = concat(gs, join="inner", label=label, keys=keys, index_unique=index_unique)
        if join_obs == "outer":
            wide = concat([replace(x, elements={}, obsm_={}) for x in gs], join="outer", label=label, keys=keys, index_unique=index_unique)
            g = replace(g, obs=wide.obs)
        if join_obsm != "inner":
            g = replace(g, obsm_=concat_aligned([x.realised().obsm_ for x in gs], [x.realised().obs for x in gs], "outer", None) if join_obsm else {})
        return Collection(g, convert, indices_strict)

    def __len__(self) -> int:
        return self.grid.n_obs

    def __getitem__(self, index) -> Collection:
        rows = index[0] if isinstance(index, tuple) and index else index
        if not self.indices_strict and isinstance(rows, (list, range)) and len(rows) and {type(x) for x in rows} == {int} and len(set(rows)) == len(rows):
            n, spark = len(self), self.grid.obs.df.sparkSession
            if any(not -n <= x < n for x in rows):
                raise IndexError(f"positions out of range for {n} rows")
            want = spark.createDataFrame([(x % n,) for x in rows], f"{ORD} long")
            keys = self.grid.obs.positions().join(want, ORD, "left_semi").select(KEY)
            index = (keys, *index[1:]) if isinstance(index, tuple) else keys
        return replace(self, grid=self.grid[index])

    def layer(self, key: str | None = None) -> DataFrame:
        """Cells of a layer, converted."""
        f = composed(chosen(self.convert, "X" if key is None else "layers", *([] if key is None else [key])))
        return self.grid.layer(key).df.withColumn("value", f(F.col("value")))

    def attr(self, slot: str, key: str) -> DataFrame:
        """(_key, value) of one annotation column or aligned array, converted."""
        f = composed(chosen(self.convert, slot, key))
        df = self.grid.obs.rows.select(KEY, F.col(key).alias("value")) if slot == "obs" else self.grid.obsm[key].df
        return df.withColumn("value", f(F.col("value")))

    def to_grid(self, x: bool = True, layers: bool = True) -> Grid:
        g = self.grid.realised()
        return replace(g, elements={k: m for k, m in g.elements.items() if (x if k is None else layers)})

    def batches(self, batch_size: int, shuffle: bool = False, drop_last: bool = False, seed: int = 0) -> DataFrame:
        """(_key, batch): rows in batches, in order or shuffled by a seeded hash. No task sees more than its partition."""
        rows = self.grid.obs.rows.select(KEY)
        if shuffle:
            at = with_positions(rows.withColumn("_r", F.struct(drawn(F.concat_ws(":", F.lit(str(seed)), F.to_json(F.struct(KEY)))), F.col(KEY))), "_r").drop("_r")
        else:
            at = with_positions(rows)
        out = at.select(KEY, F.floor(F.col(ORD) / batch_size).alias("batch"))
        if drop_last:
            out = out.where(F.col("batch") < self.grid.n_obs // batch_size)
        return out

    def n_batches(self, batch_size: int, drop_last: bool = False) -> int:
        n = len(self)
        return n // batch_size if drop_last else -(-n // batch_size)

    def iterate(self, batch_size: int, shuffle: bool = False, drop_last: bool = False, seed: int = 0) -> Iterator[tuple[int, Collection]]:
        """One batch after another, each a lazy view."""
        from gridlake.session import materialise

        b = materialise(self.batches(batch_size, shuffle, drop_last, seed))
        for k in range(self.n_batches(batch_size, drop_last)):
            yield k, self[b.where(F.col("batch") == k).select(KEY), :]

    def iterate_cells(self, batch_size: int, key: str | None = None, shuffle: bool = False, drop_last: bool = False, seed: int = 0) -> Iterator[tuple[int, list[Row]]]:
        """One batch after another as its cells (o, v, value), in one pass: cells are sorted by batch once and fetched partition by partition."""
        b = self.batches(batch_size, shuffle, drop_last, seed).select(F.col(KEY).alias("o"), "batch")
        cells = self.layer(key).join(b, "o").repartitionByRange("batch").sortWithinPartitions("batch", "o", "v").select("batch", "o", "v", "value")
        for k, rows in groupby(cells.toLocalIterator(), key=lambda r: r.batch):
            yield k, list(rows)
