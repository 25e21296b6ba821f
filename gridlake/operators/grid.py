"""The grid: a matrix with annotated axes, layers, aligned arrays, graphs and free-form metadata. Immutable and lazy."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.names import make_unique, natural_key
from gridlake.operators.axis import FROM, KEY, NAME, ORD, Axis, Categories, certain, same_rows, with_positions
from gridlake.operators.blocks import Blocks
from gridlake.operators.dictionary import Dictionary
from gridlake.operators.element import Aligned, Matrix, Pairs
from gridlake.operators.merge import equal
from gridlake.session import materialise, settings


@dataclass(frozen=True)
class Raw:
    """A frozen matrix with its own var axis. It follows the grid's obs, not its var."""

    x: Matrix
    var: Axis
    varm: dict[str, Aligned] = field(default_factory=dict)

    def vector(self, obs: Axis, label: str) -> DataFrame:
        """(_key, _name, value) along obs of one column of the raw matrix; absent cells are 0."""
        of = self.var.rows.where(F.col(NAME) == label).select(F.col(KEY).alias("v"))
        if of.limit(1).count() == 0:
            raise KeyError(label)
        cells = self.x.df.join(of, "v", "left_semi").select(F.col("o").alias(KEY), "value")
        return obs.rows.select(KEY, NAME).join(cells, KEY, "left").select(KEY, NAME, F.coalesce("value", F.lit(0)).alias("value"))

    def __getitem__(self, index) -> Raw:
        obs, var = unpack(index)
        if obs != slice(None):
            raise IndexError("raw is selected along var here; select the grid along obs")
        return replace(self, var=self.var.select(var))


def unpack(index: Any) -> tuple[Any, Any]:
    """One or two indexers, with an ellipsis anywhere."""
    if not isinstance(index, tuple):
        return (slice(None) if index is Ellipsis else index), slice(None)
    parts = list(index)
    if sum(p is Ellipsis for p in parts) > 1:
        raise IndexError("more than one ellipsis")
    if any(p is Ellipsis for p in parts):
        at = next(i for i, p in enumerate(parts) if p is Ellipsis)
        parts[at : at + 1] = [slice(None)] * (3 - len(parts))
    if len(parts) > 2:
        raise IndexError(f"{len(parts)} indexers for two axes")
    return (*parts, *[slice(None)] * (2 - len(parts)))


def equal_maps(a: Any, b: Any) -> bool:
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return set(a) == set(b) and all(equal_maps(a[k], b[k]) for k in a)
    if isinstance(a, DataFrame) and isinstance(b, DataFrame):
        return same_rows(a, b)
    return equal(a, b)


def drawn(c: Column) -> Column:
    """A number below 2**60 from a digest of a text: the same wherever and however often it is drawn."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def once(frame: DataFrame, key: str) -> DataFrame:
    """frame, if no key that an axis could have repeats in it."""
    twice = [r[0] for r in frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"keys repeat in the frame: {twice}")
    return frame


def check_key(key: str) -> str:
    if not isinstance(key, str):
        raise TypeError(f"keys are strings, not {type(key).__name__}")
    if settings().disallow_slash_in_keys and "/" in key:
        raise ValueError(f"keys must not hold a slash: {key!r}")
    return key


@dataclass(frozen=True)
class Grid:
    obs: Axis
    var: Axis
    #: X is the layer None. Elements speak of root keys; views join them to the axes when they are read.
    elements: dict[str | None, Matrix] = field(default_factory=dict)
    obsm_: dict[str, Aligned] = field(default_factory=dict)
    varm_: dict[str, Aligned] = field(default_factory=dict)
    obsp_: dict[str, Pairs] = field(default_factory=dict)
    varp_: dict[str, Pairs] = field(default_factory=dict)
    uns: dict[str, Any] = field(default_factory=dict)
    raw_: Raw | None = None

    # Construction
    def __post_init__(self):
        """Elements may be given as arrays, frames or sparse arrays: their rows and columns are the axes' positions."""
        made = {}
        for k, x in self.elements.items():
            if isinstance(x, (Matrix, Blocks)):
                continue
            m = Matrix.coerced(self.obs.df.sparkSession, x)
            if not isinstance(x, DataFrame):
                if tuple(x.shape) != (self.obs.count(), self.var.count()):
                    raise ValueError(f"layer {k!r} is {x.shape[0]} x {x.shape[1]}, the axes are {self.obs.count()} x {self.var.count()}")
                for c, axis in (("o", self.obs), ("v", self.var)):
                    if not axis.dense or axis.window is not None:
                        place = axis.positions().select(F.col(ORD).alias(c), F.col(KEY).alias("_to"))
                        m = replace(m, df=m.df.join(place, c).select(*(F.col("_to").alias(n) if n == c else F.col(n) for n in ("o", "v", "value"))))
            made[k] = m
        if made:
            object.__setattr__(self, "elements", {**self.elements, **made})

    @staticmethod
    def from_frame(df: DataFrame, key: str, name: str | None = None, columns: list[str] | None = None, sparse: bool = False) -> Grid:
        """Rows to obs, columns to var (they need one common type)."""
        cols = columns or [c for c in df.columns if c not in (key, name)]
        order = F.create_map(*(x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i).cast("long"))))
        cells = df.select(key, *cols).unpivot(key, cols, "_column", "value").select(F.col(key).alias("o"), order[F.col("_column")].alias("v"), "value")
        m = Matrix(cells, False)
        return Grid(Axis.of(df, key, name, columns=[]), Axis.of_names(df.sparkSession, cols), {None: m.nonzero() if sparse else m})

    @staticmethod
    def from_matrix(m: Matrix) -> Grid:
        """A grid from a matrix alone: its axes are the keys that cells name."""
        return Grid(*m.axes(), {None: m})

    def keys(self, slot: str) -> list[str]:
        """The names in a slot: columns of obs and var, keys of layers, obsm, varm, obsp, varp and uns."""
        if slot in ("obs", "var"):
            return self.axis(slot).columns
        if slot == "layers":
            return [k for k in self.elements if k is not None]
        if slot == "uns":
            return list(self.uns)
        if slot not in ("obsm", "varm", "obsp", "varp"):
            raise ValueError(f"no slot {slot!r}")
        return list(getattr(self, slot + "_"))

    def validate(self) -> Grid:
        """Keys of every element exist on its axes, keys are unique, arrays have their width. Runs jobs."""
        for side, axis in (("obs", self.obs), ("var", self.var)):
            if axis.rows.groupBy(KEY).count().where("count > 1").limit(1).count():
                raise ValueError(f"{side} keys repeat")
        def strangers(df, column, axis, what):
            if df.join(axis.rows.select(F.col(KEY).alias(column)), column, "left_anti").limit(1).count():
                raise ValueError(f"{what} has keys that its axis lacks")
        for k, m in self.elements.items():
            strangers(m.df, "o", self.obs, f"layer {k!r}")
            strangers(m.df, "v", self.var, f"layer {k!r}")
            if m.df.groupBy("o", "v").count().where("count > 1").limit(1).count():
                raise ValueError(f"layer {k!r} has a cell twice")
            if not m.sparse and m.df.count() != self.n_obs * self.n_vars:
                raise ValueError(f"dense layer {k!r} has not {self.n_obs} x {self.n_vars} cells")
        for axis, aligned, pairs in ((self.obs, self.obsm_, self.obsp_), (self.var, self.varm_, self.varp_)):
            for k, a in aligned.items():
                strangers(a.df, KEY, axis, k)
                if a.width is not None and a.df.where((F.size("value") != a.width) | F.col("value").isNull()).limit(1).count():
                    raise ValueError(f"{k!r} has rows of another width than {a.width}")
                if a.df.count() != axis.count():
                    raise ValueError(f"{k!r} has another number of rows than its axis")
            for k, p in pairs.items():
                strangers(p.df, "i", axis, k)
                strangers(p.df, "j", axis, k)
        return self

    # Shape and labels
    @property
    def n_obs(self) -> int:
        return self.obs.count()

    @property
    def n_vars(self) -> int:
        return self.var.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs, self.n_vars

    def __len__(self) -> int:
        return self.n_obs

    def names(self, side: str) -> DataFrame:
        return self.axis(side).rows.select(KEY, NAME)

    def axis(self, side: str) -> Axis:
        if side not in ("obs", "var"):
            raise ValueError(f"an axis is obs or var, not {side!r}")
        return getattr(self, side)

    # Elements, as this view sees them
    @property
    def X(self) -> Matrix | None:  # noqa: N802
        return self.layer(None) if None in self.elements else None

    def layer(self, key: str | None) -> Matrix:
        return self.elements[key].view(self.obs, self.var)

    @property
    def layers(self) -> dict[str | None, Matrix]:
        return {k: self.layer(k) for k in self.elements}

    @property
    def obsm(self) -> dict[str, Aligned]:
        return {k: a.view(self.obs) for k, a in self.obsm_.items()}

    @property
    def varm(self) -> dict[str, Aligned]:
        return {k: a.view(self.var) for k, a in self.varm_.items()}

    @property
    def obsp(self) -> dict[str, Pairs]:
        return {k: p.view(self.obs) for k, p in self.obsp_.items()}

    @property
    def varp(self) -> dict[str, Pairs]:
        return {k: p.view(self.var) for k, p in self.varp_.items()}

    @property
    def raw(self) -> Raw | None:
        if self.raw_ is None:
            return None
        return replace(self.raw_, x=self.raw_.x.view(self.obs, self.raw_.var), varm={k: a.view(self.raw_.var) for k, a in self.raw_.varm.items()})

    # Selection
    def __getitem__(self, index) -> Any:
        from gridlake.plans.refs import Ref

        if isinstance(index, Ref):
            return index.get(self)
        o, v = unpack(index)
        return replace(self, obs=self.obs.select(o), var=self.var.select(v))

    def __contains__(self, ref) -> bool:
        return ref.exists(self)

    def unused_categories_removed(self, side: str = "obs") -> Grid:
        """Drop categories that no row has, and their entries in a list `<column>_colors` of uns."""
        axis, uns, cats = self.axis(side), dict(self.uns), {}
        for c, old in axis.categories.items():
            cats[c] = axis.used_categories(c)
            uns |= self._colors(c, old, cats[c])
        return replace(self, uns=uns, **{side: replace(axis, categories=cats)})

    def _colors(self, column: str, old, used) -> dict[str, list]:
        """The entries of uns' list of colours that go with the categories used; a table of categories has no such list."""
        colors = self.uns.get(f"{column}_colors")
        fits = isinstance(old, Categories) and isinstance(colors, list) and len(colors) == len(old.values)
        return {f"{column}_colors": [x for x, v in zip(colors, old.values) if v in set(used.values)]} if fits else {}

    def realised(self) -> Grid:
        """This view as a grid in its own right: axes have just these rows, elements speak of their keys."""
        if self.obs.full and self.var.full:
            return self
        raw = self.raw
        obs, var, uns = self.obs.own(), self.var.own(), dict(self.uns)
        for old, new in ((self.obs, obs), (self.var, var)):
            for c in old.categories:
                uns |= self._colors(c, old.categories[c], new.categories[c])
        return replace(self, obs=obs, var=var, uns=uns, elements=self.layers, obsm_=self.obsm, varm_=self.varm, obsp_=self.obsp, varp_=self.varp,
                       raw_=raw and replace(raw, var=raw.var.own()))

    copy = realised

    # Functional setters; on a view they give a grid in its own right
    def with_column(self, side: str, name: str, value: Column | str) -> Grid:
        axis = self.axis(side)
        df = axis.df.withColumn(name, F.expr(value) if isinstance(value, str) else value)
        if certain(axis.df) and not certain(df):
            df = materialise(df)  # numbers are drawn once, whatever is read of the grid
        return replace(self, **{side: replace(axis, df=df)})

    def with_annotation(self, side: str, frame: DataFrame, key: str) -> Grid:
        """Left-align a frame's columns to an axis; rows it lacks get nulls."""
        axis = self.axis(side)
        add = frame.withColumnRenamed(key, KEY)
        double = [c for c in add.columns if c != KEY and c in axis.columns]
        if double:
            raise ValueError(f"columns exist already: {double}")
        once(frame, key)
        return replace(self, **{side: replace(axis, df=axis.df.join(add, KEY, "left"))})

    def without_columns(self, side: str, *names: str) -> Grid:
        axis = self.axis(side)
        return replace(self, **{side: replace(axis, df=axis.df.drop(*names), categories={k: v for k, v in axis.categories.items() if k not in names})})

    def with_names(self, side: str, frame: DataFrame, key: str, name: str) -> Grid:
        """Replace labels by a frame's; every row needs one."""
        axis = self.axis(side)
        once(frame, key)
        got = axis.df.drop(NAME).join(frame.select(F.col(key).alias(KEY), F.col(name).cast("string").alias(NAME), F.lit(True).alias("_hit")), KEY, "left")
        if got.where("_hit is null").limit(1).count():
            raise ValueError("the frame has not a label for every row")
        return replace(self, **{side: replace(axis, df=got.select(KEY, NAME, *axis.columns))})

    def with_layer(self, key: str | None, m: Matrix) -> Grid:
        g = self.realised()
        return replace(g, elements={**g.elements, (check_key(key) if key is not None else None): m})

    def without_layers(self, keep_x: bool = True) -> Grid:
        return replace(self, elements={k: m for k, m in self.elements.items() if keep_x and k is None})

    def with_element(self, slot: str, key: str, value) -> Grid:
        if slot not in ("obsm", "varm", "obsp", "varp"):
            raise ValueError(f"no slot {slot!r}")
        g = self.realised()
        return replace(g, **{slot + "_": {**getattr(g, slot + "_"), check_key(key): value}})

    def without_element(self, slot: str, key: str) -> Grid:
        return replace(self, **{slot + "_": {k: v for k, v in getattr(self, slot + "_").items() if k != key}})

    def with_uns(self, **values) -> Grid:
        return replace(self, uns={**self.uns, **values})

    def with_raw(self) -> Grid:
        """Keep the present matrix and var axis as raw."""
        g = self.realised()
        return replace(g, raw_=Raw(g.elements[None], g.var, dict(g.varm_)))

    def raw_grid(self) -> Grid:
        r = self.raw_
        if r is None:
            raise ValueError("no raw here")
        return Grid(self.obs, r.var, {None: r.x}, self.obsm_, dict(r.varm), self.obsp_, {}, self.uns)

    # Reshape and rename
    @property
    def T(self) -> Grid:  # noqa: N802
        """Axes and all slots change sides; raw goes."""
        return Grid(self.var, self.obs, {k: m.transposed() for k, m in self.elements.items()}, self.varm_, self.obsm_, self.varp_, self.obsp_, self.uns)

    def reindexed(self, side: str, names: list[str | None], fill: dict[str, Any] | None = None) -> Axis:
        """An axis for these labels, in order; columns of labels that are new here are null or filled."""
        return self.axis(side).reindexed(names, fill)

    def transpose(self) -> Grid:
        return self.T

    def to_df(self, layer: str | None = None, names: list[str] | None = None) -> DataFrame:
        """The matrix as a wide table: a column for each var label. Every obs row is there; absent sparse cells are 0.

        Wide tables need known columns: give the labels, or they are read from the var axis.
        """
        m = self.layer(layer)
        if names is None:
            names = [r[0] for r in self.var.rows.orderBy(KEY).select(NAME).collect()]  # they become columns
        cells = m.df.join(self.var.rows.select(F.col(KEY).alias("v"), F.col(NAME).alias("_var")), "v")
        wide = cells.select(F.col("o").alias(KEY), "_var", "value").groupBy(KEY).pivot("_var", names).agg(F.first("value"))  # a label may be called o
        out = self.obs.rows.select(KEY, NAME).join(wide, KEY, "left")
        return out.fillna(0, subset=names) if m.sparse else out

    def vector(self, side: str, key: str, layer: str | None = None) -> DataFrame:
        """(_key, _name, value) along one axis: an annotation column, or the other axis's label in a matrix."""
        from gridlake.plans.refs import A

        other = "var" if side == "obs" else "obs"
        column = key in self.axis(side).columns
        label = self.axis(other).rows.where(F.col(NAME) == key).limit(1).count() > 0
        if column and label:
            raise ValueError(f"{key!r} is both a column of {side} and a label of {other}")
        if not column and not label:
            raise KeyError(key)
        if column:
            return (A.obs if side == "obs" else A.var)[key].get(self)
        acc = A.X if layer is None else A.layers[layer]
        return (acc[:, key] if side == "obs" else acc[key, :]).get(self)

    def names_made_unique(self, side: str, join: str = "-") -> Grid:
        axis = self.axis(side)
        return replace(self, **{side: replace(axis, df=make_unique(axis.rows, NAME, KEY, join), window=None, dense=axis.dense and axis.window is None)})

    def categories_renamed(self, side: str, column: str, new: Mapping[str, str] | list[str]) -> Grid:
        axis = self.axis(side)
        old = axis.categories[column]
        if isinstance(old, Dictionary):
            if not isinstance(new, Mapping):
                raise TypeError("a table of categories is renamed by a mapping")
            table = F.create_map(*(F.lit(x) for kv in new.items() for x in kv)) if new else None
            df = axis.df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column))) if new else axis.df
            return replace(self, **{side: replace(axis, df=df, categories={**axis.categories, column: old.renamed(new)})})
        names = dict(zip(old.values, new)) if isinstance(new, list) else dict(new)
        if isinstance(new, list) and len(new) != len(old.values):
            raise ValueError(f"{len(new)} names for {len(old.values)} categories")
        table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        values = tuple(names.get(v, v) for v in old.values)
        if len(set(values)) != len(values):
            raise ValueError("categories would not be unique")
        uns = {
            k: {**v, "names": [names.get(x, x) for x in v["names"]]} if isinstance(v, dict) and v.get("params", {}).get("groupby") == column and isinstance(v.get("names"), list) else v
            for k, v in self.uns.items()
        }
        df = axis.df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
        return replace(self, uns=uns, **{side: replace(axis, df=df, categories={**axis.categories, column: Categories(values, old.ordered)})})

    def strings_categorised(self, side: str = "obs") -> Grid:
        """String columns with fewer values than rows become categories, in natural order."""
        axis = self.axis(side)
        text = [c for c, t in axis.df.dtypes if t == "string" and c != NAME and c not in axis.categories]
        if not text:
            return self
        n = axis.rows.agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(text))).first()
        found = {}
        for i, c in enumerate(text):
            if n[f"d{i}"] < n.n:
                every = Dictionary.of(axis.rows, c)
                small = n[f"d{i}"] <= settings().local_categories
                found[c] = Categories(tuple(sorted((r.value for r in every.table.select("value").collect()), key=natural_key))) if small else every
        return replace(self, **{side: replace(axis, categories={**axis.categories, **found})})

    # Chunks
    def chunked(self, size: int = 6000, layer: str | None = None) -> DataFrame:
        """The layer's cells with their chunk of rows: chunk, start, end, o, v, value."""
        n = self.n_obs
        m = self.layer(layer)
        if isinstance(m, Blocks):
            cells = m.chunked(size)
            rows = cells.select("chunk", "start", "end", F.posexplode("keys").alias("_i", "o"), "values")
            names = self.var.df.sparkSession.createDataFrame(list(enumerate(m.columns)), f"_p int, v {m._column_type()}")
            one = rows.select("chunk", "start", "end", "o", F.posexplode(F.slice("values", F.col("_i") * m.width + 1, F.lit(m.width))).alias("_p", "value"))
            return one.join(names, "_p").select("chunk", "start", "end", "o", "v", "value")
        at = with_positions(self.obs.rows.select(KEY)).select(F.col(KEY).alias("o"), F.floor(F.col(ORD) / size).alias("chunk"))
        return self.layer(layer).df.join(at, "o").select("chunk", (F.col("chunk") * size).alias("start"), F.least((F.col("chunk") + 1) * size, F.lit(n)).alias("end"), "o", "v", "value")

    def chunks(self, size: int = 6000) -> Iterator[tuple[Grid, int, int]]:
        for a in range(0, self.n_obs, size):
            z = min(a + size, self.n_obs)
            yield self[a:z], a, z

    def sample_rows(self, n: int = 1000, replace_: bool = True, seed: int = 0) -> Grid:
        """n random rows: with replacement by drawn positions, without by the smallest random numbers. A seed always draws the same."""
        total = self.n_obs
        n = min(n, total)
        spark = self.obs.df.sparkSession
        if replace_:
            draws = spark.range(n).select(F.col("id").alias("_new"), (drawn(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))) % total).alias(ORD))
            return replace(self, obs=self.obs._rekeyed(self.obs.positions().join(draws, ORD).drop(ORD), n))
        picked = self.obs.rows.orderBy(drawn(F.concat_ws(":", F.lit(str(seed)), F.to_json(F.struct(KEY)))), KEY).limit(n)
        return replace(self, obs=Axis(picked, False, self.obs.categories))

    # Comparison and description
    def equals(self, other: Grid) -> bool:
        """The same axes and the same values in every slot, uns and raw included."""
        slots = ("elements", "obsm_", "varm_", "obsp_", "varp_")
        if any(set(getattr(self, s)) != set(getattr(other, s)) for s in slots) or (self.raw_ is None) != (other.raw_ is None):
            return False
        if not all(same_rows(self.axis(s).rows.drop(FROM), other.axis(s).rows.drop(FROM)) for s in ("obs", "var")):
            return False
        if not all(self.layer(k).same_as(other.layer(k)) for k in self.elements):
            return False
        for s in ("obsm", "varm", "obsp", "varp"):
            a, b = getattr(self, s), getattr(other, s)
            if not all(getattr(a[k], "width", None) == getattr(b[k], "width", None) and same_rows(a[k].df, b[k].df) for k in a):
                return False
        if self.raw_ is not None:
            a, b = self.raw, other.raw
            if set(a.varm) != set(b.varm) or not same_rows(a.var.rows, b.var.rows) or not a.x.same_as(b.x) or not all(same_rows(a.varm[k].df, b.varm[k].df) for k in a.varm):
                return False
        return equal_maps(self.uns, other.uns)

    def to_memory(self) -> dict[str, Any]:
        """Every slot on the driver: pandas frames of the axes and of the elements (matrices as o, v, value). More than max_local_rows rows raise."""
        most = settings().max_local_rows

        def local(df: DataFrame, what: str):
            if df.limit(most + 1).count() > most:
                raise ValueError(f"{what} has more than {most} rows; raise max_local_rows to allow it")
            return df.toPandas()

        out: dict[str, Any] = {"obs": local(self.obs.rows.orderBy(KEY), "obs"), "var": local(self.var.rows.orderBy(KEY), "var"), "uns": dict(self.uns)}
        out["layers"] = {k: local(m.df, f"layer {k!r}") for k, m in self.layers.items()}
        for s in ("obsm", "varm", "obsp", "varp"):
            out[s] = {k: local(e.df, f"{s}/{k}") for k, e in getattr(self, s).items()}
        if self.raw_ is not None:
            out["raw"] = {"X": local(self.raw.x.df, "raw"), "var": local(self.raw.var.rows, "raw var")}
        return out

    def fold(self, f: Callable[[Any, str, str | None, Any], Any], start: Any) -> Any:
        """f(so far, slot, key, element) over the axes and every element."""
        got = f(f(start, "obs", None, self.obs), "var", None, self.var)
        for s in ("layers", "obsm", "varm", "obsp", "varp"):
            for k, e in getattr(self, s).items():
                got = f(got, s, k, e)
        return got

    def __eq__(self, other):
        raise NotImplementedError("== is not defined for grids; use equals()")

    __hash__ = None

    def sizes(self) -> dict[str, int]:
        """The optimizer's size estimate of each element, in bytes."""
        size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return {"obs": size(self.obs.df), "var": size(self.var.df)} | {f"layers/{k or 'X'}": size(m.df) for k, m in self.elements.items()} | {
            f"{s}/{k}": size(e.df) for s in ("obsm", "varm", "obsp", "varp") for k, e in getattr(self, s + "_").items()}

    def __repr__(self) -> str:
        lines = [f"Grid n_obs x n_vars = {self.n_obs} x {self.n_vars}"]
        parts = {"obs": self.obs.columns, "var": self.var.columns, "layers": [k for k in self.elements if k], "obsm": self.obsm_, "varm": self.varm_, "obsp": self.obsp_, "varp": self.varp_, "uns": self.uns}
        return "\n".join(lines + [f"    {k}: {', '.join(map(repr, v))}" for k, v in parts.items() if v])

    def pipe(self, f: Callable, *a, **k):
        return f(self, *a, **k)

    def uns_json(self) -> str:
        return json.dumps(self.uns, default=str, sort_keys=True)
