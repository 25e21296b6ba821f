"""Axes: the labelled rows and columns of a grid.

An axis is a DataFrame with a unique, orderable `_key` (its order is the axis's order), a label `_name` (which may
repeat or be null) and annotation columns. Matrices refer to keys, so a table's own key serves without renumbering;
positions are worked out only when an operation asks for them, and without a one-partition window.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.operators.dictionary import Dictionary
from gridlake.operators.index import Ranges, Taken
from gridlake.session import materialise, settings

KEY, NAME, ORD = "_key", "_name", "_ord"
#: Names under which a mapping may hold an axis's labels.
NAME_KEYS = ("obs_names", "var_names", "row_names", "col_names")
#: In an axis with new keys, the key that elements know a row by.
FROM = "_from"


@dataclass(frozen=True)
class Categories:
    """Category state of a string column: Spark has no enumeration type."""

    values: tuple[str, ...]
    ordered: bool = False


@dataclass(frozen=True)
class LabelIndex:
    """Where labels are: (bucket, _name, _key) frames, partitioned by a hash of the label, and how many buckets each has."""

    parts: tuple[tuple[DataFrame, int], ...]
    #: The axis's frame that it speaks of.
    of: DataFrame

    #: Keys that are a condition on the axis rather than a join.
    FEW = 1000

    def keys(self, names: list[str]) -> DataFrame:
        """(_key, _name) of rows with one of the labels; only their buckets are read."""
        found = None
        for df, n in self.parts:
            buckets = [F.pmod(F.xxhash64(F.lit(x)), F.lit(n)) for x in names]
            hit = df.where(F.col("bucket").isin(*buckets) & F.col(NAME).isin(*names)).select(KEY, NAME)
            found = hit if found is None else found.unionByName(hit)
        return found

    def rows(self, names: list[str]) -> DataFrame:
        """The axis's rows with one of the labels: by their keys, if these are few."""
        keys = self.keys(names)
        some = [r[0] for r in keys.select(KEY).limit(self.FEW + 1).collect()]
        return self.of.where(F.col(KEY).isin(*some)) if len(some) <= self.FEW else self.of.join(keys.select(KEY), KEY, "left_semi").select(*self.of.columns)


def certain(df: DataFrame) -> bool:
    """Are rows the same however often they are worked out: does nothing draw numbers or depend on how rows are dealt?"""
    return df._jdf.queryExecution().analyzed().deterministic()


def with_positions(df: DataFrame, order: str | list[str] = KEY, name: str = ORD) -> DataFrame:
    """Add 0-based positions in the order of a column, or of several.

    A range sort, then each partition's offset from the partition counts: no task sees more than its partition.
    The sorted rows are written once, so positions hold if a task runs again.
    """
    local = materialise(df.orderBy(order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = local.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()  # a row a partition
    starts = np.zeros(sizes[-1]["_p"] + 1 if sizes else 1, np.int64)
    starts[[r["_p"] for r in sizes]] = list(accumulate((r.n for r in sizes), initial=0))[:-1]
    start = F.split(F.lit(",".join(map(str, starts.tolist()))), ",").cast("array<bigint>")  # a constant, so that no row moves
    return local.withColumn(name, F.get(start, F.col("_p")) + F.col("_i")).drop("_p", "_i")


def marks(columns: list[Column]) -> tuple[Column, Column]:
    """Two sums of row hashes: whatever the order and however the rows are dealt, equal for equal multisets of rows."""
    return tuple(F.coalesce(F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(20,0)")), F.lit(0)) for seed in (1, 2))  # no overflow: the sum has ten digits more


def fingerprint(df: DataFrame) -> tuple:
    """Count and marks of a frame's rows, in one pass without moving them."""
    a, b = marks([F.col(f"`{c}`") for c in df.columns])
    return tuple(df.agg(F.count("*"), a, b).first())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """The same columns and the same rows, however often: by fingerprints, or row by row where types differ."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*(f"`{c}`" for c in a.columns))
    if a.dtypes == b.dtypes and "map<" not in str(a.dtypes):
        return fingerprint(a) == fingerprint(b)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def used_values(rows: DataFrame, column: str, known: tuple[str, ...]) -> set[str]:
    """Which of some values a column has: no more come to the driver than are there already."""
    values = rows.select(F.col(f"`{column}`").alias("value"))
    if len(known) <= 1000:
        found = values.where(F.col("value").isin(*known)) if known else values.where(F.lit(False))
    else:
        found = values.join(rows.sparkSession.createDataFrame([(v,) for v in known], "value string"), "value", "left_semi")
    return {r[0] for r in found.distinct().collect()}


#: A slice of so many first rows is taken without sorting all of them.
HEAD = 10_000


@dataclass(frozen=True)
class Axis:
    df: DataFrame
    #: Is this every row that elements may have? Then elements need no join.
    full: bool = True
    categories: dict[str, Categories | Dictionary] = field(default_factory=dict)
    #: A pending slice over `df`'s positions, composed without a job.
    window: range | None = None
    _n: int | None = None
    #: Of a concatenated axis: its label column, each source's label and the frame for which that holds; and the sources that a selection leaves.
    label: tuple[str, tuple[str, ...], DataFrame] | None = field(default=None, compare=False)
    sources: tuple[int, ...] | None = None
    #: Keys are the positions 0, 1, ... of all rows: nothing needs sorting.
    dense: bool = False
    #: Of a stored axis, where its labels are.
    labels: LabelIndex | None = field(default=None, repr=False, compare=False)
    #: The frame whose positions were worked out, and the result: axes over one frame share it.
    _sorted: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def of(df: DataFrame, key: str | Column, name: str | Column | None = None, columns: Iterable[str] | None = None, categories=None) -> Axis:
        """From a table: its key column, its label (the key as text unless given) and its annotation columns."""
        k = F.col(key) if isinstance(key, str) else key
        if settings().restrict_index_types and name is not None:
            kind = df.select(F.col(name) if isinstance(name, str) else name).dtypes[0][1]
            if kind in ("float", "double", "boolean") or kind.startswith(("array", "map", "struct", "binary")):
                raise TypeError(f"labels are text or whole numbers, not {kind}; cast them, or lift restrict_index_types")
        label = k.cast("string") if name is None else (F.col(name) if isinstance(name, str) else name).cast("string")
        used = [c for c in (key, name) if isinstance(c, str)]
        cols = list(columns) if columns is not None else [c for c in df.columns if c not in used]
        twice = sorted({c for c in cols if cols.count(c) > 1})
        if twice:
            raise ValueError(f"columns occur twice: {twice}")
        clash = [c for c in cols if c in (KEY, NAME)]
        if clash:
            raise ValueError(f"column names are reserved: {clash}")
        return Axis(df.select(k.alias(KEY), label.alias(NAME), *cols), categories=dict(categories or {}))

    @staticmethod
    def of_names(spark, names: list[str | None]) -> Axis:
        return Axis(spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"{KEY} long, {NAME} string"), _n=len(names), dense=True)

    @staticmethod
    def from_mapping(spark, columns: Mapping[str, Iterable], names: Iterable[str] | None = None) -> Axis:
        """From columns of values; labels are given, or stand under one of NAME_KEYS, or are the row numbers."""
        if not isinstance(columns, Mapping):
            raise TypeError(f"an axis needs named columns, not a {type(columns).__name__}")
        cols = {c: list(v) for c, v in columns.items()}
        for k in NAME_KEYS:
            if k in cols:
                names = cols.pop(k)
        sizes = {c: len(v) for c, v in cols.items()}
        names = [str(x) for x in (names if names is not None else range(next(iter(sizes.values()), 0)))]
        wrong = {c: n for c, n in sizes.items() if n != len(names)}
        if wrong:
            raise ValueError(f"{len(names)} rows, but columns of {wrong}")
        rows = [tuple(x) for x in zip(range(len(names)), names, *cols.values())]
        if not rows:
            return Axis.of_names(spark, [])
        return Axis(spark.createDataFrame(rows, [KEY, NAME, *cols]), _n=len(names))

    def __getitem__(self, columns: str | list[str]) -> DataFrame:
        """(_key, _name) and one or several annotation columns."""
        wanted = [columns] if isinstance(columns, str) else list(columns)
        missing = [c for c in wanted if c not in self.columns]
        if missing:
            raise KeyError(f"no columns {missing}")
        return self.rows.select(KEY, NAME, *wanted)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (KEY, NAME, FROM)]

    @property
    def rows(self) -> DataFrame:
        """The axis's rows, pending slice included."""
        w = self.window
        if w is None:
            return self.df
        if w.step < 0:
            raise ValueError("a reversed slice has new keys; take() it first")
        if w.start == 0 and w.step == 1 and w.stop <= HEAD:
            return self.df.orderBy(KEY).limit(w.stop)
        p = self.all_positions()
        inside = (F.col(ORD) >= w.start) & (F.col(ORD) < w.stop)
        return p.where(inside if w.step == 1 else inside & ((F.col(ORD) - w.start) % w.step == 0)).drop(ORD)

    def count(self) -> int:
        if self.window is not None:
            return len(self.window)
        if self._n is None:
            object.__setattr__(self, "_n", self.df.count())
        return self._n

    def labels_print(self) -> dict[str, Any]:
        """What tells the axis's labels from others': how many rows, how often a label at most, marks of the labels and of keys with labels.

        One job, whose result the axis keeps."""
        if self._sorted.get("print_of") is not self.df or self._sorted.get("print_window") != self.window:
            kind = dict(self.df.dtypes)[KEY]
            each = self.rows.groupBy(NAME).agg(F.count("*").alias("n"), *(m.alias(x) for m, x in zip(marks([F.col(KEY), F.col(NAME)]), "ab")))
            names = (F.coalesce(F.sum(F.col("n") * F.xxhash64(NAME, F.lit(seed)).cast("decimal(20,0)")), F.lit(0)) for seed in (3, 4))
            r = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), *names, F.sum("a"), F.sum("b")).first()
            self._sorted.update(print_of=self.df, print_window=self.window, print={"n": r[0], "most": r[1], "names": tuple(r[2:4]), "keys": (kind, *r[4:6])})
            object.__setattr__(self, "_n", r[0])
        return self._sorted["print"]

    def all_positions(self) -> DataFrame:
        """The frame's rows, before any slice, with positions; sorted once."""
        if self.dense:
            return self.df.withColumn(ORD, F.col(KEY).cast("long"))
        if self._sorted.get("of") is not self.df:
            self._sorted.update(of=self.df, rows=self.df.join(with_positions(self.df.select(KEY)), KEY))  # keys alone are sorted and written
        return self._sorted["rows"]

    def positions(self) -> DataFrame:
        return self.all_positions() if self.window is None else self.rows.join(with_positions(self.rows.select(KEY)), KEY)

    # Selection
    def sliced(self, s: slice) -> Axis:
        """Positions, as Python slices them; slices of slices compose on the driver."""
        base = self.window if self.window is not None else range(self.count())
        w = base[s]
        if w.step < 0:
            inside = F.col(ORD).between(w[-1], w[0]) & ((F.lit(w.start) - F.col(ORD)) % -w.step == 0) if len(w) else F.lit(False)
            found = self.all_positions().where(inside).withColumn("_new", F.floor((F.lit(w.start) - F.col(ORD)) / -w.step))
            return self._rekeyed(found.drop(ORD), len(w))
        return replace(self, window=w, full=False, _n=None)

    def taken_positions(self, positions: Iterable[int] | Taken) -> Axis:
        """Rows by position, in that order, repeats allowed: they get new keys, and remember the old as `_from`.

        A list or array goes out as a column; a frame never comes to the driver."""
        n = self.count()
        spark = self.df.sparkSession
        base = self.window or range(n)
        if isinstance(positions, Taken):
            ends = positions.frame.agg(F.min("at").alias("a"), F.max("at").alias("z"), F.count("*").alias("n")).first()
            if ends.n and not (-n <= ends.a and ends.z < n):
                raise IndexError(f"positions out of range for {n} rows: {[x for x in (ends.a, ends.z) if not -n <= x < n]}")
            size = ends.n
            want = positions.frame.select(F.col("new").alias("_new"), (F.lit(base.start) + base.step * F.when(F.col("at") < 0, F.col("at") + n).otherwise(F.col("at"))).alias(ORD))
        else:
            at = np.fromiter(positions, np.int64)
            wrong = at[(at < -n) | (at >= n)]
            if len(wrong):
                raise IndexError(f"positions out of range for {n} rows: {wrong[:10].tolist()}")
            size = len(at)
            want = spark.createDataFrame(pd.DataFrame({"_new": np.arange(size), ORD: base.start + base.step * np.where(at < 0, at + n, at)}), f"_new long, {ORD} long")
        return self._rekeyed(self.all_positions().join(want, ORD).drop(ORD), size)

    def _rekeyed(self, found: DataFrame, size: int | None = None) -> Axis:
        """found: rows with _new. size: their number, if _new counts from 0."""
        kept = [c for c in found.columns if c not in (KEY, "_new", FROM)]
        # elements speak of the root's keys; a second take goes through the first one's `_from`
        source = FROM if FROM in found.columns else KEY
        df = found.select(F.col("_new").alias(KEY), *(c for c in kept if c == NAME), *(c for c in kept if c != NAME), F.col(source).alias(FROM))
        return Axis(df, False, self.categories, None, size, dense=size is not None)

    def labelled(self, names: list[str]) -> Axis:
        """Rows by label, in that order. Labels must exist, and must not repeat on the axis."""
        spark = self.df.sparkSession
        want = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"_new long, {NAME} string")
        few = self._indexed() and len(set(names)) <= LabelIndex.FEW and None not in names
        found = (self.labels.rows(list(dict.fromkeys(names))) if few else self.rows).join(want, NAME)
        seen = found.groupBy("_new").agg(F.count("*").alias("n"))
        state = want.join(seen, "_new", "left").where("n is null or n > 1").limit(20).collect()
        missing = sorted({r[NAME] for r in state if r.n is None})
        if missing:
            raise KeyError(f"labels not found: {missing}")
        if state:
            raise ValueError(f"labels repeat on this axis, select by position: {sorted({r[NAME] for r in state})}")
        return self._rekeyed(found)

    def reindexed(self, names: list[str | None], fill: dict[str, Any] | None = None) -> Axis:
        """A row for each label, in that order and new ones too, whose columns are null or filled. Labels must not repeat on the axis."""
        spark = self.df.sparkSession
        if self.repeated().limit(1).count():
            raise ValueError("labels repeat on this axis; make them unique first")
        want = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"_new long, {NAME} string")
        have = self.rows.drop(KEY, FROM).withColumnRenamed(NAME, "_had").withColumn("_hit", F.lit(True))
        found = want.join(have, F.col(NAME).eqNullSafe(F.col("_had")), "left")
        cols = [F.when(F.col("_hit").isNull(), F.lit((fill or {}).get(c)).cast(t)).otherwise(F.col(c)).alias(c) for c, t in self.df.select(*self.columns).dtypes]
        return Axis(found.select(F.col("_new").alias(KEY), NAME, *cols), True, self.categories, None, len(names))

    def named(self, name: str) -> Axis:
        """Every row with one label. On a stored axis the index tells which, and one bucket of it is read."""
        if self._indexed():
            rows = self.labels.rows([name])
            if rows.limit(1).count() == 0:
                raise KeyError(name)
            return Axis(rows, False, self.categories)
        if self.rows.where(F.col(NAME) == name).limit(1).count() == 0:
            raise KeyError(name)
        return self.where(F.col(NAME) == name)

    def _indexed(self) -> bool:
        """Does the index speak of these very rows?"""
        return self.labels is not None and self.labels.of is self.df and self.window is None

    def name_slice(self, start: str | None, stop: str | None, step: int | None) -> Axis:
        """From one label to another, the last included."""
        if self._indexed() and step in (None, 1) and not (start is None and stop is None):
            ends = {r[NAME]: (r.lo, r.hi) for r in self.labels.keys([x for x in (start, stop) if x is not None]).groupBy(NAME).agg(F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).collect()}
            for x in (start, stop):
                if x is not None and x not in ends:
                    raise KeyError(x)
            inside = F.lit(True) if start is None else F.col(KEY) >= F.lit(ends[start][0])  # an axis's order is that of its keys
            inside = inside if stop is None else inside & (F.col(KEY) <= F.lit(ends[stop][1]))
            return Axis(self.df.where(inside), False, self.categories)
        p = self.positions()
        at = {r[NAME]: (r.lo, r.hi) for r in p.where(F.col(NAME).isin([x for x in (start, stop) if x is not None])).groupBy(NAME).agg(F.min(ORD).alias("lo"), F.max(ORD).alias("hi")).collect()}
        for x in (start, stop):
            if x is not None and x not in at:
                raise KeyError(x)
        return self.sliced(slice(at[start][0] if start is not None else None, at[stop][1] + 1 if stop is not None else None, step))

    def where(self, condition: Column | str) -> Axis:
        found = self.rows.where(condition)
        if not certain(found):
            # Numbers are drawn once for each selection, from rows that are dealt alike for all: elements agree, and a condition and its opposite leave the whole
            try:
                found = self._dealt().where(condition)
            except AnalysisException:  # it names a column that the axis itself doesn't have
                pass
            found = materialise(found)
            return Axis(found, False, self.categories, label=self.label and (*self.label[:2], found) if self._labels_hold() else None, sources=self.sources)
        left = self._sources_left(condition, found)
        if left is not None and left != self.sources:
            found = self.rows.where(F.col(f"{KEY}.src").isin(*left)).where(condition)
        label = self.label and (*self.label[:2], found) if self._labels_hold() else None
        return Axis(found, False, self.categories, label=label, sources=left)

    def _dealt(self) -> DataFrame:
        """The axis's rows in partitions and an order that stay; axes over one frame share them."""
        if self._sorted.get("dealt_of") is not self.df or self._sorted.get("dealt_window") != self.window:
            self._sorted.update(dealt_of=self.df, dealt_window=self.window, dealt=materialise(self.rows))
        return self._sorted["dealt"]

    def _labels_hold(self) -> bool:
        """Is the label column still the one that the concatenation made? Setters give the axis another frame."""
        return self.label is not None and self.label[2] is self.df and self.window is None

    def _sources_left(self, condition: Column | str, found: DataFrame) -> tuple[int, ...] | None:
        """Sources of a concatenation that a condition on its label alone leaves; others need not be scanned at all.

        found: the rows that the condition leaves. Whatever speaks of another column, or draws numbers, leaves all sources.
        """
        if not self._labels_hold():
            return self.sources
        name, values, _ = self.label
        plan = found._jdf.queryExecution().analyzed()
        test = plan.condition()
        spoken = test.references().iterator()
        ids = set()
        while spoken.hasNext():
            ids.add(spoken.next().exprId().toString())
        own = next(a for a in (plan.child().output().apply(i) for i in range(plan.child().output().size())) if a.name() == name)
        if ids != {own.exprId().toString()} or not test.deterministic():
            return self.sources
        labels = self.df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"`{name}` string")
        try:
            hit = {r[0] for r in labels.where(condition).collect()}  # a row a source
        except AnalysisException:  # it names the column through another frame
            return self.sources
        return tuple(i for i, v in enumerate(values) if v in hit and (self.sources is None or i in self.sources))

    def masked(self, mask: Any) -> Axis:
        if len(mask) != self.count():
            raise IndexError(f"mask has length {len(mask)}, axis has {self.count()}")
        return self.ranged(Ranges.of_mask(mask))

    def ranged(self, at: Ranges) -> Axis:
        """Rows at a set of positions, in the axis's order, with their keys."""
        n = self.count()
        if len(at.starts) and (at.starts[0] < 0 or at.stops[-1] > n):
            raise IndexError(f"positions out of range for {n} rows")
        here = at if self.window is None else at.within(self.window)
        return Axis(here.rows(self.all_positions(), ORD).drop(ORD), False, self.categories, None, len(at), label=None, sources=self.sources)

    def matching(self, keys: DataFrame) -> Axis:
        """Rows whose key is in the first column of a DataFrame: a distributed mask."""
        k = keys.columns[0]
        return Axis(self.rows.join(keys.select(F.col(k).alias(KEY)), KEY, "left_semi"), False, self.categories)

    def select(self, index: Any) -> Axis:
        """One dispatcher for every kind of indexer."""
        if isinstance(index, Column):
            return self.where(index)
        if isinstance(index, DataFrame):
            return self.matching(index)
        if isinstance(index, Ranges):
            return self.ranged(index)
        if isinstance(index, Taken):
            return self.taken_positions(index)
        if hasattr(index, "df") and hasattr(index, "sparse"):  # a matrix of one column: rows with a true (or other than zero) cell
            return self.matching(index.df.where(F.col("value").cast("boolean")).select("o").distinct())
        if hasattr(index, "toarray"):  # a sparse mask of one row or column
            index = index.toarray()
        if hasattr(index, "to_numpy"):
            index = index.to_numpy()
        if hasattr(index, "ravel") and hasattr(index, "dtype"):  # numpy: (n, 1) and (1, n) count as n
            if index.ndim > 1 and max(index.shape) != index.size:
                raise IndexError(f"index has shape {index.shape}")
            index = index.ravel()
            if index.dtype.kind == "b":
                return self.masked(index)
            if index.dtype.kind in "iu" and len(index):
                return self.taken_positions(index)
            index = index.tolist()
        if index is Ellipsis:
            return self
        if isinstance(index, slice):
            parts = (index.start, index.stop)
            if index == slice(None):
                return self
            if any(isinstance(x, str) for x in parts):
                return self.name_slice(*parts, index.step)
            return self.sliced(index)
        if isinstance(index, bool):
            raise IndexError("a single boolean is no index")
        if isinstance(index, int):
            n = self.count()
            if not -n <= index < n:
                raise IndexError(f"position {index} out of range for {n} rows")
            index %= n
            return self.sliced(slice(index, index + 1))
        if isinstance(index, str):
            return self.named(index)
        if isinstance(index, (list, tuple, range)):
            index = list(index)
            if not index:
                return self.where(F.lit(False))
            kinds = {type(x) for x in index}
            if kinds == {bool}:
                return self.masked(index)
            if kinds == {str}:
                return self.labelled(index)
            if kinds <= {int, float} and bool not in kinds:
                if any(float(x) != int(x) for x in index):
                    raise IndexError("fractional positions")
                return self.taken_positions(np.array(index).astype(np.int64))
        raise IndexError(f"unknown indexer: {type(index).__name__}")

    def own(self) -> Axis:
        """This selection as an axis in its own right."""
        if self.full and self.window is None:
            return self
        categories = self.categories
        if categories and settings().remove_unused_categories:
            categories = {c: self.used_categories(c) for c in categories}
        return Axis(self.rows.drop(FROM), True, categories)

    # Links from elements to this axis
    def keep(self, element: DataFrame, column: str) -> DataFrame:
        """Rows of an element whose key the axis has, with the axis's own keys."""
        if self.full:
            return element
        if self.sources is not None and FROM not in self.df.columns:
            element = element.where(F.col(f"{column}.src").isin(*self.sources))
        if FROM in self.df.columns:
            link = self.rows.select(F.col(FROM).alias(column), F.col(KEY).alias("_to"))
            names = [F.col("_to").alias(c) if c == column else F.col(c) for c in element.columns]
            return element.join(link, column).select(*names)
        return element.join(self.rows.select(F.col(KEY).alias(column)), column, "left_semi").select(*element.columns)

    def repeated(self) -> DataFrame:
        """Labels that occur more than once, and how often."""
        return self.rows.groupBy(NAME).agg(F.count("*").alias("n")).where("n > 1")

    def used_categories(self, column: str) -> Categories | Dictionary:
        """The categories of a column that still occur, in their order; a column without categories has those that Dictionary.of() gives it."""
        cats = self.categories.get(column)
        if cats is None:
            return Dictionary.of(self.rows, column)
        if isinstance(cats, Dictionary):
            return cats.kept(self.rows, column)
        used = used_values(self.rows, column, cats.values)
        return Categories(tuple(x for x in cats.values if x in used), cats.ordered)
