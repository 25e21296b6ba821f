"""References: a small language that names any vector of a grid, from Python, from a string or from JSON."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, NAME, Axis
from gridlake.operators.grid import Grid

ALL = slice(None)


@dataclass(frozen=True)
class Ref:
    """One vector (or matrix): where it is, and which axes it runs along."""

    slot: str  # layers, obs, var, obsm, varm, obsp, varp
    key: str | None
    index: tuple | int | str | None

    @property
    def dims(self) -> tuple[str, ...]:
        if self.slot in ("obs", "var"):
            return (self.slot,)
        axes = {"layers": ("obs", "var"), "obsm": ("obs",), "varm": ("var",), "obsp": ("obs", "obs"), "varp": ("var", "var")}[self.slot]
        return tuple(a for a, i in zip(axes, self.index) if i == ALL) if isinstance(self.index, tuple) else axes

    def __hash__(self) -> int:
        return hash(repr(self))

    def __repr__(self) -> str:
        show = lambda i: ":" if i == ALL else repr(i)
        if self.slot in ("obs", "var"):
            return f"A.{self.slot}.index" if self.index is None else f"A.{self.slot}[{self.index!r}]"
        where = "A.X" if self.slot == "layers" and self.key is None else f"A.{self.slot}[{self.key!r}]"
        return f"{where}[{', '.join(map(show, self.index))}]" if isinstance(self.index, tuple) else f"{where}[:, {self.index!r}]"

    def exists(self, g: Grid) -> bool:
        if self.slot in ("obs", "var"):
            return self.index is None or self.index in g.axis(self.slot).columns
        store = g.elements if self.slot == "layers" else getattr(g, self.slot + "_")
        if self.key not in store:
            return False
        if not isinstance(self.index, tuple):
            width = store[self.key].width
            return width is None or -width <= self.index < width
        sides = ("obs", "var") if self.slot == "layers" else (self.slot[:3],) * 2
        return all(i == ALL or g.axis(s).rows.where(F.col(NAME) == i).limit(1).count() > 0 for s, i in zip(sides, self.index))

    def get(self, g: Grid) -> DataFrame:
        """(_key, _name, value) along the vector's axis; a whole matrix gives its cells."""
        if self.slot in ("obs", "var"):
            axis = g.axis(self.slot)
            if self.index is not None and self.index not in axis.columns:
                raise KeyError(self.index)
            return axis.rows.select(KEY, NAME, F.col(NAME if self.index is None else self.index).alias("value"))
        if self.slot in ("obsm", "varm"):
            side = self.slot[:3]
            return g.axis(side).rows.select(KEY, NAME).join(getattr(g, self.slot)[self.key].column(self.index), KEY, "left").select(KEY, NAME, "value")
        if self.slot == "layers":
            m = g.layer(self.key)
            return _line(m.df, ("o", "v"), self.index, (g.obs, g.var), m.sparse)
        axis = g.axis(self.slot[:3])
        return _line(getattr(g, self.slot)[self.key].df, ("i", "j"), self.index, (axis, axis), True)


def _line(cells: DataFrame, columns, index, axes: tuple[Axis, Axis], sparse: bool) -> DataFrame:
    if all(i == ALL for i in index):
        return cells
    at = 0 if index[0] != ALL else 1
    label, own, along = columns[at], columns[1 - at], axes[1 - at]
    if index[1 - at] != ALL:
        raise IndexError("one label and one full slice")
    chosen = axes[at].rows.where(F.col(NAME) == index[at]).select(F.col(KEY).alias(label))
    line = cells.join(chosen, label, "left_semi").select(F.col(own).alias(KEY), "value")
    value = F.coalesce("value", F.lit(0)) if sparse else F.col("value")
    return along.rows.select(KEY, NAME).join(line, KEY, "left").select(KEY, NAME, value.alias("value"))


def _check_index(i: Any) -> tuple:
    if not isinstance(i, tuple) or len(i) != 2 or any(not isinstance(x, str) and x != ALL for x in i):
        raise IndexError("a label or a full slice for each of two axes")
    if all(isinstance(x, str) for x in i):
        raise IndexError("one of the two must be a full slice")
    return i


def _expand(i: Any):
    """One list among the indexers makes a list of references."""
    parts = i if isinstance(i, tuple) else (i,)
    lists = [k for k, x in enumerate(parts) if isinstance(x, list)]
    if len(lists) > 1:
        raise IndexError("at most one list")
    if not lists:
        return None
    k = lists[0]
    return [tuple(x if m == k else p for m, p in enumerate(parts)) for x in parts[k]]


@dataclass(frozen=True)
class Whole:
    """A whole layer, array or graph."""

    slot: str
    key: str | None = None

    def __getitem__(self, i):
        many = _expand(i)
        if many is not None:
            return [self[x if len(x) > 1 else x[0]] for x in many]
        if self.slot in ("obsm", "varm"):
            if isinstance(i, tuple):
                if len(i) != 2 or i[0] != ALL:
                    raise IndexError("a full slice and a place")
                i = i[1]
            if not isinstance(i, int):
                raise IndexError("a place is an integer")
            return Ref(self.slot, self.key, i)
        return Ref(self.slot, self.key, _check_index(i))

    def __repr__(self) -> str:
        return "A.X" if self.slot == "layers" and self.key is None else f"A.{self.slot}[{self.key!r}]"


@dataclass(frozen=True)
class Slot:
    slot: str

    def __getitem__(self, key):
        return Whole(self.slot, key)


@dataclass(frozen=True)
class Meta:
    slot: str

    @property
    def index(self) -> Ref:
        return Ref(self.slot, None, None)

    def __getitem__(self, column):
        if isinstance(column, list):
            return [self[c] for c in column]
        return Ref(self.slot, None, column)


class Root:
    X = Whole("layers")
    layers = Slot("layers")
    obs, var = Meta("obs"), Meta("var")
    obsm, varm, obsp, varp = (Slot(s) for s in ("obsm", "varm", "obsp", "varp"))

    def resolve(self, text: str, *, strict: bool = True, vec: bool | None = None) -> Ref | Whole | None:
        """From a string: X[:,g], layers.k[o,:], obs.c, obsm.k.0, obsp.k[a,:], or a whole X, layers.k, obsm.k, obsp.k."""
        try:
            found = self._parse(text)
            if vec is not None and isinstance(found, Ref) != vec:
                raise ValueError(f"{text!r} names a {'vector' if isinstance(found, Ref) else 'whole element'}")
            return found
        except ValueError:
            if strict:
                raise
            return None

    def _parse(self, text: str) -> Ref | Whole:
        m = re.fullmatch(r"(?:X|(?P<slot>layers|obsp|varp)\.(?P<key>[^\[\]]+?))(?:\[(?P<i>[^,\]]*),(?P<j>[^,\]]*)\])?", text)
        if m:
            whole = Whole(m["slot"] or "layers", m["key"])
            if m["i"] is None:
                return whole
            part = lambda s: ALL if s.strip() == ":" else s.strip()
            try:
                return whole[part(m["i"]), part(m["j"])]
            except IndexError as e:
                raise ValueError(str(e)) from None
        m = re.fullmatch(r"(?P<slot>obsm|varm)\.(?P<key>.+?)(?:\.(?P<i>-?\d+))?", text)
        if m:
            whole = Whole(m["slot"], m["key"])
            return whole if m["i"] is None else whole[int(m["i"])]
        m = re.fullmatch(r"(obs|var)\.(.+)", text)
        if m:
            return Ref(m[1], None, None if m[2] == "index" else m[2])
        raise ValueError(f"cannot read {text!r}")

    def to_json(self, ref: Ref) -> list:
        plain = lambda i: None if i == ALL else i
        if ref.slot in ("obs", "var"):
            return [ref.slot, ref.index]
        return [ref.slot, ref.key, *(map(plain, ref.index) if isinstance(ref.index, tuple) else [ref.index])]

    def from_json(self, data: list) -> Ref:
        full = lambda i: ALL if i is None else i
        match data:
            case [("obs" | "var") as slot, (str() | None) as c]:
                return Ref(slot, None, c)
            case [("obsm" | "varm") as slot, str(k), int(i)]:
                return Ref(slot, k, i)
            case ["layers", (str() | None) as k, i, j]:
                return Whole("layers", k)[full(i), full(j)]
            case [("obsp" | "varp") as slot, str(k), i, j]:
                return Whole(slot, k)[full(i), full(j)]
        raise ValueError(f"cannot read {data!r}")


A = Root()
