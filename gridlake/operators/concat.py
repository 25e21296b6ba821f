"""Concatenation that keeps axes aligned: a union along one axis, a join of labels along the other."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.names import natural_key
from gridlake.operators.axis import KEY, NAME, ORD, Axis, Categories, same_rows
from gridlake.operators.blocks import Blocks, stacked
from gridlake.operators.dictionary import Dictionary
from gridlake.operators.element import Aligned, Fill, Filled, Matrix, Pairs
from gridlake.operators.grid import Grid, Raw
from gridlake.operators.merge import MISSING, RULES, merge_maps, shared_keys, union_keys
from gridlake.operators.ragged import alike
from gridlake.session import settings

AXES = {"obs": "obs", 0: "obs", "var": "var", 1: "var"}


def other_side(side: str) -> str:
    return "var" if side == "obs" else "obs"


def _union(frames: list[DataFrame], missing: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def _source_key(i: int, column: str):
    return F.struct(F.lit(i).alias("src"), F.col(column).alias("key"))


def unified_categories(axes: list[Axis], column: str) -> Categories | Dictionary | None:
    """Categories of a concatenated column: the union in natural order; ordered only if all are the same; none if
    an input that has the column has no categories for it."""
    having = [a for a in axes if column in a.columns]
    cats = [a.categories.get(column) for a in having]
    if not cats or any(c is None for c in cats):
        return None
    if any(isinstance(c, Dictionary) for c in cats):
        tables = [c if isinstance(c, Dictionary) else Dictionary.of_values(axes[0].df.sparkSession, c.values, c.ordered) for c in cats]
        if any(t.ordered for t in tables):
            return tables[0] if all(tables[0].same_as(t) for t in tables[1:]) else None
        return tables[0] if all(t is tables[0] for t in tables) else tables[0].union(*tables[1:])
    if all(c == cats[0] for c in cats):
        return cats[0]
    if any(c.ordered for c in cats):
        return None
    return Categories(tuple(sorted({v for c in cats for v in c.values}, key=natural_key)))


def concat_axis(axes: list[Axis], join: str, label: str | None, keys: list[str], index_unique: str | None) -> Axis:
    for a in axes:
        double = {c for c in a.columns if a.columns.count(c) > 1}
        if double:
            raise ValueError(f"columns occur twice: {sorted(double)}")
    columns = shared_keys([dict.fromkeys(a.columns) for a in axes]) if join == "inner" else union_keys([dict.fromkeys(a.columns) for a in axes])
    parts = []
    for i, (a, k) in enumerate(zip(axes, keys)):
        name = F.col(NAME) if index_unique is None else F.concat(F.col(NAME), F.lit(index_unique), F.lit(k))
        tag = [F.lit(k).alias(label)] if label else []
        parts.append(a.rows.select(_source_key(i, KEY).alias(KEY), name.alias(NAME), *(c for c in columns if c in a.columns and c != label), *tag))
    cats = {c: u for c in columns if (u := unified_categories(axes, c))}
    if label:
        cats[label] = Categories(tuple(keys))
    df = _union(parts).select(KEY, NAME, *(c for c in columns if c != label), *([label] if label else []))
    return Axis(df, True, cats, label=(label, tuple(keys), df) if label else None)


def same_labels(a: Axis, b: Axis) -> str | None:
    """`keys` if two axes have the same labels under the same keys, `order` if they have the same labels in the same order."""
    x, y = a.labels_print(), b.labels_print()
    if x["names"] != y["names"] or x["n"] != y["n"]:
        return None
    if x["keys"] == y["keys"]:
        return "keys"
    places = a.positions().select(NAME, F.col(ORD).alias("_a")).join(b.positions().select(NAME, F.col(ORD).alias("_b")), NAME)
    return "order" if not places.where("_a <> _b").limit(1).count() else None


def aligned_axis(axes: list[Axis], join: str) -> tuple[Axis, list[DataFrame | None]]:
    """The other axis's labels, and for each input a map from its keys to the new ones (none where they are the same).

    inner: labels that all have, in the first input's order; outer: all labels, sorted unless the inputs have the same ones in the same order.
    """
    if all(a is axes[0] or a.df is axes[0].df and a.full and axes[0].full for a in axes):
        return Axis(axes[0].rows.select(KEY, NAME), True), [None] * len(axes)
    for a in axes:
        if settings().check_uniqueness and a.labels_print()["most"] > 1:
            raise ValueError("labels repeat on the axis that is joined; make them unique first")
    alike = [same_labels(axes[0], a) for a in axes[1:]]
    if all(x == "keys" for x in alike):
        return Axis(axes[0].rows.select(KEY, NAME), True), [None] * len(axes)
    if all(alike):
        join = "inner"
    names = [a.rows.select(NAME) for a in axes]
    if join == "inner":
        common = reduce(lambda x, y: x.join(y, NAME, "left_semi"), names)
        first = axes[0].rows.select(KEY, NAME).join(common, NAME, "left_semi")
        new = Axis(first.select(KEY, NAME), True)
    else:
        every = reduce(lambda x, y: x.union(y), names).distinct()
        new = Axis(every.select(F.col(NAME).alias(KEY), F.col(NAME)), True)
    maps = []
    for i, a in enumerate(axes):
        if join == "outer":
            maps.append(a.rows.select(F.col(KEY).alias("_old"), F.col(NAME).alias("_new")))
        elif i == 0:
            maps.append(new.df.select(F.col(KEY).alias("_old"), F.col(KEY).alias("_new")))
        else:
            maps.append(a.rows.select(F.col(KEY).alias("_old"), NAME).join(new.df.select(F.col(KEY).alias("_new"), NAME), NAME).select("_old", "_new"))
    return new, maps


def _mapped(df: DataFrame, column: str, to: DataFrame | None) -> DataFrame:
    if to is None:
        return df
    return df.join(to.withColumnRenamed("_old", column), column).select(*(F.col("_new").alias(c) if c == column else F.col(c) for c in df.columns))


def default_fill(matrices: list[Matrix | None]) -> float:
    """0 if any input is sparse, NaN otherwise."""
    return 0.0 if any(m is not None and m.sparse for m in matrices) else float("nan")


def _from_source(i: int):
    return lambda k: F.struct(F.lit(i).alias("src"), k.alias("key"))


def concat_blocks(ms: list[Blocks], maps, new: Axis, fill: float | None) -> Blocks:
    """Dense inputs that are blocks, along obs: columns are rewritten where they lie, rows are a union. Columns are as many as a row has values."""
    columns = [r[0] for r in new.rows.orderBy(KEY).select(KEY).collect()]
    parts = []
    for m, to in zip(ms, maps):
        names = {} if to is None else dict(map(tuple, to.select("_old", "_new").collect()))
        renamed = m if to is None else replace(m, columns=tuple(names.get(c, (None, i)) for i, c in enumerate(m.columns)))  # those that go get a name of their own
        parts.append(renamed.reindexed(columns, float("nan") if fill is None else fill))
    return stacked(parts, [_from_source(i) for i in range(len(ms))])


def concat_matrices(ms: list[Matrix | None], grids: list[Grid], side: str, maps, new: Axis, fill: float | None) -> Matrix | Blocks:
    if side == "obs" and all(isinstance(m, Blocks) for m in ms):
        return concat_blocks(ms, maps, new, fill)
    along, across = ("o", "v") if side == "obs" else ("v", "o")
    sparse = any(m is not None and m.sparse for m in ms)
    value = default_fill(ms) if fill is None else fill
    parts, fills = [], []
    for i, (m, g) in enumerate(zip(ms, grids)):
        if m is not None:
            parts.append(_mapped(m.df, across, maps[i]).withColumn(along, _source_key(i, along)).select("o", "v", "value"))
        if value == 0 and sparse:
            continue  # absent cells are zero already
        absent = new.df.select(F.col(KEY).alias(across))
        if m is not None and maps[i] is not None:
            absent = absent.join(maps[i].select(F.col("_new").alias(across)), across, "left_anti")
        if m is None or maps[i] is not None:
            mine = g.axis(side).rows.select(_source_key(i, KEY).alias(along))
            fills.append(Fill(mine, absent, value) if along == "o" else Fill(absent, mine, value))
    return Filled(_union(parts), sparse, tuple(fills)) if fills else Matrix(_union(parts), sparse)


def _common_fields(have: list[Aligned | None], join: str) -> list[Aligned | None]:
    """Values of any length with one type: at every depth the fields that all have (inner) or any has (outer, null where one lacks it)."""
    if len({str(a.df.schema["value"].dataType) for a in have if a is not None}) == 1:
        return have
    return [a and replace(a, df=df) for a, df in zip(have, alike([a and a.df for a in have], join))]


def concat_aligned(slots: list[dict[str, Aligned]], axes: list[Axis], join: str, fill: float | None) -> dict[str, Aligned]:
    out = {}
    for k in shared_keys(slots) if join == "inner" else union_keys(slots):
        have = [s.get(k) for s in slots]
        widths = [a.width for a in have if a is not None]
        fixed = all(w is not None for w in widths)
        if not fixed and any(w is not None for w in widths):
            raise ValueError(f"{k!r} mixes arrays of fixed and of any length")
        kinds = {a.df.schema["value"].dataType.typeName() for a in have if a is not None}
        if len(kinds) > 1:
            raise ValueError(f"{k!r} mixes {' and '.join(sorted(kinds))}")
        have = have if fixed else _common_fields(have, join)
        width = (min if join == "inner" else max)(widths) if fixed else None
        value = float("nan") if fill is None else fill
        parts = []
        for i, (a, axis) in enumerate(zip(have, axes)):
            if a is None:
                filled = F.array_repeat(F.lit(value).cast("double"), width) if fixed else F.lit(None)
                parts.append(axis.rows.select(_source_key(i, KEY).alias(KEY), filled.alias("value")))
            else:
                a = a if not fixed or a.width == width else a.resized(width, value)
                parts.append(a.df.select(_source_key(i, KEY).alias(KEY), "value"))
        out[k] = Aligned(_union(parts), width)
    return out


def concat_pairs(slots: list[dict[str, Pairs]], join: str) -> dict[str, Pairs]:
    """Block-diagonal graphs."""
    out = {}
    for k in shared_keys(slots) if join == "inner" else union_keys(slots):
        out[k] = Pairs(_union([s[k].df.select(_source_key(i, "i").alias("i"), _source_key(i, "j").alias("j"), "value") for i, s in enumerate(slots) if k in s]))
    return out


def merge_columns(axes: list[Axis], new: Axis, maps, rule: str | Callable | None) -> Axis:
    """Annotation of the joined axis. Columns are compared after alignment, so a value against a missing label differs.

    A callable gets a mapping of names to columns for each input, aligned, and returns one mapping."""
    if rule is None:
        return new
    names = [dict.fromkeys(a.columns) for a in axes]
    frames = [_mapped(a.rows.select(KEY, *a.columns), KEY, m) for a, m in zip(axes, maps)]
    table = new.df
    for i, f in enumerate(frames):
        table = table.join(f.select(KEY, *(F.col(c).alias(f"_{i}_{c}") for c in names[i])), KEY, "left")
    if callable(rule):
        made = rule([{c: F.col(f"_{i}_{c}") for c in n} for i, n in enumerate(names)])
        return Axis(table.select(KEY, NAME, *(c.alias(k) for k, c in made.items())), True)
    picked, checks = {}, []
    for c in union_keys(names):
        have = [i for i, n in enumerate(names) if c in n]
        if rule == "first" or len(have) == 1 and rule in ("only", "unique"):
            picked[c] = have[0]
        elif rule == "unique" or (rule == "same" and len(have) == len(axes)):
            checks.append((c, have))
    tests = [F.every(reduce(lambda x, y: x & y, [F.col(f"_{have[0]}_{c}").eqNullSafe(F.col(f"_{i}_{c}")) for i in have[1:]], F.lit(True))).alias(f"t{k}") for k, (c, have) in enumerate(checks)]
    if tests:
        verdict = table.agg(*tests).first()  # one row
        picked |= {c: have[0] for k, (c, have) in enumerate(checks) if verdict[f"t{k}"] is not False}
    order = [c for c in union_keys(names) if c in picked]
    cats = {c: axes[picked[c]].categories[c] for c in order if c in axes[picked[c]].categories}
    return Axis(table.select(KEY, NAME, *(F.col(f"_{picked[c]}_{c}").alias(c) for c in order)), True, cats)


def merge_elements(slots: list[dict[str, Any]], maps, keys: tuple[str, ...], rule: str | Callable | None) -> dict[str, Any]:
    """Aligned arrays or graphs of the joined axis, by the same rules. A callable gets a mapping for each input, aligned."""
    if rule is None:
        return {}
    if not callable(rule) and rule not in RULES:
        raise ValueError(f"no merge rule {rule!r}")
    moved = [{k: replace(e, df=reduce(lambda d, c: _mapped(d, c, m), keys, e.df)) for k, e in s.items()} for s, m in zip(slots, maps)]
    if callable(rule):
        return dict(rule(moved)) if any(moved) else {}
    out = {}
    for k in union_keys(moved):
        have = [s[k] for s in moved if k in s]
        alike = lambda: all(getattr(h, "width", None) == getattr(have[0], "width", None) and same_rows(have[0].df, h.df) for h in have[1:])  # noqa: E731, B023
        if rule == "first" or (len(have) == 1 and rule in ("only", "unique")) or (rule in ("same", "unique") and (rule == "unique" or len(have) == len(slots)) and alike()):
            out[k] = have[0]
    return out


def concat(grids: list[Grid] | Mapping[str, Grid], *, axis: str | int = "obs", join: str = "inner", merge=None, uns_merge=None, label: str | None = None,
           keys: list[str] | None = None, index_unique: str | None = None, fill_value: float | None = None, pairwise: bool = False) -> Grid:
    if isinstance(grids, Mapping):
        if keys is not None:
            raise TypeError("keys come with the mapping")
        keys, grids = list(grids), list(grids.values())
    if axis not in AXES:
        raise ValueError(f"axis is obs, var, 0 or 1, not {axis!r}")
    if join not in ("inner", "outer"):
        raise ValueError(f"join is inner or outer, not {join!r}")
    side = AXES[axis]
    keys = [str(k) for k in (keys if keys is not None else range(len(grids)))]
    grids = [g.realised() for g in grids]
    along, across = [g.axis(side) for g in grids], [g.axis(other_side(side)) for g in grids]
    new_along = concat_axis(along, join, label, keys, index_unique)
    bare, maps = aligned_axis(across, join)
    new_across = merge_columns(across, bare, maps, merge)
    stores = [g.elements for g in grids]
    layers = {k: concat_matrices([s.get(k) for s in stores], grids, side, maps, bare, fill_value) for k in (shared_keys(stores) if join == "inner" else union_keys(stores))}
    m, p = ("obsm_", "obsp_") if side == "obs" else ("varm_", "varp_")
    am, ap = ("varm_", "varp_") if side == "obs" else ("obsm_", "obsp_")
    get = lambda slot: [getattr(g, slot) for g in grids]
    slots = {
        m: concat_aligned(get(m), along, join, fill_value), p: concat_pairs(get(p), join) if pairwise else {},
        am: merge_elements(get(am), maps, (KEY,), merge), ap: merge_elements(get(ap), maps, ("i", "j"), merge),
    }
    raw = None
    if side == "obs" and grids and all(g.raw_ is not None for g in grids):
        # raw is joined without merging annotation
        r = concat([Grid(g.obs, g.raw_.var, {None: g.raw_.x}, {}, g.raw_.varm) for g in grids], axis=side, join=join, fill_value=fill_value)
        raw = Raw(r.elements[None], r.var, {})
    axes = {side: new_along, other_side(side): new_across}
    return Grid(axes["obs"], axes["var"], layers, slots["obsm_"], slots["varm_"], slots["obsp_"], slots["varp_"], merge_maps([g.uns for g in grids], uns_merge), raw)


__all__ = ["MISSING", "concat", "concat_aligned", "concat_axis", "default_fill", "unified_categories"]
