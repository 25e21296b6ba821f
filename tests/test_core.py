"""Axes, views, concatenation, merge rules, references and sources, on small grids."""

import gzip
import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlake.ext import register_namespace
from gridlake.functions.names import as_structs, convert_string, natural_key
from gridlake.operators.axis import KEY, NAME, Axis, Categories
from gridlake.operators.collection import Collection, chosen, composed
from gridlake.operators.concat import concat
from gridlake.operators.element import Aligned, Matrix, Pairs
from gridlake.operators.grid import Grid, unpack
from gridlake.operators.merge import merge_maps, merge_outer
from gridlake.plans.refs import A, Ref, Whole
from gridlake.session import override, settings
from gridlake.sources import store, text


def grid(spark, x, obs, var, sparse=True, obs_cols=None, var_cols=None, **k):
    """A grid from a nested list."""
    def axis(names, cols):
        cols = cols or {}
        pdf = pd.DataFrame({KEY: range(len(names)), NAME: names, **cols})
        return Axis(spark.createDataFrame(pdf))
    cells = [(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v or not sparse]
    return Grid(axis(obs, obs_cols), axis(var, var_cols), {None: Matrix(spark.createDataFrame(cells, "o long, v long, value double"), sparse)}, **k)


def wide(g):
    """{row: {column: value}} of a grid, absent sparse cells 0, in axis order."""
    df = g.to_df().orderBy(KEY).toPandas()
    return {r[NAME]: {c: r[c] for c in df.columns if c not in (KEY, NAME)} for _, r in df.iterrows()}


def names(axis):
    return [r[0] for r in axis.rows.orderBy(KEY).select(NAME).collect()]


@pytest.fixture(scope="module")
def g(spark):
    return grid(spark, [[0, 1, 2], [3, 0, 5], [6, 7, 0], [0, 0, 9], [1, 1, 1]], list("abcde"), list("xyz"), obs_cols={"t": [0, 1, 0, 1, 0]}, var_cols={"w": [1.5, 2.5, 3.5]})


INDEXERS = [slice(None), slice(1, 4), slice(None, None, 2), slice(None, None, -1), slice(-3, None), slice(4, 0, -2), 2, -1, [3, 1, 1], [True, False, True, True, False], np.array([[0], [4]]), np.array([1.0, 2.0]), [], range(1, 3), pd.Series([2, 0])]


@pytest.mark.parametrize("i", INDEXERS, ids=str)
def test_rows_as_numpy_selects(g, i):
    have = np.array(list("abcde"))
    want = have[np.array(i).ravel().astype(int)] if isinstance(i, np.ndarray) else have[i.to_numpy()] if isinstance(i, pd.Series) else have[list(i)] if isinstance(i, range) else have[np.array(i, int)] if i == [] else have[i]
    assert names(g[i].obs) == np.atleast_1d(want).tolist()


@pytest.mark.parametrize("i", INDEXERS[:9], ids=str)
@pytest.mark.parametrize("j", [slice(1, None), slice(None, None, -1), [1, 0, 1], [True, False]], ids=str)
def test_views_of_views(g, i, j):
    have = np.array(list("abcde"))
    a = np.atleast_1d(have[i])
    if isinstance(j, list) and (j == [True, False] and len(a) != 2 or max(j) >= len(a)):
        with pytest.raises(IndexError):
            g[i][j]
        return
    v = g[i][j]
    assert names(v.obs) == a[j].tolist()
    x = np.array([[0, 1, 2], [3, 0, 5], [6, 7, 0], [0, 0, 9], [1, 1, 1]])
    rows = [list("abcde").index(n) for n in a[j]]
    assert (v.X.df.agg(F.sum("value")).first()[0] or 0) == x[rows].sum()


def test_labels(g):
    assert names(g[["d", "a"]].obs) == ["d", "a"] and names(g["c"].obs) == ["c"]
    assert names(g["b":"d"].obs) == ["b", "c", "d"]
    with pytest.raises(KeyError, match="nope"):
        g[["a", "nope"]]
    with pytest.raises(KeyError):
        g["nope"]
    with pytest.raises(IndexError):
        g[5]
    with pytest.raises(IndexError):
        g[[0.5]]
    with pytest.raises(IndexError):
        g[[True]]
    with pytest.raises(IndexError):
        g[object()]


def test_repeated_labels(spark):
    d = grid(spark, [[1], [2], [3]], ["a", "a", "b"], ["x"])
    assert d["a"].n_obs == 2
    with pytest.raises(ValueError):
        d[["a"]]
    assert names(d.names_made_unique("obs").obs) == ["a", "a-1", "b"]
    e = grid(spark, [[1]] * 7, ["a", "a", "a-1", "a", None, None, "a-3"], ["x"])
    assert names(e.names_made_unique("obs").obs) == ["a", "a-2", "a-1", "a-4", None, None, "a-3"]


def test_unpack_and_two_axes(g):
    assert unpack(...) == (slice(None), slice(None)) and unpack((..., 1)) == (slice(None), 1) and unpack((1, ...)) == (1, slice(None))
    with pytest.raises(IndexError):
        unpack((1, 2, 3))
    v = g[[2, 0], ["z", "x"]]
    assert wide(v) == {"c": {"z": 0, "x": 6}, "a": {"z": 2, "x": 0}} and v.shape == (2, 2)
    assert g[F.col("t") == 1, F.col("w") > 2].X.df.count() == 2
    assert names(g.T.obs) == ["x", "y", "z"] and wide(g.T)["x"]["c"] == 6


def test_vectors_and_references(g, spark):
    value = lambda df: [r.value for r in df.orderBy(KEY).collect()]
    assert value(g.vector("obs", "y")) == [1, 0, 7, 0, 1] and value(g.vector("var", "b")) == [3, 0, 5] and value(g.vector("obs", "t")) == [0, 1, 0, 1, 0]
    with pytest.raises(KeyError):
        g.vector("obs", "q")
    both = g.with_column("obs", "x", F.lit(1))
    with pytest.raises(ValueError):
        both.vector("obs", "x")
    emb = Aligned(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], f"{KEY} long, value array<double>"), 2)
    near = Pairs(spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25)], "i long, j long, value double"))
    h = g.with_element("obsm", "e", emb).with_element("obsp", "n", near)
    assert value(h[A.obsm["e"][:, 1]]) == [0, 2, 4, 6, 8] and value(h[A.obsp["n"]["a", :]]) == [0, 0.5, 0, 0, 0] and value(h[A.obsp["n"][:, "c"]]) == [0, 0.25, 0, 0, 0]
    assert A.X[:, "y"] in h and A.X[:, "q"] not in h and A.obsm["e"][2] not in h and A.obs["t"] in h and A.obs.index in h
    assert h[2:].obsp["n"].df.count() == 0 and h[:2].obsp["n"].df.count() == 1


@pytest.mark.parametrize(("text_", "ref"), [
    ("X[:,:]", A.X[:, :]), ("X[:,g]", A.X[:, "g"]), ("layers.y[c,:]", A.layers["y"]["c", :]), ("obs.a", A.obs["a"]), ("var.index", A.var.index), ("obsm.c.0", A.obsm["c"][:, 0]),
    ("varp.g[:,c2]", A.varp["g"][:, "c2"])])
def test_reference_strings(text_, ref):
    assert A.resolve(text_) == ref == A.from_json(json.loads(json.dumps(A.to_json(ref)))) and A.resolve(text_, vec=True) == ref
    assert eval(repr(ref)) == ref and A.resolve(text_, vec=False, strict=False) is None
    with pytest.raises(ValueError):
        A.resolve(text_, vec=False)


def test_reference_rules():
    assert A.resolve("X") == Whole("layers") and A.resolve("obsm.c", vec=False) == Whole("obsm", "c")
    assert A.X[:, ["a", "b"]] == [A.X[:, "a"], A.X[:, "b"]] and A.obs[["p", "q"]] == [A.obs["p"], A.obs["q"]]
    assert A.X[:, "a"].dims == ("obs",) and A.X[:, :].dims == ("obs", "var") and A.varp["g"]["a", :].dims == ("var",)
    for bad in ("nope", "foo.bar", "X[a]", "X[a,b]"):
        with pytest.raises(ValueError):
            A.resolve(bad)
    with pytest.raises(IndexError):
        A.X[["a"], ["b"]]
    assert len({Ref("obs", None, "a"), A.obs["a"]}) == 1


# Concatenation
@pytest.fixture(scope="module")
def stalls(spark):
    """Days at three market stalls by goods sold. Hall and quay share two goods, hall and pier one, quay and pier none but a day."""
    hall = grid(spark, [[5, 0, 1], [0, 2, 2], [3, 3, 0]], ["mon", "tue", "wed"], ["pear", "fig", "leek"], obs_cols={"rain": ["yes", "no", "no"]}, uns={"city": "Kiel", "owner": "Ida", "open": {"at": 7, "till": 18}})
    quay = grid(spark, [[8, 4]], ["sun"], ["leek", "fig"], obs_cols={"rain": ["hail"], "tide": [1.25]}, uns={"city": "Kiel", "owner": "Bo", "open": {"at": 7, "till": 14}, "fish": [3]})
    pier = grid(spark, [[6, 1, 9, 0], [0, 0, 2, 7]], ["sun", "sat"], ["pear", "rope", "net", "oar"], obs_cols={"berth": [4, 5]}, uns={"city": "Kiel", "owner": "Ida", "boats": 2})
    return hall, quay, pier


def test_inner_and_outer(stalls):
    hall, quay, pier = stalls
    assert wide(concat([hall, quay])) == {"mon": {"fig": 0, "leek": 1}, "tue": {"fig": 2, "leek": 2}, "wed": {"fig": 3, "leek": 0}, "sun": {"fig": 4, "leek": 8}}
    assert concat([hall, quay, pier]).shape == (6, 0) and names(concat([quay, hall]).var) == ["leek", "fig"]
    every = concat([hall, quay, pier], join="outer")
    assert names(every.var) == ["fig", "leek", "net", "oar", "pear", "rope"] and every.obs.columns == ["rain", "tide", "berth"] and every.n_obs == 6
    assert wide(every)["sat"] == {"fig": 0, "leek": 0, "net": 2, "oar": 7, "pear": 0, "rope": 0}
    assert wide(concat([hall, quay], join="outer", fill_value=-2.5))["sun"] == {"fig": 4, "leek": 8, "pear": -2.5}
    beside = concat([quay, pier], axis="var")
    assert wide(beside) == {"sun": {"leek": 8, "fig": 4, "pear": 6, "rope": 1, "net": 9, "oar": 0}}
    nested = concat([concat([hall, quay]), concat([quay, hall])])
    assert nested.shape == (8, 2) and nested.X.df.agg(F.sum("value")).first()[0] == 2 * (0 + 1 + 2 + 2 + 3 + 0 + 4 + 8)
    with pytest.raises(ValueError):
        concat([hall, quay], axis=2)


def test_order_of_the_joined_axis(spark):
    x = grid(spark, [[1, 2, 3]], ["p"], ["c", "a", "b"])
    y = grid(spark, [[4, 5, 6]], ["q"], ["b", "d", "c"])
    assert names(concat([x, y]).var) == ["c", "b"] and names(concat([x, y], join="outer").var) == ["a", "b", "c", "d"]


def test_equal_labels_keep_their_order(spark):
    """The same labels in two frames: joined without sorting, and without a map where keys are the same too."""
    x = grid(spark, [[1, 2, 3]], ["p"], ["c", "a", "b"])
    y = grid(spark, [[4, 5, 6]], ["q"], ["c", "a", "b"])
    other_keys = Grid(y.obs, Axis(y.var.df.withColumn(KEY, F.col(KEY) * 10 + 3)), {None: Matrix(y.X.df.withColumn("v", F.col("v") * 10 + 3))})
    for z in (y, other_keys):
        for join in ("inner", "outer"):
            got = concat([x, z], join=join)
            assert names(got.var) == ["c", "a", "b"] and wide(got) == {"p": {"c": 1, "a": 2, "b": 3}, "q": {"c": 4, "a": 5, "b": 6}}
    turned = grid(spark, [[6, 5, 4]], ["q"], ["b", "a", "c"])
    assert names(concat([x, turned], join="outer").var) == ["a", "b", "c"] and wide(concat([x, turned]))["q"] == {"c": 4, "a": 5, "b": 6}


def test_labels_keys_and_names(stalls):
    hall, quay, pier = stalls
    rows = concat({"h": hall, "q": quay, "p": pier}, label="place", index_unique="/").obs
    assert names(rows) == ["mon/h", "tue/h", "wed/h", "sun/q", "sun/p", "sat/p"] and rows.categories["place"] == Categories(("h", "q", "p"))
    with pytest.raises(TypeError):
        concat({"h": hall}, keys=["h"])


def test_dense_inputs_fill_with_nan(spark):
    x = grid(spark, [[1, 2]], ["p"], ["a", "b"], sparse=False)
    y = grid(spark, [[3]], ["q"], ["a"], sparse=False)
    m = concat([x, y], join="outer").X
    assert not m.sparse and m.df.count() == 4 and m.df.where("isnan(value)").count() == 1
    assert Matrix(m.df).same_as(Matrix(m.df))


def test_layers_and_arrays(spark, stalls):
    hall, quay, _ = stalls
    priced = hall.with_layer("cost", hall.elements[None])
    assert set(concat([quay, priced]).elements) == {None} and set(concat([quay, priced], join="outer").elements) == {None, "cost"}
    assert concat([hall, Grid(quay.obs, quay.var)]).elements == {}

    def arrays(goods, **made):
        """Arrays along var by a function of a good's name."""
        return {k: Aligned(spark.createDataFrame([(i, f(x)) for i, x in enumerate(goods)], f"{KEY} long, value array<double>"), len(f(goods[0]))) for k, f in made.items()}

    size = lambda x: [float(len(x)), 0.5]
    p = replace(hall, varm_=arrays(["pear", "fig", "leek"], size=size, shelf=lambda x: [1.0], season=lambda x: [6.0, 9.0, 3.0]))
    q = replace(quay, varm_=arrays(["leek", "fig"], size=size, shelf=lambda x: [1.0, 2.0]))
    r = replace(quay, varm_=arrays(["leek", "fig"], size=lambda x: [float(ord(x[0])), 0.5]))
    got = lambda rule, *gs: sorted(concat(list(gs), merge=rule).varm_)
    assert got("same", p, q) == ["size"] and got("unique", p, q) == ["season", "size"] and got("only", p, q) == ["season"]
    assert got("first", p, q) == ["season", "shelf", "size"] and got(None, p, q) == [] and got("same", p, r) == [] and got("unique", p, r) == ["season", "shelf"]


@pytest.mark.parametrize(("rule", "columns"), [(None, []), ("same", ["length"]), ("unique", ["length", "tag", "note"]), ("first", ["length", "tag", "score", "note"]), ("only", ["note"])])
def test_merge_of_annotation(spark, rule, columns):
    """length is the same in all; tag stands in two that agree, score in two that differ, note in one."""
    length, tag = {"length": [30, 10, 20]}, {"tag": ["red", "blue", "red"]}
    sets = [length | tag | {"score": [0.5, 0.25, 4.0]}, length | {"score": [0.5, 0.25, 8.0], "note": [7, 8, 9]}, length | tag]
    gs = [grid(spark, [[3, 1, 4], [1, 5, 9]], [f"s{i}1", f"s{i}2"], ["f", "g", "h"], var_cols=c) for i, c in enumerate(sets)]
    assert concat(gs, merge=rule).var.columns == columns


def test_merge_by_a_function(spark):
    p, q = (grid(spark, [[1, 2]], [r], ["f", "g"], var_cols={"n": n}) for r, n in (("p", [1, 5]), ("q", [4, 2])))
    got = concat([p, q], merge=lambda maps: {"most": F.greatest(*(m["n"] for m in maps))}).var.rows.orderBy(KEY).collect()
    assert [r.most for r in got] == [4, 5]


MERGES = [
    ([{"k": 5}, {"k": 6}, {"k": 5}], {None: {}, "first": {"k": 5}, "unique": {}, "same": {}, "only": {}}),
    ([{"p": 1, "q": 2}, {"q": 2}], {None: {}, "first": {"p": 1, "q": 2}, "unique": {"p": 1, "q": 2}, "same": {"q": 2}, "only": {"p": 1}}),
    ([{"t": {"u": 1, "v": {"w": 2}}, "z": 9}, {"t": {"v": {"w": 2, "x": 3}}}],
     {None: {}, "first": {"t": {"u": 1, "v": {"w": 2, "x": 3}}, "z": 9}, "unique": {"t": {"u": 1, "v": {"w": 2, "x": 3}}, "z": 9}, "same": {"t": {"v": {"w": 2}}}, "only": {"t": {"u": 1, "v": {"x": 3}}, "z": 9}}),
    ([{"m": {"n": 1}}, {"m": 4, "n": 2}, {"n": 2}], {None: {}, "first": {"m": {"n": 1}, "n": 2}, "unique": {"n": 2}, "same": {}, "only": {}}),
]


@pytest.mark.parametrize(("maps", "want"), MERGES)
@pytest.mark.parametrize("wrap", [lambda v: v, lambda v: [v], lambda v: np.array([v, np.nan]), lambda v: pd.DataFrame({"c": [v]})])
def test_merge_of_maps(maps, want, wrap):
    deep = lambda m: {k: deep(v) if isinstance(v, dict) else wrap(v) for k, v in m.items()}
    for rule, w in want.items():
        assert str(merge_maps([deep(m) for m in maps], rule)) == str(deep(w))
    assert merge_outer([{"a": 1}, {"a": 2, "b": 3}], ["x", "y"]) == {"a-x": 1, "a-y": 2, "b": 3}
    assert merge_maps(maps, lambda ms: {"n": len(ms)}) == {"n": len(maps)}


def test_uns_merge(stalls):
    get = lambda r: concat(list(stalls), uns_merge=r).uns
    assert get("same") == {"city": "Kiel"} and get("only") == {"fish": [3], "boats": 2} and get(None) == {}
    assert get("unique") == {"city": "Kiel", "open": {"at": 7}, "fish": [3], "boats": 2}
    assert get("first") == {"city": "Kiel", "owner": "Ida", "open": {"at": 7, "till": 18}, "fish": [3], "boats": 2}


def test_categories(spark, stalls):
    hall, quay, _ = stalls
    with_cat = lambda x, *v: Grid(Axis(x.obs.df, True, {"rain": Categories(v)}), x.var, x.elements)
    assert concat([with_cat(hall, "w30", "w4"), with_cat(quay, "w007")]).obs.categories["rain"].values == ("w4", "w007", "w30")
    assert "rain" not in concat([with_cat(hall, "yes"), quay]).obs.categories
    assert hall.strings_categorised().obs.categories["rain"].values == ("no", "yes") and quay.strings_categorised().obs.categories == {}
    h = Grid(Axis(hall.obs.df, True, {"rain": Categories(("yes", "no", "snow"))}), hall.var, {}, uns={"rain_colors": ["blue", "gold", "white"], "rank": {"params": {"groupby": "rain"}, "names": ["yes", "no"]}})
    u = h[["tue"]].unused_categories_removed()
    assert u.obs.categories["rain"].values == ("no",) and u.uns["rain_colors"] == ["gold"]
    own = h[["wed"]].realised()  # a view's own copy drops them by itself, unless told not to
    assert own.obs.categories["rain"].values == ("no",) and own.uns["rain_colors"] == ["gold"] and h.uns["rain_colors"] == ["blue", "gold", "white"]
    with override(remove_unused_categories=False):
        assert h[["mon"]].realised().obs.categories["rain"].values == ("yes", "no", "snow")
    assert h.obs.used_categories("rain") == Categories(("yes", "no")) and h[["mon"]].obs.used_categories("rain").values == ("yes",)
    r = h.categories_renamed("obs", "rain", ["wet", "dry", "cold"])
    assert r.obs.categories["rain"].values == ("wet", "dry", "cold") and r.uns["rank"]["names"] == ["wet", "dry"] and {x.rain for x in r.obs.rows.collect()} == {"wet", "dry"}
    with pytest.raises(ValueError):
        h.categories_renamed("obs", "rain", ["wet"])


def test_raw(stalls):
    hall, quay, _ = stalls
    r = hall.with_raw()[:, ["fig"]]
    assert r.shape == (3, 1) and r.raw.var.count() == 3 and r[["tue"]].raw.x.df.count() == 2 and r.raw_grid().shape == (3, 3)
    assert concat([quay.with_raw(), hall]).raw_ is None and names(concat([hall.with_raw(), quay.with_raw()]).raw.var) == ["fig", "leek"]
    with pytest.raises(IndexError):
        r.raw[0]


def test_validation_and_setters(g, spark):
    assert g.validate() is g
    with pytest.raises(ValueError):
        Grid(g.obs, g.var, {None: Matrix(spark.createDataFrame([(77, 0, 1.0)], "o long, v long, value double"))}).validate()
    with pytest.raises(ValueError):
        Grid(g.obs, g.var, {None: Matrix(g.X.df.union(g.X.df))}).validate()
    with pytest.raises(ValueError):
        g.with_layer("a/b", g.X)
    with override(disallow_slash_in_keys=False):
        assert not settings().disallow_slash_in_keys and "a/b" in g.with_layer("a/b", g.X).layers
    with pytest.raises(NotImplementedError):
        g == g
    v = g[[1, 1, 0]].with_layer("twice", g[[1, 1, 0]].X)
    array = lambda x: Aligned(spark.createDataFrame([(i, [x]) for i in range(5)], f"{KEY} long, value array<double>"), 1)
    one = g.with_element("obsm", "e", array(1.0)).with_uns(n=1).with_raw()
    assert one.equals(g.with_element("obsm", "e", array(1.0)).with_uns(n=1).with_raw())
    for other in (g, g.with_element("obsm", "e", array(2.0)).with_uns(n=1).with_raw(), g.with_element("obsm", "e", array(1.0)).with_uns(n=2).with_raw(), g.with_element("obsm", "e", array(1.0)).with_uns(n=1),
                  replace(one, raw_=replace(one.raw_, x=Matrix(g.X.df.withColumn("value", F.col("value") + 1))))):
        assert not one.equals(other)
    assert v.equals(v) and wide(v)["b"] == {"x": 3, "y": 0, "z": 5} and not v.equals(g)
    assert "t" not in g.without_columns("obs", "t").obs.columns and "n_obs" in repr(g) and g.sizes()["obs"] > 0
    assert g.sample_rows(3, replace_=False).n_obs == 3 and g.sample_rows(99).n_obs == 5
    assert [(a, z, c.n_obs) for c, a, z in g.chunks(2)] == [(0, 2, 2), (2, 4, 2), (4, 5, 1)]


def test_to_memory_and_fold(g):
    got = g[1:3].with_raw().to_memory()
    assert got["obs"][NAME].tolist() == ["b", "c"] and got["layers"][None]["value"].sum() == 21 and set(got) == {"obs", "var", "uns", "layers", "obsm", "varm", "obsp", "varp", "raw"}
    with override(max_local_rows=1), pytest.raises(ValueError):
        g.to_memory()
    assert g.fold(lambda n, slot, key, e: n + 1, 0) == 3


def test_more_indexers(g, spark):
    class Sparse:
        def toarray(self):
            return np.array([[True], [False], [False], [True], [True]])

    assert names(g[Sparse()].obs) == ["a", "d", "e"]
    mask = Matrix(spark.createDataFrame([(1, 0, True), (2, 0, False), (4, 0, True)], "o long, v long, value boolean"))
    assert names(g[mask].obs) == ["b", "e"]
    a = g.obs.reindexed(["e", "new", "a"], {"t": -5})
    assert names(a) == ["e", "new", "a"] and [r.t for r in a.rows.orderBy(KEY).collect()] == [0, -5, 0]
    assert [r.value for r in g.with_raw()[:, ["x"]].raw.vector(g.obs, "z").orderBy(KEY).collect()] == [2, 5, 0, 9, 1]
    frame = spark.createDataFrame([(1, 2.5)], "k long, name double")
    with pytest.raises(TypeError):
        Axis.of(frame, "k", "name")
    with override(restrict_index_types=False):
        assert names(Axis.of(frame, "k", "name")) == ["2.5"]
    with pytest.raises(ValueError, match="twice"):
        Axis.of(frame.select("k", "name", "name"), "k", columns=["name", "name"])


def test_what_a_matrix_or_an_axis_may_be_made_of(spark, g):
    class Coo:  # stands for a sparse array
        shape, dtype = (2, 3), np.dtype("f8")
        row, col, data = np.array([0, 1]), np.array([2, 0]), np.array([1.5, 2.5])

        def tocoo(self):
            return self

    sparse, dense = Matrix.coerced(spark, Coo()), Matrix.coerced(spark, np.array([[0, 4], [5, 0]]))
    assert sparse.sparse and sorted(map(tuple, sparse.df.collect())) == [(0, 2, 1.5), (1, 0, 2.5)]
    assert not dense.sparse and dense.df.count() == 4 and Matrix.coerced(spark, pd.DataFrame({"a": [True], "b": [False]})).df.dtypes[2][1] == "boolean"
    assert Matrix.coerced(spark, g.X) is g.X or Matrix.coerced(spark, g.X).df is not None
    for bad, error in ((np.zeros((2, 2, 2)), ValueError), (np.zeros(3), ValueError), (np.array([["a"]]), TypeError), ([[1]], TypeError), (g.obs.df, TypeError), (g.X.df.withColumn("value", F.lit("x")), TypeError)):
        with pytest.raises(error):
            Matrix.coerced(spark, bad)
    alone = Grid.from_matrix(sparse)
    assert alone.shape == (2, 2) and names(alone.var) == ["0", "2"] and alone.validate() is alone
    a = Axis.from_mapping(spark, {"obs_names": ["p", "q"], "n": [1, 2]})
    assert names(a) == ["p", "q"] and a.columns == ["n"] and names(Axis.from_mapping(spark, {"n": [5, 6]})) == ["0", "1"]
    assert [r.n for r in a["n"].orderBy(KEY).collect()] == [1, 2] and a[["n"]].columns == [KEY, NAME, "n"]
    for bad, error in ((pd.Series([1]), TypeError), ({"obs_names": ["p"], "n": [1, 2]}, ValueError)):
        with pytest.raises(error):
            Axis.from_mapping(spark, bad)
    with pytest.raises(KeyError):
        a["m"]
    rag = Aligned(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], f"{KEY} long, value array<double>"))
    assert rag.length() == 2 and rag.length(1) is None and Aligned(rag.df.where(f"{KEY} = 1")).length(1) == 2
    full = g.with_layer("l", g.X).with_uns(u=1)
    assert [full.keys(s) for s in ("obs", "var", "layers", "obsm", "uns")] == [["t"], ["w"], ["l"], [], ["u"]]
    s = as_structs(g.obs.df, [NAME, "t"])
    assert s.columns == [KEY, "value"] and s.orderBy(KEY).first().value.asDict() == {NAME: "a", "t": 0}


def test_positions_are_worked_out_once(g, monkeypatch):
    import gridlake.operators.axis as axis

    calls = []
    real = axis.with_positions
    monkeypatch.setattr(axis, "with_positions", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    fresh = replace(g, obs=Axis(g.obs.df.select("*")))
    v = fresh.with_layer("l", fresh.X)[1:4]
    assert v.X.df.count() + v.layer("l").df.count() + v.obs.rows.count() == 5 + 5 + 3 and len(calls) == 1
    assert names(fresh[:2].obs) == ["a", "b"] and len(calls) == 1


def test_a_common_label_is_made_unique(spark):
    rows = [(i, "same" if i % 3 else f"n{i}") for i in range(300)] + [(300, None), (301, "same-2"), (302, None)]
    a = Axis.of(spark.createDataFrame(rows, "k long, name string"), "k", "name")
    got = names(Grid(a, a).names_made_unique("obs").obs)
    assert len({x for x in got if x}) == 301 and got[1] == "same" and got[2] == "same-1" and got[4] == "same-3" and got[300] is None


def test_arrays_of_two_kinds_do_not_mix(spark, stalls):
    a, b, _ = stalls
    array = Aligned(spark.createDataFrame([(0, [1.0]), (1, [2.0])], f"{KEY} long, value array<double>"), None)
    struct = Aligned(spark.createDataFrame([(0, (1.0,)), (1, (2.0,))], f"{KEY} long, value struct<x: double>"), None)
    with pytest.raises(ValueError, match="mixes"):
        concat([a.with_element("obsm", "e", array), b.with_element("obsm", "e", struct)])


def test_store(g, spark, tmp_path):
    p = str(tmp_path / "g")
    full = g.with_layer("l", g.X).with_raw().with_uns(n={"a": [1, 2]}).with_element("obsm", "e", Aligned(spark.createDataFrame([(i, [float(i)]) for i in range(5)], f"{KEY} long, value array<double>"), 1))
    store.write(full, p)
    back = store.read(spark, p)
    assert back.equals(full) and back.uns == full.uns and back.obsm_["e"].width == 1 and back.raw.x.df.count() == g.X.df.count()
    part = store.read(spark, p, elements=["layers/l"], obs_columns=[], obs=slice(1, 3))
    assert set(part.elements) == {"l"} and part.obs.columns == [] and part.n_obs == 2
    seen = []
    store.read(spark, p, callback=lambda f, s, where, e: (seen.append(where), f(s, where, e))[1])
    assert any(x.endswith("layers/l") for x in seen)
    moved = lambda m: Matrix(m.df.withColumn("o", F.col("o") + 100), m.sparse)
    more = replace(full, obs=Axis(g.obs.df.withColumn(KEY, F.col(KEY) + 100)), elements={k: moved(m) for k, m in full.elements.items()},
                   obsm_={"e": Aligned(full.obsm_["e"].df.withColumn(KEY, F.col(KEY) + 100), 1)}, raw_=replace(full.raw_, x=moved(full.raw_.x)))
    with pytest.raises(ValueError, match="differ"):  # nothing may be left short
        store.append(p, replace(more, obsm_={}))
    store.append(p, more)
    twice = store.read(spark, p).validate()
    assert twice.n_obs == 10 and twice.raw.x.df.count() == 2 * g.X.df.count() and twice.layer("l").df.count() == 2 * g.X.df.count() and twice.obsm["e"].df.count() == 10
    with pytest.raises(ValueError, match="keys exist"):
        store.append(p, full)
    assert store.unwriteable(g.with_uns(x=object())) == ["uns/x"]
    assert store.write_csvs(full, str(tmp_path / "csv")) == ["uns/n"]


def test_concat_on_disk(spark, tmp_path, stalls):
    a, b, _ = stalls
    for k, x in (("a", a.with_raw()), ("b", b.with_raw())):
        store.write(x.with_layer("l", x.X), str(tmp_path / k))
    for join in ("inner", "outer"):
        out = str(tmp_path / join)
        store.concat_on_disk(spark, {k: str(tmp_path / k) for k in "ab"}, out, join=join, label="from", uns_merge="unique")
        got, want = store.read(spark, out), concat({k: x.with_raw().with_layer("l", x.X) for k, x in (("a", a), ("b", b))}, join=join, label="from", uns_merge="unique")
        assert got.equals(want) and got.uns == want.uns and got.obs.categories == want.obs.categories and wide(got) == wide(want)


def test_text(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)
    a = text.read_csv(spark, put("a.csv", ",c1,c2\nr1,1.0,0.0\nr2,3,4\nr3,5,6\n"))
    assert wide(a) == {"r1": {"c1": 1, "c2": 0}, "r2": {"c1": 3, "c2": 4}, "r3": {"c1": 5, "c2": 6}}
    b = text.read_text(spark, put("b.tsv", "# one\n# two\n# c1 c2\nr1\t1.0\t0.0\nr2\t3\t4\n"), "\t")
    assert wide(b) == {"r1": {"c1": 1, "c2": 0}, "r2": {"c1": 3, "c2": 4}}
    c = text.read_text(spark, put("c.txt", "1 2 3\n4 5 6\n"))
    assert wide(c) == {"0": {"0": 1, "1": 2, "2": 3}, "1": {"0": 4, "1": 5, "2": 6}}
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write('"x","y"\n1,1e3\n3,nan\n')
    assert wide(text.read_csv(spark, str(tmp_path / "d.csv.gz")))["0"] == {"x": 1, "y": 1000}
    with pytest.raises(ValueError):
        text.read_csv(spark, put("e.csv", "1,2\n3\n"))
    with pytest.raises(ValueError):
        text.read_csv(spark, put("f.csv", "1 2\n"))
    assert wide(text.read_umi(spark, put("u.tsv", "gene\tcell\tcount\ng2\tc1\t3\ng1\tc2\t1\ng2\tc1\t1\n"))) == {"c1": {"g1": 0, "g2": 4}, "c2": {"g1": 1, "g2": 0}}
    m = text.read_mtx(spark, put("m.mtx", "%%MatrixMarket matrix coordinate integer symmetric\n% c\n3 3 2\n2 1 5\n3 3 7\n"))
    assert sorted(map(tuple, m.X.df.collect())) == [(0, 1, 5.0), (1, 0, 5.0), (2, 2, 7.0)] and m.shape == (3, 3)
    assert wide(text.read_mtx(spark, put("n.mtx", "%%MatrixMarket matrix array real general\n2 1\n5\n6\n"))) == {"0": {"0": 5}, "1": {"0": 6}}


def test_collection(spark, stalls):
    hall, quay, _ = stalls
    with pytest.raises(ValueError):
        Collection.of([hall, quay])
    c = Collection.of({"h": hall, "q": quay}, join_vars="inner", label="place", convert={"X": lambda v: v * 2, "obs": {"rain": F.upper}})
    assert len(c) == 4 and c.layer().agg(F.sum("value")).first()[0] == 2 * 20 and {r.value for r in c.attr("obs", "rain").collect()} == {"YES", "NO", "HAIL"}
    assert c.n_batches(3) == 2 and c.n_batches(3, drop_last=True) == 1
    got = list(c.iterate(3))
    assert [len(x) for _, x in got] == [3, 1] and names(got[0][1].grid.obs) == ["mon", "tue", "wed"]
    cells = list(c.iterate_cells(3))
    assert [(k, len(x)) for k, x in cells] == [(0, 4), (1, 2)] and sum(r.value for _, x in cells for r in x) == 40
    loose = Collection.of([hall, quay], join_vars="inner", join_obsm=None, indices_strict=False)
    assert names(loose[[3, 0]].grid.obs) == ["mon", "sun"] and names(Collection.of([hall, quay], join_vars="inner")[[3, 0]].grid.obs) == ["sun", "mon"]
    assert sorted(r.batch for r in c.batches(3, shuffle=True, drop_last=True, seed=1).collect()) == [0, 0, 0]
    assert set(c.to_grid(x=False).elements) == set() and chosen({"a": 1}, "a") is None and composed(None, F.upper) is not None


def test_small_functions(spark):
    assert sorted(["b10", "b9", "a"], key=natural_key) == ["a", "b9", "b10"]
    assert [convert_string(x) for x in ("1", "1.5", "True", "None", "x")] == [1, 1.5, True, None, "x"]

    @register_namespace("counts")
    class Counts:
        def __init__(self, grid):
            self.grid = grid

        def cells(self):
            return self.grid.X.df.count()

    one = grid(spark, [[1, 0]], ["a"], ["x", "y"])
    assert one.counts.cells() == 1 and one.counts is one.counts and one.with_uns(n=1).counts is not one.counts
    with pytest.raises(AttributeError):
        register_namespace("obs")(Counts)


def test_streaming(spark, tmp_path):
    from gridlake.streaming.ingest import append_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2, 3.0)], "o long, v long, value double").write.parquet(src)
    append_stream(spark.readStream.schema("o long, v long, value double").parquet(src), out, str(tmp_path / "c")).awaitTermination(60)
    assert store.read_elem(spark, out, {"encoding-type": "sparse-matrix"}).df.count() == 1


def test_plans(g, spark):
    """A view reaches the scan as a semi-join, and a label filter prunes inputs."""
    plan = g[F.col("t") == 1].X.df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    both = concat({"a": g, "b": g}, label="batch")[F.col("batch") == "a"]
    assert "Union" not in both.X.df._jdf.queryExecution().optimizedPlan().toString() and both.X.df.count() == g.X.df.count()
    v = both.obs.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in v


def test_filters_on_concatenations(spark):
    """Only a condition on the label as concat() made it, and on nothing else, leaves sources out."""
    x = grid(spark, [[1, 2], [3, 4]], ["a", "b"], ["f", "g"], obs_cols={"src": [100, 0]})
    y = grid(spark, [[5, 6], [7, 8]], ["c", "d"], ["f", "g"], obs_cols={"src": [1, 100]})
    g = concat({"p": x, "q": y}, label="batch")
    assert g[F.col("batch") == "q"].obs.sources == (1,) and sorted(wide(g[F.col("batch") == "q"])) == ["c", "d"]
    assert g.obs.where("batch <> 'q'").sources == (0,) and g[F.col("batch") == "q"][F.col("src") == 100].obs.sources == (1,)
    assert sorted(wide(g[F.col("src") == 100])) == ["a", "d"]
    assert sorted(wide(g[(F.col("batch") == "p") | (F.col("src") == 100)])) == ["a", "b", "d"]
    other = g.with_column("obs", "batch", F.concat(F.lit("new "), "batch"))
    assert sorted(wide(other[F.col("batch") == "new p"])) == ["a", "b"]
    assert sorted(wide(g.categories_renamed("obs", "batch", {"p": "P"})[F.col("batch") == "P"])) == ["a", "b"]
    assert sorted(wide(g[F.col("batch") == "p"].with_column("obs", "batch", F.lit("q"))[F.col("batch") == "q"])) == ["a", "b"]
    assert g[F.rand(4) < 0.5].obs.sources is None and sorted(wide(g[F.rand(4) >= 0])) == ["a", "b", "c", "d"]


def test_repeated_keys_in_frames(spark, g):
    twice = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (None, "n"), (None, "n")], "k long, new string")
    with pytest.raises(ValueError, match="repeat"):
        g.with_annotation("obs", twice, "k")
    with pytest.raises(ValueError, match="repeat"):
        g.with_names("obs", twice, "k", "new")
    assert g.with_annotation("obs", twice.where("new <> 'y'"), "k").obs.rows.count() == g.n_obs


def test_fingerprints(spark):
    from gridlake.operators.axis import fingerprint, same_rows

    rows = [(1, "a", float("nan")), (2, None, -0.0), (2, None, -0.0)]
    df = spark.createDataFrame(rows, "k long, s string, v double")
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("k"))) != fingerprint(df.distinct())
    assert same_rows(df, df.select("v", "s", "k")) and not same_rows(df, df.where("k = 1")) and same_rows(df, df.withColumn("k", F.col("k").cast("int")))
    a, b = Axis.of_names(spark, ["x", "y", None]), Axis.of_names(spark, ["x", None, "y"])
    p, q = a.labels_print(), b.labels_print()
    assert p["names"] == q["names"] and p["keys"] != q["keys"] and (p["n"], p["most"]) == (3, 1) and a.labels_print() is p
    assert Axis.of_names(spark, ["x", "x"]).labels_print()["most"] == 2 and Axis.of_names(spark, []).labels_print()["n"] == 0


def test_concat_runs_few_jobs(spark):
    """At most a job an input before the query starts."""
    gs = [grid(spark, [[1, 2, 3]], [f"r{i}"], ["a", "b", "c"] if i % 2 else ["c", "b", "d"]) for i in range(5)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    concat(gs, join="outer")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # with adaptive execution a query of one shuffle counts as two jobs, one for its stage
    assert len(tracker.getJobIdsForGroup("few")) <= 3 * len(gs)


def test_grids_take_arrays(spark):
    """Arrays and frames as elements: their places are the axes' positions, whatever the keys."""
    x = np.array([[1, 0, 2], [0, 3, 4]])
    obs = Axis.of(spark.createDataFrame([(7, "a"), (9, "b")], "k long, n string"), "k", "n")
    var = Axis.of_names(spark, ["u", "v", "w"])
    want = {"a": {"u": 1, "v": 0, "w": 2}, "b": {"u": 0, "v": 3, "w": 4}}
    assert wide(Grid(obs, var, {None: x})) == want and wide(Grid(obs, var, {None: pd.DataFrame(x)})) == want
    assert not Grid(obs, var, {None: x}).X.sparse and Grid(obs, var, {None: x.astype(bool)}).X.df.schema["value"].dataType.simpleString() == "boolean"
    assert wide(Grid(obs, var, {None: spark.createDataFrame([(7, 2, 5.0)], "o long, v long, value double")}))["a"] == {"u": 0, "v": 0, "w": 5}
    for bad, error in ((x[:1], ValueError), (x[0], ValueError), (x.astype(str), TypeError), ("text", TypeError)):
        with pytest.raises(error):
            Grid(obs, var, {None: bad})
    with override(max_filled_cells=5), pytest.raises(ValueError, match="max_filled_cells"):
        Grid(obs, var, {None: x}).X.densified(obs, var)


def test_structs_both_ways(spark):
    from gridlake.functions.names import from_structs

    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "k int, s string, d double")
    assert from_structs(as_structs(df, ["s", "d"])).collect() == df.collect()
    with pytest.raises(ValueError):
        from_structs(as_structs(df, ["s", "d"], "v").withColumn("s", F.lit(1)), "v")


def test_fills_are_counted_without_being_made(stalls):
    hall, quay, pier = stalls
    g = concat([hall, quay, pier], join="outer", fill_value=-2.5)
    src = F.col("o.src").alias("src")
    counts = lambda df: {(r.src, r.value): r.n for r in df.collect()}
    for m in (g.X, g[F.col("_key.src") < 2].X, g[:, F.col(NAME) > "g"].X, concat([hall.T, quay.T], axis="var", join="outer", fill_value=7.0).T.X):
        assert counts(m.tally(src)) == counts(m.df.groupBy(src, "value").agg(F.count("*").alias("n")))
    assert g.X.tally(src).where("value = -2.5").agg(F.sum("n")).first()[0] == 3 * 3 + 1 * 4 + 2 * 2
    with override(max_filled_cells=5):
        many = concat([hall, quay, pier], join="outer", fill_value=-2.5)
        assert counts(many.X.tally(src)) == counts(g.X.tally(src))
        with pytest.raises(ValueError, match="max_filled_cells"):
            many.X.df


def test_random_masks_are_drawn_once(spark):
    def mixed(parts):
        for p in parts:
            yield p.sample(frac=1)

    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("x").alias("c")).mapInPandas(mixed, "k long, c string")  # in another order each time
    cells = spark.range(400).select(F.col("id").alias("o"), F.lit(0).cast("long").alias("v"), F.lit(1.0).alias("value"))
    g = Grid(Axis.of(rows, "k"), Axis.of_names(spark, ["a"]), {None: Matrix(cells)})
    keys = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    low = F.rand(11) < 0.5
    both = [g[m].X.df for m in (low, ~low)]
    assert keys(both[0].union(both[1]), "o") == list(range(400)) and 0 < both[0].count() < 400
    other = F.udf(lambda: float(np.random.random()), "double").asNondeterministic()
    h = g[other() < 0.5]
    assert keys(h.obs.rows, KEY) == keys(h.X.df, "o") == keys(h.obs.rows, KEY)
    assert g[F.col("k") > 390].n_obs == 9 and keys((k := g[(other() < 0.5) & (F.col("k") > 9)]).obs.rows, KEY) == keys(k.X.df, "o")  # k: the table's own column
    u = g.with_column("obs", "u", F.rand(3))
    assert sorted(u[F.col("u") < 0.5].obs.rows.collect() + u[F.col("u") >= 0.5].obs.rows.collect()) == sorted(u.obs.rows.collect())


def test_coordinate_files_are_read_without_sorting_lines(spark, tmp_path, monkeypatch):
    """Cut into part files; cells that read like the size line are cells."""
    (tmp_path / "m").mkdir()
    put = lambda name, lines: (tmp_path / "m" / name).write_text("\n".join(lines) + "\n")
    put("part-0", ["%%MatrixMarket matrix coordinate real general", "% c", "", "3 3 4", "1 2 5"])
    put("part-1", ["3 3 4", "2 1 6"])
    put("part-2", [" 3 3  4 "])
    with monkeypatch.context() as m:
        for name in ("with_positions", "_numbered"):
            m.setattr(text, name, None, raising=False)
        g = text.read_mtx(spark, str(tmp_path / "m"))
        got = sorted(map(tuple, g.X.df.collect()))
    assert g.shape == (3, 3) and got == [(0, 1, 5.0), (1, 0, 6.0), (2, 2, 4.0), (2, 2, 4.0)]


def test_lines_are_numbered_across_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(7):
        (tmp_path / "t" / f"part-{i}").write_text("".join(f"{i * 100 + j},1\n\n" for j in range(i * 10)))
    cells = text.read_csv(spark, str(tmp_path / "t"), first_column_names=True)
    rows = {r[KEY]: r[NAME] for r in cells.obs.rows.collect()}
    assert [rows[k] for k in range(len(rows))] == [str(i * 100 + j) for i in range(7) for j in range(i * 10)]
