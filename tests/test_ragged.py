"""Nested values: common types, subset, concatenation, length and cuts."""

import pytest
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, Axis
from gridlake.operators.concat import concat
from gridlake.operators.element import Aligned
from gridlake.operators.grid import Grid


def held(spark, rows, kind):
    """A grid whose obsm holds nested values."""
    df = spark.createDataFrame(list(enumerate(rows)), f"{KEY} long, value {kind}")
    return Grid(Axis.of(spark.range(len(rows)), "id"), Axis.of_names(spark, ["x"]), {}, {"r": Aligned(df)})


def values(g):
    plain = lambda x: [plain(y) for y in x] if isinstance(x, list) else {k: plain(v) for k, v in x.asDict().items()} if hasattr(x, "asDict") else x
    return [plain(r.value) for r in g.obsm["r"].df.orderBy(KEY).collect()]


@pytest.fixture(scope="module")
def two(spark):
    a = held(spark, [[[(1, "a")], []], [], None], "array<array<struct<n: int, s: string>>>")
    b = held(spark, [[[(2.5, (7,)), None], [(0.5, None)]], [None]], "array<array<struct<n: double, t: struct<u: long>>>>")
    return a, b


def test_outer_has_every_field_at_every_depth(two):
    got = values(concat(list(two), join="outer"))
    assert got == [[[{"n": 1.0, "s": "a", "t": None}], []], [], None, [[{"n": 2.5, "s": None, "t": {"u": 7}}, None], [{"n": 0.5, "s": None, "t": None}]], [None]]


def test_inner_has_the_shared_ones(two):
    assert values(concat(list(two))) == [[[{"n": 1.0}], []], [], None, [[{"n": 2.5}, None], [{"n": 0.5}]], [None]]


def test_subset_and_missing_input(spark, two):
    a, b = two
    g = concat([a, Grid(b.obs, b.var), b], join="outer")
    assert values(g)[3:5] == [None, None] and len(values(g)) == 7
    part = g[F.col(f"{KEY}.src") != 1][[4, 0, 0]]
    assert values(part) == [[None], [[{"n": 1.0, "s": "a", "t": None}], []], [[{"n": 1.0, "s": "a", "t": None}], []]]
    assert values(a[1:]) == [[], None]


def test_types_that_do_not_meet(spark, two):
    with pytest.raises(ValueError, match="no common type"):
        concat([two[0], held(spark, [[["x"]]], "array<array<string>>")], join="outer")


def test_length_by_depth_and_cuts(spark):
    g = held(spark, [[[1, 2], [3, 4]], [[5, 6], [7, 8]], [[9, 10], [11, 12]]], "array<array<int>>")
    r = g.obsm["r"]
    assert [r.length(i) for i in range(3)] == [3, 2, 2]
    with pytest.raises(IndexError):
        r.length(3)
    mixed = held(spark, [[[1], [2, 3]], [[4]]], "array<array<int>>").obsm["r"]
    assert mixed.length(1) is None and mixed.length(2) is None
    at = lambda *x: [row.value for row in mixed.cut(*x).df.orderBy(KEY).collect()]
    assert at(0) == [[1], [4]] and at(1) == [[2, 3], None] and at(slice(None), 0) == [[1, 2], [4]] and at(slice(1, None)) == [[[2, 3]], []]
    assert at(-1, slice(-1, None)) == [[3], [4]] and at(slice(0, 9), slice(1, 5)) == [[[], [3]], [[]]]
