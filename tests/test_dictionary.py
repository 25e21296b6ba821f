"""Category tables against lists."""

import pytest
from pyspark.sql import functions as F

from gridlake.functions.names import natural_key
from gridlake.operators.axis import KEY, NAME, Axis, Categories
from gridlake.operators.concat import concat
from gridlake.operators.dictionary import Dictionary
from gridlake.operators.element import Matrix
from gridlake.operators.grid import Grid
from gridlake.session import override
from gridlake.sources import store, zarr

WORDS = ["g10", "g2", "g1", "10", "9", "a", "", "g002", "g2b", "ä", "2x3", "2x21", "99999999999999999999999999999999999999999999", "100000000000000000000000000000000000000000000"]


def test_natural_order(spark):
    d = Dictionary.of(spark.createDataFrame([(w,) for w in WORDS * 2 + [None]], "w string"), "w")
    assert [natural_key(x) for x in d.head(99)] == sorted(natural_key(w) for w in WORDS)
    assert [(r.value, r.code) for r in d.coded().orderBy("code").collect()] == [(w, i) for i, w in enumerate(d.head(99))]


@pytest.fixture
def g(spark):
    obs = spark.createDataFrame([(i, f"n{i}", f"c{i % 7}") for i in range(50)], f"{KEY} long, {NAME} string, c string")
    m = Matrix(spark.createDataFrame([(i, 0, 1.0) for i in range(50)], "o long, v long, value double"))
    with override(local_categories=3):
        return Grid(Axis(obs), Axis.of_names(spark, ["x"]), {None: m}).strings_categorised()


def test_subset_rename_and_union(spark, g):
    d = g.obs.categories["c"]
    assert isinstance(d, Dictionary) and d.head(9) == [f"c{i}" for i in range(7)]
    part = g[F.col("c").isin("c5", "c2")].realised()
    assert part.obs.categories["c"].head(9) == ["c2", "c5"]
    r = g.categories_renamed("obs", "c", {"c3": "third"})
    assert r.obs.categories["c"].head(9) == ["c0", "c1", "c2", "third", "c4", "c5", "c6"] and r.obs.df.where("c = 'third'").count() == 7
    with pytest.raises(ValueError):
        g.categories_renamed("obs", "c", {"c3": "c4"})
    mixed = Grid(Axis(part.obs.df, True, {"c": Categories(("c5", "z1", "c2"))}), part.var, part.elements)
    assert concat([part, mixed]).obs.categories["c"].head(9) == ["c2", "c5", "z1"]
    fixed = Dictionary.of_values(spark, ["low", "high"], ordered=True)
    with_ = lambda c: Grid(Axis(part.obs.df, True, {"c": c}), part.var, part.elements)
    assert concat([with_(fixed), with_(Categories(("low", "high"), True))]).obs.categories["c"].head(9) == ["low", "high"]
    assert "c" not in concat([with_(fixed), part]).obs.categories
    assert part.unused_categories_removed().obs.categories["c"].head(9) == ["c2", "c5"]


def test_stored(spark, g, tmp_path):
    store.write(g[F.col(KEY) < 3].realised(), str(tmp_path / "s"))
    store.append(str(tmp_path / "s"), g[F.col(KEY).between(3, 4)].realised())
    assert store.read(spark, str(tmp_path / "s")).obs.categories["c"].head(9) == [f"c{i}" for i in range(5)]
    assert store.read(spark, str(tmp_path / "s"), version=1).obs.categories["c"].head(9) == ["c0", "c1", "c2"]
    zarr.write_zarr(g, str(tmp_path / "z"))
    with override(local_categories=3):
        h = zarr.read_zarr(spark, str(tmp_path / "z"))
    assert h.obs.categories["c"].head(9) == [f"c{i}" for i in range(7)] and sorted(r.c for r in h.obs.df.collect()) == sorted(r.c for r in g.obs.df.collect())


def test_a_million_categories(spark):
    """Subset and concatenated; none comes to the driver, and building runs no job over them."""
    n = 1_000_000
    obs = Axis.of(spark.range(2 * n).select("id", F.concat(F.lit("cat "), (F.col("id") % n).cast("string")).alias("c")), "id")
    g = Grid(obs, Axis.of_names(spark, ["x"]), {None: Matrix(spark.range(2 * n).select(F.col("id").alias("o"), F.lit(0).cast("long").alias("v"), F.lit(1.0).alias("value")))}).strings_categorised()
    assert isinstance(g.obs.categories["c"], Dictionary)
    both = concat([g[F.col(KEY) < 600_000], g[F.col(KEY) >= 2 * n - 500_000]])
    d = both.obs.categories["c"]
    assert isinstance(d, Dictionary) and d.count() == n and d.head(3) == ["cat 0", "cat 1", "cat 2"]
    assert both[F.col("c").isin("cat 7", "cat 999999")].realised().obs.categories["c"].head(5) == ["cat 7", "cat 999999"]
