"""Dense matrices as blocks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, NAME, Axis
from gridlake.operators.blocks import Blocks, stacked
from gridlake.operators.concat import concat
from gridlake.operators.element import Matrix
from gridlake.operators.grid import Grid
from gridlake.sources import store

N, W = 23, 6
X = np.arange(N * W, dtype=float).reshape(N, W) / 4


@pytest.fixture(scope="module")
def b(spark):
    rows = spark.createDataFrame([(10 * i, X[i].tolist()) for i in range(N)], "k long, row array<double>")
    return Blocks.of_rows(rows.orderBy(F.desc("k")), "k", "row", list("uvwxyz"), per_block=5 * W)


def dense(m):
    """Rows in order, and their keys."""
    got = m.rows().orderBy("_at").collect()
    assert [r["_at"] for r in got] == list(range(len(got)))
    return np.array([r["_row"] for r in got]), [r[KEY] for r in got]


def test_blocks(b):
    x, keys = dense(b)
    assert (x == X).all() and keys == [10 * i for i in range(N)] and b.count() == N and b.width == W
    assert sorted((r.start, len(r["keys"]), len(r["values"])) for r in b.blocks.collect()) == [(0, 5, 30), (5, 5, 30), (10, 5, 30), (15, 5, 30), (20, 3, 18)]


@pytest.mark.parametrize(("a", "z"), [(0, N), (3, 4), (4, 17), (5, 10), (22, 23), (23, 23), (7, 99)])
def test_slices_move_nothing(b, a, z):
    s = b.sliced(a, z)
    if a < min(z, N):
        assert (dense(s)[0] == X[a:z]).all()
    else:
        assert s.blocks.count() == 0
    assert s.count() == max(0, min(z, N) - a)


def test_take_pad_and_columns(spark, b):
    want = [5, 5, 0, 22, 7]
    t = b.taken(spark.createDataFrame([(i, 10 * p) for i, p in enumerate(want)], f"_new long, {KEY} long"), per_block=12)
    assert (dense(t)[0] == X[want]).all() and dense(t)[1] == [0, 1, 2, 3, 4]
    p, keys = dense(b.padded(spark.createDataFrame([(k,) for k in (230, 10, 15, 20)], "k long"), -1.0))
    assert keys == [10, 15, 20, 230] and (p == np.array([X[1], [-1] * W, X[2], [-1] * W])).all()
    c = b.reindexed(list("zq") + ["u", "z"], 9.0)
    assert c.columns == ("z", "q", "u", "z") and (dense(c)[0] == np.column_stack([X[:, 5], np.full(N, 9.0), X[:, 0], X[:, 5]])).all()
    assert b.reindexed(list("uvwxyz")) is b and (dense(b.mapped(lambda v: v * 2))[0] == X * 2).all()


@pytest.mark.parametrize("size", [1, 4, 5, 7, 100])
def test_chunks(b, size):
    got = sorted(b.chunked(size).collect(), key=lambda r: r.chunk)
    assert [(r.start, r.end) for r in got] == [(i, min(i + size, N)) for i in range(0, N, size)]
    for r in got:
        assert (np.array(r["values"]).reshape(-1, W) == X[r.start : r.end]).all() and r["keys"] == [10 * i for i in range(r.start, r.end)]
    assert (dense(b.reblocked(size))[0] == X).all()


def test_long_form_and_back(spark, b):
    m = b.matrix()
    assert m.df.count() == N * W and b.same_as(m) and not b.same_as(Matrix(m.df.withColumn("value", F.col("value") + 1), False))
    obs = Axis.of(spark.createDataFrame([(10 * i,) for i in range(N)], "k long"), "k")
    var = Axis.of(spark.createDataFrame([(c,) for c in "uvwxyz"], "k string"), "k")
    again = Blocks.of_matrix(m, obs, var, per_block=40)
    assert (dense(again)[0] == X).all() and again.columns == b.columns
    holes = Blocks.of_matrix(Matrix(m.df.where("value <> 1.5"), True), obs, var)
    assert (dense(holes)[0] == np.where(X == 1.5, 0, X)).all()


def grids(spark, b):
    axis = lambda names: Axis(spark.createDataFrame([(n, n) for n in names], f"{KEY} string, {NAME} string"))
    obs = Axis.of(spark.createDataFrame([(10 * i,) for i in range(N)], "k long"), "k")
    half = b.reindexed(list("wxyzab"), 5.0)
    return Grid(obs, axis("uvwxyz"), {None: b}), Grid(obs, axis("wxyzab"), {None: half}), half


@pytest.mark.parametrize(("join", "fill"), [("inner", None), ("outer", None), ("outer", -2.0)])
def test_concat_agrees_with_the_long_form(spark, b, join, fill):
    one, two, half = grids(spark, b)
    m = concat([one, two], join=join, fill_value=fill).X
    assert isinstance(m, Blocks)
    long = concat([Grid(one.obs, one.var, {None: b.matrix()}), Grid(two.obs, two.var, {None: half.matrix()})], join=join, fill_value=fill).X
    assert m.same_as(long) and m.count() == 2 * N
    mixed = concat([one, Grid(two.obs, two.var, {None: half.matrix()})], join=join, fill_value=fill).X
    assert mixed.same_as(long)


def test_outer_concat_shuffles_less_than_a_quarter(spark, tmp_path):
    """Bytes that tasks write for shuffles, of blocks and of the long form, where maps of columns are too large to broadcast."""
    n, w = 3000, 60
    made = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda j: F.rand(5) + j).alias("row"))
    made.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    axis = lambda a, z: Axis(spark.createDataFrame([(i, f"c{i:03}") for i in range(a, z)], f"{KEY} long, {NAME} string"))
    obs = Axis.of(rows.select("id"), "id")
    blocks = [Blocks.of_rows(rows, "id", "row", list(range(a, a + w))) for a in (0, 20)]
    for i, x in enumerate(blocks):
        x.blocks.write.parquet(str(tmp_path / f"b{i}"))
        blocks[i] = Blocks(spark.read.parquet(str(tmp_path / f"b{i}")), x.columns)
        blocks[i].df.write.parquet(str(tmp_path / f"l{i}"))
    long = [Matrix(spark.read.parquet(str(tmp_path / f"l{i}")), False) for i in range(2)]

    def shuffled(ms):
        g = concat([Grid(obs, axis(a, a + w), {None: m}) for a, m in zip((0, 20), ms)], join="outer")
        m = g.X
        return written(spark, lambda: (m.blocks if isinstance(m, Blocks) else m.df).write.format("noop").mode("overwrite").save())

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = shuffled(blocks), shuffled(long)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert b > 100_000 and 4 * a < b


def written(spark, job):
    """Bytes of shuffle files that a job writes."""
    sc = spark._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    job()
    return total() - before


def test_in_a_grid(spark, b, tmp_path):
    one, _, _ = grids(spark, b)
    assert one[F.col(KEY) == 30].X.df.count() == W and one.T.X.df.count() == N * W
    assert one.chunked(4).groupBy("chunk").count().count() == 6 and one.chunked(4).count() == N * W
    store.write(one, str(tmp_path / "g"))
    back = store.read(spark, str(tmp_path / "g"))
    assert isinstance(back.X, Blocks) and back.X.same_as(b) and back.X.columns == b.columns
    two = stacked([b, b], [lambda k: k, lambda k: k + 1000])
    assert (dense(two)[0] == np.concatenate([X, X])).all() and dense(two)[1][-1] == 1220
    with pytest.raises(ValueError):
        stacked([b, b.reindexed(["u"])])
