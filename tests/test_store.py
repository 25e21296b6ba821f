"""Versions of a stored grid, writers that fail or meet, and reads that open only the files they need."""

import pytest
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, Axis, Categories
from gridlake.operators.blocks import Blocks
from gridlake.operators.element import Aligned, Matrix, Pairs
from gridlake.operators.grid import Grid
from gridlake.sources import store


def made(spark, a, z, kinds=("x", "y")):
    """Rows a to z - 1, of every element along obs."""
    ids = spark.range(a, z)
    obs = Axis.of(ids.select("id", F.when(F.col("id") % 2 == 0, kinds[0]).otherwise(kinds[1]).alias("kind")), "id", categories={"kind": Categories(kinds)})
    var = Axis.of(spark.range(5), "id")
    cells = ids.crossJoin(spark.range(5).select(F.col("id").alias("v"))).where("(id + v) % 3 = 0").select(F.col("id").alias("o"), "v", (F.col("id") * 10 + F.col("v")).alias("value"))
    emb = Aligned(ids.select(F.col("id").alias(KEY), F.array(F.col("id").cast("double")).alias("value")), 1)
    dense = Blocks.of_rows(ids.select("id", F.array(*(F.col("id") * 10 + j for j in range(5))).alias("row")), "id", "row", list(range(5)))
    return Grid(obs, var, {None: Matrix(cells), "d": dense}, {"e": emb}, {}, {"p": Pairs(ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1).alias("value")))})


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def path(spark, tmp_path):
    p = str(tmp_path / "g")
    store.write(made(spark, 0, 40), p)
    return p


def test_versions(spark, path):
    store.append(path, made(spark, 100, 140, ("x", "z")))
    assert store.versions(spark, path) == [1, 2]
    new, old = store.read(spark, path).validate(), store.read(spark, path, version=1).validate()
    assert (new.n_obs, old.n_obs) == (80, 40) and new.obs.categories["kind"].values == ("x", "y", "z") and old.obs.categories["kind"].values == ("x", "y")
    assert sorted(r["_at"] for r in new.layer("d").rows().collect()) == list(range(80)) and new.obsp["p"].df.count() == 80
    with pytest.raises(FileExistsError):
        store.write(made(spark, 0, 4), path)
    store.write(made(spark, 0, 4), path, "overwrite")
    assert store.read(spark, path).n_obs == 4 and store.read(spark, path, version=2).n_obs == 80
    with pytest.raises(FileNotFoundError):
        store.read(spark, path, version=9)
    assert store.clean_up(spark, path) == []  # just written
    gone = store.clean_up(spark, path, grace=0)
    assert len(gone) == 2 * 5 + 1 and store.versions(spark, path) == [3] and store.read(spark, path).validate().n_obs == 4


def test_append_that_dies_leaves_the_old_grid(spark, path, monkeypatch):
    whole, real = rows(store.read(spark, path).X.df), store.write_elem

    def dies(where, *a, **k):
        if where.endswith("obsm/e"):
            raise OSError("lost")
        return real(where, *a, **k)

    monkeypatch.setattr(store, "write_elem", dies)
    with pytest.raises(OSError, match="lost"):
        store.append(path, made(spark, 100, 140))
    monkeypatch.undo()
    g = store.read(spark, path).validate()
    assert g.n_obs == 40 and rows(g.X.df) == whole and store.versions(spark, path) == [1]
    store.append(path, made(spark, 100, 140))
    assert store.read(spark, path).n_obs == 80 and store.clean_up(spark, path, keep=2, grace=0) == []


def test_of_two_writers_one_wins(spark, path, monkeypatch):
    real = store._publish

    def late(*a):
        monkeypatch.undo()
        store.append(path, made(spark, 200, 210))  # another writer, while this one was at work
        return real(*a)

    monkeypatch.setattr(store, "_publish", late)
    with pytest.raises(store.Conflict):
        store.append(path, made(spark, 100, 140))
    g = store.read(spark, path).validate()
    assert g.n_obs == 50 and store.clean_up(spark, path, keep=2, grace=0) == []  # the loser took its folders away
    store.append(path, made(spark, 100, 140))
    assert store.read(spark, path).n_obs == 90
    with pytest.raises(ValueError, match="exist"):
        store.append(path, made(spark, 205, 206))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A store of many files."""
    p = str(tmp_path_factory.mktemp("store") / "g")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.write(made(spark, 0, 4000), p)
    for k, v in old.items():
        spark.conf.set(k, v)
    return p


def scanned(df):
    """Rows, and files and bytes that the scans of a query opened, by the metrics of its plan."""
    got = rows(df)
    df._jdf.queryExecution().executedPlan()
    q = df._jdf.queryExecution()
    q.toRdd().count()
    files = size = 0
    todo = [q.executedPlan()]
    while todo:
        n = todo.pop()
        if n.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            n = n.executedPlan()
        if n.getClass().getSimpleName() == "FileSourceScanExec":
            m = n.metrics()
            files += m.apply("numFiles").value()
            size += m.apply("filesSize").value()
        todo += [n.children().apply(i) for i in range(n.children().size())]
        if n.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(n.plan())
    return got, files, size


def test_scanned_bytes_fall_with_the_selection(spark, wide):
    x = lambda keys: store.read(spark, wide, elements=["X"], keys=keys).X.df
    every, files, size = scanned(x(None))
    assert files >= 12
    for keys, want in [(store.Keys.between(100, 200), range(100, 201)), (store.Keys.of([7, 9, 3000]), (7, 9, 3000)), (store.Keys.of([5]), (5,))]:
        got, some, part = scanned(x(keys))
        assert got == [r for r in every if r[0] in want] and some <= 3 and part < size / 4
    got, some, part = scanned(x(store.Keys.between(-9, -1)))
    assert got == []
    half = scanned(x(store.Keys.between(0, 1999)))
    assert half[1] < files and half[2] < 0.7 * size and len(half[0]) == len([r for r in every if r[0] < 2000])


def test_selected_grid_is_whole(spark, wide):
    keys = store.Keys.of([*range(50, 60), 1234, 3999])
    g = store.read(spark, wide, elements=["X", "obsm/e", "obsp/p"], keys=keys)
    assert g.validate().n_obs == 12 and g.obsp["p"].df.count() == 12 and [r[0] for r in rows(g.obsm["e"].df)] == [*range(50, 60), 1234, 3999]
    many = store.Keys.of(list(range(0, 4000, 7)), gap=0)
    assert len(many.runs) > many.MANY and store.read(spark, wide, elements=["X"], keys=many).n_obs == len(range(0, 4000, 7))


def test_runs_are_clumped():
    assert store.Keys.of([9, 1, 2, 3]) == store.Keys(((1, 9),), (1, 2, 3, 9)) and store.Keys.of([1, 2, 3], 1) == store.Keys(((1, 3),))
    assert store.Keys.of([1, 500, 2], 10).runs == ((1, 2), (500, 500)) and store.Keys.of(["b", "a"]).runs == (("a", "a"), ("b", "b"))
    assert store.Keys.of([]).runs == ()


def test_labels_are_looked_up_in_one_bucket(spark, wide):
    """By the plan's metrics: one bucket of the index, and one file of obs."""
    g = store.read(spark, wide, elements=["X"])
    assert rows(g["123"].obs.rows.select(KEY)) == [(123,)] and rows(g[["77", "3001", "77"]].obs.rows.select("_from")) == [(77,), (77,), (3001,)]
    part = g["100":"203"].obs
    assert rows(part.rows.select(KEY)) == [(i,) for i in range(100, 204)] and rows(g["3990":].obs.rows.select(KEY)) == [(i,) for i in range(3990, 4000)]
    got, files, _ = scanned(g.obs.labels.keys(["123"]))
    every = scanned(g.obs.labels.parts[0][0])
    assert got == [(123, "123")] and files == 1 and every[1] >= 16
    for missing in ("nobody", ["1", "nobody"]):
        with pytest.raises(KeyError):
            g[missing]
    with pytest.raises(KeyError):
        g["5":"nobody"]
    assert g[F.col(KEY) > 5].obs.labels is None and store.read(spark, wide, keys=store.Keys.of([5, 6])).obs.labels is None
    with pytest.raises(KeyError):
        g[F.col(KEY) > 5]["5"]


def test_label_index_grows_with_appends(spark, tmp_path):
    p = str(tmp_path / "g")
    store.write(made(spark, 0, 40), p)
    store.append(p, made(spark, 100, 140))
    g = store.read(spark, p)
    assert len(g.obs.labels.parts) == 2 and rows(g[["120", "3"]].obs.rows.select("_from")) == [(3,), (120,)] and store.read(spark, p, version=1).obs.labels.keys(["120"]).count() == 0
