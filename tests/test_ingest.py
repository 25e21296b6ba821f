"""Streams appended to stored grids: batches count once, whatever fails in between."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, Axis
from gridlake.operators.element import Matrix
from gridlake.operators.grid import Grid
from gridlake.sources import store
from gridlake.streaming.ingest import append_grids


def grid_of(rows, var):
    return Grid(Axis.of(rows.select("id", "kind"), "id"), var, {None: Matrix(rows.select(F.col("id").alias("o"), F.explode("cells").alias("v")).withColumn("value", F.col("o") * 10 + F.col("v")))})


def some(spark, a, z):
    return spark.range(a, z).select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("kind"), F.expr("array(id % 5, (id + 1) % 5)").alias("cells"))


@pytest.fixture
def at(spark, tmp_path):
    """A stored grid of ten rows, and folders of a stream with two files."""
    store.write(grid_of(some(spark, 0, 10), Axis.of(spark.range(5), "id")), str(tmp_path / "g"))
    for a in (10, 30):
        some(spark, a, a + 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return {k: str(tmp_path / k) for k in ("g", "in", "log")}


def run(spark, at, make=grid_of, **k):
    s = spark.readStream.schema(some(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(at["in"])
    append_grids(s, at["g"], at["log"], make, **k).awaitTermination(120)


def keys(spark, at):
    g = store.read(spark, at["g"]).validate()
    assert sorted(map(tuple, g.X.df.collect())) == sorted((r[KEY], v, r[KEY] * 10 + v) for r in g.obs.df.collect() for v in (r[KEY] % 5, (r[KEY] + 1) % 5))
    return sorted(r[KEY] for r in g.obs.df.select(KEY).collect())


def test_a_version_for_each_batch(spark, at):
    run(spark, at)
    assert keys(spark, at) == list(range(50)) and store.versions(spark, at["g"]) == [1, 2, 3]
    assert store.snapshot(spark, at["g"])["streams"] == {at["log"]: 1}
    run(spark, at)
    assert store.versions(spark, at["g"]) == [1, 2, 3]
    some(spark, 50, 55).coalesce(1).write.mode("append").parquet(at["in"])
    run(spark, at)
    assert keys(spark, at) == list(range(55)) and store.versions(spark, at["g"]) == [1, 2, 3, 4]


def test_a_batch_run_again_adds_nothing(spark, at):
    run(spark, at)
    for f in ("1", ".1.crc"):  # Spark's log lacks the last batch, as after a failure right behind the version
        os.remove(f"{at['log']}/commits/{f}")
    run(spark, at)
    assert keys(spark, at) == list(range(50)) and store.versions(spark, at["g"]) == [1, 2, 3]


def test_a_batch_that_fails_is_taken_up_again(spark, at):
    calls = []

    def fails_once(rows, var):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return grid_of(rows, var)

    with pytest.raises(StreamingQueryException):
        run(spark, at, fails_once)
    assert len(keys(spark, at)) == 30 and store.versions(spark, at["g"]) == [1, 2]
    run(spark, at)
    assert keys(spark, at) == list(range(50))


def test_another_writer_in_between(spark, at, monkeypatch):
    publish, rivals = store._publish, []

    def slow(session, path, base, body):
        if not rivals:
            rivals.append(1)
            store.append(path, grid_of(some(session, 100, 103), Axis.of(session.range(5), "id")))
        return publish(session, path, base, body)

    monkeypatch.setattr(store, "_publish", slow)
    run(spark, at)
    assert keys(spark, at) == [*range(50), 100, 101, 102] and store.versions(spark, at["g"]) == [1, 2, 3, 4]


def test_empty_batches_and_keys_that_exist(spark, at):
    some(spark, 0, 0).coalesce(1).write.mode("append").parquet(at["in"])
    run(spark, at)
    assert store.versions(spark, at["g"]) == [1, 2, 3]
    some(spark, 49, 52).coalesce(1).write.mode("append").parquet(at["in"])
    with pytest.raises(StreamingQueryException, match="keys exist already"):
        run(spark, at)
    assert keys(spark, at) == list(range(50))


def test_two_streams_have_marks_of_their_own(spark, at, tmp_path):
    run(spark, at, name="a")
    other = at | {"in": str(tmp_path / "in2"), "log": str(tmp_path / "log2")}
    some(spark, 60, 70).coalesce(1).write.parquet(other["in"])
    run(spark, other, name="b")
    assert store.snapshot(spark, at["g"])["streams"] == {"a": 1, "b": 0} and len(keys(spark, at)) == 60
