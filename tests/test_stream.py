"""Batch streams: order, jobs, resuming."""

import json

import pytest
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, Axis
from gridlake.operators.collection import Collection
from gridlake.operators.element import Matrix
from gridlake.operators.grid import Grid
from gridlake.operators.stream import BatchStream, dealt


@pytest.fixture(scope="module")
def c(spark):
    """203 rows with two cells each, but for rows 100 to 129, which have none."""
    n = 203
    cells = spark.range(n).where("id NOT BETWEEN 100 AND 129").select(F.col("id").alias("o"), F.explode(F.expr("array(0L, 1L)")).alias("v"), F.col("id").cast("double").alias("value"))
    return Collection(Grid(Axis.of(spark.range(n), "id"), Axis.of_names(spark, ["x", "y"]), {None: Matrix(cells)}), convert={"X": lambda x: x + 1})


def test_in_order(spark, c, tmp_path):
    got = list(BatchStream.write(c, str(tmp_path), 10))
    assert [k for k, _ in got] == list(range(21)) and [len(x) for _, x in got] == [20] * 10 + [0] * 3 + [20] * 7 + [6]
    assert [(r.o, r.v, r.value) for r in got[13][1]][:3] == [(130, 0, 131.0), (130, 1, 131.0), (131, 0, 132.0)]
    assert len(list(BatchStream.write(c, str(tmp_path), 10, drop_last=True))) == 20 and [len(x) for _, x in BatchStream.write(c, str(tmp_path), 1000)] == [346]


@pytest.mark.parametrize("block", [1, 7])
def test_resume(spark, c, tmp_path, block):
    """Stopped after some batches, and from a cursor that went through JSON: the same batches in the same order."""
    s = BatchStream.write(c, str(tmp_path), 8, shuffle=True, seed=3, block=block)
    whole = [(k, [tuple(r) for r in x]) for k, x in BatchStream.resume(spark, s.cursor())]
    seen = []
    for k, x in s:
        seen.append((k, [tuple(r) for r in x]))
        if k == 9:
            break
    assert s.cursor()["next"] == 9  # the tenth was handed out, but nobody said that it is done
    s.next = 10
    later = BatchStream.resume(spark, json.loads(json.dumps(s.cursor())))
    seen += [(k, [tuple(r) for r in x]) for k, x in later]
    assert seen == whole and sorted(r[2] for _, x in whole for r in x) == sorted(r.o for r in c.layer().collect())
    assert [k for k, _ in whole] == list(range(26)) and later.next == 26
    order = [r.id for r in dealt(c, 8, True, False, 3, block).orderBy("batch", "place").select(F.col(KEY).alias("id")).collect()]
    assert sorted(order) == list(range(203)) != order
    if block > 1:
        assert {i // 7 for i in order[:7]} == {order[0] // 7}


def test_jobs_do_not_grow_with_batches(spark, c, tmp_path):
    def jobs(size):
        s = BatchStream.write(c, str(tmp_path), size)
        group = f"size {size}"
        spark.sparkContext.setJobGroup(group, group)
        n = len(list(s))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (few, a), (many, b) = jobs(100), jobs(2)
    assert (few, many) == (3, 102) and b <= 4 * a and b < many
