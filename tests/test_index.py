"""Sets and frames of positions against lists."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, NAME, Axis
from gridlake.operators.index import Ranges, Taken


def listed(r):
    return [i for a, z in zip(r.starts.tolist(), r.stops.tolist()) for i in range(a, z)]


def test_algebra_of_ranges():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 40)
        x, y = ({i for i in range(n) if r.random() < p} for p in (r.random(), r.random()))
        a, b = (Ranges.of_mask([i in s for i in range(n)]) for s in (x, y))
        assert listed(a) == sorted(x) and len(a) == len(x) and listed(a | b) == sorted(x | y) and listed(a & b) == sorted(x & y) and listed(a.beside(n)) == sorted(set(range(n)) - x)
        i, j = sorted(r.randrange(0, n + 2) for _ in "ab")
        assert listed(a.sliced(i, j)) == sorted(x)[i:j]
        base = range(r.randrange(5), 500, r.randrange(1, 4))
        assert listed(a.within(base)) == [base[p] for p in sorted(x)]
    assert Ranges.of((5, 9), (1, 3), (3, 4), (8, 12), (7, 7)) == Ranges.of((1, 4), (5, 12)) and len(Ranges.of()) == 0


@pytest.fixture(scope="module")
def axis(spark):
    """Keys 0, 3, 6, ...: not positions."""
    return Axis.of(spark.range(1000).select((F.col("id") * 3).alias("k")), "k")


def labels(a):
    return [int(r[0]) // 3 for r in a.rows.orderBy(KEY).select(NAME).collect()]


def test_masks_and_ranges_select(axis):
    mask = np.arange(1000) % 3 == 1
    assert labels(axis.select(mask)) == list(range(1, 1000, 3)) == labels(axis.select(mask.tolist()))  # more runs than a condition takes
    few = Ranges.of((3, 5), (990, 1000))
    assert labels(axis.select(few)) == [3, 4, *range(990, 1000)] and axis.select(few).count() == 12
    assert labels(axis.select(slice(100, 200)).select(few.sliced(0, 2))) == [103, 104]
    assert labels(axis.select(slice(100, 200, 2)).select(Ranges.of((1, 4)))) == [102, 104, 106] and labels(axis.select(Ranges.of())) == []
    with pytest.raises(IndexError):
        axis.select(Ranges.of((999, 1001)))
    with pytest.raises(IndexError):
        axis.select([True])


def test_frames_of_positions(spark, axis):
    want = [5, -1, 5, 0, 998]
    frame = Taken.of(spark.createDataFrame(list(enumerate(want)), "i long, p long"), "i", "p")
    assert labels(axis.select(frame)) == [5, 999, 5, 0, 998] == labels(axis.select(want)) == labels(axis.select(np.array(want)))
    assert labels(axis.select(slice(10, 20)).select(frame.__class__(frame.frame.where("new < 4")))) == [15, 19, 15, 10]
    taken = axis.select(frame)
    assert taken.dense and labels(taken.select(slice(1, 4))) == [999, 5, 0] and labels(taken.select(slice(None, None, -2))) == [998, 5, 5] and labels(taken.select([4, 4])) == [998, 998]
    with pytest.raises(IndexError):
        axis.select(Taken.of(spark.createDataFrame([(0, 1000)], "i long, p long"), "i", "p"))


def test_slice_of_take_of_slice_is_one_join(spark):
    a = Axis(spark.range(1000).select(F.col("id").alias(KEY), F.col("id").cast("string").alias(NAME)), dense=True, _n=1000)
    got = a.select(slice(10, 900, 3)).select(Taken.of(spark.range(50), "id", F.col("id") * 5)).select(slice(3, 40, 2))
    plan = got.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and [int(r[0]) for r in got.rows.orderBy(KEY).select(NAME).collect()] == [10 + 15 * i for i in range(3, 40, 2)]


def test_a_million_positions_in_constant_driver_memory(spark):
    n = 4_000_000
    a = Axis(spark.range(n).select(F.col("id").alias(KEY), F.col("id").cast("string").alias(NAME)), dense=True, _n=n)
    tracemalloc.start()
    some = a.select(Ranges.of((1_000_000, 1_500_000), (2_000_000, 2_500_000)))
    taken = some.select(Taken.of(spark.range(1_000_000), "id", F.lit(999_999) - F.col("id")))
    got = taken.rows.agg(F.count("*"), F.min(F.col(NAME).cast("long")), F.max_by(NAME, KEY)).first()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tuple(got) == (1_000_000, 1_000_000, "1000000") and peak < 5_000_000
