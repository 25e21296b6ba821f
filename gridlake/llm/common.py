"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null document id counts as larger than every real one.
NULL_ID = 2**63 - 1


#: Rows and bytes in a batch for Python: texts are long, so the default row count would make batches of many MB.
BATCH_ROWS = 512
BATCH_BYTES = "4m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of sf_dir; also sets the session's Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where it is unset (tests, one machine) make one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridlake-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df hasn't."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_key{i}" for i in range(n + len(taken))) if x not in taken][:n]


#: Rows equal in id and text, of which more are dealt apart.
REPEATS = 256


def _often(keyed: DataFrame, repeats: int) -> tuple[DataFrame | None, int, int]:
    """Keys (_often_id, _often_th) of more than `repeats` rows, None if there are none; bytes of text; rows."""
    n = keyed.groupBy("_id", "_th").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    all_ = n.agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    often = n.where(F.col("n") > repeats).select(F.col("_id").alias("_often_id"), F.col("_th").alias("_often_th"))
    return often if (all_.most or 0) > repeats else None, all_.b or 0, all_.n or 0


def told_apart(keyed: DataFrame, repeats: int = REPEATS) -> tuple[DataFrame, int, int]:
    """keyed (_id, _th, text, ...) with _salt, its bytes of text and its rows.

    Groups are dealt by a hash of (_id, _th, _salt). The salt is 0 but where more than `repeats` rows are equal in id and
    text: there each row has its own, written to the checkpoint folder once, so that no retry can deal a row anew."""
    often, size, n = _often(keyed, repeats)
    if often is None:
        return keyed.withColumn("_salt", F.lit(0).cast("long")), size, n
    hit = keyed.join(often, (F.col("_id") == F.col("_often_id")) & (F.col("_th") == F.col("_often_th")), "left")
    return cut(hit.withColumn("_salt", F.when(F.col("_often_id").isNotNull(), F.monotonically_increasing_id()).otherwise(0)).drop("_often_id", "_often_th")), size, n


def folded(keyed: DataFrame, repeats: int = REPEATS) -> tuple[DataFrame, int]:
    """keyed (_id, _th, text), with one row for those of which more than `repeats` are equal, and its bytes of text."""
    often, size, _ = _often(keyed, repeats)
    if often is None:
        return keyed, size
    same = (F.col("_id") == F.col("_often_id")) & (F.col("_th") == F.col("_often_th"))
    return keyed.join(often, same, "left_anti").unionByName(keyed.join(often, same, "left_semi").groupBy("_id", "_th").agg(F.min("text").alias("text"))), size


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list: the smallest node reachable.

    Alternating large-star and small-star rounds: each round is two aggregations over the edges, and a
    group's edges are replaced by a star around its minimum, so chains halve every round. A hot centre costs
    no more than its own edges, because minima are combined before the shuffle and joined back by
    AQE-splittable joins. Each round's edges are written to the shared checkpoint folder.
    """
    e = cut(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    )
    while True:  # the sum of all nodes' smallest neighbours falls with each round, so it settles
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")),
                                      F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("s"))
            .select("s.u", "s.v").where("u <> v").distinct()
        )
        new = cut(small)
        # A star forest has no node that is both a centre and a leaf, and one centre to each leaf.
        bad = new.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not bad:
            bad = new.select("u").distinct().join(new.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        e = new
        if not bad:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
                e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def held_out(id_col: str | Column = "doc_id") -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
