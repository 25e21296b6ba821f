"""Mini-batches as a stream that can stop and go on: cells are dealt to batches once, in one shuffle, and read file by file.

Files hold whole runs of batches in order, and a table says which; a batch that lies across two files is read from both. So
the number of jobs is the number of files, whatever the number of batches, and the driver holds a batch at a time. A cursor
is a small mapping: where the batches lie and which one is next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, ORD, with_positions
from gridlake.operators.collection import Collection
from gridlake.operators.grid import drawn
from gridlake.sources import store


def dealt(c: Collection, batch_size: int, shuffle: bool, drop_last: bool, seed: int, block: int) -> DataFrame:
    """(_key, batch, place): rows in batches. Shuffled, blocks of `block` neighbouring rows are drawn, and rows of a block keep together."""
    rows = c.grid.obs.rows.select(KEY)
    if not shuffle:
        at = with_positions(rows)
    else:
        if block > 1:
            rows = with_positions(rows).withColumn("_b", F.floor(F.col(ORD) / block)).drop(ORD)
        else:
            rows = rows.withColumn("_b", F.to_json(F.struct(KEY)))
        draw = lambda *cols: drawn(F.concat_ws(":", F.lit(str(seed)), *(x.cast("string") for x in cols)))
        at = with_positions(rows.withColumn("_r", F.struct(draw(F.col("_b")), F.col("_b"), draw(F.lit("row"), F.to_json(F.struct(KEY))), F.col(KEY))), "_r").drop("_r", "_b")
    out = at.select(KEY, F.floor(F.col(ORD) / batch_size).alias("batch"), (F.col(ORD) % batch_size).alias("place"))
    return out.where(F.col("batch") < c.grid.n_obs // batch_size) if drop_last else out


@dataclass
class BatchStream:
    """Batches of cells (place, o, v, value) from `next` on."""

    spark: SparkSession
    path: str
    n: int
    next: int = 0

    @staticmethod
    def write(c: Collection, path: str, batch_size: int, key: str | None = None, shuffle: bool = False, drop_last: bool = False, seed: int = 0, block: int = 1) -> BatchStream:
        """Deal a collection's cells to batches, into a new folder below path."""
        spark = c.grid.obs.df.sparkSession
        path = f"{path}/batches-{uuid.uuid4().hex}"
        rows = dealt(c, batch_size, shuffle, drop_last, seed, block)
        cells = c.layer(key).join(rows.withColumnRenamed(KEY, "o"), "o").select("batch", "place", "o", "v", "value")
        cells.repartitionByRange("batch", "place").sortWithinPartitions("batch", "place", "v").write.parquet(path)
        store._write_zones(spark, path, "batch")
        n = c.n_batches(batch_size, drop_last)
        store._create(spark, f"{path}/_stream.json", json.dumps({"n": n}))
        return BatchStream(spark, path, n)

    def cursor(self) -> dict[str, Any]:
        return {"path": self.path, "next": self.next}

    @staticmethod
    def resume(spark: SparkSession, cursor: dict[str, Any]) -> BatchStream:
        return BatchStream(spark, cursor["path"], json.loads(store._get_text(spark, f"{cursor['path']}/_stream.json"))["n"], cursor["next"])

    def _cells(self) -> Iterator[Row]:
        zones = self.spark.read.parquet(f"{self.path}/_zones").where(F.col("high") >= self.next).orderBy("low", "high").collect()  # a row a file
        for z in zones:
            yield from self.spark.read.parquet(f"{self.path}/{z.file}").where(F.col("batch") >= self.next).orderBy("batch", "place", "v").toLocalIterator()

    def __iter__(self) -> Iterator[tuple[int, list[Row]]]:
        """(batch, cells) in order. A batch without any cell is an empty list; the cursor moves on when the next one is asked for."""
        start = self.next
        for k, rows in groupby(self._cells(), key=lambda r: r.batch):
            while start < k:
                yield start, []
                start += 1
                self.next = start
            yield k, list(rows)
            start = k + 1
            self.next = start
        while start < self.n:
            yield start, []
            start += 1
            self.next = start
