"""Streaming ingest (an extension): a stream of rows becomes appended rows of a stored grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlake.operators.axis import Axis
from gridlake.operators.grid import Grid
from gridlake.sources import store


def append_grids(rows: DataFrame, path: str, checkpoint: str, grid_of: Callable[[DataFrame, Axis], Grid], name: str | None = None, **trigger) -> StreamingQuery:
    """Append each micro-batch of a stream to a stored grid, as one version that has all of it or none.

    grid_of(batch, var) makes a grid of a batch's rows over the stored columns; a row of the grid must be whole within its batch.
    Each batch counts once: the version that adds it keeps its number under the stream's name (the checkpoint's folder unless
    given), so a batch that Spark runs again after a failure between the version and its own log adds nothing. Where another
    writer made a version in between, the batch is checked and appended anew. A batch without rows makes no version; a batch
    with a key that the grid has stops the query, with that batch not appended."""
    stream = name or checkpoint

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read by every element
        try:
            while not held.isEmpty():
                try:
                    store.append(path, grid_of(held, store.read(batch.sparkSession, path, elements=[]).var), (stream, number))
                    return
                except store.Conflict:
                    continue
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_stream(cells: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of (o, v, value) cells to a layer's folder. The file sink is exactly-once per checkpoint;
    read the folder with `sources.store.read_elem` as a matrix."""
    return (cells.select("o", "v", "value").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def windowed_matrix(events: DataFrame, ts: str, obs: str, var: str, width: str, late: str) -> DataFrame:
    """Cells counted per time window, with a watermark: (start, o, v, value)."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    return (events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), F.col(obs).alias("o"), F.col(var).alias("v"))
            .agg(F.count("*").alias("value")).select(F.col("w.start").alias("start"), "o", "v", "value"))
