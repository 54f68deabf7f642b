"""Inserts from a stream: each micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.columns import column_of
from ..operators.dml import append
from ..operators.grid import Grid


def insert_stream(stream: DataFrame, grid: Grid, starts: list[float], path: str, checkpoint: str) -> StreamingQuery:
    """Key each batch, place it in its columns and add it to the stored points; a batch that is run again overwrites its own files."""

    def write(batch: DataFrame, epoch: int) -> None:
        keyed = grid.keyed(batch)
        append(keyed.withColumn("col_id", column_of(keyed["key"], starts)), f"{path}/epoch={epoch}")

    def once(batch: DataFrame, epoch: int) -> None:
        target = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={epoch}")
        target.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
        write(batch, epoch)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
