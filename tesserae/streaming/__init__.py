"""Streams of vectors into a feature cache.

Blocks are independent, so encoding keeps no state: each micro-batch is encoded by the same
expressions as a table and appended. Rows carry their batch, and a batch that runs again after a
failure replaces its own partition, so each is stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators import quantize as Q


def encode_stream(stream: DataFrame, column: str, path: str, checkpoint: str, mode: str = "amo_balanced", group: int = 32, available_now: bool = True) -> StreamingQuery:
    """Start writing the codes of `column` below path, partitioned by micro-batch."""

    def put(batch: DataFrame, epoch: int) -> None:
        out = Q.encode(batch, column, mode, group).drop(column).withColumn("batch", F.lit(epoch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
