"""Matching of concepts that arrive as a stream, batch by batch, against a standing table of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.candidates import blocked_topk


def match_arrivals(arrivals: DataFrame, targets: DataFrame, path: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Append the k best targets of each arriving concept (concept, labels) to a Parquet table.

    A batch that is repeated after a failure overwrites its own partition, so every match is stored once.
    """

    def one(batch: DataFrame, number: int) -> None:
        blocked_topk(batch, targets, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
