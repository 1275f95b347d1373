"""Ledgers, caches and recall records kept by a stream: newest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from provenir.sources.writers import append_newest


def keep_newest(
    stream: DataFrame, folder: str, state: str, keys: list[str], order: list[Column]
) -> None:
    """Write what has arrived and stop; progress stays under ``state``."""
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, epoch: append_newest(batch, epoch, folder, keys, order)
        )
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
