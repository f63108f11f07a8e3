"""Micro-batches of a stream into a store.

Each micro-batch is one committed log batch.  Its id is in the edit that commits it, so a batch that a restart delivers
again is left out, wherever the first delivery broke off.  No watermark: the newest sequence number wins, however late a row is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def ingest(store: Store, stream: DataFrame, checkpoint: str, *order: str, flush_every: int = 16, name: str = "ingest") -> StreamingQuery:
    """``stream`` has key, type, value and the ``order`` columns; runs until stopped, or to the end of what there is."""

    def batch(rows: DataFrame, number: int) -> None:
        if number <= dict(store.version.marks).get(name, -1):
            return
        store.apply_many(rows, *order, mark=(name, number))
        if number % flush_every == flush_every - 1:
            store.flush()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
