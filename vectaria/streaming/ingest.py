"""Bulk upsert of a stream into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.collection import Collection


def bulk_upsert_stream(points: DataFrame, collection: Collection, checkpoint: str, name: str = "bulk", once: bool = True) -> StreamingQuery:
    """Each micro-batch is one commit.  The manifest records its number, so a batch that is run again
    after a failure changes nothing; ids resolve by batch, then by row order."""

    def apply(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            collection.upsert(kept, batch=f"{name}/{number}")
        finally:
            kept.unpersist()

    writer = points.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()
