"""Scores as a stream: new pairs are stored by micro-batch, once per key and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.score_store import ScoreStore


def ingest(stream: DataFrame, store: ScoreStore, checkpoint: str) -> StreamingQuery:
    """Write a stream of (query_id, doc_id, model, score) into the store; available rows, then stop.

    Versions are the store's own clock, so of a streamed and a put score the later one counts. A batch that
    is run again puts the same scores once more, and a read sees each key's latest.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.put(batch.dropDuplicates(["query_id", "doc_id", "model"]))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
