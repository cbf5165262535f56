"""Keeping the history up to date from a stream of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from verdigris.operators import history
from verdigris.sources.store import Store


def follow(outcomes: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds each micro-batch of outcomes (id, ord, at, passed, duration_ms) to the store as a partial history of its own;
    nothing that is there is written again but by the store's merges. ord orders an id's outcomes in the whole stream, so
    late ones take their place. The batch's number is committed with its rows, under the checkpoint's name, so that one
    that is repeated after a failure counts once."""

    def add(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, store.path).append((checkpoint, number), history=history.partial(batch))

    w = outcomes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (w.trigger(availableNow=True) if available_now else w).start()
