"""Episodes from a stream, ingested batch by batch (an addition: the writes themselves are batches)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from palimpsest.operators.lifecycle import ingest_episodes
from palimpsest.sources.shared import with_numbers
from palimpsest.sources.store import Store


def stream_episodes(episodes: DataFrame, store: Store, checkpoint: str, *, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), **trigger):
    """Start a query that commits each micro-batch of episodes (with ids) to the store.

    A batch that is delivered again changes nothing: an episode that is there already, unchanged,
    is no error.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.commit(ingest_episodes, with_numbers(batch, ["id"], "pos"), clock())

    return episodes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
