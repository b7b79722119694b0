"""Landed search responses as a stream: every micro-batch is a run of the postings store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postwatch.sinks import postings as store

PAUSE = "20 seconds"
#: Batches after which the store is compacted.
COMPACT_EVERY = 180


def start(feed: DataFrame, root: str, run: str, checkpoint: str, once: bool = False, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Take in the streaming ``feed`` (see ``feeds.landed_responses``); run ids and ``checkpoint`` as in ``poll_stream.start``."""

    def serve(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{run}-{batch_id:010d}"
        store.write(batch, root, run_id)
        if batch_id % compact_every == compact_every - 1:
            store.compact(batch.sparkSession, root, lambda earlier: earlier < run_id)

    writer = feed.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).queryName(f"landing-{run}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PAUSE)).start()
