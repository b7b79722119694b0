"""Change requests as a stream: every micro-batch is one poll."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postwatch.plans import poll

# Fixed value: seconds between two polls.
PAUSE = "20 seconds"
#: Polls after which the stores are compacted: about once an hour.
COMPACT_EVERY = 180


def _today() -> str:
    return datetime.datetime.now(datetime.timezone.utc).date().isoformat()


def start(feed: DataFrame, settings: poll.PollSettings, run: str, checkpoint: str, once: bool = False,
          day: Callable[[], str] = _today, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start polling the streaming ``feed``.

    A fresh checkpoint counts batches from 0 again, so ``run`` is part of every run id; take one that sorts after all
    earlier ones. ``once`` serves what is there and stops; otherwise a batch starts every 20 seconds. What was sent
    is remembered in the ledger table, not in stream state, as it has no end. ``checkpoint``: a folder all executors share.

    Every ``compact_every`` polls the runs before the current one are folded (never the current one: after a failure Spark
    does it again), so the stores have a bounded number of files however long the stream runs.
    """

    def serve(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{run}-{batch_id:010d}"
        poll.poll(batch.sparkSession, batch, run_id, day(), settings)
        if batch_id % compact_every == compact_every - 1:
            poll.compact(batch.sparkSession, settings.root, before=run_id, prefix=f"{run}-")

    writer = feed.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).queryName(f"poll-{run}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PAUSE)).start()
