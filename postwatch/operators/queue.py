"""URL queues: what to fetch next, what is left, and the results so far.

A queue may hold one URL many times; all joins by URL salt such URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postwatch.functions import text
from postwatch.operators import skew

# Fixed values.
BATCH = 100
BLOCKED = ["linkedin.com", "indeed.com"]
URL_COLUMN_MARKS = ["url", "link"]


def url_column(columns: list[str]) -> str:
    """The first column whose lowered name holds "url" or "link"; looks at names only."""
    for name in columns:
        if any(mark in name.lower() for mark in URL_COLUMN_MARKS):
            return name
    raise ValueError("no column name contains 'url' or 'link'")


def filter_links(table: DataFrame, blocked: list[str] | None = None, column: str | None = None) -> DataFrame:
    """Rows whose link holds none of ``blocked`` (letter case counts). A row of empty fields holds none and stays; blank lines
    are no rows, the scan leaves them out."""
    link = F.col(f"`{column or url_column(table.columns)}`")
    return table.where(~F.coalesce(text.contains_any(link, BLOCKED if blocked is None else blocked), F.lit(False)))


def processed_urls(*tables: DataFrame) -> DataFrame:
    """Distinct ``job_url`` over all given tables."""
    urls = None
    for table in tables:
        one = table.select("job_url")
        urls = one if urls is None else urls.unionByName(one)
    return urls.distinct()


def unprocessed(queue: DataFrame, processed: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Queue rows whose URL is not processed, copies kept."""
    done = processed.select("job_url").distinct()
    return skew.salted_join(queue, done, ["job_url"], "left_anti", ["pos"], hot_rows)


def file_order(queue: DataFrame) -> list[Column]:
    """What orders the rows of a queue: ``pos`` starts anew in each file."""
    return [F.col(c) for c in ("source_file", "pos") if c in queue.columns]


def next_batch(queue: DataFrame, processed: DataFrame, size: int | None = BATCH, marker: str | None = None,
               hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """The first ``size`` rows, in file order, that carry ``marker`` and are not processed. Copies count.

    A queue of several files (``source_file`` beside ``pos``) is taken file by file. ``size=None`` takes all rows and
    needs no order.
    """
    listed = queue.where(F.col("job_url").isNotNull())
    if marker is not None:
        listed = listed.where(F.contains("job_url", F.lit(marker)))
    waiting = unprocessed(listed, processed, hot_rows)
    return waiting if size is None else waiting.orderBy(*file_order(queue)).limit(size)


def remaining(queue: DataFrame, newly_processed: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    return unprocessed(queue, newly_processed, hot_rows)


def results(batch: DataFrame, triaged: DataFrame, queue: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """One result per batch row: the **first** queue row with its URL, all columns, plus ``html_file_path``.

    A batch row whose page is not in ``triaged`` was not fetched and gives no result. Of several copies of a page one
    that was kept counts.
    """
    first = skew.first_row(queue, ["job_url"], file_order(queue))
    paths = triaged.groupBy(F.col("url").alias("job_url")).agg(F.max("html_file_path").alias("html_file_path"))
    found = first.join(paths, "job_url")
    asked = batch.select("job_url", F.col("pos").alias("_asked"))
    return skew.salted_join(asked, found, ["job_url"], "inner", ["_asked"], hot_rows, counted=queue).select(*queue.columns, "html_file_path")


def counts(queue: DataFrame, processed: DataFrame, newly_processed: DataFrame) -> DataFrame:
    """One row: distinct URLs processed before, now, the sum of both, and queue rows before and after."""
    before = processed.agg(F.count_distinct("job_url").alias("n_before"))
    now = newly_processed.agg(F.count_distinct("job_url").alias("n_new"))
    rows = queue.agg(F.count("*").alias("n_queue"))
    left = remaining(queue, newly_processed).agg(F.count("*").alias("n_remaining"))
    parts = [
        table.select(F.lit(name).alias("name"), F.col(table.columns[0]).alias("value"))
        for name, table in {"before": before, "new": now, "queue": rows, "remaining": left}.items()
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def pick(name: str):
        return F.max(F.when(F.col("name") == name, F.col("value")))

    return stacked.agg(
        pick("before").alias("n_before"), pick("new").alias("n_new"),
        (pick("before") + pick("new")).alias("n_processed_total"),
        pick("queue").alias("n_queue"), pick("remaining").alias("n_remaining"),
    )
