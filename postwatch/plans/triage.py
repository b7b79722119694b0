"""One pass over a URL queue: choose a batch, judge its pages, and what to write of results, pages and queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postwatch import schemas
from postwatch.operators import pages as page_ops, queue as queue_ops
from postwatch.sinks import crawl, runs


@dataclass(frozen=True)
class Triage:
    """``triaged`` has the verdicts without page texts, ``store`` the texts of the pages to keep."""

    batch: DataFrame
    triaged: DataFrame
    newly: DataFrame
    results: DataFrame
    store: DataFrame
    remaining: DataFrame


def triage_pass(queue: DataFrame, processed: DataFrame, pages: DataFrame, directory: str, size: int | None = queue_ops.BATCH,
                marker: str | None = None, keywords: list[str] | None = None,
                required: tuple[str, str | None] | None = None) -> Triage:
    """``size=None`` takes all of the queue. Rejected pages count as processed; rows without a page stay queued.

    Pages are long. They are judged where they lie and the verdicts are joined; of the texts only those to keep move.
    Beside a small batch adaptive execution sends the batch to the pages. (An inner join with distinct URLs; a semi join
    would be pushed below the verdicts and move the texts.)
    """
    batch = queue_ops.next_batch(queue, processed, size, marker)
    asked = batch.select(F.col("job_url").alias("url")).distinct()
    judged = page_ops.triage(pages, directory, keywords, required)
    triaged = judged.drop("html").join(asked, "url")
    store = page_ops.store_rows(judged).join(asked, "url")
    newly = triaged.select(F.col("url").alias("job_url")).distinct()
    results = queue_ops.results(batch, triaged, queue)
    return Triage(batch, triaged, newly, results, store, queue_ops.remaining(queue, newly))


_PROCESSED = StructType([StructField("job_url", StringType())])


def run_triage(spark: SparkSession, queue: DataFrame, pages: DataFrame, root: str, run_id: str, directory: str,
               size: int | None = queue_ops.BATCH, marker: str | None = None, keywords: list[str] | None = None,
               required: tuple[str, str | None] | None = None) -> DataFrame:
    """One pass whose outputs are written: verdicts, results, kept pages, processed URLs, and the queue that is left.

    Page texts are judged once: the verdicts are written with the texts of the pages to keep, and everything else is made
    from them. Each run owns its directories under ``root`` (processed, verdicts, results, pages, queue), so the same run
    done again replaces them. Returns the queue that is left; it is what the next run takes.

    The run's counts (see ``queue.counts``) are a row of ``counts``. They are taken while the outputs are written, so they read nothing more.
    """
    before, now, rows, left = (Observation() for _ in range(4))
    done = runs.read_runs(spark, f"{root}/processed", _PROCESSED, without=run_id).select("job_url").distinct()
    done = done.observe(before, F.count("job_url").alias("n"))
    batch = runs.staged(queue_ops.next_batch(queue, done, size, marker), f"{root}/batch/run_id={run_id}")
    asked = batch.select(F.col("job_url").alias("url")).distinct()
    judged = page_ops.triage(pages, directory, keywords, required)
    kept_text = F.when(F.col("html_file_path") != "", F.col("html")).alias("html")
    columns = [kept_text if c == "html" else F.col(c) for c in judged.columns]
    verdicts = runs.staged(judged.select(*columns).join(asked, "url"), f"{root}/verdicts/run_id={run_id}")
    newly = verdicts.select(F.col("url").alias("job_url")).distinct()
    crawl.append_results(queue_ops.results(batch, verdicts, queue), f"{root}/results", run_id)
    crawl.append_pages(page_ops.store_rows(verdicts), f"{root}/pages", run_id)
    runs.write_run(newly.observe(now, F.count("job_url").alias("n")), f"{root}/processed", run_id)
    waiting = queue_ops.remaining(queue.observe(rows, F.count(F.lit(1)).alias("n")), newly)
    waiting = runs.staged(waiting.observe(left, F.count(F.lit(1)).alias("n")), f"{root}/queue/run_id={run_id}")
    n_before, n_new, n_queue, n_left = (runs.observed(seen, ["n"])["n"] for seen in (before, now, rows, left))
    counted = spark.createDataFrame([(n_before, n_new, n_before + n_new, n_queue, n_left)], schemas.TRIAGE_COUNTS)
    runs.write_run(counted, f"{root}/counts", run_id)
    return waiting


def counts(spark: SparkSession, root: str) -> DataFrame:
    """One row per run: distinct URLs processed before, now, the sum of both, and queue rows before and after."""
    return runs.read_runs(spark, f"{root}/counts", schemas.TRIAGE_COUNTS)
