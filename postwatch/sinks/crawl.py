"""Outputs of page triage: results, the remaining queue, the page store, filtered link lists."""

from __future__ import annotations

from pyspark.sql import DataFrame

from postwatch.sinks import runs

_CSV = {"header": "true", "escape": '"', "quote": '"', "emptyValue": ""}


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV files with a header, quoted as the scan in ``sources.queue_csv`` reads them.

    The rows lie in the order of ``order``, by default their place in the queue they were read from (``source_file``, ``pos``; not written): each
    file holds a range of it, sorted, and the names of the files sort as their ranges do. So a scan over ``whole`` files numbers them
    as they were. ``order=[]`` writes them as they come.
    """
    place = [c for c in ("source_file", "pos") if c in rows.columns]
    by = place if order is None else order
    if by:
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    rows.drop(*(place if order is None else [])).write.mode("overwrite").options(**_CSV).csv(path)


def append_results(rows: DataFrame, path: str, run_id: str, csv: bool = False) -> None:
    if csv:
        write_csv(rows, f"{path}/run_id={run_id}")
    else:
        runs.write_run(rows, path, run_id)


def write_remaining(rows: DataFrame, source: str, target: str) -> None:
    """The queue file without what was processed, in its own order. Spark cannot overwrite what it reads."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("write the remaining queue to another path than the one it was read from")
    write_csv(rows, target)


def append_pages(rows: DataFrame, path: str, run_id: str) -> None:
    """Page texts with ``html_file_path`` as a column; a file per page would swamp the file system."""
    runs.write_run(rows, path, run_id)
