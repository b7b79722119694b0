"""Costly expressions are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` plus the given columns.

    A filter on a projected column is pushed below the projection as a copy of its whole expression, so a parsed
    document would be parsed again for every filter on it. Filters do not pass a generator, hence one of one row.
    """
    made = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return rows.select(*keep, F.inline(F.array(made)))
