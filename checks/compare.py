"""Run every query and its SQL twin on one data directory and compare: ``python -m checks.compare [dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracles, registry


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def difference(spark: SparkSession, db: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str | None:
    """What differs, or None."""
    frame = registry.all_queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = sorted(map(repr, (tuple(row) for row in frame.select(*columns).collect())))
    twin = db.sql(oracles.all_oracles()[name])
    if sorted(twin.columns) != columns:
        return f"columns {columns} against {sorted(twin.columns)}"
    theirs = sorted(map(repr, twin.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()))
    if ours != theirs:
        only_ours, only_theirs = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
        return f"{len(ours)} against {len(theirs)} rows; only ours {only_ours[:2]}, only theirs {only_theirs[:2]}"
    if not ours:
        return "no rows"
    kinds = dict(frame.dtypes)
    known = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    wrong = {c: (kinds[c], str(t)) for c, t in zip(twin.columns, twin.types) if known.get(str(t)) != kinds[c]}
    return f"types {wrong}" if wrong else None


def main() -> int:
    from postwatch import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.all_queries())
    spark, db, bad = session.local_session(), connect(sf_dir), 0
    for name in names:
        began = time.time()
        try:
            found = difference(spark, db, sf_dir, name)
        except Exception as error:  # one broken query must not hide the others
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name:24s} {time.time() - began:6.1f}s {'ok' if found is None else found}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
