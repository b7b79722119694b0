"""Which runs of a store count: compaction folds many runs into one, and a pointer says when that one takes their place.

A store is a folder of tables, each made of ``run_id=<run>`` folders. Compaction writes the rows of the folded runs as one run
more, the base, whose name holds a ``~``, and then creates the pointer ``_generations/<number>.json``, one small file that is
seen whole or not at all. Readers take the newest pointer: its base and every run that is not folded. So a compaction that is
lost half way leaves a base nobody reads, and the old runs count as before. What a generation has folded is deleted by the
compaction after it, so readers that began before have that long to end, and the number of files stays bounded.

One compaction at a time; names of runs hold no ``~``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F

from postwatch.sinks import files

MARK = "~"
_POINTER = re.compile(r"(\d{10})\.json")


@dataclass(frozen=True)
class Generation:
    number: int = 0
    base: str | None = None
    folded: tuple[str, ...] = ()


def current(spark: SparkSession, root: str) -> Generation:
    numbers = [m[1] for name in files.names(spark, f"{root}/_generations") if (m := _POINTER.fullmatch(name))]
    if not numbers:
        return Generation()
    read = json.loads(files.read(spark, f"{root}/_generations/{max(numbers)}.json"))
    return Generation(int(max(numbers)), read["base"], tuple(read["folded"]))


def visible(generation: Generation) -> Column:
    """For rows with ``run_id``, a partition column: the base and the runs that are not folded into it."""
    run = F.col("run_id")
    own = ~F.contains(run, F.lit(MARK))
    if generation.folded:
        own = own & ~run.isin(*generation.folded)
    return own | (run == generation.base) if generation.base else own


def recent(generation: Generation) -> Column:
    return visible(Generation(generation.number, None, generation.folded))


def run_ids(spark: SparkSession, tables: Iterable[str]) -> set[str]:
    """Runs that have a folder in any of the tables, bases included."""
    return {name.removeprefix("run_id=") for table in tables for name in files.names(spark, table) if name.startswith("run_id=")}


def refuse_folded(spark: SparkSession, root: str, run_id: str) -> None:
    if run_id in current(spark, root).folded:
        raise ValueError(f"run {run_id} is folded into the base and cannot be done again")


def compact(spark: SparkSession, root: str, tables: list[str], write: Callable[[str], None], which: Callable[[str], bool],
            drop: Callable[[str], None] | None = None) -> bool:
    """Fold the runs that ``which`` takes. ``write(base)`` writes the rows of the base and of those runs as run ``base``.

    ``drop(run)`` removes a run for good; by default its folders are deleted. False when there was nothing to fold.
    """
    for run in (name for name in files.names(spark, f"{root}/_generations") if name.endswith(".early")):
        files.delete(spark, f"{root}/_generations/{run}")
    now = current(spark, root)
    there = run_ids(spark, tables)
    folding = sorted(run for run in there if MARK not in run and run not in now.folded and which(run))
    if not folding:
        return False
    base = f"{folding[-1]}{MARK}{now.number + 1:010d}"
    write(base)
    files.create(spark, f"{root}/_generations/{now.number + 1:010d}.json", json.dumps({"base": base, "folded": [*folding, *([now.base] if now.base else [])]}))
    kept = {*folding, now.base, base}
    for run in there - kept:
        if run in now.folded or MARK in run:  # superseded by the generation before, or left by a lost compaction
            if drop:
                drop(run)
            for table in tables:
                files.delete(spark, f"{table}/run_id={run}")
    for name in files.names(spark, f"{root}/_generations"):
        if (m := _POINTER.fullmatch(name)) and int(m[1]) < now.number:
            files.delete(spark, f"{root}/_generations/{name}")
    return True


def folded_rows(generation: Generation, which: Callable[[str], bool], runs: Iterable[str]) -> Column:
    """Rows that a compaction takes: of the base and of the runs to be folded."""
    wanted = [run for run in runs if MARK not in run and run not in generation.folded and which(run)]
    return F.col("run_id").isin(*wanted, *([generation.base] if generation.base else []))
