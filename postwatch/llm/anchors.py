"""Finding windows that may stand in several places: shared by the operators on repeated substrings and repeated phrases.

Each window of a text gets as anchor the least hash of the grams inside it. Equal windows have equal anchors, and
consecutive windows mostly share one, so a text has far fewer anchors than windows. Only anchors that occur in two
different texts, or twice in one, can belong to a repeated window; the rest of the work is on the stretches around those.

Copies of one text form a class; only its first row (least doc_id) goes through the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postwatch.llm import common

#: Stands for a null doc_id inside the operators: smaller than any other.
NO_ID = -(1 << 63)


def keyed(documents: DataFrame) -> DataFrame:
    """id (never null), x (64 bits of the text, tells rows of one id apart), cls (the text's class), text (never null)."""
    text = common.text_of()
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("x"),
        common.text_class().alias("cls"),
        text.alias("text"),
    )


def public_id() -> Column:
    return F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id")


def classes(summary: DataFrame) -> DataFrame:
    """cls, first (its least id), copies."""
    return summary.groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("copies"))


def recurring(summary: DataFrame) -> DataFrame:
    """m, n: anchors of at least two texts. ``anchors`` holds their values, or structs of the value and a mark of the text."""
    rows = summary.select(F.explode("anchors").alias("m"), "x")
    if "struct" in dict(rows.dtypes)["m"]:
        rows = rows.select("m.m", "m.x")
    return (
        rows.groupBy("m")
        .agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .where("low <> high")
        .select("m", "n")
    )


def candidates(summary: DataFrame, found: DataFrame, firsts: DataFrame, hot: int) -> DataFrame:
    """id, x, marks (array of m, salts): the recurring anchors of the first row of each class.

    ``salts`` is 0 for an anchor of up to ``hot`` places, else into how many parts its places are to be dealt.
    """
    salts = F.when(F.col("n") > hot, F.ceil(F.col("n") / hot)).otherwise(0).cast("int").alias("salts")
    anchor = "anchors.m" if "struct" in dict(summary.dtypes)["anchors"] else "anchors"
    per_text = summary.select("id", "x", F.explode(anchor).alias("m")).join(found, "m").select("id", "x", "m", salts)
    listed = per_text.groupBy("id", "x").agg(F.collect_set(F.struct("m", "salts")).alias("marks"))
    return listed.join(firsts, ["id", "x"], "left_semi")


def runs(least: np.ndarray, valid: np.ndarray, doc: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last place of the stretches of valid windows of one text with one ``least``, cut at ``longest``."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    value, text = least[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    parts = -(-length // longest)
    start = at[np.repeat(first, parts)] + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.minimum(start + longest, np.repeat(at[first] + length, parts))
    return start, end


def wanted(marks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of (text, anchor) of a ``marks`` column, and each one's number of salts."""
    entries = marks.flatten()
    text = np.repeat(np.arange(len(marks), dtype=np.uint64), marks.value_lengths().to_numpy())
    known = common.mixed(entries.field(0).to_numpy().astype(np.uint64) + common.mixed(text))
    order = np.argsort(known)
    return known[order], entries.field(1).to_numpy()[order]


def among(known: np.ndarray, anchor: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each (text, anchor) stands in ``known``, and whether it does; a chance hit costs work, not rightness."""
    probe = common.mixed(anchor + common.mixed(text.astype(np.uint64)))
    at = np.minimum(np.searchsorted(known, probe), len(known) - 1)
    return at, known[at] == probe


def nested(column: pa.Array, base: np.ndarray) -> np.ndarray:
    """The numbers of a column of lists of lists, each added to its row's base."""
    inner = column.flatten()
    per_row = np.diff(np.append(0, np.cumsum(inner.value_lengths().to_numpy()))[np.append(0, np.cumsum(column.value_lengths().to_numpy()))])
    return inner.flatten().to_numpy().astype(np.int64) + np.repeat(base, per_row)
