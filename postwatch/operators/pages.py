"""Triage of stored pages: title, error keyword, bot challenge, required element, file path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postwatch.functions import html, urls
from postwatch.operators import once


def titles(pages: DataFrame) -> DataFrame:
    return pages.withColumn("title", html.title(F.col("html")))


def triage(pages: DataFrame, directory: str, keywords: list[str] | None = None,
           required: tuple[str, str | None] | None = None) -> DataFrame:
    """Adds title, is_challenge, keyword and ``html_file_path``, '' for a page that is not to be kept.

    With ``required`` (tag, id) a page is kept when it has that element; otherwise when no keyword is in it.
    Bot-challenge pages are never kept. A page that is not kept still counts as processed.
    """
    words = html.ERROR_KEYWORDS if keywords is None else keywords
    looked = titles(pages).withColumns(
        {
            "is_challenge": html.is_challenge(F.col("html"), F.col("title")),
            "keyword": html.first_keyword(F.col("html"), F.col("title"), words),
        }
    )
    wanted: Column = html.has_element(F.col("html"), *required) if required else F.col("keyword").isNull()
    kept = F.coalesce(wanted, F.lit(False)) & ~F.col("is_challenge")
    path = F.when(kept, urls.path_key(F.col("url"), directory)).otherwise("")
    judged = {name: F.col(name) for name in ("title", "is_challenge", "keyword")}
    return once.computed(looked, pages.columns, **judged, html_file_path=path)


def store_rows(triaged: DataFrame) -> DataFrame:
    """The pages to keep, keyed by URL: two URLs may share one file path."""
    return triaged.where("html_file_path <> ''").select("url", "html_file_path", "html")


def path_collisions(triaged: DataFrame) -> DataFrame:
    """File paths more than one URL maps to."""
    kept = triaged.where("html_file_path <> ''")
    counted = kept.groupBy("html_file_path").agg(F.count_distinct("url").alias("n_urls"))
    return counted.where("n_urls > 1")
