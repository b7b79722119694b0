"""What page triage asks of an HTML text. Regular expressions, not a DOM: script text is text too."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postwatch.functions import text

# Words that mark an error page, in the order they are tried.
ERROR_KEYWORDS = [
    "error",
    "not found",
    "job not found",
    "listing not found",
    "page not found",
    "nicht verfügbar",
    "nicht mehr verfügbar",
    "nicht gefunden",
    "seite nicht gefunden",
    "abgelaufen",
    "entfernt",
    "nicht existiert",
]

# Marks of a bot-challenge page.
CHALLENGE_TITLES = ["Just a moment...", "Attention Required!"]
CHALLENGE_TITLE_WORD = "cloudflare"
CHALLENGE_DIVS = ["cf-challenge", "challenge-stage"]
CHALLENGE_FRAME = "challenges.cloudflare.com"


def title(html: Column) -> Column:
    """Text of the first title element, white space collapsed; '' when there is none."""
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


def has_element(html: Column, tag: str, element_id: str | None = None) -> Column:
    """Whether a start tag (with that id) is there. The plain search ahead of the pattern settles most pages."""
    if element_id is None:
        return F.regexp_like(html, F.lit(rf"(?i)<{tag}[\s/>]"))
    pattern = rf"""(?i)<{tag}\s(?:[^>]*\s)?id\s*=\s*["']?(?-i:{element_id})["'\s/>]"""
    return F.contains(html, F.lit(element_id)) & F.regexp_like(html, F.lit(pattern))


def is_challenge(html: Column, page_title: Column) -> Column:
    by_title = text.contains_any(page_title, CHALLENGE_TITLES) | F.contains(
        F.lower(text.or_empty(page_title)), F.lit(CHALLENGE_TITLE_WORD)
    )
    frame = rf"""(?i)<iframe\s[^>]*src\s*=\s*["']?[^"'>]*(?-i:{CHALLENGE_FRAME.replace(".", "[.]")})"""
    by_element = F.contains(html, F.lit(CHALLENGE_FRAME)) & F.regexp_like(html, F.lit(frame))
    for div in CHALLENGE_DIVS:
        by_element = by_element | has_element(html, "div", div)
    return F.coalesce(by_title | by_element, F.lit(False))


def first_keyword(html: Column, page_title: Column, keywords: list[str]) -> Column:
    """First keyword of the list found in title or text, letter case ignored; NULL when none is.

    Both texts are lower-cased once: the keywords are tried inside one expression over the two.
    """
    lowered = F.array(F.struct(F.lower(html).alias("page"), F.lower(page_title).alias("title")))

    def first(texts: Column) -> Column:
        found = F.lit(None).cast("string")
        for keyword in reversed(keywords):
            word = F.lit(keyword)
            found = F.when(F.contains(texts.title, word) | F.contains(texts.page, word), word).otherwise(found)
        return found

    return F.element_at(F.transform(lowered, first), 1)
