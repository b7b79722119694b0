"""Text rules for posting fields and log lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

MIN_LENGTH = 2


def strip(text: Column) -> Column:
    """Drop white space at both ends, not only the space character that ``trim`` drops."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def long_enough(text: Column, least: int = MIN_LENGTH) -> Column:
    return F.coalesce(F.char_length(text) >= least, F.lit(False))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def search_text(position: Column, location: Column) -> Column:
    return F.concat(position, F.lit(" jobs in "), location)


def score_text(score: Column) -> Column:
    """Two decimals, ties decided by the exact binary value (half even)."""
    return F.call_function("format_number", score, F.lit("0.00"))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def contains_any(text: Column, needles: list[str]) -> Column:
    """Case-sensitive; NULL text contains nothing."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(or_empty(text), F.lit(needle))
    return hit
