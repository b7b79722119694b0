"""Digest text as expressions. Markup is our own and plain; values are escaped by default."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DateType

from postwatch.functions import text

# Fixed values.
UNDATED = "This Week"
NO_POSITION = "your role"
DIGEST_SUBJECT = "Found some job opportunities for you!"
WELCOME_SUBJECT = "Please confirm your job alert"

#: The greeting lines of a digest unless the caller brings others.
GREETINGS = ("Your postings of today.",)


def posted_label(date_posted: Column, declared: DataType) -> Column:
    """A date column gives ``Mar 16, 2025``; every other type, text included, the fixed label."""
    if isinstance(declared, DateType):
        return F.coalesce(F.date_format(date_posted, "MMM dd, yyyy"), F.lit(UNDATED))
    return F.lit(UNDATED)


def card(title: Column, company: Column, location: Column, link: Column, posted: Column, escape: bool = True) -> Column:
    put = (lambda c: text.escape_html(text.or_empty(c))) if escape else text.or_empty
    return F.concat(
        F.lit("<li><h3>"), put(title), F.lit("</h3><p>"), put(company), F.lit("</p><p>"), put(location),
        F.lit("<br>Posted: "), posted, F.lit('</p><a href="'), put(link), F.lit('">Open posting</a></li>'),
    )


def greeting(day: Column | str | datetime.date, *key: Column, lines: Sequence[str] = GREETINGS) -> Column:
    """One of the lines, the same on every run for one key and day."""
    day = F.lit(str(day)) if not isinstance(day, Column) else day
    number = F.conv(F.substring(F.md5(F.concat_ws("|", day, *key)), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(line) for line in lines]), (F.pmod(number, F.lit(len(lines))) + 1).cast("int"))


def heading(position: Column, location: Column, escape: bool = True) -> Column:
    put = text.escape_html if escape else (lambda c: c)
    return F.concat(
        F.when(text.or_empty(position) == "", F.lit(NO_POSITION)).otherwise(put(position)),
        F.when(text.or_empty(location) == "", F.lit("")).otherwise(F.concat(F.lit(" · "), put(location))),
    )


def digest_body(cards: Column, email: Column, position: Column, location: Column, greeting_line: Column,
                unsubscribe: Column) -> Column:
    return F.concat(
        F.lit("<h1>Roles for "), heading(position, location), F.lit("</h1><p>"), greeting_line, F.lit("</p><ul>"),
        cards, F.lit("</ul><p>Sent to "), text.escape_html(email), F.lit('. <a href="'), text.escape_html(unsubscribe),
        F.lit('">Unsubscribe</a></p>'),
    )


def welcome_body(confirm: Column) -> Column:
    return F.concat(F.lit('<h1>Your alert is set up</h1><a href="'), text.escape_html(confirm), F.lit('">Confirm this address</a>'))
