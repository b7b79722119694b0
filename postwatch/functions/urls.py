"""Links: canonical form, file keys, and the links put into mails."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postwatch.functions import text

# scheme, user part, host, port, path, query, fragment
_PARTS = (
    r"(?is)^(https?)://(?:([^/?#@\s]*)@)?([^/?#@:\s\[\]]+|\[[0-9a-f:.]+\])(?::(\d{0,5}))?"
    r"(/[^?#]*)?(\?[^#]*)?(#.*)?$"
)

# Characters replaced by "_" in the two kinds of file key.
UNSAFE_IN_PATH = r'[<>:"/\\|?*]'
NOT_ALPHANUMERIC = "[^a-zA-Z0-9]"


_SEPARATOR = "\u001f"


def parts(link: Column) -> Column:
    """The seven parts of a stripped link, found in one match; anything but seven items is not a link."""
    marked = F.regexp_replace(link, _PARTS, _SEPARATOR.join(f"${i}" for i in range(1, 8)))
    return F.split(marked, _SEPARATOR)


def from_parts(found: Column) -> Column:
    """Canonical text built from :func:`parts`."""
    scheme, user, host, port, path, query, fragment = (F.get(found, F.lit(i)) for i in range(7))
    scheme = F.lower(scheme)
    number = F.nullif(port, F.lit("")).cast("int")
    default = F.when(scheme == "http", 80).otherwise(443)
    built = F.concat(
        scheme,
        F.lit("://"),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""),
        F.lower(host),
        F.when(number.isNull() | (number == default), "").otherwise(F.concat(F.lit(":"), number.cast("string"))),
        F.when(path == "", "/").otherwise(path),
        query,
        fragment,
    )
    fits = (F.size(found) == 7) & F.coalesce(number <= 65535, F.lit(True))
    return F.when(fits, F.replace(built, F.lit(" "), F.lit("%20")))


def canonical(link: Column) -> Column:
    """Canonical text of an http(s) link, NULL when it is not one.

    Scheme and host in lower case, default port dropped, "/" for an empty path, blanks as %20.
    This text is the ledger key.
    """
    return from_parts(parts(text.strip(link)))


def path_key(url: Column, directory: str) -> Column:
    """``directory/<url with path characters as _>.html``"""
    name = F.concat(F.regexp_replace(url, UNSAFE_IN_PATH, "_"), F.lit(".html"))
    return F.concat(F.lit(directory.rstrip("/") + "/"), name) if directory else name


def indexed_key(url: Column, index: Column) -> Column:
    """``page_<index>_<url with everything but letters and digits as _>.html``"""
    return F.format_string("page_%d_%s.html", index.cast("long"), F.regexp_replace(url, NOT_ALPHANUMERIC, "_"))


def confirm_url(base: str, token: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/confirm/"), token)


def query_value(value: Column) -> Column:
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))


def unsubscribe_url(base: str, email: Column, position: Column, location: Column, encode: bool = True) -> Column:
    """``encode=False`` puts the three values in as they are."""
    put = query_value if encode else (lambda value: value)
    return F.concat(
        F.lit(base + "?email="), put(email), F.lit("&position="), put(position), F.lit("&location="), put(location)
    )
