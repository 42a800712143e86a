"""Plain forms of paths, function ids and session ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_key(c: Column) -> Column:
    """Path or function id in plain form: forward slashes, never doubled, no leading ./, no
    surrounding blanks. Blank becomes null."""
    s = F.regexp_replace(c, r"\\", "/")
    s = F.regexp_replace(s, r"^[\s\p{Z}\uFEFF]+|[\s\p{Z}\uFEFF]+$", "")
    s = F.regexp_replace(s, r"/{2,}", "/")
    s = F.regexp_replace(s, r"^(\./)+", "")
    s = F.regexp_replace(s, r"\s*::\s*", "::")
    return F.when(s != "", s)


def plain_session(c: Column) -> Column:
    """Session id in lower case without blanks, braces or a urn prefix. Blank becomes null."""
    s = F.lower(F.regexp_replace(c, r"[\s{}]+", ""))
    s = F.regexp_replace(s, r"^urn:uuid:", "")
    return F.when(s != "", s)


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    s = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(s != "", s)


def utc_millis(c: Column) -> Column:
    """ISO text with any zone offset to a UTC timestamp; null where it can't be read."""
    return F.try_to_timestamp(F.trim(c))
