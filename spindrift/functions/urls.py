"""URL functions. All are NULL for NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(url: Column) -> Column:
    """Without the fragment."""
    return F.regexp_replace(url, "#.*$", "")


def is_url(url: Column) -> Column:
    """Whether it parses as an absolute URL; false for NULL."""
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("unknown"))


def fingerprint(url: Column) -> Column:
    """SHA-256 of the canonical URL, in hexadecimal."""
    return F.sha2(canonical(url), 256)
