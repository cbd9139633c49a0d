"""Formatting of numbers for reports, and guarded rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hundredths(n: Column, unit: int) -> Column:
    """n / unit with two decimals, rounded half up in whole numbers."""
    # bigint throughout: / rounds decimals to six places, which can reach the next whole number; n * 100 may not fit
    n, u = n.cast("bigint"), F.lit(unit).cast("bigint")
    c = F.call_function("div", n, u) * 100 + F.call_function("div", n % u * 100 + unit // 2, u)
    return F.concat(F.floor(c / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def format_bytes(n: Column) -> Column:
    """``0 B`` to ``1.00 GB``, in steps of 1024; GB is the largest unit."""
    out = F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((20, "KB"), (30, "MB")):
        out = out.when(n < 1 << power, F.concat(_hundredths(n, 1 << (power - 10)), F.lit(f" {unit}")))
    return out.when(n.isNotNull(), F.concat(_hundredths(n, 1 << 30), F.lit(" GB")))


def format_ns(ns: Column) -> Column:
    """``999 ms`` below a second (whole milliseconds), else ``1.00 s``; ``N/A`` for NULL."""
    return (
        F.when(ns.isNull(), F.lit("N/A"))
        .when(ns < 1_000_000_000, F.concat(F.floor(ns / 1_000_000).cast("bigint").cast("string"), F.lit(" ms")))
        .otherwise(F.concat(_hundredths(ns, 1_000_000_000), F.lit(" s")))
    )


def format_elapsed(seconds: Column) -> Column:
    """``1d 02:03:04`` for a duration in seconds; ``N/A`` for NULL."""
    whole = F.floor(seconds).cast("bigint")
    clock = F.format_string("%02d:%02d:%02d", F.floor(whole % 86_400 / 3600).cast("bigint"), F.floor(whole % 3600 / 60).cast("bigint"), whole % 60)
    return F.when(seconds.isNull(), "N/A").when(whole < 86_400, clock).otherwise(F.concat(F.floor(whole / 86_400).cast("string"), F.lit("d "), clock))


def rate(n: Column, seconds: Column) -> Column:
    """n per second; 0 if no time has passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def whole_second_rate(n: Column, seconds: Column) -> Column:
    """n per second by whole seconds; 0 within the first."""
    return F.when(F.floor(seconds) > 0, n / F.floor(seconds)).otherwise(F.lit(0.0))
