"""Column expressions on positions in a recording, in integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("long")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def format_clock(ms: Column) -> Column:
    """``m:ss``, or ``h:mm:ss`` from an hour on; truncated, never rounded."""
    total = F.greatest(div(F.coalesce(ms, F.lit(0)), 1000), F.lit(0))
    hours, minutes, seconds = div(total, 3600), div(total, 60) % 60, total % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), _two(minutes), F.lit(":"), _two(seconds))
                  ).otherwise(F.concat(minutes.cast("string"), F.lit(":"), _two(seconds)))


def format_duration(ms: Column) -> Column:
    """``45s``, ``3m 20s``, ``1h 40m``; a dash without a length."""
    total = F.bround(ms / 1000).cast("long")
    hours, minutes, seconds = div(total, 3600), div(total, 60) % 60, total % 60
    return (F.when(ms.isNull() | (ms <= 0), F.lit("-"))
            .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), _two(minutes), F.lit("m")))
            .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), _two(seconds), F.lit("s")))
            .otherwise(F.concat(seconds.cast("string"), F.lit("s"))))


def timestamp(ms: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm``; WebVTT writes a dot."""
    at = F.greatest(ms, F.lit(0))
    total = div(at, 1000)
    hours = div(total, 3600).cast("string")
    return F.concat(F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), F.lit("0")), F.lit(":"),
                    _two(div(total, 60) % 60), F.lit(":"), _two(total % 60), F.lit(separator),
                    F.lpad((at % 1000).cast("string"), 3, "0"))


def stamp_ms(stamp: Column) -> Column:
    """``00:01:15,300`` or ``01:15.3`` back into milliseconds."""
    flat = F.replace(F.trim(stamp), F.lit(","), F.lit("."))
    head, fraction = F.split_part(flat, F.lit("."), F.lit(1)), F.split_part(flat, F.lit("."), F.lit(2))
    seconds = F.aggregate(F.split(head, ":"), F.lit(0).cast("long"),
                          lambda acc, part: acc * 60 + part.cast("long"))
    return seconds * 1000 + F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("long")


def clock_ms(stamp: Column) -> Column:
    """``1:15`` or ``1:02:03`` as milliseconds; null for anything else."""
    parts = F.split(stamp, ":")
    seconds = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, part: acc * 60 + part.cast("long"))
    return F.when(F.size(parts).isin(2, 3), seconds * 1000)
