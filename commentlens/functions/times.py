"""Comment-time expressions.

All of them work on TIMESTAMP_NTZ and give the same result in every session time
zone: values never pass through a zone-aware timestamp whose local hour could be
skipped or repeated by daylight saving.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlens.constants import COMMENT_TIME_24H_PATTERN, COMMENT_TIME_PATTERNS

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _parse_ntz(text: Column, pattern: str) -> Column:
    # A failing parse is slow; texts that cannot fit are not tried.
    half_day = text.rlike("(?i)[ap]m$")
    fitting = half_day if pattern.endswith("a") else ~half_day
    # Parsed as UTC, so that the instant counts the microseconds of the wall clock.
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{pattern} XXX"))
    return F.when(fitting, F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH)))


def parse_comment_time(
    text: Column, patterns: Sequence[str] = COMMENT_TIME_PATTERNS, compat: bool = False
) -> Column:
    """Text to TIMESTAMP_NTZ; a value that fits no pattern becomes NULL.

    ``compat`` reads the hour as a 24-hour one and leaves AM/PM without effect.
    """
    if compat:
        twenty_four = F.regexp_extract(text, r"(?i)^(.+) [ap]m$", 1)
        return _parse_ntz(F.nullif(twenty_four, F.lit("")), COMMENT_TIME_24H_PATTERN)
    return F.coalesce(*[_parse_ntz(text, p) for p in patterns])


def _micros_between(start: Column, end: Column) -> Column:
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    return _micros_between(start, end) / 6e7


def hours_between(start: Column, end: Column) -> Column:
    return _micros_between(start, end) / 3.6e9


def days_between(start: Column, end: Column) -> Column:
    return _micros_between(start, end) / 8.64e10


def hour_of(ts: Column) -> Column:
    """Floor to the hour."""
    past_hour = F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts))
    return ts - past_hour
