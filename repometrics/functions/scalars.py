"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from repometrics.constants import SECONDS_PER_DAY

_WHITESPACE = " \t\r\n\f\x0b"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def import_short_name(name: Column | str, sep: str = ".") -> Column:
    """Text before the first separator; a missing name counts as ''."""
    return F.coalesce(F.substring_index(_col(name), sep, 1), F.lit(""))


def strip(text: Column | str) -> Column:
    """Text without whitespace of any kind at its ends."""
    return F.btrim(_col(text), F.lit(_WHITESPACE))


def nonblank_lines(content: Column | str) -> Column:
    """Number of lines that hold something besides whitespace."""
    # One match per line: from its first visible character to its end.
    return F.regexp_count(_col(content), F.lit(r"\S[^\n]*")).cast("bigint")


def any_contains(text: Column | str, terms: Sequence[str]) -> Column:
    """True when the text holds at least one of the terms."""
    return reduce(lambda found, term: found | _col(text).contains(term), terms, F.lit(False))


def epoch_days(seconds: Column) -> Column:
    """Seconds as fractional days."""
    return seconds / F.lit(float(SECONDS_PER_DAY))


def epoch_iso(seconds: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC, whatever the session's time zone is."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    text = F.date_format(start + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(text, F.lit("+00:00"))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days from one moment to another."""
    seconds = F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1e6)
    return epoch_days(seconds)


def clamp_above(value: Column | str, cap: float) -> Column:
    """Values above ``cap`` become ``cap``; missing stays missing."""
    value = _col(value).cast("double")
    return F.when(value > cap, F.lit(float(cap))).otherwise(value)


def clamp_below(value: Column | str, floor: float) -> Column:
    """Values not above ``floor``, missing ones too, become ``floor``."""
    value = _col(value).cast("double")
    return F.when(value > floor, value).otherwise(F.lit(float(floor)))
