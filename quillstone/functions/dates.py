"""Days in UTC+8 and due dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Taipei"
#: Days until a thing is due again.
CORRECTION_DAYS, OUTLINE_DAYS, CONCEPT_DAYS_GOOD, CONCEPT_DAYS, VISION_DAYS, WRONG_DAYS = 1, 2, 7, 2, 1, 1


def local_day(ts: Column) -> Column:
    """The day in UTC+8 of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), ZONE))


def local_day_of_ms(ms: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), ZONE))


def add_days(day: Column, n) -> Column:
    return F.date_add(day, n)


def parse_day(c: Column) -> Column:
    """YYYY-MM-DD only."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def days_until(end: Column, start: Column) -> Column:
    """Days between two texts, at least 0; 0 if either is no day."""
    return F.greatest(F.lit(0), F.coalesce(F.datediff(parse_day(end), parse_day(start)), F.lit(0)))


def is_due(due: Column, today: Column) -> Column:
    """Without a due day a thing is due."""
    return F.coalesce(due <= today, F.lit(True))


def display_day(saved: Column, *stamps: Column) -> Column:
    """The saved day if it is one, else the first positive stamp's day in UTC+8, else empty."""
    stamp = F.coalesce(*[F.when(s > 0, s) for s in stamps])
    return F.coalesce(F.when(saved.rlike(r"^\d{4}-\d{2}-\d{2}$"), saved), F.date_format(local_day_of_ms(stamp), "yyyy-MM-dd"), F.lit(""))


def updated_at(updated: Column, created: Column, fallback: Column) -> Column:
    """Milliseconds of the first stamp that parses."""
    ms = lambda c: F.unix_millis(F.try_to_timestamp(c))
    return F.coalesce(ms(updated), ms(created), fallback, F.lit(0))


def duration_text(ms: Column, by_seconds: bool = True) -> Column:
    """Rounded seconds; with minutes from 60 of them on, or else from 60,000 ms on (59,500 to 59,999 ms differ)."""
    s = F.floor(ms / 1000 + 0.5)
    return F.when(s >= 60 if by_seconds else ms >= 60_000, F.format_string("%d分%d秒", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d秒", s))


def clock_text(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def concept_due(day: Column, understood: Column) -> Column:
    return F.date_add(day, F.when(understood, CONCEPT_DAYS_GOOD).otherwise(CONCEPT_DAYS))


def outline_due(day: Column, has_reference: Column) -> Column:
    return F.when(has_reference, F.date_add(day, OUTLINE_DAYS))
