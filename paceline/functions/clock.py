"""Epoch milliseconds, local days and calendar arithmetic."""

from __future__ import annotations

from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def zone(name: str) -> str:
    """A named zone; offsets and unknown names are refused."""
    if name not in available_timezones() or name.startswith(("Etc/GMT", "GMT+", "GMT-")):
        raise ValueError(f"{name!r} is not a named time zone")
    ZoneInfo(name)
    return name


def wall_ms(ts: Column) -> Column:
    """Milliseconds of a wall-clock timestamp read as UTC, rounded down, whatever the session's zone."""
    return F.floor(F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / 1000).cast("long")


def local(ms: Column, tz: str = "UTC") -> Column:
    """The wall clock in tz as text, yyyy-MM-dd HH:mm:ss."""
    shift = F.from_utc_timestamp(F.timestamp_millis(ms), F.lit(zone(tz)))
    return F.date_format(F.to_utc_timestamp(shift, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def local_day(ms: Column, tz: str = "UTC") -> Column:
    if tz == "UTC":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))
    return F.to_date(F.substring(local(ms, tz), 1, 10))


def local_hour(ms: Column, tz: str = "UTC") -> Column:
    if tz == "UTC":
        return (F.floor(ms / 3_600_000) % 24).cast("int")
    return F.substring(local(ms, tz), 12, 2).cast("int")


def day_start_ms(day: Column, tz: str = "UTC") -> Column:
    """Milliseconds of local midnight."""
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS
    if tz == "UTC":
        return days
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(days), F.lit(zone(tz))))


def local_range(first: Column, last: Column, tz: str = "UTC") -> tuple[Column, Column]:
    """Half-open UTC bounds of a range of local days."""
    return day_start_ms(first, tz), day_start_ms(F.date_add(last, 1), tz)


def monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def window_start(end: Column, weeks: int) -> Column:
    """The first day of the weeks that end with a day."""
    return F.date_add(end, 1 - 7 * weeks)


def valid_day(text: Column) -> Column:
    """Whether text is a real day written yyyy-MM-dd."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))


def months_overlapping(start_ms: Column, end_ms: Column) -> Column:
    """The UTC months (yyyy-MM) that a half-open range meets, for partition filters."""
    first = F.trunc(local_day(start_ms), "month")
    last = F.trunc(local_day(F.greatest(start_ms, end_ms - 1)), "month")
    return F.transform(F.sequence(first, last, F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def rough_bounds(start_ms: int, end_ms: int) -> tuple[int, int]:
    """A UTC range wide enough for any zone: a day before, two after."""
    return start_ms - DAY_MS, end_ms + 2 * DAY_MS


def bed_day(day: Column, clock: Column) -> Column:
    """The date of a bedtime HH:mm: from noon it belongs to the day before."""
    return F.when(F.substring(clock, 1, 2).cast("int") >= 12, F.date_sub(day, 1)).otherwise(day)


def age_at(birth: Column, day: Column) -> Column:
    return F.floor(F.months_between(day, birth) / 12).cast("int")
