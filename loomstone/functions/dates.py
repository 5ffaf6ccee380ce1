"""Dates and times as columns, in UTC unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_monday(d: Column) -> Column:
    """The day itself if it is a Monday, else the next one."""
    d = F.to_date(d)
    return F.when(F.dayofweek(d) == 2, d).otherwise(F.next_day(d, "MO"))


def next_monday_8am(ts: Column, zone: str = "America/New_York") -> Column:
    """Monday 08:00 of the zone at or after ``ts``, in UTC; right across clock changes."""
    local = F.from_utc_timestamp(ts, zone)
    day = F.to_date(local)
    early = (F.dayofweek(day) == 2) & (F.hour(local) < 8)
    monday = F.when(early, day).otherwise(F.next_day(day, "MO"))
    return F.to_utc_timestamp(monday.cast("timestamp") + F.expr("INTERVAL 8 HOURS"), zone)


def add_business_days(d: Column, n: int) -> Column:
    """``n`` working days later, or earlier for a negative ``n``; Saturdays and Sundays are skipped."""
    d = F.to_date(d)
    if n == 0:
        return d
    span = abs(n) * 2 + 4
    step = 1 if n > 0 else -1
    days = F.sequence(F.date_add(d, step), F.date_add(d, step * span), F.expr(f"INTERVAL {step} DAY"))
    return F.element_at(F.filter(days, lambda x: F.weekday(x) < 5), abs(n))


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def clock_utc(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a 'UTC'")


def minutes_to_read(tokens: Column) -> Column:
    """Eight minutes for a thousand tokens, at least one; one where nothing is known."""
    return F.when(tokens > 0, F.greatest(F.lit(1), F.floor(tokens * 8 / 1000 + 0.5))).otherwise(F.lit(1)).cast("int")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_iso_millis(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & F.try_to_timestamp(c).isNotNull()


def any_timestamp(c: Column) -> Column:
    """A time given as milliseconds since 1970 or as ISO text; null where neither."""
    return F.when(c.rlike(r"^\d{11,14}$"), F.timestamp_millis(c.try_cast("long"))).otherwise(F.try_to_timestamp(c))


def age_days(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def backoff_ms(base: int, attempt: Column, most: int) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(float(most)))
