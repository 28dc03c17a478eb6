"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
MICROS = 1_000_000


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp column (with or without zone, session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970."""
    return F.unix_seconds(ts.cast("timestamp"))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def day_number(ts: Column) -> Column:
    """Days since 1970 as int."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def second_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("int")


def hhmm_seconds(text: Column) -> Column:
    """'HH:MM' or 'HH:MM:SS' to second of day; blank or malformed text gives null."""
    parts = F.split(F.trim(text), ":")
    hour = F.get(parts, F.lit(0)).try_cast("int")
    minute = F.get(parts, F.lit(1)).try_cast("int")
    second = F.coalesce(F.get(parts, F.lit(2)).try_cast("int"), F.lit(0))
    return hour * 3600 + minute * 60 + second


def clamped_hhmm_minutes(text: Column) -> Column:
    """'HH:MM' to minute of day with hour kept in 0..23 and minute in 0..59."""
    parts = F.split(F.trim(text), ":")
    hour = F.get(parts, F.lit(0)).try_cast("int")
    minute = F.get(parts, F.lit(1)).try_cast("int")
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), c))
    return F.when(hour.isNotNull() & minute.isNotNull(), clamp(hour, 23) * 60 + clamp(minute, 59))


def loose_date(raw: Column) -> Column:
    """A date written as ISO text, YYYYMMDD or 1YYMMDD."""
    text = F.trim(raw.cast("string"))
    return (
        F.when(text.rlike(r"^1\d{6}$"), F.try_to_date(F.concat(F.lit("20"), F.substring(text, 2, 6)), "yyyyMMdd"))
        .when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(text).cast("date"))
    )


def is_true(predicate: Column) -> Column:
    """A comparison that met a null or NaN counts as not satisfied."""
    return F.coalesce(predicate, F.lit(False))


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(default))
