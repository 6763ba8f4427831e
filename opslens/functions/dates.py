"""Date and time semantics of the reports.

All times are ``timestamp_ntz`` and mean UTC. Differences count unit
*boundaries*: 00:59 to 01:01 is one hour, unlike Spark's ``timestampdiff``.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}

# Formats behind the numeric style codes of the reports.
STYLE_FORMATS = {
    101: "MM/dd/yyyy",
    102: "yyyy.MM.dd",
    103: "dd/MM/yyyy",
    104: "dd.MM.yyyy",
    108: "HH:mm:ss",
    111: "yyyy/MM/dd",
    112: "yyyyMMdd",
    120: "yyyy-MM-dd HH:mm:ss",
    121: "yyyy-MM-dd HH:mm:ss.SSS",
    126: "yyyy-MM-dd'T'HH:mm:ss",
}


def instant(value: str | datetime | Column) -> Column:
    """Literal point in time without a zone; columns pass through."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return F.lit(text).cast("timestamp_ntz")


def day(value: str | date) -> Column:
    """Literal date."""
    return F.lit(str(value)).cast("date")


def epoch_seconds(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def epoch_millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of ``unit`` boundaries crossed between ``start`` and ``end``."""
    if unit == "millisecond":
        return epoch_millis(end) - epoch_millis(start)
    if unit == "day":
        return F.datediff(end.cast("date"), start.cast("date")).cast("long")
    size = UNIT_SECONDS[unit]
    return F.floor(epoch_seconds(end) / size) - F.floor(epoch_seconds(start) / size)


def add(unit: str, amount: Column | int, c: Column) -> Column:
    """``c`` moved by ``amount`` units (millisecond .. day)."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    return F.timestamp_add(unit.upper(), amount.cast("long"), c)


def ago(as_of: str | datetime | Column, amount: int, unit: str) -> Column:
    return add(unit, -amount, instant(as_of))


def packed_datetime(run_date: Column, run_time: Column) -> Column:
    """``yyyymmdd`` and ``HHMMSS`` integers to a timestamp."""
    def part(c: Column, divisor: int, modulus: int | None = None) -> Column:
        value = F.call_function("div", c.cast("long"), F.lit(divisor))
        return (value % modulus if modulus else value).cast("int")

    return F.make_timestamp_ntz(
        part(run_date, 10000),
        part(run_date, 100, 100),
        part(run_date, 1, 100),
        part(run_time, 10000),
        part(run_time, 100, 100),
        part(run_time, 1, 100).cast("decimal(16,6)"),
    )


def packed_seconds(duration: Column) -> Column:
    """``[DD]HHMMSS`` integer to seconds."""
    d = duration.cast("long")

    def field(divisor: int) -> Column:
        return F.call_function("div", d, F.lit(divisor)) % 100

    days = F.call_function("div", d, F.lit(1000000))
    return days * 86400 + field(10000) * 3600 + field(100) * 60 + d % 100


def clock_text(seconds: Column) -> Column:
    """``h hours, m minutes, s seconds``; wraps at a day like a time of day."""
    s = seconds % 86400
    return F.concat(
        F.call_function("div", s, F.lit(3600)).cast("string"), F.lit(" hours, "),
        F.call_function("div", s % 3600, F.lit(60)).cast("string"), F.lit(" minutes, "),
        (s % 60).cast("string"), F.lit(" seconds"),
    )


def millis_clock(ms: Column) -> Column:
    """Milliseconds as ``HH:mm:ss``; wraps at 24 hours."""
    return F.date_format(add("millisecond", ms, F.lit("1970-01-01").cast("timestamp_ntz")),
                         STYLE_FORMATS[108])


def style_text(c: Column, style: int) -> Column:
    return F.date_format(c, STYLE_FORMATS[style])


def shift_hours(c: Column, hours: int) -> Column:
    """UTC to local time by a whole number of hours."""
    return add("hour", hours, c)


def tick_time(as_of: str | datetime | Column, now_ticks: Column, ticks: Column) -> Column:
    """Wall time of a millisecond tick counter reading."""
    return add("millisecond", ticks - now_ticks, instant(as_of))


def day_floor(as_of: str | datetime, days: int) -> Column:
    """Midnight ``days`` before ``as_of``."""
    return ago(as_of, days, "day").cast("date").cast("timestamp_ntz")


def since(as_of: str | datetime, amount: int, unit: str) -> Column:
    """Start of a look-back interval: whole days start at midnight, hours do not."""
    return day_floor(as_of, amount) if unit == "day" else ago(as_of, amount, unit)
