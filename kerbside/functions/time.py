"""Date and time expressions on zone-less timestamps.

Everything is built from date arithmetic, so no result depends on the session
time zone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAY_SECONDS = 86_400
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3_600, "d": DAY_SECONDS}
GROUPING_INTERVAL = {"hour": "1h", "day": "1d", "week": "7d"}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval_seconds(interval: str) -> int:
    """'30m' -> 1800."""
    m = re.fullmatch(r"(\d+)([smhd])", interval)
    if not m:
        raise ValueError(f"not an interval: {interval!r}")
    return int(m.group(1)) * UNIT_SECONDS[m.group(2)]


def step(seconds: int) -> Column:
    """A day-time interval literal."""
    return F.expr(f"INTERVAL '{int(seconds)}' SECOND") if seconds < 60 else F.expr(
        f"INTERVAL '{int(seconds) // 60}' MINUTE"
    )


def ntz(value) -> Column:
    """Literal or column as a zone-less timestamp."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("timestamp_ntz")


def trunc_time(ts: Column | str, interval: str) -> Column:
    """Start of the epoch-aligned bucket (7d buckets start on Thursdays)."""
    ts, n = as_col(ts), interval_seconds(interval)
    day = F.to_date(ts)
    if n % DAY_SECONDS == 0:
        days = n // DAY_SECONDS
        if days > 1:
            day = F.date_sub(day, F.pmod(F.unix_date(day), F.lit(days)))
        return day.cast("timestamp_ntz")
    if DAY_SECONDS % n:
        raise ValueError(f"{interval} does not divide a day")
    minute = F.hour(ts) * 60 + F.minute(ts)
    if n % 60 == 0:
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute - minute % (n // 60))
    second = minute * 60 + F.second(ts)
    return day.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (second - second % n).cast("decimal(18,6)")
    )


def trunc_grain(ts: Column | str, grain: str) -> Column:
    """Start of the year, month, day or hour."""
    ts = as_col(ts)
    if grain in ("year", "month"):
        return F.trunc(F.to_date(ts), grain).cast("timestamp_ntz")
    return trunc_time(ts, {"day": "1d", "hour": "1h"}[grain])


def add_months_to(d: Column | str, n: int) -> Column:
    return F.add_months(as_col(d), n)


def iso_weekday(ts: Column | str) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(as_col(ts)) + 1


def fractional_hour(ts: Column | str) -> Column:
    ts = as_col(ts)
    return F.hour(ts) + F.minute(ts) / 60.0


def calendar_parts(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "month": F.month(ts),
            "dayofyear": F.dayofyear(ts),
            "weekday": iso_weekday(ts),
        }
    )


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds between two wall-clock times.

    Taken from the interval: timestampdiff would convert both to instants of the
    session's zone and count hours that daylight saving skips or repeats.
    """
    return (as_col(end) - as_col(start)).cast("interval second").cast("bigint")


def elapsed_micros(start: Column | str, end: Column | str) -> Column:
    seconds = (as_col(end) - as_col(start)).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def as_instant(ts: Column | str) -> Column:
    """A wall-clock time as the TIMESTAMP that shows it in UTC, whatever the session zone."""
    return F.timestamp_micros(elapsed_micros(ntz("1970-01-01"), ts))


def from_instant(t: Column | str) -> Column:
    """Inverse of as_instant."""
    micros = F.unix_micros(as_col(t))
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return ntz("1970-01-01") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def duration_minutes(start: Column | str, end: Column | str) -> Column:
    return elapsed_micros(start, end) / F.lit(60_000_000.0)


def duration_hours(start: Column | str, end: Column | str) -> Column:
    return elapsed_micros(start, end) / F.lit(3_600_000_000.0)


def month_to_date(month: Column | str) -> Column:
    """'2024-03' -> 2024-03-01; NULL for anything else."""
    return F.try_to_date(F.concat(as_col(month), F.lit("-01")), "yyyy-MM-dd")


def time_signature_flags(df: DataFrame, ts: str) -> DataFrame:
    """Weekend, morning (7-10) and evening (16-19) flags."""
    h = F.hour(ts)
    return df.withColumns(
        {
            "is_weekend": F.weekday(ts) >= 5,
            "is_morning": h.between(7, 10),
            "is_evening": h.between(16, 19),
        }
    )


def cyclic(value: Column | str, period: float) -> tuple[Column, Column]:
    """(sin, cos) of a value on a circle of the given period."""
    angle = as_col(value) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def with_cyclic_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """hour, dow and their circle coordinates."""
    hour_sin, hour_cos = cyclic(F.hour(ts), 24)
    dow_sin, dow_cos = cyclic(iso_weekday(ts), 7)
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "dow": iso_weekday(ts),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
        }
    )


def epoch_ms_to_day(ms: Column | str) -> Column:
    """Calendar day of an epoch-millisecond instant, rounded up to the next midnight."""
    day_ms = F.lit(DAY_SECONDS * 1000)
    return F.date_from_unix_date(F.ceil(as_col(ms) / day_ms).cast("int"))


def time_spine(spark: SparkSession, start, end, freq: str, name: str = "timestamp") -> DataFrame:
    """All instants start, start+freq, ... up to end."""
    return spark.range(1).select(
        F.explode(F.sequence(ntz(start), ntz(end), step(interval_seconds(freq)))).alias(name)
    )


def choose_grain(start: Column, end: Column) -> Column:
    """Dashboard grain for a period: hour up to a week, day up to a year, else week.

    Periods shorter than a day count as one day.
    """
    hours = F.greatest(elapsed_micros(start, end) / F.lit(3_600_000_000.0), F.lit(24.0))
    return F.when(hours <= 7 * 24, "hour").when(hours <= 365 * 24, "day").otherwise("week")


def chart_grain(start: Column, end: Column) -> Column:
    """Report grain for a period: month from a year on, day from five days on, else hour."""
    days = F.date_diff(F.to_date(end), F.to_date(start))
    return F.when(days >= 365, "month").when(days >= 5, "day").otherwise("hour")
