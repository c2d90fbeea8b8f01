"""Calendar expressions over the UTC hour, and the US federal holiday dimension."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hour_of(c: Column) -> Column:
    return F.hour(c)


def month_of(c: Column) -> Column:
    return F.month(c)


def dow0(c: Column) -> Column:
    """Day of week with Sunday = 0 (Spark's own count starts Sunday at 1)."""
    return F.dayofweek(c) - 1


def is_weekend(c: Column) -> Column:
    return dow0(c).isin(0, 6)


def utc_date(c: Column) -> Column:
    return F.to_date(c)


def floor_hour(c: Column) -> Column:
    return F.date_trunc("hour", c)


def to_utc(c: Column, zone: str | Column) -> Column:
    """Wall-clock time in ``zone`` to UTC."""
    return F.to_utc_timestamp(c, zone)


def target_epoch(c: Column, hours: int = 24) -> Column:
    """Unix seconds of the hour that a prediction made at ``c`` is for."""
    return F.unix_timestamp(c) + hours * 3600


def parse_hour(c: Column) -> Column:
    """``2025-03-15T14`` to a timestamp; NULL when it does not parse."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH"))


def parse_int_date(c: Column) -> Column:
    """``20250315`` (number or text) to a date; NULL when it does not parse."""
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date")


def fourier(c: Column, period_days: float = 365.25, k: int = 1) -> dict[str, Column]:
    """``sin``/``cos`` terms 1..k of the day of year, as named columns."""
    terms = {}
    for i in range(1, k + 1):
        angle = F.dayofyear(c) * F.lit(2 * math.pi * i / period_days)
        terms[f"sin_{i}"] = F.sin(angle)
        terms[f"cos_{i}"] = F.cos(angle)
    return terms


def season(c: Column) -> Column:
    """Meteorological season of a date."""
    m = F.month(c)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


# --- US federal holidays -----------------------------------------------------------------------


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _last_monday_of_may(year: int) -> dt.date:
    last = dt.date(year, 5, 31)
    return last - dt.timedelta(days=last.weekday())


def _observed(day: dt.date) -> dt.date:
    """Saturday holidays are kept on Friday, Sunday holidays on Monday."""
    shift = {5: -1, 6: 1}.get(day.weekday(), 0)
    return day + dt.timedelta(days=shift)


def holiday_dates(first: dt.date, last: dt.date) -> list[dt.date]:
    """Observed federal holidays in the closed range ``first``..``last``."""
    monday, thursday = 0, 3
    days: set[dt.date] = set()
    for year in range(first.year, last.year + 2):
        days |= {
            _observed(dt.date(year, 1, 1)),
            _nth_weekday(year, 2, monday, 3),
            _last_monday_of_may(year),
            _observed(dt.date(year, 7, 4)),
            _nth_weekday(year, 9, monday, 1),
            _nth_weekday(year, 10, monday, 2),
            _observed(dt.date(year, 11, 11)),
            _nth_weekday(year, 11, thursday, 4),
            _observed(dt.date(year, 12, 25)),
        }
        if year >= 1986:
            days.add(_nth_weekday(year, 1, monday, 3))
        if year >= 2021:
            days.add(_observed(dt.date(year, 6, 19)))
    return sorted(d for d in days if first <= d <= last)


def is_us_holiday(c: Column) -> Column:
    """Whether a date is an observed federal holiday, of any year: the rule of ``holiday_dates`` as an expression."""
    weekday = F.weekday(c)  # Monday is 0

    def fixed(d: Column) -> Column:
        month_day = F.month(d) * 100 + F.dayofmonth(d)
        return month_day.isin(101, 704, 1111, 1225) | ((month_day == 619) & (F.year(d) >= 2021))

    def nth(month: int, day: int, n: int) -> Column:
        return (F.month(c) == month) & (weekday == day) & (F.ceil(F.dayofmonth(c) / 7) == n)

    shifted = ((weekday == 4) & fixed(F.date_add(c, 1))) | ((weekday == 0) & fixed(F.date_sub(c, 1)))
    last_monday = (F.month(c) == 5) & (weekday == 0) & (F.dayofmonth(c) >= 25)
    king = nth(1, 0, 3) & (F.year(c) >= 1986)
    return ((weekday < 5) & fixed(c)) | shifted | king | nth(2, 0, 3) | last_monday | nth(9, 0, 1) | nth(10, 0, 2) | nth(11, 3, 4)


def us_holidays(spark: SparkSession, year_from: int, year_to: int) -> DataFrame:
    """One row per observed holiday of the years: at most 12 rows a year."""
    days = holiday_dates(dt.date(year_from, 1, 1), dt.date(year_to, 12, 31))
    values = ", ".join(f"(DATE '{d.isoformat()}')" for d in days)
    return spark.sql(f"SELECT * FROM VALUES {values} AS holidays(holiday_date)")
