"""Dates of fiscal quarters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def fiscal_quarter(period_end: Column) -> Column:
    """FYyyQn of a year that begins in April; null for a month that ends no quarter."""
    month = F.month(period_end)
    year = F.year(period_end) + F.when(month > 3, 1).otherwise(0)
    number = F.when(month == 3, 4).otherwise((month / 3 - 1).cast("int"))
    return F.when(month % 3 == 0, F.format_string("FY%02dQ%d", year % 100, number))


def months_before(period_end: Column, months: int) -> Column:
    """The quarter end so many months before."""
    return F.last_day(F.add_months(period_end, -months))


def last_quarters(today: Column, count: int, due: int) -> Column:
    """The last `count` quarter ends that are at least `due` days before today, newest first."""
    end = F.last_day(F.add_months(F.trunc(F.date_sub(today, due), "quarter"), 2))
    last = F.when(end <= F.date_sub(today, due), end).otherwise(months_before(end, 3))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.last_day(F.add_months(last, i * -3)))


def window_quarter(day: Column, days: int) -> Column:
    """The quarter end at most `days` before the day, and not on it; null if the last one is longer ago."""
    end = F.date_sub(F.trunc(day, "quarter"), 1).cast("date")
    return F.when(F.datediff(day, end) <= days, end)


def filed_on(board: Column, known: Column, period_end: Column, deadline: int = 45) -> tuple[Column, Column]:
    """When results were filed, and whether that is only the deadline."""
    stated = F.coalesce(board, known)
    return F.coalesce(stated, F.date_add(period_end, deadline)), stated.isNull()


def fetch_start(last: Column, today: Column, years: int = 5) -> Column:
    return F.coalesce(last, F.date_sub(today, 365 * years))


def is_filler(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    """A bar of one price without volume."""
    return (open_ == high) & (high == low) & (low == close) & (F.coalesce(volume, F.lit(0)) == 0)
