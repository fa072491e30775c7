"""Reporting windows, computed on the driver, and store-local dates, computed in the plan."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def store_date(instant: Column, zone: Column) -> Column:
    """The local calendar date of an instant."""
    return F.from_utc_timestamp(instant, zone).cast("date")


def start_of_day(day: Column, zone: Column) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def completed_window(now: datetime, zone: str, days: int) -> tuple[date, date]:
    """The last ``days`` local days up to yesterday, as first day and the day after the last."""
    if not 1 <= days <= 365:
        raise ValueError("days must be from 1 to 365")
    today = now.astimezone(ZoneInfo(zone)).date()
    return today - timedelta(days=days), today


def preceding(window: tuple[date, date]) -> tuple[date, date]:
    """The window of equal length that ends where this one begins."""
    return window[0] - (window[1] - window[0]), window[0]


def ranged_window(first: date | None, last: date | None) -> tuple[date, date]:
    """An inclusive range as a half-open window; both ends or neither."""
    if first is None or last is None or first > last or (last - first).days >= 365:
        raise ValueError("from and to must both be given, in order, within 365 days")
    return first, last + timedelta(days=1)


def date_spine(spark: SparkSession, window: tuple[str, str]) -> DataFrame:
    """A row per day of a half-open window."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(window[0]).cast("date"), F.date_sub(F.lit(window[1]).cast("date"), 1))).alias("day"))
