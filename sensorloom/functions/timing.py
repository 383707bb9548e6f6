"""Differences between instants."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(at: datetime) -> datetime:
    """A datetime without zone is meant in UTC, whatever the driver's own zone is."""
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def _floor_div(value: Column, by: int) -> Column:
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("long")


def floor_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds from ``earlier`` to ``later``, floored also below zero."""
    return _floor_div(F.unix_micros(later) - F.unix_micros(earlier), 1_000_000)


def age_seconds(now: Column, then: Column) -> Column:
    """Age clamped at zero; zero when there is nothing to be old."""
    return F.coalesce(F.greatest(floor_seconds(now, then), F.lit(0)), F.lit(0)).cast("long")


def lag_millis(later: Column, earlier: Column) -> Column:
    return _floor_div(F.unix_micros(later) - F.unix_micros(earlier), 1000)
