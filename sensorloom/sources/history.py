"""Cursor reads of a source's retained readings, and the days that hold a span of sequences."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.schemas import SOURCE_KEY

DAY, LOW, HIGH = "day", "low_sequence", "high_sequence"


def day_index(samples: DataFrame) -> DataFrame:
    """Lowest and highest sequence of each source key on each event day, to be kept beside samples stored by day."""
    return samples.groupBy(F.to_date("observed_at").alias(DAY), *SOURCE_KEY).agg(
        F.min("source_sequence").alias(LOW), F.max("source_sequence").alias(HIGH)
    )


def merge_day_index(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy(DAY, *SOURCE_KEY).agg(F.min(LOW).alias(LOW), F.max(HIGH).alias(HIGH))


def days_with(index: DataFrame, wanted: Column | DataFrame) -> list[date]:
    """Days on which a condition on the index holds, or that meet spans (source key, low_sequence, high_sequence).

    One value a calendar day comes to the driver.
    """
    if isinstance(wanted, Column):
        found = index.where(wanted)
    else:
        spans = wanted.select(*SOURCE_KEY, F.col(LOW).alias("_low"), F.col(HIGH).alias("_high"))
        found = index.join(spans, SOURCE_KEY).where((F.col(LOW) <= F.col("_high")) & (F.col(HIGH) >= F.col("_low")))
    return [r[DAY] for r in found.select(DAY).distinct().orderBy(DAY).collect()]


def on_days(stored: DataFrame, days: list[date], column: str) -> DataFrame:
    """``stored`` restricted to folders of these days; ``column`` is the day it is partitioned by."""
    return stored.where(F.col(column).isin(days)) if days else stored.limit(0)


def read_after_cursor(
    history: DataFrame, source_epoch: str | None, after_sequence: int, limit: int | None = 500, current_epoch: str | None = None,
    index: DataFrame | None = None, day: str = "observed_date",
) -> DataFrame:
    """Readings after the cursor in sequence order. With the day ``index`` only days that may hold some are read, of the partition column ``day``.

    ``history`` holds readings of ``current_epoch`` (or several epochs when that is
    null, then ``source_epoch`` selects). A cursor of another epoch restarts from zero.
    """
    if limit is not None and not 1 <= limit <= 500:
        raise ValueError("INVALID_PAGE_SIZE")
    epoch = current_epoch if current_epoch is not None else source_epoch
    rows = history if epoch is None else history.where(F.col("source_epoch") == epoch)
    same = source_epoch is None or source_epoch == epoch
    if index is not None:
        later = F.col(HIGH) > (after_sequence if same else 0)
        rows = on_days(rows, days_with(index, later if epoch is None else later & (F.col("source_epoch") == epoch)), day)
    page = rows.where(F.col("source_sequence") > (after_sequence if same else 0)).orderBy("source_sequence")
    return page if limit is None else page.limit(limit)


def cursor_state(
    history: DataFrame, source_epoch: str | None, after_sequence: int, current_epoch: str | None = None
) -> DataFrame:
    """One row: current epoch, earliest and latest retained sequence, and whether the cursor expired.

    A cursor of the current epoch that is older than the reading before the earliest retained
    one has lost readings: the caller has to recover, not to skip them silently.
    """
    epoch = current_epoch if current_epoch is not None else source_epoch
    rows = history if epoch is None else history.where(F.col("source_epoch") == epoch)
    same = source_epoch is None or source_epoch == epoch
    span = rows.agg(F.min("source_sequence").alias("earliest_sequence"), F.max("source_sequence").alias("latest_sequence"))
    lost = F.lit(same and after_sequence > 0) & (F.lit(after_sequence) < F.col("earliest_sequence") - 1)
    return span.select(
        F.lit(epoch).alias("source_epoch"), "earliest_sequence", "latest_sequence", F.coalesce(lost, F.lit(False)).alias("expired")
    )


def next_cursor(page: DataFrame, after_sequence: int) -> DataFrame:
    return page.agg(F.coalesce(F.max("source_sequence"), F.lit(after_sequence)).alias("next_sequence"))
