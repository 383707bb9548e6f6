"""Event-time queries on canonical samples."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.cursor import decode_cursor, encode_cursor
from sensorloom.functions.timing import utc
from sensorloom.runtime import materialize
from sensorloom.rules import check_page_size, check_query_range
from sensorloom.sources.canonical import PARTITION


def filter_interval(df: DataFrame, from_: datetime | None, to: datetime | None) -> DataFrame:
    """Half-open ``[from, to)`` on event time; everything when a bound is missing.

    A table partitioned by event date is also filtered on that column, because the
    optimizer does not derive the date bound from the instant.
    """
    if from_ is None or to is None:
        return df
    low, high = F.lit(utc(from_)), F.lit(utc(to))
    kept = df.where((F.col("observed_at") >= low) & (F.col("observed_at") < high))
    if PARTITION in df.columns:
        kept = kept.where(F.col(PARTITION).between(F.to_date(low), F.to_date(high)))
    return kept


def with_flag(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.array_contains("flags", flag))


def tag_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(F.col("source_tag").like(pattern))


def _matching(
    canonical: DataFrame,
    facility: str,
    from_: datetime,
    to: datetime,
    asset: str | None,
    signal: str | None,
    include_flagged: bool,
    include_bad_quality: bool,
    maximum_range: timedelta,
) -> DataFrame:
    check_query_range(from_, to, maximum_range)
    rows = filter_interval(canonical.where(F.col("facility_id") == facility), from_, to)
    if asset and asset.strip():
        rows = rows.where(F.col("asset_id") == asset)
    if signal and signal.strip():
        rows = rows.where(F.col("signal_id") == signal)
    if not include_flagged:
        rows = rows.where(F.size("flags") == 0)
    if not include_bad_quality:
        rows = rows.where(F.col("quality") == "GOOD")
    return rows


def query_telemetry(
    canonical: DataFrame,
    facility: str,
    from_: datetime,
    to: datetime,
    asset: str | None = None,
    signal: str | None = None,
    include_flagged: bool = True,
    include_bad_quality: bool = True,
    maximum_range: timedelta = timedelta(hours=24),
) -> DataFrame:
    """Samples of a facility in event-time order, then by id."""
    return _matching(
        canonical, facility, from_, to, asset, signal, include_flagged, include_bad_quality, maximum_range
    ).orderBy("observed_at", "observation_id")


def _after(observed_at: datetime, observation_id: str) -> Column:
    at = F.lit(utc(observed_at))
    return (F.col("observed_at") > at) | ((F.col("observed_at") == at) & (F.col("observation_id") > observation_id))


def telemetry_page(
    canonical: DataFrame,
    facility: str,
    from_: datetime,
    to: datetime,
    asset: str | None = None,
    signal: str | None = None,
    include_flagged: bool = True,
    include_bad_quality: bool = True,
    page_size: int = 200,
    cursor: str | None = None,
    maximum_range: timedelta = timedelta(hours=24),
    maximum_page: int = 1000,
) -> tuple[DataFrame, str | None]:
    """One keyset page and the cursor of the next one, null on the last page.

    The page and one row more are read once; that row tells whether there is a next page.
    At most ``maximum_page`` rows reach the driver, only to find the cursor.
    """
    check_query_range(from_, to, maximum_range)
    check_page_size(page_size, maximum_page)
    rows = _matching(
        canonical, facility, from_, to, asset, signal, include_flagged, include_bad_quality, maximum_range
    )
    if cursor and cursor.strip():
        after = decode_cursor(cursor)
        rows = rows.where(_after(*after))
        if PARTITION in rows.columns:
            rows = rows.where(F.col(PARTITION) >= F.to_date(F.lit(utc(after[0]))))
    read = materialize(rows.orderBy("observed_at", "observation_id").limit(page_size + 1), "page")
    ordered = read.orderBy("observed_at", "observation_id")
    head = ordered.select(F.unix_micros("observed_at").alias("at"), "observation_id").collect()
    following = None
    if len(head) > page_size:
        last = head[page_size - 1]
        following = encode_cursor(datetime(1970, 1, 1) + timedelta(microseconds=last["at"]), last["observation_id"])
    return ordered.limit(page_size), following


def recent_batches(manifests: DataFrame, n: int) -> DataFrame:
    return manifests.orderBy(F.desc("received_at"), "batch_id").limit(n)


def failed_batches(manifests: DataFrame) -> DataFrame:
    return manifests.where(F.col("processing_status") == "FAILED").orderBy(F.desc("received_at"), "batch_id")
