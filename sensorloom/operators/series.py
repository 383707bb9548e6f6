"""Gauges as series: what was pending, and how old, at every sampling instant.

A gauge is a state, not an event. Its series comes from the two events of every row, its opening and its
closing, by prefix sums; the oldest pending row at an instant is the first of the rows whose closing is a running
maximum. Both scans work on slices, so one key may hold most rows, and cost the rows plus the samples however long the
rows stay pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.scan import Running, running, slice_rows

SECOND = 1_000_000
AT = "sampled_at"
_NEVER = (1 << 62) - 1


def _micros(value: Column | str) -> Column:
    return F.unix_micros(F.col(value) if isinstance(value, str) else value)


def _first_step_from(micros: Column, start: Column, step: int) -> Column:
    """Number of the first sample at or after an instant."""
    return F.greatest(F.ceil((micros - start) / F.lit(step)), F.lit(0)).cast("long")


def _samples(keys: DataFrame, start: Column, end: Column, step: int) -> DataFrame:
    """Each key with every sample number from start to before end."""
    last = F.floor((end - 1 - start) / F.lit(step)).cast("long")
    numbers = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    return keys.select("*", F.explode(numbers).alias("_step"))


def pending_series(
    rows: DataFrame, opened: str, closed: str, start: Column, end: Column, step_seconds: int,
    keys: list[str] = [], capacity: int | None = None, slices: int | None = None,
) -> DataFrame:
    """Pending rows and the age of the oldest at every ``step_seconds`` from ``start`` to before ``end``, for each key.

    A row is pending from ``opened`` to before ``closed``, for ever if that is null; one closed no later than it was
    opened never is, nor is one without ``opened``. Adds ``sampled_at``, ``pending``, ``oldest_age_seconds`` (0 without
    a pending row) and with ``capacity`` its ``utilization_ratio``. Keys must not be null.
    """
    step = step_seconds * SECOND
    by = keys or ["_series"]
    first, until = _micros(start), _micros(end)
    spans = rows.select(
        *(keys or [F.lit(0).alias("_series")]), _micros(opened).alias("_open"), F.coalesce(_micros(closed), F.lit(_NEVER)).alias("_close")
    ).where((F.col("_open") < F.col("_close")) & (F.col("_open") < until) & (F.col("_close") > first))
    spans = spans.select(*by, "_open", "_close", first.alias("_first"), until.alias("_until"))
    number = lambda c: _first_step_from(c, F.col("_first"), step)
    # openings and closings per sample are summed before anything is scanned
    changes = (
        spans.select(*by, F.explode(F.array(
            F.struct(number(F.col("_open")).alias("_step"), F.lit(1).alias("_n")),
            F.struct(number(F.col("_close")).alias("_step"), F.lit(-1).alias("_n")),
        )).alias("_e"))
        .groupBy(*by, "_e._step").agg(F.sum("_e._n").alias("_change"))
    )
    everything = (rows.select(*keys) if keys else rows.sparkSession.range(1).select(F.lit(0).alias("_series"))).distinct()
    grid = _samples(everything, first, until, step)
    counted = running(
        slice_rows(grid.join(changes, [*by, "_step"], "left"), by, ["_step"], slices),
        {"pending": Running(F.col("_change"), kind="sum", inclusive=True)},
    )
    # rows that close later than all that opened before them, each the oldest from the closing of the one before
    seen = running(slice_rows(spans, by, ["_open", "_close"], slices), {"_before": Running(F.col("_close"))})
    from_ = F.greatest("_open", F.coalesce("_before", F.col("_open")))
    holds = seen.where(F.col("_before").isNull() | (F.col("_close") > F.col("_before"))).select(
        *by, "_open", number(from_).alias("_low"), number(F.least("_close", "_until")).alias("_high")
    ).where("_low < _high")
    oldest = holds.select(*by, "_open", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_step"))
    sampled = F.timestamp_micros(first + F.col("_step") * step)
    age = F.floor((_micros(AT) - F.col("_open")) / F.lit(SECOND)).cast("long")
    out = counted.join(oldest, [*by, "_step"], "left").withColumn(AT, sampled).select(
        *keys, AT, F.col("pending").cast("long").alias("pending"), F.coalesce(age, F.lit(0)).alias("oldest_age_seconds")
    )
    return out if capacity is None else out.withColumn("utilization_ratio", F.col("pending") / F.lit(capacity))


def age_series(
    events: DataFrame, at: str, start: Column, end: Column, step_seconds: int, keys: list[str] = [], slices: int | None = None
) -> DataFrame:
    """Seconds since the last event of each key at every sample; null before the first."""
    step = step_seconds * SECOND
    by = keys or ["_series"]
    first, until = _micros(start), _micros(end)
    rows = events.select(*(keys or [F.lit(0).alias("_series")]), _micros(at).alias("_at"), first.alias("_first")).where(F.col("_at") < until)
    latest = rows.groupBy(*by, _first_step_from(F.col("_at"), F.col("_first"), step).alias("_step")).agg(F.max("_at").alias("_last"))
    everything = (events.select(*keys) if keys else events.sparkSession.range(1).select(F.lit(0).alias("_series"))).distinct()
    grid = _samples(everything, first, until, step).join(latest, [*by, "_step"], "left")
    scanned = running(slice_rows(grid, by, ["_step"], slices), {"_seen": Running(F.col("_last"), inclusive=True)})
    sampled = first + F.col("_step") * step
    return scanned.select(
        *keys, F.timestamp_micros(sampled).alias(AT), F.floor((sampled - F.col("_seen")) / F.lit(SECOND)).cast("long").alias("age_seconds")
    )


def level_series(
    readings: DataFrame, at: str, level: str, start: Column, end: Column, step_seconds: int,
    keys: list[str] = [], stale_seconds: int | None = None, tie_break: tuple[str, ...] = (), slices: int | None = None,
) -> DataFrame:
    """The last reported ``level`` of each key at every sample; null before the first report, and once it is older than ``stale_seconds``.

    Reports of the same instant are told apart by ``tie_break``, then by the higher level.
    """
    step = step_seconds * SECOND
    by = keys or ["_series"]
    first, until = _micros(start), _micros(end)
    rows = readings.select(
        *(keys or [F.lit(0).alias("_series")]), F.struct(_micros(at).alias("at"), *tie_break, F.col(level).alias("level")).alias("_r"), first.alias("_first")
    ).where(F.col("_r.at") < until)
    latest = rows.groupBy(*by, _first_step_from(F.col("_r.at"), F.col("_first"), step).alias("_step")).agg(F.max("_r").alias("_last"))
    everything = (readings.select(*keys) if keys else readings.sparkSession.range(1).select(F.lit(0).alias("_series"))).distinct()
    grid = _samples(everything, first, until, step).join(latest, [*by, "_step"], "left")
    scanned = running(slice_rows(grid, by, ["_step"], slices), {"_seen": Running(F.col("_last"), inclusive=True)})
    sampled = first + F.col("_step") * step
    fresh = F.lit(True) if stale_seconds is None else sampled - F.col("_seen.at") <= stale_seconds * SECOND
    return scanned.select(*keys, F.timestamp_micros(sampled).alias(AT), F.when(fresh, F.col("_seen.level")).alias(level))
