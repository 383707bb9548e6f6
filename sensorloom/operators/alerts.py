"""The pipeline's alert rules over the metric tables of this library."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.order import alert_states


@dataclass(frozen=True)
class Alert:
    """``condition`` reads the columns of its metric table; ``for_seconds`` it has to hold."""

    condition: Callable[[], Column]
    for_seconds: int
    severity: str
    metric: str


def _above(column: str, limit: float) -> Callable[[], Column]:
    return lambda: F.col(column) > limit


# Thresholds, durations and severities. ``metric`` names the function
# whose output the condition reads, sampled over time.
ALERTS = {
    "CollectorOffline": Alert(_above("heartbeat_age_seconds", 90), 60, "critical", "fleet_gauges"),
    "CollectorSpoolBacklog": Alert(lambda: F.col("utilization_ratio") >= 0.8, 120, "warning", "pending_gauges"),
    "CollectorOldUnsentData": Alert(_above("oldest_age_seconds", 300), 120, "warning", "pending_gauges"),
    "CollectorUploadFailures": Alert(_above("failures", 3), 60, "warning", "stage_stats"),
    "TransactionalOutboxBacklog": Alert(
        lambda: (F.col("pending") > 10) | (F.col("oldest_age_seconds") > 30), 120, "critical", "pending_gauges"
    ),
    "ProcessingLagHigh": Alert(_above("p99_seconds", 30), 300, "warning", "lag_summary"),
    "RejectionSpike": Alert(_above("ratio", 0.05), 300, "warning", "rejection_ratio"),
    "RawStoreOperationsFailing": Alert(_above("failures", 3), 60, "critical", "stage_stats"),
    "DatabaseWritesFailing": Alert(_above("failures", 3), 60, "critical", "stage_stats"),
}


def evaluate_alert(
    metric: DataFrame, name: str, keys: list[str] = [], order: list[str] = ["window_start"], step_seconds: int = 300
) -> DataFrame:
    """Alert state at every sample of a metric table, which has one every ``step_seconds`` unless it counted nothing."""
    rule = ALERTS[name]
    return alert_states(metric, rule.condition(), rule.for_seconds, keys, order, step_seconds=step_seconds).select(
        F.lit(name).alias("alert"), F.lit(rule.severity).alias("severity"), "*"
    )
