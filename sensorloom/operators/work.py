"""Joins between control tables: reconciliation, replay selection, spool bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timing import utc
from sensorloom.rules import ReplayRequest


def reconcile_objects(objects: DataFrame, manifests: DataFrame) -> DataFrame:
    """Object keys on one side only, with ``state`` ``ORPHAN`` or ``MISSING``; empty means healthy."""
    stored = objects.select("object_key", F.lit(True).alias("_stored"))
    listed = manifests.select("object_key", F.lit(True).alias("_listed"))
    return (
        stored.join(listed, "object_key", "full_outer")
        .where(F.col("_stored").isNull() | F.col("_listed").isNull())
        .select("object_key", F.when(F.col("_listed").isNull(), F.lit("ORPHAN")).otherwise(F.lit("MISSING")).alias("state"))
        .orderBy("object_key")
    )


def reconciliation_summary(differences: DataFrame) -> DataFrame:
    return differences.agg(
        F.count_if(F.col("state") == "ORPHAN").alias("orphan_objects"),
        F.count_if(F.col("state") == "MISSING").alias("missing_objects"),
    ).withColumn("healthy", (F.col("orphan_objects") == 0) & (F.col("missing_objects") == 0))


def replay_runs(spark, requests: list[ReplayRequest]) -> DataFrame:
    return spark.createDataFrame(
        [
            (r.replay_id, r.facility_id, utc(r.from_time), utc(r.to_time), r.mapping_version,
             r.quality_rules_version, r.reason, r.requested_at and utc(r.requested_at))
            for r in (r.check() for r in requests)
        ],
        "replay_id string, facility_id string, from_time timestamp, to_time timestamp, mapping_version string, "
        "quality_rules_version string, reason string, requested_at timestamp",
    )


#: Requests that a plain join compares with every batch of their facility.
FEW_REQUESTS = 8
#: Seconds of a time bin, times LEVEL_FACTOR for each level above.
BIN_SECONDS, LEVELS, LEVEL_FACTOR = 60, 18, 4


def _width(level: int) -> int:
    return BIN_SECONDS * 1_000_000 * LEVEL_FACTOR**level


def _bin(micros: Column, level: Column) -> Column:
    width = F.lit(BIN_SECONDS * 1_000_000) * F.pow(F.lit(LEVEL_FACTOR), level).cast("long")
    return F.floor(micros / width).cast("long")


def _spans(rows: DataFrame, low: Column, high: Column, side: str) -> DataFrame:
    """Rows with both ends of their span in microseconds and the level whose bins are no shorter than it."""
    longest = F.greatest(F.col(f"_high{side}") - F.col(f"_low{side}"), F.lit(1)) / F.lit(BIN_SECONDS * 1_000_000)
    level = F.least(F.greatest(F.ceil(F.log(longest) / F.log(F.lit(float(LEVEL_FACTOR)))), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    return rows.withColumns({f"_low{side}": low, f"_high{side}": high}).where(f"_low{side} <= _high{side}").withColumn("_own", level)


#: Of a level of one side: how many rows, the sum of their spans and the longest, in microseconds.
Levels = dict[int, tuple[int, float, int]]
#: Where the rows of a level lie: on which level's bins, whether beside longer spans there, from how long before their start on.
Places = dict[int, list[tuple[int, int, int]]]


def _levels(rows: DataFrame, side: str) -> Levels:
    span = F.col(f"_high{side}") - F.col(f"_low{side}")
    found = rows.groupBy("_own").agg(F.count(F.lit(1)), F.sum(span.cast("double")), F.max(span)).collect()  # LEVELS rows at most
    return {own: (n, total, longest) for own, n, total, longest in found}


def _places(points: Levels, spans: Levels) -> tuple[float, Places, Places]:
    """How many rows the places make, and those of ``points``, which lie in the bin of their start alone, and of ``spans``.

    A span lies in all bins where a row that meets it may start. Levels of few points count as the next one. A span that is longer
    than the bins of a level of points lies in the many bins it covers, or the points lie on its level too: whichever makes fewer rows.
    """
    grid, bins = {}, {}
    for own in sorted(points, reverse=True):
        n, _, longest = points[own]
        above = min(bins, default=None)
        joins = above is not None and n * LEVEL_FACTOR ** (above - own) <= bins[above][0]
        grid[own] = at = above if joins else own
        more, longer = bins.get(at, (0, 0))
        bins[at] = (more + n, max(longer, longest))
    lifted = {(g, own) for g, (n, _) in bins.items() for own, (_, total, _) in spans.items() if own > g and total / _width(g) > n}
    of_points = {own: [(g, 0, 0), *((level, 1, 0) for level in sorted(spans) if (g, level) in lifted)] for own, g in grid.items()}
    of_spans: Places = {}
    for own in spans:
        up = [reach for g, (_, reach) in bins.items() if (g, own) in lifted]
        of_spans[own] = [(g, 0, reach) for g, (_, reach) in bins.items() if (g, own) not in lifted] + ([(own, 1, max(up))] if up else [])
    copies = sum(points[own][0] * len(places) for own, places in of_points.items())
    copies += sum(n + (total + n * reach) / _width(g) for own, (n, total, _) in spans.items() for g, _, reach in of_spans[own])
    return copies, of_points, of_spans


def _in_bins(rows: DataFrame, places: Places, side: str, points: bool) -> DataFrame:
    """Rows by (_level, _wider, _bin)."""
    at = F.array().cast("array<struct<_level:int,_wider:int,_reach:bigint>>")
    for own, where in places.items():
        here = F.array(*[F.struct(F.lit(g).alias("_level"), F.lit(wider).alias("_wider"), F.lit(reach).cast("long").alias("_reach")) for g, wider, reach in where])
        at = F.when(F.col("_own") == own, here).otherwise(at)
    placed = rows.withColumn("_place", F.explode(at)).withColumns({c: F.col(f"_place.{c}") for c in ("_level", "_wider", "_reach")})
    first, last = _bin(F.col(f"_low{side}") - F.col("_reach"), F.col("_level")), _bin(F.col(f"_high{side}"), F.col("_level"))
    return placed.withColumn("_bin", first if points else F.explode(F.sequence(first, last))).drop("_own", "_place", "_reach")


def overlapping_intervals(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``keys`` whose spans meet: an equi-join on time bins.

    A left span holds both its ends, a right span its start only. A row's own level is the one whose bins are no
    shorter than its span. Rows of one side lie in the bin of their start alone, on their own level and on those of much longer
    spans of the other side; a row of the other side lies in the bins where rows that meet it may start. So two rows share one bin
    at most, of about the length of the longer span, and the pairs compared grow with the pairs that overlap. The side that
    is to lie in one bin is the one that makes fewer rows so, by counts of both sides' levels that are taken at the call. Spans
    with a null end, or that end before they start, meet nothing. Both inputs are read twice, for the levels and for the rows.
    """
    return (
        _sharing_bins(left, right, keys, left_span, right_span)
        .where("_low_l <= _high_r and _high_l >= _low_r")
        .drop(*[f"{c}_{side}" for c in ("_low", "_high") for side in "lr"], "_level", "_wider", "_bin")
    )


def _sharing_bins(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """The pairs that ``overlapping_intervals`` compares, each once."""
    lefts, rights = _binned(left, right, keys, left_span, right_span)
    return lefts.join(rights, [*keys, "_level", "_wider", "_bin"])


def _binned(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Both sides by ``keys`` and bin: what the join moves."""
    lefts = _spans(left, *(F.unix_micros(c) for c in left_span), "_l")
    rights = _spans(right, F.unix_micros(right_span[0]), F.unix_micros(right_span[1]) - 1, "_r")
    of_left, of_right = _levels(lefts, "_l"), _levels(rights, "_r")
    by_left, *left_points = _places(of_left, of_right)
    by_right, *right_points = _places(of_right, of_left)
    at_left, at_right = left_points if by_left < by_right else reversed(right_points)
    return _in_bins(lefts, at_left, "_l", by_left < by_right), _in_bins(rights, at_right, "_r", by_left >= by_right)


def overlapping_batches(manifests: DataFrame, requests: list[ReplayRequest] | DataFrame) -> DataFrame:
    """Manifest rows whose event interval touches a request, with its ``replay_id``.

    Many requests, or a table of them (replay_id, facility_id, from_time, to_time), meet the batches in time bins, so the
    pairs that are compared grow with the pairs that overlap.
    """
    few = isinstance(requests, list) and len(requests) <= FEW_REQUESTS
    table = replay_runs(manifests.sparkSession, requests) if isinstance(requests, list) else requests
    wanted = table.select("replay_id", "facility_id", "from_time", "to_time")
    if not few:
        spans = ("minimum_observed_at", "maximum_observed_at"), ("from_time", "to_time")
        return overlapping_intervals(manifests, wanted, ["facility_id"], *spans).drop("from_time", "to_time")
    overlaps = (F.col("minimum_observed_at") < F.col("to_time")) & (F.col("maximum_observed_at") >= F.col("from_time"))
    return manifests.join(wanted, "facility_id").where(overlaps).drop("from_time", "to_time")


def select_replay_batches(manifests: DataFrame, requests: list[ReplayRequest] | DataFrame) -> DataFrame:
    """The batches to replay, per request in receipt order."""
    return (
        overlapping_batches(manifests, requests)
        .select("replay_id", "batch_id", "received_at")
        .orderBy("replay_id", "received_at", "batch_id")
    )


def replay_worklist(replay_batches: DataFrame, replay_runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Pending batches of active replays, oldest request first, then receipt order."""
    active = replay_runs.where(F.col("status").isin("PENDING", "RUNNING")).select(
        "replay_id", "requested_at", "mapping_version", "quality_rules_version"
    )
    return (
        replay_batches.where(F.col("status") == "PENDING")
        .select("replay_id", "batch_id")
        .join(active, "replay_id")
        .join(manifests.select("batch_id", "received_at", "object_key", "checksum"), "batch_id")
        .orderBy("requested_at", "received_at", "batch_id")
    )


def unbatched(spool: DataFrame, items: DataFrame) -> DataFrame:
    """Unacknowledged spool rows that are in no batch yet."""
    return spool.where(F.col("acknowledged_at").isNull()).join(
        items.select(F.col("observation_id").alias("id")), "id", "left_anti"
    )


def acknowledge(spool: DataFrame, items: DataFrame, acked_batches: DataFrame) -> DataFrame:
    """Set ``acknowledged_at`` for the rows of the given (batch_id, acknowledged_at) batches."""
    done = (
        items.join(acked_batches.select("batch_id", F.col("acknowledged_at").alias("_at")), "batch_id")
        .groupBy(F.col("observation_id").alias("id"))
        .agg(F.max("_at").alias("_at"))
    )
    return (
        spool.join(done, "id", "left")
        .withColumn("acknowledged_at", F.coalesce("_at", "acknowledged_at"))
        .drop("_at")
        .select(*spool.columns)
    )


def due_items(
    df: DataFrame, states: list[str], now: Column, limit: int | None = None, oldest: tuple[str, ...] = ("created_at", "item_id")
) -> DataFrame:
    due = df.where(F.col("state").isin(states) & (F.col("next_attempt_at") <= now)).orderBy(*oldest)
    return due if limit is None else due.limit(limit)


def prune(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Keep rows that are not acknowledged or were acknowledged at or after the cutoff."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= cutoff))
