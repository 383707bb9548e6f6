"""Test inputs derived from the whole ``events`` table with plain expressions.

``TABLES_SQL`` and ``DECIDE_SQL`` state the same derivations for the comparison engine.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.operators.aggregate import COUNTS
from sensorloom.operators.order import source_positions
from sensorloom.plans.process import Processed, process_batches
from sensorloom.rules import ReplayRequest, mapping_rules, quality_rules
from sensorloom.runtime import configure, materialize

EPOCH = "00000000-0000-4000-8000-00000000000"
MAPPING_0 = mapping_rules("controller-a-mapping-1.0.0")
MAPPING_1 = mapping_rules("controller-a-mapping-1.1.0")
QUALITY = quality_rules("quality-rules-1.0.0")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def bounds(spark: SparkSession, sf_dir: str):
    """First and last event time and the highest id: one row of plain aggregates."""
    return events(spark, sf_dir).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("event_id").alias("top")
    ).first()


def batch_key(batch_no: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(batch_no.cast("string"), 12, "0"))


def zone(user: Column) -> Column:
    return F.lpad((user % 12 + 1).cast("string"), 2, "0")


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as delivered once, plus re-deliveries one day later in batches of their own."""
    source = events(spark, sf_dir)
    half = events(spark, sf_dir).agg(F.floor(F.max("event_id") / 2)).scalar()
    event_id = F.col("event_id")
    shipped = source.select(
        "*", F.floor(event_id / 4).alias("batch_no"), (event_id % 4).alias("item_order"), F.lit(0).alias("again")
    ).unionByName(
        source.where(event_id % 25 == 3).select(
            "*", (F.floor(event_id / 100) + 1_000_000_000).alias("batch_no"), F.floor(event_id % 100 / 25).alias("item_order"),
            F.lit(1).alias("again"),
        )
    )
    kind = F.col("event_type")
    point = (
        F.when(kind == "click", F.lit("TEMP_PV"))
        .when(kind == "view", F.lit("RH_PV"))
        .when(kind == "purchase", F.lit("FAN_OUT"))
        .when(kind == "signup", F.lit("TEMP_AUX_PV"))
        .otherwise(F.lit("DOOR_SW"))
    )
    shift = (
        F.when(event_id % 97 == 1, F.lit(1_200_000_000))
        .when(event_id % 10 == 5, F.lit(120_000_000))
        .when(event_id % 10 == 0, F.lit(-600_000_000))
        .otherwise(F.lit(0))
    )
    newest = F.max("ts").over(Window.partitionBy("batch_no"))
    received = F.timestamp_micros(F.unix_micros(newest) + 5_000_000 + F.col("again") * 86_400_000_000)
    return (
        shipped.withColumn("received_at", received)
        .select(
            batch_key(F.col("batch_no")).alias("batch_id"),
            "item_order",
            F.lit("facility-alpha").alias("facility_id"),
            F.lit("edge-gateway-01").alias("collector_id"),
            F.lit("1.0.0").alias("collector_version"),
            F.lit("controller-a").alias("source_system"),
            F.concat(F.lit(EPOCH), F.when(event_id < half, F.lit("1")).otherwise(F.lit("2"))).alias("source_epoch"),
            event_id.alias("source_sequence"),
            F.concat(F.lit("CTRL_A.ZONE["), zone(F.col("user_id")), F.lit("]."), point).alias("source_tag"),
            F.timestamp_micros(F.unix_micros("ts") + shift).alias("observed_at"),
            "value",
            F.lit("number").alias("value_type"),
            F.when(event_id % 20 == 7, F.lit("invalid-unit"))
            .when(kind.isin("click", "signup"), F.lit("degC"))
            .otherwise(F.lit("%"))
            .alias("raw_unit"),
            F.when(event_id % 13 == 0, F.lit(0)).otherwise(F.lit(192)).alias("source_quality_code"),
            "received_at",
        )
        .withColumn("processed_at", F.timestamp_micros(F.unix_micros("received_at") + 1_000_000))
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries as nested contract batches with ``received_at``."""
    from sensorloom.sources.raw import assemble_batches

    flat = delivery(spark, sf_dir).withColumn("raw_value", F.parse_json(F.col("value").cast("string")))
    return assemble_batches(flat.withColumn("created_at", F.col("received_at")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = F.array_join(F.sort_array(F.collect_list(F.lpad(F.col("source_sequence").cast("string"), 12, "0"))), ",")
    return (
        delivery(spark, sf_dir)
        .groupBy("batch_id", "facility_id", "collector_id", "received_at")
        .agg(
            F.min("observed_at").alias("minimum_observed_at"),
            F.max("observed_at").alias("maximum_observed_at"),
            F.count(F.lit(1)).alias("observation_count"),
            sequences.alias("content"),  # at most 500 per batch by contract
        )
        .withColumn("object_key", F.concat(F.lit("raw-observations/batch="), "batch_id"))
        .withColumn("checksum", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    )


def batch_number() -> Column:
    return F.substring("batch_id", 25, 12).cast("long")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completed attempt per batch, some failed before it, some run again, some failed for good."""
    base = manifest(spark, sf_dir).select(
        "batch_id", "received_at", batch_number().alias("n"), "observation_count"
    )

    def kind(label: str, rows: DataFrame, status: str, delay: int, took: Column, accepted: Column, error: str | None) -> DataFrame:
        started = F.unix_micros("received_at") + delay * 1_000_000
        return rows.select(
            F.concat("batch_id", F.lit("/" + label)).alias("processing_attempt_id"),
            "batch_id",
            F.lit(None).cast("string").alias("replay_id"),
            F.lit(status).alias("status"),
            F.timestamp_micros(started).alias("started_at"),
            F.timestamp_micros(started + took).alias("completed_at"),
            accepted.alias("accepted_count"),
            F.lit(0).cast("long").alias("flagged_count"),
            F.lit(0).cast("long").alias("rejected_count"),
            (F.col("observation_count") - accepted).alias("duplicate_count"),
            F.lit(error).cast("string").alias("last_error"),
        )

    n, zero = F.col("n"), F.lit(0).cast("long")
    took = (n % 7 + 1) * 250_000
    parts = [
        kind("done", base.where(n % 10 != 4), "COMPLETED", 10, took, F.col("observation_count"), None),
        kind("fail", base.where(n % 9 == 0), "FAILED", 1, took, zero, "store unavailable"),
        kind("again", base.where(n % 8 == 0), "COMPLETED", 60, took, zero, None),
        kind("dead", base.where(n % 14 == 4), "TERMINAL", 30, took, zero, "gave up"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge rows; one collector holds half of them."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 2 == 0, F.lit("edge-0"))
        .otherwise(F.concat(F.lit("edge-"), (F.col("user_id") % 5).cast("string")))
        .alias("collector_id"),
        F.col("ts").alias("persisted_at"),
        F.when(F.col("event_id") % 3 == 0, F.timestamp_micros(F.unix_micros("ts") + 60_000_000)).alias("acknowledged_at"),
    )


def spool_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_id") % 5 == 0).select(
        F.concat(F.lit("out-"), F.floor(F.col("event_id") / 500).cast("string")).alias("batch_id"),
        F.col("event_id").alias("observation_id"),
        (F.col("event_id") % 500).alias("item_order"),
    )


def spool_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series crossing both marks."""
    return events(spark, sf_dir).select(
        F.lit("edge-gateway-01").alias("collector_id"), "event_id", "ts",
        (F.lit(50_000) + (F.col("event_id") * 7919) % 50_001).alias("rows"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("edge-"), F.col("user_id").cast("string")).alias("collector_id"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("beat"),
        (F.col("event_id") % 1000).alias("spool_observation_count"),
        (F.col("event_id") % 600).alias("oldest_unsent_observation_age_seconds"),
        (F.col("event_type") != "error").alias("source_connected"),
    )


def unsent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge rows from their writing to their upload: up to half an hour, some two hours, a few never."""
    event_id = F.col("event_id")
    wait = F.when(event_id % 500 == 1, F.lit(7200)).otherwise(event_id * 7919 % 1800)
    sent = F.timestamp_micros(F.unix_micros("ts") + wait * 1_000_000)
    return events(spark, sf_dir).select(
        F.when(F.col("user_id") % 2 == 0, F.lit("edge-0")).otherwise(F.concat(F.lit("edge-"), (F.col("user_id") % 5).cast("string"))).alias("collector_id"),
        F.col("ts").alias("persisted_at"), F.when(event_id % 4001 != 4000, sent).alias("sent_at"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a batch, published within a minute and a half."""
    wait = batch_number() * 7919 % 90
    return manifest(spark, sf_dir).select(
        F.col("received_at").alias("created_at"), F.timestamp_micros(F.unix_micros("received_at") + wait * 1_000_000).alias("published_at")
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads and raw store operations, sixty times as dense as the events, with stretches of failures."""
    first = bounds(spark, sf_dir)["first"]
    at = F.timestamp_micros(F.unix_micros(F.lit(first)) + F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / 60))
    event_id = F.col("event_id")
    return events(spark, sf_dir).select(
        F.when(event_id % 2 == 0, F.lit("upload")).otherwise(F.lit("raw-store")).alias("operation"), at.alias("started_at"),
        F.timestamp_micros(F.unix_micros(at) + 250_000).alias("completed_at"),
        F.when((event_id % 5 == 3) & (F.floor(event_id / 300) % 3 != 0), F.lit("FAILED")).otherwise(F.lit("COMPLETED")).alias("status"),
    )


def many_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay request of ten minutes around every event."""
    around = lambda seconds: F.timestamp_micros(F.unix_micros("ts") + seconds * 1_000_000)
    return events(spark, sf_dir).select(
        F.concat(F.lit("replay-"), F.col("event_id").cast("string")).alias("replay_id"), F.lit("facility-alpha").alias("facility_id"),
        around(-300).alias("from_time"), around(300).alias("to_time"),
    )


def replay_requests(spark: SparkSession, sf_dir: str) -> list[ReplayRequest]:
    b = bounds(spark, sf_dir)
    day = b["first"].replace(hour=0, minute=0, second=0, microsecond=0)
    return [
        ReplayRequest(
            f"00000000-0000-4000-9000-00000000000{i}", "facility-alpha", day + timedelta(days=start),
            day + timedelta(days=start + 1), "controller-a-mapping-1.1.0", "recover auxiliary tags",
            requested_at=b["last"] + timedelta(days=2, minutes=i),
        )
        for i, start in ((1, 10), (2, 14))
    ]


_stored: dict[tuple, Processed] = {}


def stored(spark: SparkSession, sf_dir: str) -> Processed:
    """The stored result of processing all deliveries under mapping 1.0.0, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        done = process_batches(delivery(spark, sf_dir), MAPPING_0, QUALITY)
        canonical = materialize(done.canonical, "canonical")
        # of the stored rows: done.positions would join all rows with their exceptions once more for the same maxima
        _stored[key] = replace(done, canonical=canonical, positions=materialize(source_positions(canonical), "positions"))
    return _stored[key]


def processed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests carrying the counts of the stored result."""
    counts = stored(spark, sf_dir).attempts.select("batch_id", *COUNTS)
    return (
        manifest(spark, sf_dir)
        .join(counts, "batch_id", "left")
        .withColumn("processing_status", F.when(F.col("accepted_count").isNull(), F.lit("RECEIVED")).otherwise(F.lit("PROCESSED")))
    )


def plain(df: DataFrame) -> DataFrame:
    """Types both engines share: zone-less timestamps, long integers, arrays as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        out.append(c.alias(name))
    return df.select(*out)


TABLES_SQL = r"""
WITH bounds AS (
  SELECT max(event_id) // 2 AS half, min(ts) AS first_ts, max(ts) AS last_ts,
         date_trunc('day', min(ts)) AS day0 FROM events
),
shipped AS (
  SELECT *, event_id // 4 AS batch_no, event_id % 4 AS item_order, 0 AS again FROM events
  UNION ALL
  SELECT *, 1000000000 + event_id // 100, event_id % 100 // 25, 1 FROM events WHERE event_id % 25 = 3
),
delivery AS (
  SELECT *, received_at + INTERVAL 1 SECOND AS processed_at FROM (
    SELECT '00000000-0000-4000-8000-' || lpad(batch_no::VARCHAR, 12, '0') AS batch_id, batch_no, again,
      item_order, 'facility-alpha' AS facility_id, 'edge-gateway-01' AS collector_id,
      '1.0.0' AS collector_version, 'controller-a' AS source_system,
      '00000000-0000-4000-8000-00000000000' || CASE WHEN event_id < half THEN '1' ELSE '2' END AS source_epoch,
      event_id AS source_sequence,
      'CTRL_A.ZONE[' || lpad((user_id % 12 + 1)::VARCHAR, 2, '0') || '].' ||
        CASE event_type WHEN 'click' THEN 'TEMP_PV' WHEN 'view' THEN 'RH_PV' WHEN 'purchase' THEN 'FAN_OUT'
                        WHEN 'signup' THEN 'TEMP_AUX_PV' ELSE 'DOOR_SW' END AS source_tag,
      CASE WHEN event_id % 97 = 1 THEN ts + INTERVAL 20 MINUTE
           WHEN event_id % 10 = 5 THEN ts + INTERVAL 2 MINUTE
           WHEN event_id % 10 = 0 THEN ts - INTERVAL 10 MINUTE ELSE ts END AS observed_at,
      value,
      CASE WHEN event_id % 20 = 7 THEN 'invalid-unit' WHEN event_type IN ('click', 'signup') THEN 'degC'
           ELSE '%' END AS raw_unit,
      CAST(CASE WHEN event_id % 13 = 0 THEN 0 ELSE 192 END AS BIGINT) AS source_quality_code,
      max(ts) OVER (PARTITION BY batch_no) + INTERVAL 5 SECOND + again * INTERVAL 1 DAY AS received_at
    FROM shipped, bounds
  )
),
manifest AS (
  SELECT batch_id, batch_no, facility_id, collector_id, received_at, min(observed_at) AS minimum_observed_at,
    max(observed_at) AS maximum_observed_at, count(*) AS observation_count,
    string_agg(lpad(source_sequence::VARCHAR, 12, '0'), ',' ORDER BY source_sequence) AS content,
    'raw-observations/batch=' || batch_id AS object_key,
    'sha256:' || sha256(string_agg(lpad(source_sequence::VARCHAR, 12, '0'), ',' ORDER BY source_sequence)) AS checksum
  FROM delivery GROUP BY ALL
),
attempt AS (
  SELECT batch_id || '/' || kind AS processing_attempt_id, batch_id, status, started_at,
    started_at + (batch_no % 7 + 1) * INTERVAL 250 MILLISECOND AS completed_at,
    CASE WHEN kind = 'done' THEN observation_count ELSE 0 END AS accepted_count,
    CASE WHEN kind = 'done' THEN 0 ELSE observation_count END AS duplicate_count, last_error
  FROM (
    SELECT *, received_at + INTERVAL 10 SECOND AS started_at, 'done' AS kind, 'COMPLETED' AS status, NULL AS last_error FROM manifest WHERE batch_no % 10 <> 4
    UNION ALL SELECT *, received_at + INTERVAL 1 SECOND, 'fail', 'FAILED', 'store unavailable' FROM manifest WHERE batch_no % 9 = 0
    UNION ALL SELECT *, received_at + INTERVAL 60 SECOND, 'again', 'COMPLETED', NULL FROM manifest WHERE batch_no % 8 = 0
    UNION ALL SELECT *, received_at + INTERVAL 30 SECOND, 'dead', 'TERMINAL', 'gave up' FROM manifest WHERE batch_no % 14 = 4
  )
),
spool AS (
  SELECT event_id AS id,
    CASE WHEN user_id % 2 = 0 THEN 'edge-0' ELSE 'edge-' || (user_id % 5)::VARCHAR END AS collector_id,
    ts AS persisted_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 60 SECOND END AS acknowledged_at
  FROM events
),
spool_item AS (
  SELECT 'out-' || (event_id // 500)::VARCHAR AS batch_id, event_id AS observation_id, event_id % 500 AS item_order
  FROM events WHERE event_id % 5 = 0
),
spool_level AS (
  SELECT 'edge-gateway-01' AS collector_id, event_id, ts, 50000 + (event_id * 7919) % 50001 AS rows FROM events
),
heartbeat AS (
  SELECT 'edge-' || user_id::VARCHAR AS collector_id, ts AS received_at, event_id AS beat,
    event_id % 1000 AS spool_observation_count, event_id % 600 AS oldest_unsent_observation_age_seconds,
    event_type <> 'error' AS source_connected FROM events
),
unsent AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'edge-0' ELSE 'edge-' || (user_id % 5)::VARCHAR END AS collector_id, ts AS persisted_at,
    CASE WHEN event_id % 4001 <> 4000 THEN ts + CASE WHEN event_id % 500 = 1 THEN 7200 ELSE event_id * 7919 % 1800 END * INTERVAL 1 SECOND END AS sent_at
  FROM events
),
outbox AS (
  SELECT received_at AS created_at, received_at + (batch_no * 7919 % 90) * INTERVAL 1 SECOND AS published_at FROM manifest
),
operation AS (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'upload' ELSE 'raw-store' END AS operation,
    make_timestamp(epoch_us(first_ts) + (epoch_us(ts) - epoch_us(first_ts)) // 60 + 250000) AS completed_at,
    CASE WHEN event_id % 5 = 3 AND event_id // 300 % 3 <> 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status
  FROM events, bounds
),
request AS (
  SELECT '00000000-0000-4000-9000-000000000001' AS replay_id, day0 + INTERVAL 10 DAY AS from_time,
    day0 + INTERVAL 11 DAY AS to_time, last_ts + INTERVAL 2 DAY + INTERVAL 1 MINUTE AS requested_at FROM bounds
  UNION ALL
  SELECT '00000000-0000-4000-9000-000000000002', day0 + INTERVAL 14 DAY, day0 + INTERVAL 15 DAY,
    last_ts + INTERVAL 2 DAY + INTERVAL 2 MINUTE FROM bounds
)
"""

DECIDE_SQL = r"""
mapped AS (
  SELECT *,
    CASE WHEN regexp_full_match(source_tag, 'CTRL_A\.ZONE\[(\d{2})\]\.TEMP_PV') THEN 'T'
         WHEN @mapping = '1.1.0' AND regexp_full_match(source_tag, 'CTRL_A\.ZONE\[(\d{2})\]\.TEMP_AUX_PV') THEN 'T'
         WHEN regexp_full_match(source_tag, 'CTRL_A\.ZONE\[(\d{2})\]\.RH_PV') THEN 'H'
         WHEN regexp_full_match(source_tag, 'CTRL_A\.ZONE\[(\d{2})\]\.FAN_OUT') THEN 'F' END AS rule
  FROM @input
),
tagged AS (
  SELECT *,
    CASE WHEN rule IS NOT NULL THEN 'zone-' || regexp_extract(source_tag, 'ZONE\[(\d{2})\]', 1) END AS asset_id,
    CASE rule WHEN 'T' THEN 'environment.air_temperature' WHEN 'H' THEN 'environment.relative_humidity'
              WHEN 'F' THEN 'ventilation.output' END AS signal_id,
    CASE WHEN rule = 'T' THEN 'degC' WHEN rule IS NOT NULL THEN '%' END AS expected_unit,
    CASE WHEN rule = 'T' THEN 'Cel' WHEN rule IS NOT NULL THEN '%' END AS unit,
    floor((epoch_us(observed_at) - epoch_us(processed_at)) / 1000000) AS ahead,
    floor((epoch_us(received_at) - epoch_us(observed_at)) / 1000000) AS late
  FROM mapped
),
evaluated AS (
  SELECT *,
    sha256(facility_id || chr(31) || source_system || chr(31) || source_epoch || chr(31) ||
           source_sequence::VARCHAR || chr(31) || source_tag) AS observation_id,
    CASE WHEN reason_code IS NOT NULL THEN '' ELSE concat_ws(',',
      CASE WHEN ahead > 5 THEN 'FUTURE_TIMESTAMP' END, CASE WHEN late > 300 THEN 'LATE_ARRIVAL' END) END AS base_flags,
    CASE WHEN reason_code IS NULL THEN CASE WHEN source_quality_code = 192 THEN 'GOOD' ELSE 'BAD' END END AS quality,
    CASE reason_code
      WHEN 'UNKNOWN_SOURCE_TAG' THEN 'No mapping rule recognizes the source tag'
      WHEN 'UNSUPPORTED_RAW_UNIT' THEN 'Expected source unit ' || expected_unit || ' but received ' || raw_unit
      WHEN 'VALUE_OUT_OF_RANGE' THEN 'The raw value is outside the configured physical range'
      WHEN 'TIMESTAMP_TOO_FAR_IN_FUTURE' THEN 'The source timestamp is too far in the future' END AS reason
  FROM (
    SELECT *,
      CASE WHEN rule IS NULL THEN 'UNKNOWN_SOURCE_TAG'
           WHEN raw_unit <> expected_unit THEN 'UNSUPPORTED_RAW_UNIT'
           WHEN value < CASE WHEN rule = 'T' THEN -40 ELSE 0 END
             OR value > CASE WHEN rule = 'T' THEN 125 ELSE 100 END THEN 'VALUE_OUT_OF_RANGE'
           WHEN ahead > 300 THEN 'TIMESTAMP_TOO_FAR_IN_FUTURE' END AS reason_code
    FROM tagged
  )
),
marked AS (
  SELECT *, reason_code IS NULL AND row_number() OVER (
      PARTITION BY observation_id, reason_code IS NULL ORDER BY received_at, batch_id, item_order) = 1
      AND observation_id NOT IN (SELECT observation_id FROM @known) AS is_canonical
  FROM evaluated
),
scanned AS (
  SELECT *,
    greatest(max(CASE WHEN is_canonical THEN source_sequence END) OVER prior, p.max_sequence) AS seen_sequence,
    greatest(max(CASE WHEN is_canonical THEN observed_at END) OVER prior, p.max_observed_at) AS seen_at
  FROM marked LEFT JOIN @positions p USING (facility_id, source_system, source_epoch, source_tag)
  WINDOW prior AS (PARTITION BY facility_id, source_system, source_epoch, source_tag
    ORDER BY received_at, batch_id, item_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
decided AS (
  SELECT *,
    CASE WHEN is_canonical AND out_of_order THEN concat_ws(',', nullif(base_flags, ''), 'OUT_OF_ORDER')
         ELSE base_flags END AS flags,
    CASE WHEN reason_code IS NOT NULL THEN 'REJECTED' WHEN NOT is_canonical THEN 'DUPLICATE'
         WHEN base_flags <> '' OR out_of_order THEN 'FLAGGED' ELSE 'ACCEPTED' END AS outcome
  FROM (
    SELECT *, reason_code IS NULL AND coalesce(source_sequence < seen_sequence, false)
           OR reason_code IS NULL AND coalesce(observed_at < seen_at, false) AS out_of_order
    FROM scanned
  )
),
canonical AS (SELECT * FROM decided WHERE outcome IN ('ACCEPTED', 'FLAGGED'))
"""

_NO_KNOWN = "(SELECT NULL::VARCHAR AS observation_id WHERE false)"
_NO_POSITIONS = (
    "(SELECT NULL::VARCHAR AS facility_id, NULL::VARCHAR AS source_system, NULL::VARCHAR AS source_epoch, "
    "NULL::VARCHAR AS source_tag, NULL::BIGINT AS max_sequence, NULL::TIMESTAMP AS max_observed_at WHERE false)"
)


_CHAIN = ("mapped", "tagged", "evaluated", "marked", "scanned", "decided", "canonical")


def decide_sql(suffix: str, mapping: str, source: str, known: str = _NO_KNOWN, positions: str = _NO_POSITIONS) -> str:
    """The decision steps over ``source``, each named with ``suffix``."""
    text = re.sub(rf"\b({'|'.join(_CHAIN)})\b", rf"\g<1>{suffix}", DECIDE_SQL)
    for mark, value in (("@mapping", f"'{mapping}'"), ("@input", source), ("@known", known), ("@positions", positions)):
        text = text.replace(mark, value)
    return text


def sql(tail: str, mapping: str = "1.0.0", extra: str = "") -> str:
    """``tail`` over the shared derivations; ``extra`` adds more named steps before it."""
    steps = [TABLES_SQL.rstrip(), decide_sql("", mapping, "delivery")] + ([extra] if extra else [])
    return ",".join(steps) + tail
