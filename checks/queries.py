"""Every operator as a query over the given tables, with its comparison SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import plain, sql
from sensorloom import schemas
from sensorloom.functions.identity import checksum, content_digest
from sensorloom.operators import aggregate, alerts, documents, evaluate, fleet, identity, order, query, series, validate, work
from sensorloom.operators.aggregate import COUNTS
from sensorloom.plans import job
from sensorloom.plans.accept import accept_batches
from sensorloom.plans.process import process_batches
from sensorloom.plans.replay import replay
from sensorloom.rules import MappingRule, MappingRules
from sensorloom.runtime import configure, materialize, scratch_path
from sensorloom.sources import canonical, history, raw
from sensorloom.sources.runs import RunStore
from sensorloom.streaming import absence, ingest, metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def _evaluated(spark, d, mapping=fx.MAPPING_0):
    return materialize(evaluate.evaluate_observations(fx.delivery(spark, d), mapping, fx.QUALITY), "evaluated")


def _accepted(spark, d, mapping=fx.MAPPING_0):
    return _evaluated(spark, d, mapping).where(identity.not_rejected())


def _outcomes(spark, d):
    return fx.stored(spark, d).outcomes


def _canonical(spark, d):
    return fx.stored(spark, d).canonical


def _now(spark, d):
    return F.lit(fx.bounds(spark, d)["last"])


_stores: dict[tuple, str] = {}


def _raw_store(spark, d) -> str:
    """Raw store holding all deliveries, written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        root = scratch_path(spark, "raw")
        raw.write_raw_batches(fx.raw_documents(spark, d), root)
        _stores[key] = root
    return _stores[key]


# ---------------------------------------------------------------- sources and sinks

_OBS = "batch_id, item_order, source_sequence, source_tag, observed_at, value, raw_unit, source_quality_code"


@register("raw_batch_scan", sql(f"SELECT {_OBS}, strftime(received_at, '%Y-%m-%d') AS date, strftime(received_at, '%H') AS hour FROM delivery"))
def raw_batch_scan(spark, d):
    batches = raw.scan_raw_batches(spark, _raw_store(spark, d), multiline=False)
    folders = batches.select(F.col("batchId").alias("batch_id"), "date", "hour")
    rows = evaluate.numeric_value(raw.explode_observations(batches))
    return rows.join(folders, "batch_id").select(*_OBS.split(", "), "date", "hour")


@register("explode_observations", sql(f"SELECT {_OBS} FROM delivery"))
def explode_observations(spark, d):
    rows = raw.explode_observations(fx.raw_documents(spark, d))
    # Item order is the position inside the array; re-delivered batches number theirs from zero too.
    typed = evaluate.numeric_value(rows)
    return typed.select(*_OBS.split(", "))


@register("object_digests", sql("SELECT batch_id, CASE WHEN batch_no % 33 = 0 THEN 'CHECKSUM_MISMATCH' END AS reason_code FROM manifest"))
def object_digests(spark, d):
    """Digests of all stored batches against those recorded before some of them were altered."""
    recorded = raw.scan_stored_batches(spark, _raw_store(spark, d))
    altered = F.substring("batchId", 25, 12).cast("long") % 33 == 0
    root = scratch_path(spark, "altered")
    raw.write_raw_batches(
        fx.raw_documents(spark, d).withColumn("collectorVersion", F.when(altered, F.lit("1.0.1")).otherwise(F.col("collectorVersion"))), root
    )
    verified = validate.verify_objects(raw.scan_stored_batches(spark, root), recorded)
    return verified.select(F.substring_index("object_key", "/batch=", -1).alias("batch_id"), "reason_code")


@register(
    "raw_batch_sink",
    sql("SELECT facility_id AS facility, strftime(received_at, '%Y-%m-%d') AS date, strftime(received_at, '%H') AS hour, "
        "collector_id AS collector, count(DISTINCT batch_id) AS batches, count(*) AS observations FROM delivery GROUP BY ALL"),
)
def raw_batch_sink(spark, d):
    root = scratch_path(spark, "sink")
    documents_ = fx.raw_documents(spark, d)
    raw.write_raw_batches(documents_, root)
    raw.write_raw_batches(documents_, root)  # a second delivery stores nothing
    return raw.scan_raw_batches(spark, root, multiline=False).groupBy("facility", "date", "hour", "collector").agg(
        F.count(F.lit(1)).alias("batches"), F.sum(F.size("observations")).alias("observations")
    )


@register(
    "canonical_sink",
    sql("SELECT strftime(observed_at, '%Y-%m-%d') AS observed_date, signal_id, count(*) AS samples, min(observed_at) AS first_at, "
        "max(observed_at) AS last_at FROM canonical GROUP BY ALL"),
)
def canonical_sink(spark, d):
    path = scratch_path(spark, "canonical")
    canonical.write_canonical(_canonical(spark, d), path)
    return (
        spark.read.parquet(path)
        .groupBy(F.date_format("observed_date", "yyyy-MM-dd").alias("observed_date"), "signal_id")
        .agg(F.count(F.lit(1)).alias("samples"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))
    )


@register(
    "rejection_sink",
    sql("SELECT batch_id, reason_code, count(*) AS rejections, min(processed_at) AS first_created_at FROM decided "
        "WHERE outcome = 'REJECTED' GROUP BY ALL"),
)
def rejection_sink(spark, d):
    path = scratch_path(spark, "rejections")
    canonical.write_rejections(fx.stored(spark, d).rejections, path)
    return canonical.quarantine_report(spark.read.parquet(path))


_FIRST_EPOCH = fx.EPOCH + "1"


@register(
    "cursor_read",
    sql("SELECT source_epoch, source_sequence, source_tag, value FROM delivery, (SELECT max(event_id) // 4 AS cursor FROM events) "
        "WHERE source_epoch LIKE '%1' AND source_sequence > cursor"),
)
def cursor_read(spark, d):
    live = fx.delivery(spark, d)
    cursor = fx.bounds(spark, d)["top"] // 4
    return history.read_after_cursor(live, _FIRST_EPOCH, cursor, limit=None).select(
        "source_epoch", "source_sequence", "source_tag", "value"
    )


def _by_day(spark, d) -> tuple[DataFrame, DataFrame]:
    """The stored samples in folders by event day, and the index of their sequences."""
    path, index = scratch_path(spark, "canonical"), scratch_path(spark, "days")
    canonical.write_canonical(_canonical(spark, d), path)
    history.day_index(_canonical(spark, d)).write.parquet(index)
    return spark.read.parquet(path), spark.read.parquet(index)


@register(
    "cursor_read_by_day",
    sql("SELECT source_sequence, observation_id, value FROM canonical, (SELECT max(event_id) // 3 AS cursor FROM events) "
        "WHERE source_epoch LIKE '%1' AND source_sequence > cursor"),
)
def cursor_read_by_day(spark, d):
    """Stored samples after a cursor, from the days that hold such sequences."""
    stored, index = _by_day(spark, d)
    cursor = fx.bounds(spark, d)["top"] // 3
    return history.read_after_cursor(stored, _FIRST_EPOCH, cursor, limit=None, index=index).select("source_sequence", "observation_id", "value")


@register(
    "known_ids_by_day",
    sql("SELECT DISTINCT observation_id FROM evaluated JOIN canonical USING (observation_id) WHERE evaluated.reason_code IS NULL AND evaluated.batch_no >= 1000000000"),
)
def known_ids_by_day(spark, d):
    """The ids of the re-deliveries that are stored already, looked up in the days of their sequences."""
    stored, index = _by_day(spark, d)
    again = _accepted(spark, d).where(fx.batch_number() >= 1_000_000_000)
    firsts = identity.first_arrivals(again, carry=(*schemas.SOURCE_KEY, "source_sequence"))
    return identity.known_ids(firsts, stored, fx.stored(spark, d).positions, index=index)


@register("cursor_after_epoch_change", sql("SELECT max(source_sequence) AS next_sequence FROM delivery WHERE source_epoch LIKE '%2'"))
def cursor_after_epoch_change(spark, d):
    live = fx.delivery(spark, d)
    page = history.read_after_cursor(live, _FIRST_EPOCH, fx.bounds(spark, d)["top"], limit=None, current_epoch=fx.EPOCH + "2")
    return history.next_cursor(page, 0)


# ---------------------------------------------------------------- validation


def _altered_envelopes(spark, d):
    n = F.substring("batchId", 25, 12).cast("long")
    pick = lambda by, is_, value, column: F.when(n % by == is_, F.lit(value)).otherwise(F.col(column))
    return (
        fx.raw_documents(spark, d)
        .withColumn("n", n)
        .withColumn("contractVersion", pick(17, 0, "raw-observation.batch.v2", "contractVersion"))
        .withColumn("collectorVersion", pick(29, 3, " \t", "collectorVersion"))
        .withColumn("facilityId", pick(31, 4, "-alpha", "facilityId"))
        .withColumn("collectorId", pick(23, 2, "edge gateway", "collectorId"))
        .withColumn("batchId", F.when(n % 19 == 1, F.concat(F.lit("zz"), F.col("batchId"))).otherwise(F.col("batchId")))
    )


@register(
    "batch_envelope_validation",
    sql("""SELECT n, CASE WHEN n % 17 = 0 THEN 'UNSUPPORTED_CONTRACT_VERSION'
      WHEN n % 19 = 1 OR n % 23 = 2 OR n % 29 = 3 OR n % 31 = 4 THEN 'INVALID_ENVELOPE'
      WHEN n_obs > 3 THEN 'INVALID_OBSERVATION_COUNT' END AS reason_code
    FROM (SELECT batch_no AS n, count(*) AS n_obs FROM delivery GROUP BY ALL)"""),
)
def batch_envelope_validation(spark, d):
    return validate.validate_batches(_altered_envelopes(spark, d), maximum=3).select("n", "reason_code")


@register(
    "batch_item_validation",
    sql("""SELECT batch_id, CASE WHEN max(CASE WHEN source_sequence % 37 IN (0, 1, 2) THEN 1 ELSE 0 END) = 1
      THEN 'INVALID_ENVELOPE' END AS reason_code FROM delivery GROUP BY ALL"""),
)
def batch_item_validation(spark, d):
    seq = F.col("source_sequence")
    flawed = (
        fx.delivery(spark, d)
        .withColumn("raw_value", F.parse_json(F.col("value").cast("string")))
        .withColumn("created_at", F.col("received_at"))
        .withColumn("source_tag", F.when(seq % 37 == 0, F.lit("  ")).otherwise(F.col("source_tag")))
        .withColumn("source_epoch", F.when(seq % 37 == 1, F.lit("1-1-1-1")).otherwise(F.col("source_epoch")))
        .withColumn("raw_unit", F.when(seq % 37 == 2, F.repeat(F.lit("u"), 33)).otherwise(F.col("raw_unit")))
    )
    batches = raw.assemble_batches(flawed)
    return validate.validate_batch_items(batches).select(F.col("batchId").alias("batch_id"), "reason_code")


@register("object_size_check", sql("SELECT batch_id, CASE WHEN batch_no % 13 = 0 THEN 'PAYLOAD_TOO_LARGE' END AS reason_code FROM manifest"))
def object_size_check(spark, d):
    """Lengths of all stored batches, some of which were padded beyond the limit set here."""
    padded = F.substring("batchId", 25, 12).cast("long") % 13 == 0
    root = scratch_path(spark, "padded")
    raw.write_raw_batches(
        fx.raw_documents(spark, d).withColumn("collectorVersion", F.when(padded, F.repeat(F.lit("9"), 20_000)).otherwise(F.col("collectorVersion"))), root
    )
    return validate.check_object_sizes(raw.scan_stored_batches(spark, root), max_decompressed=15_000).select("batch_id", "reason_code")


@register(
    "digest_verification",
    sql("""SELECT object_key, 'sha256:' || sha256(stored) AS checksum, checksum AS recorded_checksum,
      'sha-256=:' || base64(unhex(sha256(stored))) || ':' AS content_digest,
      CASE WHEN batch_no % 33 = 5 THEN 'CHECKSUM_MISMATCH' END AS reason_code
    FROM (SELECT *, CASE WHEN batch_no % 33 = 5 THEN content || '!' ELSE content END AS stored FROM manifest)"""),
)
def digest_verification(spark, d):
    manifests = fx.manifest(spark, d)
    damaged = F.when(fx.batch_number() % 33 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    stored = manifests.select("object_key", damaged.cast("binary").alias("content"))
    digests = stored.select("object_key", checksum(F.col("content")).alias("checksum"), content_digest(F.col("content")).alias("content_digest"))
    verified = validate.verify_objects(digests, manifests)
    return verified.join(digests.select("object_key", "content_digest"), "object_key")


@register(
    "field_limit_check",
    sql("""SELECT batch_id, item_order, CASE WHEN source_sequence % 41 IN (0, 1, 2, 3) THEN 'FIELD_TOO_LONG' END AS reason_code
    FROM delivery"""),
)
def field_limit_check(spark, d):
    seq = F.col("source_sequence")
    obs = (
        fx.delivery(spark, d)
        .withColumn("source_tag", F.when(seq % 41 == 0, F.repeat(F.lit("t"), 257)).when(seq % 41 == 1, F.lit("\t ")).otherwise(F.col("source_tag")))
        .withColumn("raw_unit", F.when(seq % 41 == 2, F.lit(None)).otherwise(F.col("raw_unit")))
        .withColumn("source_system", F.when(seq % 41 == 3, F.repeat(F.lit("\U0001F600"), 33)).otherwise(F.col("source_system")))
    )
    return validate.check_field_limits(obs).select("batch_id", "item_order", "reason_code")


@register(
    "interval_filter",
    sql("""SELECT observation_id, observed_at FROM canonical, bounds
    WHERE observed_at >= day0 + INTERVAL 3 DAY AND observed_at < day0 + INTERVAL 20 DAY"""),
)
def interval_filter(spark, d):
    path = scratch_path(spark, "canonical")
    canonical.write_canonical(_canonical(spark, d), path)
    day = fx.bounds(spark, d)["first"].replace(hour=0, minute=0, second=0, microsecond=0)
    return query.filter_interval(spark.read.parquet(path), day + timedelta(days=3), day + timedelta(days=20)).select(
        "observation_id", "observed_at"
    )


@register(
    "flag_and_tag_filters",
    sql("SELECT observation_id, source_tag, flags FROM canonical WHERE flags LIKE '%LATE_ARRIVAL%' AND source_tag LIKE '%.TEMP%'"),
)
def flag_and_tag_filters(spark, d):
    rows = query.tag_like(query.with_flag(_canonical(spark, d), "LATE_ARRIVAL"), "%.TEMP%")
    return rows.select("observation_id", "source_tag", "flags")


# ---------------------------------------------------------------- mapping and quality

_TAGS = "batch_id, item_order, source_tag, asset_id, signal_id, expected_unit, unit"


@register("tag_mapping", sql(f"SELECT {_TAGS} FROM tagged", mapping="1.1.0"))
def tag_mapping(spark, d):
    return evaluate.map_tags(fx.delivery(spark, d), fx.MAPPING_1).select(*_TAGS.split(", "))


@register("tag_mapping_by_distinct_tag", sql(f"SELECT {_TAGS} FROM tagged", mapping="1.1.0"))
def tag_mapping_by_distinct_tag(spark, d):
    return evaluate.map_tags(fx.delivery(spark, d), fx.MAPPING_1, strategy="distinct").select(*_TAGS.split(", "))


def _many_rules() -> MappingRules:
    """The built-in rules among thousands that other controllers need, some of which share their beginning or have none."""
    others = [
        MappingRule(rf"CTRL_{n}\.UNIT\[(?<zone>\d{{2}})\]\.TEMP_PV", "unit-${zone}", "environment.air_temperature", "degC", "Cel")
        for n in range(5000)
    ]
    late = [
        MappingRule(r"CTRL_A\.ZONE\[(?<zone>\d{2})\]\.[A-Z_]+_PV", "late-${zone}", "environment.air_temperature", "degF", "Cel"),
        MappingRule(r"(?:CTRL|PLC)_A\.ZONE\[(?<zone>\d{2})\]\.FAN_OUT", "loose-${zone}", "ventilation.output", "1", "%"),
    ]
    return MappingRules(fx.MAPPING_1.version, (*others[:2500], *fx.MAPPING_1.rules, *others[2500:], *late))


@register("tag_mapping_many_rules", sql(f"SELECT {_TAGS} FROM tagged", mapping="1.1.0"))
def tag_mapping_many_rules(spark, d):
    return evaluate.map_tags(fx.delivery(spark, d), _many_rules()).select(*_TAGS.split(", "))


@register("asset_template", sql("SELECT DISTINCT source_tag, 'zone-' || regexp_extract(source_tag, 'ZONE\\[(\\d{2})\\]', 1) AS asset_id FROM delivery"))
def asset_template(spark, d):
    pattern, template = r"CTRL_A\.ZONE\[(?<zone>\d{2})\]\.\w+_\w+", "zone-${zone}"
    tags = fx.delivery(spark, d).select("source_tag").distinct()
    return tags.withColumn("asset_id", evaluate.render_asset_id(F.col("source_tag"), pattern, template, 1))


@register(
    "numeric_check",
    sql("""SELECT batch_id, item_order,
      CASE WHEN source_sequence % 9 IN (2, 3, 4, 5) OR source_sequence % 9 = 7 THEN 'NON_NUMERIC_VALUE'
           WHEN source_sequence % 9 = 6 THEN 'NON_FINITE_VALUE' END AS reason_code,
      CASE source_sequence % 9 WHEN 2 THEN 'string' WHEN 3 THEN 'boolean' WHEN 4 THEN 'null' WHEN 5 THEN 'object'
           WHEN 7 THEN 'array' ELSE 'number' END AS value_type,
      CASE source_sequence % 9 WHEN 6 THEN NULL WHEN 1 THEN floor(value)
           WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE value END AS finite_value
    FROM delivery"""),
)
def numeric_check(spark, d):
    text, kind = F.col("value").cast("string"), F.col("source_sequence") % 9
    document = (
        F.when(kind == 1, F.floor("value").cast("string"))
        .when(kind == 2, F.concat(F.lit('"'), text, F.lit('"')))
        .when(kind == 3, F.lit("true"))
        .when(kind == 4, F.lit("null"))
        .when(kind == 5, F.concat(F.lit('{"v":'), text, F.lit("}")))
        .when(kind == 6, F.lit("1e999"))
        .when(kind == 7, F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
    )
    obs = fx.delivery(spark, d).withColumn("raw_value", F.parse_json(document)).drop("value", "value_type")
    typed = evaluate.numeric_value(obs)
    code = F.when(evaluate.non_numeric(), F.lit("NON_NUMERIC_VALUE")).when(evaluate.non_finite(), F.lit("NON_FINITE_VALUE"))
    return typed.select(
        "batch_id", "item_order", code.alias("reason_code"), "value_type",
        F.when(F.abs("value") < float("inf"), F.col("value")).alias("finite_value"),
    )


@register(
    "unit_check",
    sql("""SELECT batch_id, item_order, CASE WHEN raw_unit <> expected_unit THEN 'UNSUPPORTED_RAW_UNIT' END AS reason_code,
      CASE WHEN raw_unit <> expected_unit THEN 'Expected source unit ' || expected_unit || ' but received ' || raw_unit END AS reason
    FROM tagged"""),
)
def unit_check(spark, d):
    mapped = evaluate.map_tags(fx.delivery(spark, d), fx.MAPPING_0)
    wrong = evaluate.unsupported_unit() & F.col("signal_id").isNotNull()
    return mapped.select(
        "batch_id", "item_order", F.when(wrong, F.lit("UNSUPPORTED_RAW_UNIT")).alias("reason_code"),
        F.when(wrong, evaluate.unit_reason()).alias("reason"),
    )


@register(
    "range_check",
    sql("""SELECT batch_id, item_order, value, CASE WHEN rule IS NULL OR value < CASE WHEN rule = 'T' THEN -40 ELSE 0 END
      OR value > CASE WHEN rule = 'T' THEN 125 ELSE 100 END THEN 'VALUE_OUT_OF_RANGE' END AS reason_code FROM tagged"""),
)
def range_check(spark, d):
    mapped = evaluate.map_tags(fx.delivery(spark, d), fx.MAPPING_0)
    code = F.when(evaluate.out_of_range(fx.QUALITY), F.lit("VALUE_OUT_OF_RANGE"))
    return mapped.select("batch_id", "item_order", "value", code.alias("reason_code"))


@register(
    "future_check",
    sql("SELECT batch_id, item_order, CASE WHEN ahead > 300 THEN 'TIMESTAMP_TOO_FAR_IN_FUTURE' END AS reason_code FROM tagged"),
)
def future_check(spark, d):
    code = F.when(evaluate.too_far_in_future(fx.QUALITY), F.lit("TIMESTAMP_TOO_FAR_IN_FUTURE"))
    return fx.delivery(spark, d).select("batch_id", "item_order", code.alias("reason_code"))


@register(
    "quality_flags",
    sql("""SELECT batch_id, item_order, concat_ws(',', CASE WHEN ahead > 5 THEN 'FUTURE_TIMESTAMP' END,
      CASE WHEN late > 300 THEN 'LATE_ARRIVAL' END) AS flags FROM tagged"""),
)
def quality_flags(spark, d):
    return fx.delivery(spark, d).select("batch_id", "item_order", evaluate.quality_flags(fx.QUALITY).alias("flags"))


@register(
    "quality_label",
    sql("SELECT batch_id, item_order, CASE WHEN source_quality_code = 192 THEN 'GOOD' ELSE 'BAD' END AS quality FROM delivery"),
)
def quality_label(spark, d):
    return fx.delivery(spark, d).select("batch_id", "item_order", evaluate.quality_label(fx.QUALITY).alias("quality"))


_DECISION = "batch_id, item_order, observation_id, asset_id, signal_id, unit, reason_code, reason, quality"


@register(
    "evaluate_observations",
    sql(f"""SELECT {_DECISION}, base_flags AS flags, CASE WHEN reason_code IS NOT NULL THEN 'REJECTED'
      WHEN base_flags <> '' THEN 'FLAGGED' ELSE 'ACCEPTED' END AS outcome FROM evaluated""", mapping="1.1.0"),
)
def evaluate_observations(spark, d):
    decided = evaluate.evaluate_observations(fx.delivery(spark, d), fx.MAPPING_1, fx.QUALITY)
    return decided.select(*_DECISION.split(", "), "flags", "outcome")


# ---------------------------------------------------------------- identity and audit


@register("observation_identity", sql("SELECT batch_id, item_order, observation_id FROM evaluated"))
def observation_identity(spark, d):
    return evaluate.with_observation_id(fx.delivery(spark, d)).select("batch_id", "item_order", "observation_id")


@register(
    "dedup_first",
    sql("""SELECT batch_id, item_order, observation_id, is_canonical, CASE WHEN reason_code IS NOT NULL THEN 'REJECTED'
      WHEN NOT is_canonical THEN 'DUPLICATE' WHEN base_flags <> '' THEN 'FLAGGED' ELSE 'ACCEPTED' END AS outcome FROM marked"""),
)
def dedup_first(spark, d):
    return identity.dedup_first(_evaluated(spark, d)).select(
        "batch_id", "item_order", "observation_id", "is_canonical", "outcome"
    )


@register(
    "dedup_against_history",
    sql("""SELECT DISTINCT e.observation_id, e.observation_id IN (SELECT observation_id FROM canonical) AS known
    FROM evaluated1 e WHERE reason_code IS NULL""", extra=fx.decide_sql("1", "1.1.0", "delivery")),
)
def dedup_against_history(spark, d):
    firsts = identity.first_arrivals(_accepted(spark, d, fx.MAPPING_1))
    return identity.mark_known(firsts, _canonical(spark, d)).select("observation_id", "known")


@register(
    "identity_conflicts",
    sql("""SELECT s.observation_id, c.observed_at AS stored_observed_at, s.observed_at AS conflicting_observed_at,
      count(*) AS arrivals, 'IDENTITY_CONFLICT' AS reason_code
    FROM (SELECT observation_id, observed_at + CASE WHEN again = 1 AND source_sequence % 2 = 1 THEN 7 ELSE 0 END * INTERVAL 1 SECOND AS observed_at
          FROM evaluated WHERE reason_code IS NULL) s
    JOIN canonical c USING (observation_id) WHERE c.observed_at <> s.observed_at GROUP BY ALL"""),
)
def identity_conflicts(spark, d):
    moved = (fx.batch_number() >= 1_000_000_000) & (F.col("source_sequence") % 2 == 1)
    shifted = F.timestamp_micros(F.unix_micros("observed_at") + 7_000_000)
    accepted = _accepted(spark, d).withColumn("observed_at", F.when(moved, shifted).otherwise(F.col("observed_at")))
    return identity.identity_conflicts(accepted, _canonical(spark, d))


def _laid_out(spark, d) -> RunStore:
    """The stored identities and rejections as ledgers of one recorded run."""
    store = RunStore(spark, scratch_path(spark, "ledgers"), buckets=16)
    done = fx.stored(spark, d)
    store.write_ledger("first", "identities", done.canonical.select(*job.IDENTITY.names), job.BY_ID)
    store.write_ledger("first", "audit", identity.rejection_keys(done.rejections.where("substring(observation_id, 1, 1) < '6'")), identity.REJECTION_KEY)
    store.record("first", 0)
    return store


@register("identity_conflicts_by_bucket", ORACLES["identity_conflicts"])
def identity_conflicts_by_bucket(spark, d):
    moved = (fx.batch_number() >= 1_000_000_000) & (F.col("source_sequence") % 2 == 1)
    shifted = F.timestamp_micros(F.unix_micros("observed_at") + 7_000_000)
    accepted = _accepted(spark, d).withColumn("observed_at", F.when(moved, shifted).otherwise(F.col("observed_at")))
    store = _laid_out(spark, d)
    return identity.identity_conflicts(accepted, job.identities(store), align=store.aligned)


@register("dedup_against_buckets", ORACLES["dedup_against_history"])
def dedup_against_buckets(spark, d):
    firsts = identity.first_arrivals(_accepted(spark, d, fx.MAPPING_1))
    store = _laid_out(spark, d)
    return identity.mark_known(firsts, job.identities(store), store.aligned).select("observation_id", "known")


@register(
    "rejection_merge_by_bucket",
    sql("""SELECT observation_id, batch_id, reason_code FROM evaluated
    WHERE reason_code IS NOT NULL AND observation_id >= '6' GROUP BY ALL"""),
)
def rejection_merge_by_bucket(spark, d):
    """Three of eight rejections are recorded already, in an audit bucketed by its whole key."""
    store = _laid_out(spark, d)
    audit = store.read_ledger("audit", job.AUDIT, identity.REJECTION_KEY)
    return identity.merge_rejections(audit, fx.stored(spark, d).rejections, store.aligned).select("observation_id", "batch_id", "reason_code")


@register(
    "receipt_resolution",
    sql(""", receipt AS (
      SELECT batch_id, checksum, received_at, 0::BIGINT AS delivery_id FROM manifest
      UNION ALL SELECT batch_id, checksum, received_at, 1 FROM manifest WHERE batch_no % 7 = 0
      UNION ALL SELECT batch_id, 'sha256:other', received_at, 2 FROM manifest WHERE batch_no % 11 = 0
      UNION ALL SELECT batch_id, 'sha256:other', received_at, 3 FROM manifest WHERE batch_no % 22 = 0)
    SELECT batch_id, delivery_id, CASE WHEN delivery_id = 0 THEN 'ACCEPTED'
      WHEN checksum = first_value(checksum) OVER (PARTITION BY batch_id ORDER BY received_at, delivery_id) THEN 'ALREADY_ACCEPTED'
      ELSE 'BATCH_CHECKSUM_CONFLICT' END AS receipt FROM receipt"""),
)
def receipt_resolution(spark, d):
    base = fx.manifest(spark, d).select("batch_id", "checksum", "received_at", fx.batch_number().alias("n"))
    other = F.lit("sha256:other")
    deliveries = base.withColumn("delivery_id", F.lit(0))
    for i, by, content in ((1, 7, F.col("checksum")), (2, 11, other), (3, 22, other)):
        deliveries = deliveries.unionByName(
            base.where(F.col("n") % by == 0).withColumn("checksum", content).withColumn("delivery_id", F.lit(i))
        )
    return identity.resolve_receipts(deliveries).select("batch_id", "delivery_id", "receipt")


@register(
    "rejection_merge",
    sql("""SELECT observation_id, batch_id, reason_code, mapping_version, created_at FROM (
      SELECT observation_id, batch_id, reason_code, 'controller-a-mapping-1.1.0' AS mapping_version, processed_at AS created_at FROM evaluated1 WHERE reason_code IS NOT NULL)""",
        extra=fx.decide_sql("1", "1.1.0", "delivery")),
)
def rejection_merge(spark, d):
    existing = fx.stored(spark, d).rejections
    newer = process_batches(fx.delivery(spark, d), fx.MAPPING_1, fx.QUALITY).rejections
    # Everything arrives twice, together with rejections that are recorded already.
    offered = newer.unionByName(newer).unionByName(existing)
    merged = identity.merge_rejections(existing, offered)
    return merged.select("observation_id", "batch_id", "reason_code", "mapping_version", "created_at")


@register("duplicate_identities", sql("SELECT observation_id, count(*) AS copies FROM evaluated GROUP BY 1 HAVING count(*) > 1"))
def duplicate_identities(spark, d):
    return identity.duplicate_identities(_outcomes(spark, d))


@register(
    "duplicate_excess",
    sql("SELECT count(*) AS total_rows, count(DISTINCT observation_id) AS distinct_ids, count(*) - count(DISTINCT observation_id) AS excess_rows FROM evaluated"),
)
def duplicate_excess(spark, d):
    return identity.duplicate_excess(_outcomes(spark, d))


# ---------------------------------------------------------------- ordered scans


@register("out_of_order", sql("SELECT batch_id, item_order, observation_id, is_canonical, out_of_order, flags FROM decided WHERE reason_code IS NULL", mapping="1.1.0"))
def out_of_order(spark, d):
    marked = identity.mark_canonical(_accepted(spark, d, fx.MAPPING_1))
    return order.flag_out_of_order(marked).select(
        "batch_id", "item_order", "observation_id", "is_canonical", "out_of_order", "flags"
    )


@register(
    "backpressure_state",
    sql("""SELECT event_id, rows, coalesce(last_value(event IGNORE NULLS) OVER (ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS paused
    FROM (SELECT *, CASE WHEN rows >= 80000 OR rows + 500 > 100000 THEN true WHEN rows <= 60000 THEN false END AS event FROM spool_level)"""),
)
def backpressure_state(spark, d):
    states = order.hysteresis(fx.spool_level(spark, d), 100_000, order=["ts", "event_id"])
    return states.select("event_id", "rows", "paused")


@register(
    "source_gaps",
    sql("""SELECT source_system, source_epoch, cursor_sequence, earliest_sequence, latest_sequence FROM (
      SELECT source_system, '1' AS source_epoch, max(CASE WHEN event_id <= half THEN event_id END) - 10 AS cursor_sequence,
        min(CASE WHEN event_id > half THEN event_id END) AS earliest_sequence, max(event_id) AS latest_sequence
      FROM (SELECT *, 'controller-' || user_id::VARCHAR AS source_system FROM events), bounds GROUP BY ALL)
    WHERE cursor_sequence > 0 AND cursor_sequence < earliest_sequence - 1"""),
)
def source_gaps(spark, d):
    e = fx.events(spark, d).select(
        F.concat(F.lit("controller-"), F.col("user_id").cast("string")).alias("source_system"),
        F.lit("1").alias("source_epoch"), F.col("event_id").alias("source_sequence"),
    )
    half = fx.bounds(spark, d)["top"] // 2
    cursors = e.where(F.col("source_sequence") <= half).groupBy("source_system", "source_epoch").agg(
        (F.max("source_sequence") - 10).alias("cursor_sequence")
    )
    return order.detect_cursor_gap(cursors, e.where(F.col("source_sequence") > half))


@register(
    "alert_states",
    sql("""SELECT event_id, CASE WHEN active THEN since END AS active_since,
      CASE WHEN NOT active THEN 'inactive' WHEN epoch_us(ts) - epoch_us(since) >= 120000000 THEN 'firing' ELSE 'pending' END AS state
    FROM (SELECT *, min(CASE WHEN active THEN ts END) OVER (PARTITION BY island) AS since
      FROM (SELECT *, rows / 100000 >= 0.8 AS active, count(CASE WHEN NOT (rows / 100000 >= 0.8) THEN 1 END) OVER (ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM spool_level))"""),
)
def alert_states(spark, d):
    level = fx.spool_level(spark, d)
    alerts = order.alert_states(level, F.col("rows") / 100_000 >= 0.8, 120, order=["ts", "event_id"])
    return alerts.select("event_id", "active_since", "state")


@register(
    "batch_assignment",
    sql("""SELECT id, collector_id, batch_ordinal, item_order, count(*) OVER batch >= 50
        OR first_value(persisted_at) OVER (batch ORDER BY id) + INTERVAL 86400 SECOND < last_ts AS ready
    FROM (SELECT *, rn // 50 AS batch_ordinal, rn % 50 AS item_order FROM (
      SELECT *, row_number() OVER (PARTITION BY collector_id ORDER BY id) - 1 AS rn FROM spool
      WHERE acknowledged_at IS NULL AND id NOT IN (SELECT observation_id FROM spool_item))), bounds
    WINDOW batch AS (PARTITION BY collector_id, batch_ordinal)"""),
)
def batch_assignment(spark, d):
    rows = work.unbatched(fx.spool(spark, d), fx.spool_items(spark, d))
    assigned = order.assign_batches(rows, _now(spark, d), size=50, max_age_seconds=86_400)
    return assigned.select("id", "collector_id", "batch_ordinal", "item_order", "ready")


# ---------------------------------------------------------------- joins


def _objects(spark, d):
    manifests = fx.manifest(spark, d)
    n = fx.batch_number()
    orphan = F.concat(F.lit("raw-observations/orphan="), "batch_id").alias("object_key")
    return manifests.where(n % 50 != 0).select("object_key").unionByName(manifests.where(n % 60 == 0).select(orphan))


_DIFF = """(SELECT object_key, 'MISSING' AS state FROM manifest WHERE batch_no % 50 = 0
  UNION ALL SELECT 'raw-observations/orphan=' || batch_id, 'ORPHAN' FROM manifest WHERE batch_no % 60 = 0)"""


@register("reconciliation", sql(f"SELECT * FROM {_DIFF}"))
def reconciliation(spark, d):
    return work.reconcile_objects(_objects(spark, d), fx.manifest(spark, d))


@register(
    "reconcile_store",
    sql("""SELECT 'facility=' || facility_id || '/date=' || strftime(received_at, '%Y-%m-%d') || '/hour=' || strftime(received_at, '%H') ||
      '/collector=' || collector_id || '/batch=' || batch_id AS object_key, CASE WHEN batch_no % 50 = 0 THEN 'MISSING' ELSE 'ORPHAN' END AS state
    FROM manifest WHERE (batch_no % 50 = 0) <> (batch_no % 60 = 0)"""),
)
def reconcile_store(spark, d):
    """Batches in the raw store against manifests by the key both have; some of either are missing."""
    n = F.substring("batchId", 25, 12).cast("long")
    root = scratch_path(spark, "partial")
    raw.write_raw_batches(fx.raw_documents(spark, d).where(n % 50 != 0), root)
    manifests = fx.manifest(spark, d).where(fx.batch_number() % 60 != 0).withColumn(
        "object_key", raw.object_key(F.col("facility_id"), F.col("received_at"), F.col("collector_id"), F.col("batch_id"))
    )
    return work.reconcile_objects(raw.scan_stored_batches(spark, root), manifests)


@register(
    "cursor_state",
    sql("""SELECT source_epoch, min(source_sequence) AS earliest_sequence, max(source_sequence) AS latest_sequence,
      min(source_sequence) - 1 > any_value(half) // 4 AS expired FROM delivery, bounds WHERE source_epoch LIKE '%1' AND source_sequence > half // 2 GROUP BY 1"""),
)
def cursor_state(spark, d):
    """A cursor that fell behind what the source still retains."""
    half = fx.bounds(spark, d)["top"] // 2
    retained = fx.delivery(spark, d).where(F.col("source_sequence") > half // 2)
    return history.cursor_state(retained, _FIRST_EPOCH, half // 4)


@register(
    "reconciliation_summary",
    sql(f"""SELECT count(CASE WHEN state = 'ORPHAN' THEN 1 END) AS orphan_objects,
      count(CASE WHEN state = 'MISSING' THEN 1 END) AS missing_objects, count(*) = 0 AS healthy FROM {_DIFF}"""),
)
def reconciliation_summary(spark, d):
    return work.reconciliation_summary(work.reconcile_objects(_objects(spark, d), fx.manifest(spark, d)))


_OVERLAP = "manifest JOIN request ON minimum_observed_at < to_time AND maximum_observed_at >= from_time"


@register(
    "replay_selection_many",
    sql("""SELECT 'replay-' || event_id::VARCHAR AS replay_id, batch_id, received_at FROM manifest JOIN events
      ON minimum_observed_at < ts + INTERVAL 300 SECOND AND maximum_observed_at >= ts - INTERVAL 300 SECOND"""),
)
def replay_selection_many(spark, d):
    """A request around every event: batches and requests meet in time bins."""
    known = fx.manifest(spark, d).select("batch_id", "facility_id", "received_at", "minimum_observed_at", "maximum_observed_at")
    manifests = materialize(known, "manifests")  # a stored table, as which they are read; what made them goes
    return work.overlapping_batches(manifests, fx.many_requests(spark, d)).select("replay_id", "batch_id", "received_at")


@register("replay_selection", sql(f"SELECT replay_id, batch_id, received_at FROM {_OVERLAP}"))
def replay_selection(spark, d):
    return work.select_replay_batches(fx.manifest(spark, d), fx.replay_requests(spark, d))


def _replay_tables(spark, d):
    requests = fx.replay_requests(spark, d)
    manifests = fx.manifest(spark, d)
    n = fx.batch_number()
    zero = F.lit(0).cast("long")
    runs = work.replay_runs(spark, requests).select(
        "*",
        F.when(F.col("replay_id").endswith("1"), F.lit("RUNNING")).otherwise(F.lit("PENDING")).alias("status"),
        *[zero.alias(c) for c in ("processed_observation_count", *COUNTS)],
    )
    done = n % 3 == 0
    failed = F.col("replay_id").endswith("2") & (n % 5 == 1)
    batches = work.select_replay_batches(manifests, requests).select(
        "replay_id", "batch_id",
        F.when(done, F.lit("COMPLETED")).when(failed, F.lit("FAILED")).otherwise(F.lit("PENDING")).alias("status"),
        F.when(done, F.lit(4)).otherwise(F.lit(0)).cast("long").alias("processed_observation_count"),
        F.when(done, n % 4).otherwise(zero).alias("accepted_count"),
        zero.alias("flagged_count"),
        zero.alias("rejected_count"),
        F.when(done, 4 - n % 4).otherwise(zero).alias("duplicate_count"),
    )
    return runs, batches, manifests


_REPLAY_BATCH = f""", replay_batch AS (SELECT replay_id, batch_id, batch_no, received_at, requested_at, object_key, checksum,
    CASE WHEN batch_no % 3 = 0 THEN 'COMPLETED' WHEN replay_id LIKE '%2' AND batch_no % 5 = 1 THEN 'FAILED' ELSE 'PENDING' END AS status
  FROM {_OVERLAP})"""


@register(
    "replay_worklist",
    sql(_REPLAY_BATCH + " SELECT replay_id, batch_id, requested_at, received_at, object_key, checksum FROM replay_batch WHERE status = 'PENDING'"),
)
def replay_worklist(spark, d):
    runs, batches, manifests = _replay_tables(spark, d)
    return work.replay_worklist(batches, runs, manifests).select(
        "replay_id", "batch_id", "requested_at", "received_at", "object_key", "checksum"
    )


@register(
    "unbatched_rows",
    sql("SELECT id, collector_id FROM spool WHERE acknowledged_at IS NULL AND id NOT IN (SELECT observation_id FROM spool_item)"),
)
def unbatched_rows(spark, d):
    return work.unbatched(fx.spool(spark, d), fx.spool_items(spark, d)).select("id", "collector_id")


@register(
    "acknowledge",
    sql("""SELECT id, collector_id, coalesce(CASE WHEN i.observation_id IS NOT NULL THEN last_ts END, acknowledged_at) AS acknowledged_at
    FROM spool LEFT JOIN (SELECT observation_id FROM spool_item WHERE (observation_id // 500) % 2 = 0) i ON i.observation_id = id, bounds"""),
)
def acknowledge(spark, d):
    items = fx.spool_items(spark, d)
    even = F.split("batch_id", "-")[1].cast("long") % 2 == 0
    acked = items.where(even).select("batch_id").distinct().withColumn("acknowledged_at", _now(spark, d))
    return work.acknowledge(fx.spool(spark, d), items, acked).select("id", "collector_id", "acknowledged_at")


# ---------------------------------------------------------------- aggregations


@register(
    "batch_manifest",
    sql("""SELECT batch_id, facility_id, collector_id, received_at, minimum_observed_at, maximum_observed_at, observation_count,
      object_key, checksum, 'RECEIVED' AS processing_status FROM manifest"""),
)
def batch_manifest(spark, d):
    digests = fx.manifest(spark, d).select("batch_id", "object_key", "checksum")
    return aggregate.build_manifests(fx.raw_documents(spark, d), digests).select(
        "batch_id", "facility_id", "collector_id", "received_at", "minimum_observed_at", "maximum_observed_at",
        "observation_count", "object_key", "checksum", "processing_status",
    )


_COUNTS_SQL = """count(CASE WHEN outcome = 'ACCEPTED' THEN 1 END) AS accepted_count,
  count(CASE WHEN outcome = 'FLAGGED' THEN 1 END) AS flagged_count, count(CASE WHEN outcome = 'REJECTED' THEN 1 END) AS rejected_count,
  count(CASE WHEN outcome = 'DUPLICATE' THEN 1 END) AS duplicate_count, count(*) AS total_count"""


@register("batch_outcome_counts", sql(f"SELECT batch_id, {_COUNTS_SQL} FROM decided GROUP BY 1"))
def batch_outcome_counts(spark, d):
    return aggregate.batch_outcome_counts(_outcomes(spark, d)).drop("replay_id")


@register(
    "out_of_order_counts",
    sql("""SELECT count(CASE WHEN out_of_order THEN 1 END) AS out_of_order_arrivals,
      count(CASE WHEN is_canonical AND out_of_order THEN 1 END) AS out_of_order_samples FROM decided"""),
)
def out_of_order_counts(spark, d):
    return aggregate.out_of_order_counts(_outcomes(spark, d))


@register(
    "replay_rollup",
    sql(_REPLAY_BATCH + """ SELECT replay_id, CAST(4 * count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS BIGINT) AS processed_observation_count,
      CAST(sum(CASE WHEN status = 'COMPLETED' THEN batch_no % 4 ELSE 0 END) AS BIGINT) AS accepted_count,
      CAST(sum(CASE WHEN status = 'COMPLETED' THEN 4 - batch_no % 4 ELSE 0 END) AS BIGINT) AS duplicate_count,
      count(CASE WHEN status <> 'COMPLETED' THEN 1 END) AS remaining_batches,
      CASE WHEN count(CASE WHEN status = 'FAILED' THEN 1 END) > 0 THEN 'FAILED'
           WHEN count(CASE WHEN status <> 'COMPLETED' THEN 1 END) = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS status
    FROM replay_batch GROUP BY 1"""),
)
def replay_rollup(spark, d):
    runs, batches, _ = _replay_tables(spark, d)
    return aggregate.rollup_replays(runs, batches).select(
        "replay_id", "processed_observation_count", "accepted_count", "duplicate_count", "remaining_batches", "status"
    )


@register(
    "batch_status",
    sql("""SELECT m.batch_id,
      CASE WHEN count(CASE WHEN status = 'COMPLETED' THEN 1 END) > 0 THEN 'PROCESSED'
           WHEN count(CASE WHEN status = 'TERMINAL' THEN 1 END) > 0 THEN 'FAILED' ELSE 'RECEIVED' END AS processing_status,
      count(CASE WHEN status <> 'TERMINAL' THEN 1 END) AS processing_attempt_count,
      coalesce(arg_min(accepted_count, completed_at) FILTER (WHERE status = 'COMPLETED'), 0) AS accepted_count,
      coalesce(arg_min(duplicate_count, completed_at) FILTER (WHERE status = 'COMPLETED'), 0) AS duplicate_count,
      nullif(CASE WHEN count(CASE WHEN status = 'COMPLETED' THEN 1 END) > 0
        THEN arg_max(coalesce(last_error, ''), completed_at) FILTER (WHERE status <> 'TERMINAL')
        ELSE arg_max(coalesce(last_error, ''), completed_at) END, '') AS last_error
    FROM manifest m LEFT JOIN attempt a ON a.batch_id = m.batch_id GROUP BY 1"""),
)
def batch_status(spark, d):
    return aggregate.fold_batch_status(fx.manifest(spark, d), fx.attempts(spark, d)).select(
        "batch_id", "processing_status", "processing_attempt_count", "accepted_count", "duplicate_count", "last_error"
    )


@register("outcome_balance", sql("SELECT count(*) AS observations, count(outcome) AS outcomes, true AS balanced FROM decided"))
def outcome_balance(spark, d):
    return aggregate.outcome_balance(fx.processed_manifest(spark, d))


def _bucket(column: str, seconds: int) -> str:
    return f"make_timestamp((epoch_us({column}) // {seconds}000000) * {seconds}000000)"


for _name, _text, _seconds in (("1m", "1 minute", 60), ("5m", "5 minutes", 300), ("30m", "30 minutes", 1800)):

    def _rates(spark, d, _text=_text):
        return aggregate.outcome_rates(_outcomes(spark, d), _text, ("outcome", "reason_code"))

    register(
        f"outcome_rates_{_name}",
        sql(f"SELECT {_bucket('processed_at', _seconds)} AS window_start, outcome, reason_code, count(*) AS observations, "
            f"count(*) / {_seconds}.0::DOUBLE AS per_second FROM decided GROUP BY 1, 2, 3"),
    )(_rates)


@register(
    "outcome_rates_sliding",
    sql(f"""SELECT {_bucket('processed_at', 300)} - k * INTERVAL 5 MINUTE AS window_start, outcome, count(*) AS observations,
      count(*) / 1800.0::DOUBLE AS per_second FROM decided, (SELECT unnest(range(6)) AS k) GROUP BY 1, 2"""),
)
def outcome_rates_sliding(spark, d):
    return aggregate.outcome_rates(_outcomes(spark, d), "30 minutes", slide="5 minutes")


@register(
    "out_of_order_rates",
    sql(f"""SELECT {_bucket('processed_at', 1800)} AS window_start, out_of_order, count(*) AS observations,
      count(*) / 1800.0::DOUBLE AS per_second FROM decided GROUP BY 1, 2"""),
)
def out_of_order_rates(spark, d):
    return aggregate.outcome_rates(_outcomes(spark, d), "30 minutes", ("out_of_order",))


@register(
    "rejection_ratio",
    sql(f"""SELECT window_start, rejected, observations, rejected / observations::DOUBLE AS ratio, rejected / observations::DOUBLE > 0.05 AS spike
    FROM (SELECT {_bucket('processed_at', 300)} AS window_start, count(CASE WHEN outcome = 'REJECTED' THEN 1 END) AS rejected,
      count(*) AS observations FROM decided GROUP BY 1)"""),
)
def rejection_ratio(spark, d):
    return aggregate.rejection_ratio(_outcomes(spark, d), "5 minutes")


def _alert_sql(series: str, condition: str, name: str, severity: str, seconds: int, columns: str) -> str:
    """A five-minute window that counted nothing has a ratio or number of zero, which ends the condition."""
    return sql(f""", series AS ({series}),
    whole AS (SELECT make_timestamp(t) AS window_start, s.* EXCLUDE (window_start), s.window_start IS NOT NULL AS counted
      FROM (SELECT unnest(range(min(epoch_us(window_start)), max(epoch_us(window_start)) + 1, 300000000)) AS t FROM series) LEFT JOIN series s
      ON epoch_us(s.window_start) = t),
    held AS (SELECT *, counted AND {condition} AS active, count(CASE WHEN NOT (counted AND {condition}) THEN 1 END) OVER (ORDER BY window_start
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM whole),
    dated AS (SELECT * FROM (SELECT *, min(CASE WHEN active THEN window_start END) OVER (PARTITION BY island) AS since FROM held) WHERE counted)
    SELECT '{name}' AS alert, '{severity}' AS severity, {columns}, CASE WHEN active THEN since END AS active_since,
      CASE WHEN NOT active THEN 'inactive' WHEN epoch_us(window_start) - epoch_us(since) >= {seconds}000000 THEN 'firing'
        ELSE 'pending' END AS state FROM dated""")


@register(
    "rejection_spike_alert",
    _alert_sql(
        f"SELECT {_bucket('processed_at', 300)} AS window_start, count(CASE WHEN outcome = 'REJECTED' THEN 1 END) AS rejected, "
        "count(*) AS observations FROM decided GROUP BY 1",
        "rejected / observations > 0.05", "RejectionSpike", "warning", 300, "window_start, rejected, observations",
    ),
)
def rejection_spike_alert(spark, d):
    ratio = aggregate.rejection_ratio(_outcomes(spark, d), "5 minutes")
    return alerts.evaluate_alert(ratio, "RejectionSpike").drop("ratio", "spike")


@register(
    "stage_failure_alert",
    _alert_sql(
        f"SELECT {_bucket('completed_at', 300)} AS window_start, count(CASE WHEN status <> 'COMPLETED' THEN 1 END) AS failures "
        "FROM attempt GROUP BY 1",
        "failures > 3", "DatabaseWritesFailing", "critical", 60, "window_start, failures",
    ),
)
def stage_failure_alert(spark, d):
    stats = aggregate.stage_stats(fx.attempts(spark, d), "5 minutes").select("window_start", "failures")
    return alerts.evaluate_alert(stats, "DatabaseWritesFailing")


# Gauges sampled once a minute over all days that have events.
_STEP = 60
_SAMPLES = f"""sample AS (SELECT make_timestamp(t) AS sampled_at FROM (SELECT unnest(range(epoch_us(date_trunc('day', first_ts)),
  epoch_us(date_trunc('day', last_ts) + INTERVAL 1 DAY), {_STEP}000000)) AS t FROM bounds))"""


def _pending_sql(rows: str, opened: str, closed: str, keys: str = "") -> str:
    """Pending rows and oldest age by a range join of every sample with the rows open at it."""
    k, on = (f"{keys}, ", f"g.{keys} = r.{keys} AND ") if keys else ("", "")
    grid = f"(SELECT {k}sampled_at FROM sample" + (f", (SELECT DISTINCT {keys} FROM {rows}))" if keys else ")")
    return f"""SELECT {f'g.{keys}, ' if keys else ''}g.sampled_at, count(r.opened) AS pending,
      coalesce(max((epoch_us(g.sampled_at) - epoch_us(r.opened)) // 1000000), 0)::BIGINT AS oldest_age_seconds
      FROM {grid} g LEFT JOIN (SELECT {k}{opened} AS opened, coalesce({closed}, TIMESTAMP '2100-01-01') AS closed FROM {rows}) r
      ON {on}r.opened <= g.sampled_at AND r.closed > g.sampled_at GROUP BY ALL"""


def _sampled_sql(series: str, condition: str, name: str, columns: str, keys: str = "") -> str:
    """Alert states over a series without gaps."""
    rule = alerts.ALERTS[name]
    part = f"PARTITION BY {keys} " if keys else ""
    return sql(f"""SELECT '{name}' AS alert, '{rule.severity}' AS severity, {columns}, CASE WHEN active THEN since END AS active_since,
      CASE WHEN NOT active THEN 'inactive' WHEN epoch_us(sampled_at) - epoch_us(since) >= {rule.for_seconds}000000 THEN 'firing' ELSE 'pending' END AS state
      FROM (SELECT *, min(CASE WHEN active THEN sampled_at END) OVER (PARTITION BY {f'{keys}, ' if keys else ''}island) AS since FROM
        (SELECT *, count(CASE WHEN NOT active THEN 1 END) OVER ({part}ORDER BY sampled_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM
          (SELECT *, coalesce({condition}, false) AS active FROM gauge)))""", extra=f"{_SAMPLES}, gauge AS ({series})")


def _over(spark, d) -> tuple:
    """The sampled days and the step."""
    b = fx.bounds(spark, d)
    midnight = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    return F.lit(midnight(b["first"])), F.lit(midnight(b["last"]) + timedelta(days=1)), _STEP


def _sampled_alert(gauge: DataFrame, name: str, keys: list[str] = []) -> DataFrame:
    return alerts.evaluate_alert(gauge, name, keys, [series.AT], _STEP)


_EDGE_SQL = _pending_sql("unsent", "persisted_at", "sent_at", "collector_id")


@register("pending_series", sql(f"SELECT *, pending / 20 AS utilization_ratio FROM gauge", extra=f"{_SAMPLES}, gauge AS ({_EDGE_SQL})"))
def pending_series(spark, d):
    return series.pending_series(fx.unsent(spark, d), "persisted_at", "sent_at", *_over(spark, d), ["collector_id"], capacity=20)


@register(
    "spool_backlog_alert",
    _sampled_sql(_EDGE_SQL, "pending / 20 >= 0.8", "CollectorSpoolBacklog", "collector_id, sampled_at, pending", "collector_id"),
)
def spool_backlog_alert(spark, d):
    gauge = series.pending_series(fx.unsent(spark, d), "persisted_at", "sent_at", *_over(spark, d), ["collector_id"], capacity=20)
    return _sampled_alert(gauge, "CollectorSpoolBacklog", ["collector_id"]).drop("utilization_ratio", "oldest_age_seconds")


_REPORTED_SQL = """SELECT b.collector_id, sampled_at, arg_max(age, (received_at, beat)) AS oldest_age_seconds FROM sample s
  JOIN (SELECT 'edge-' || (user_id % 3)::VARCHAR AS collector_id, ts AS received_at, event_id AS beat, event_id % 600 AS age FROM events) b
  ON b.received_at <= s.sampled_at AND b.received_at >= s.sampled_at - INTERVAL 1 HOUR GROUP BY ALL"""
_OLD_EDGE = _sampled_sql(_EDGE_SQL, "oldest_age_seconds > 300", "CollectorOldUnsentData", "'spool' AS branch, collector_id, sampled_at, oldest_age_seconds", "collector_id")
_OLD_REPORTED = _sampled_sql(
    f"SELECT collector_id, sampled_at, oldest_age_seconds FROM (SELECT * FROM sample, (SELECT DISTINCT 'edge-' || (user_id % 3)::VARCHAR AS collector_id FROM events)) LEFT JOIN ({_REPORTED_SQL}) USING (collector_id, sampled_at)",
    "oldest_age_seconds > 300", "CollectorOldUnsentData", "'heartbeat' AS branch, collector_id, sampled_at, oldest_age_seconds", "collector_id",
)


@register("old_unsent_data_alert", f"SELECT * FROM ({_OLD_EDGE}) UNION ALL SELECT * FROM ({_OLD_REPORTED})")
def old_unsent_data_alert(spark, d):
    """Both branches of the rule: the age in the collector's own store, and the age its heartbeats report, while they are an hour old at most."""
    over = _over(spark, d)
    own = series.pending_series(fx.unsent(spark, d), "persisted_at", "sent_at", *over, ["collector_id"]).drop("pending")
    beats = fx.heartbeats(spark, d).withColumn(
        "collector_id", F.concat(F.lit("edge-"), (F.substring_index("collector_id", "-", -1).cast("long") % 3).cast("string"))
    )
    reported = series.level_series(
        beats, "received_at", "oldest_unsent_observation_age_seconds", *over, ["collector_id"], stale_seconds=3600, tie_break=("beat",)
    ).withColumnRenamed("oldest_unsent_observation_age_seconds", "oldest_age_seconds")
    alert = lambda gauge, branch: _sampled_alert(gauge, "CollectorOldUnsentData", ["collector_id"]).withColumn("branch", F.lit(branch))
    return alert(own, "spool").unionByName(alert(reported, "heartbeat"))


@register(
    "collector_offline_alert",
    _sampled_sql(
        """SELECT sampled_at, ((epoch_us(sampled_at) - epoch_us(received_at)) // 1000000)::BIGINT AS heartbeat_age_seconds
          FROM sample ASOF LEFT JOIN (SELECT DISTINCT received_at FROM heartbeat) ON sampled_at >= received_at""",
        "heartbeat_age_seconds > 90", "CollectorOffline", "sampled_at, heartbeat_age_seconds",
    ),
)
def collector_offline_alert(spark, d):
    age = series.age_series(fx.heartbeats(spark, d), "received_at", *_over(spark, d))
    return _sampled_alert(age.withColumnRenamed("age_seconds", "heartbeat_age_seconds"), "CollectorOffline")


@register(
    "outbox_backlog_alert",
    _sampled_sql(_pending_sql("outbox", "created_at", "published_at"), "pending > 10 OR oldest_age_seconds > 30",
                 "TransactionalOutboxBacklog", "sampled_at, pending, oldest_age_seconds"),
)
def outbox_backlog_alert(spark, d):
    gauge = series.pending_series(fx.outbox(spark, d), "created_at", "published_at", *_over(spark, d))
    return _sampled_alert(gauge, "TransactionalOutboxBacklog")


def _failures_sql(name: str, operation: str) -> str:
    rule = alerts.ALERTS[name]
    return _alert_sql(
        f"SELECT {_bucket('completed_at', 300)} AS window_start, count(CASE WHEN status <> 'COMPLETED' THEN 1 END) AS failures "
        f"FROM operation WHERE operation = '{operation}' GROUP BY 1", "failures > 3", name, rule.severity, rule.for_seconds, "window_start, failures",
    )


def _failures_alert(spark, d, name: str, operation: str):
    stats = aggregate.stage_stats(fx.operations(spark, d).where(F.col("operation") == operation), "5 minutes").select("window_start", "failures")
    return alerts.evaluate_alert(stats, name)


@register("upload_failures_alert", _failures_sql("CollectorUploadFailures", "upload"))
def upload_failures_alert(spark, d):
    return _failures_alert(spark, d, "CollectorUploadFailures", "upload")


@register("raw_store_failures_alert", _failures_sql("RawStoreOperationsFailing", "raw-store"))
def raw_store_failures_alert(spark, d):
    return _failures_alert(spark, d, "RawStoreOperationsFailing", "raw-store")


_B = aggregate.LAG_BOUNDS
_LE = ", ".join(f"count(CASE WHEN lag_ms <= {b}000 THEN 1 END) AS le_{b}" for b in _B)
_P99 = " ".join(
    f"WHEN le_{hi} >= samples * 0.99::DOUBLE THEN {lo}.0::DOUBLE + {hi - lo}.0::DOUBLE * "
    f"((samples * 0.99::DOUBLE - {f'le_{lo}' if lo else 0}) / (le_{hi} - {f'le_{lo}' if lo else 0}))"
    for lo, hi in zip([0, *_B], _B)
)


@register(
    "lag_summary",
    sql(f"""SELECT window_start, samples, total / 1000::DOUBLE / samples AS mean_seconds, {', '.join(f'le_{b}' for b in _B)},
      CASE {_P99} ELSE 300.0::DOUBLE END AS p99_seconds, le_30 / samples::DOUBLE AS share_within_objective
    FROM (SELECT {_bucket('processed_at', 86400)} AS window_start, count(*) AS samples, sum(lag_ms)::BIGINT AS total, {_LE}
      FROM (SELECT processed_at, (epoch_us(processed_at) - epoch_us(observed_at)) // 1000 AS lag_ms FROM canonical
        WHERE quality = 'GOOD' AND observed_at <= processed_at) GROUP BY 1)"""),
)
def lag_summary(spark, d):
    return aggregate.lag_summary(_canonical(spark, d), "1 day")


@register(
    "processing_lag_alert",
    _alert_sql(
        f"""SELECT window_start, samples, CASE {_P99} ELSE 300.0::DOUBLE END AS p99_seconds
        FROM (SELECT {_bucket('processed_at', 300)} AS window_start, count(*) AS samples, {_LE}
          FROM (SELECT processed_at, (epoch_us(processed_at) - epoch_us(observed_at)) // 1000 AS lag_ms FROM canonical
            WHERE quality = 'GOOD' AND observed_at <= processed_at) GROUP BY 1)""",
        "p99_seconds > 30", "ProcessingLagHigh", "warning", 300, "window_start, samples, p99_seconds",
    ),
)
def processing_lag_alert(spark, d):
    lag = aggregate.lag_summary(_canonical(spark, d), "5 minutes").select("window_start", "samples", "p99_seconds")
    return alerts.evaluate_alert(lag, "ProcessingLagHigh")


@register(
    "lag_sketch",
    sql(f"""SELECT {_bucket('processed_at', 21600)} - k * INTERVAL 6 HOUR AS window_start, count(*) AS samples, true AS p50_within, true AS p99_within
    FROM canonical, (SELECT unnest(range(4)) AS k) WHERE quality = 'GOOD' AND observed_at <= processed_at GROUP BY 1"""),
)
def lag_sketch(spark, d):
    """Sliding days from sketches of six hours: whether the exact ranks of the sketched percentiles are within three times the stated error."""
    samples = _canonical(spark, d)
    panes = materialize(aggregate.lag_sketches(samples, "6 hours"), "panes")
    found = materialize(aggregate.sketched_percentiles(panes, "1 day", "6 hours"), "percentiles")
    fresh = samples.where("quality = 'GOOD' and observed_at <= processed_at").select(
        F.window("processed_at", "1 day", "6 hours")["start"].alias("window_start"),
        (F.floor((F.unix_micros("processed_at") - F.unix_micros("observed_at")) / F.lit(1000)) / 1000).alias("lag"),
    )
    error = 3 * aggregate.rank_error()

    def within(q: float, column: str):
        below, upto = (F.count_if(c) / F.count("*") for c in (F.col("lag") < F.col(column), F.col("lag") <= F.col(column)))
        return (below <= q + error) & (upto >= q - error)

    return fresh.join(found, "window_start").groupBy("window_start", "samples").agg(
        within(0.5, "p50_seconds").alias("p50_within"), within(0.99, "p99_seconds").alias("p99_within")
    )


@register(
    "lag_percentiles",
    sql(f"""SELECT {_bucket('processed_at', 86400)} AS window_start, round(quantile_cont(lag_ms, 0.5) / 1000, 3) AS p50_seconds, round(quantile_cont(lag_ms, 0.99) / 1000, 3) AS p99_seconds
    FROM (SELECT processed_at, ((epoch_us(processed_at) - epoch_us(observed_at)) // 1000)::DOUBLE AS lag_ms FROM canonical
      WHERE quality = 'GOOD' AND observed_at <= processed_at) GROUP BY 1"""),
)
def lag_percentiles(spark, d):
    return aggregate.lag_percentiles(_canonical(spark, d), "1 day")


@register(
    "ingestion_rates",
    sql(f"""SELECT {_bucket('received_at', 300)} AS window_start, collector_id, count(*) AS observations, count(*) / 300.0::DOUBLE AS per_second
    FROM delivery GROUP BY 1, 2"""),
)
def ingestion_rates(spark, d):
    return aggregate.outcome_rates(fx.delivery(spark, d), "5 minutes", ("collector_id",), ts="received_at")


@register(
    "ingestion_results",
    sql(f"""SELECT {_bucket('received_at', 1800)} AS window_start, receipt, count(*) AS observations, count(*) / 1800.0::DOUBLE AS per_second
    FROM (SELECT received_at, CASE WHEN k = 0 THEN 'ACCEPTED' WHEN k = 1 THEN 'ALREADY_ACCEPTED' ELSE 'BATCH_CHECKSUM_CONFLICT' END AS receipt
      FROM manifest, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR k = 1 AND batch_no % 7 = 0 OR k = 2 AND batch_no % 11 = 0) GROUP BY 1, 2"""),
)
def ingestion_results(spark, d):
    """Accepted, duplicate and conflicting deliveries over time."""
    base = fx.manifest(spark, d).select("batch_id", "checksum", "received_at", fx.batch_number().alias("n"))
    deliveries = base.withColumn("delivery_id", F.lit(0))
    for k, by, content in ((1, 7, F.col("checksum")), (2, 11, F.lit("sha256:other"))):
        deliveries = deliveries.unionByName(base.where(F.col("n") % by == 0).withColumn("checksum", content).withColumn("delivery_id", F.lit(k)))
    return aggregate.outcome_rates(identity.resolve_receipts(deliveries), "30 minutes", ("receipt",), ts="received_at")


@register(
    "receipts_with_orphans",
    sql("""SELECT batch_id, CASE WHEN batch_no % 60 = 0 THEN 'ACCEPTED' WHEN batch_no % 60 = 1 THEN 'BATCH_CHECKSUM_CONFLICT' ELSE 'ACCEPTED' END AS receipt,
      CASE WHEN batch_no % 60 = 0 THEN 'left/' || batch_id END AS reused_object_key FROM manifest"""),
)
def receipts_with_orphans(spark, d):
    """Objects that an acceptance left without a manifest: equal ones are used again, others conflict."""
    base = fx.manifest(spark, d).select("batch_id", "checksum", "received_at", F.lit(0).alias("delivery_id"))
    left = fx.batch_number() % 60
    stored = base.where(left <= 1).select(
        "batch_id", F.concat(F.lit("left/"), "batch_id").alias("object_key"), F.when(left == 0, F.col("checksum")).otherwise(F.lit("sha256:x")).alias("checksum")
    )
    return identity.resolve_receipts(base, stored=stored).select("batch_id", "receipt", "reused_object_key")


@register(
    "fleet_gauges",
    sql(""", latest AS (SELECT * FROM heartbeat QUALIFY row_number() OVER (PARTITION BY collector_id ORDER BY received_at DESC, beat DESC) = 1)
    SELECT greatest(floor((epoch_us(any_value(last_ts)) + 45500000 - epoch_us(max(received_at))) / 1000000), 0)::DOUBLE AS heartbeat_age_seconds,
      sum(spool_observation_count)::BIGINT AS spool_observations, max(oldest_unsent_observation_age_seconds) AS oldest_unsent_age_seconds
    FROM latest, bounds"""),
)
def fleet_gauges(spark, d):
    now = F.timestamp_micros(F.unix_micros(_now(spark, d)) + 45_500_000)
    return fleet.fleet_gauges(fleet.latest_heartbeats(fx.heartbeats(spark, d), ("beat",)), now)


@register(
    "pending_gauges",
    sql("""SELECT count(CASE WHEN acknowledged_at IS NULL THEN 1 END) AS pending,
      greatest(floor((epoch_us(any_value(last_ts)) - epoch_us(min(CASE WHEN acknowledged_at IS NULL THEN persisted_at END))) / 1000000), 0)::BIGINT AS oldest_age_seconds,
      count(CASE WHEN acknowledged_at IS NULL THEN 1 END) / 100000::DOUBLE AS utilization_ratio FROM spool, bounds"""),
)
def pending_gauges(spark, d):
    return aggregate.pending_gauges(
        fx.spool(spark, d), F.col("acknowledged_at").isNull(), "persisted_at", _now(spark, d), capacity=100_000
    )


@register("count_by_reason_and_quality", sql("SELECT outcome, reason_code, quality, count(*) AS row_count FROM decided GROUP BY 1, 2, 3"))
def count_by_reason_and_quality(spark, d):
    return aggregate.count_by(_outcomes(spark, d), "outcome", "reason_code", "quality")


@register(
    "stage_stats",
    sql(f"""SELECT window_start, attempts, successes, failures, micros / 1000000::DOUBLE / attempts AS mean_seconds,
      successes / 300.0::DOUBLE AS successes_per_second, failures / 300.0::DOUBLE AS failures_per_second, failures > 3 AS failing
    FROM (SELECT {_bucket('completed_at', 300)} AS window_start, count(*) AS attempts,
      sum(epoch_us(completed_at) - epoch_us(started_at))::BIGINT AS micros, count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS successes,
      count(CASE WHEN status <> 'COMPLETED' THEN 1 END) AS failures FROM attempt GROUP BY 1)"""),
)
def stage_stats(spark, d):
    return aggregate.stage_stats(fx.attempts(spark, d), "5 minutes")


# ---------------------------------------------------------------- queries and pages

_SAMPLE = "observation_id, asset_id, signal_id, observed_at, received_at, processed_at, value, unit, quality, flags, source_sequence"


@register(
    "telemetry_query",
    sql(f"""SELECT {_SAMPLE} FROM canonical WHERE signal_id = 'environment.air_temperature' AND quality = 'GOOD' AND flags = ''"""),
)
def telemetry_query(spark, d):
    b = fx.bounds(spark, d)
    return query.query_telemetry(
        _canonical(spark, d), "facility-alpha", b["first"] - timedelta(days=1), b["last"] + timedelta(days=1),
        signal="environment.air_temperature", include_flagged=False, include_bad_quality=False,
        maximum_range=timedelta(days=366),
    ).select(*_SAMPLE.split(", "))


@register(
    "telemetry_page",
    sql(f"""SELECT {_SAMPLE} FROM canonical, bounds WHERE observed_at >= day0 + INTERVAL 5 DAY AND observed_at < day0 + INTERVAL 6 DAY
    ORDER BY observed_at, observation_id LIMIT 10 OFFSET 10"""),
)
def telemetry_page(spark, d):
    day = fx.bounds(spark, d)["first"].replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=5)
    page = lambda cursor: query.telemetry_page(
        _canonical(spark, d), "facility-alpha", day, day + timedelta(days=1), page_size=10, cursor=cursor
    )
    _, following = page(None)
    second, _ = page(following)
    return second.select(*_SAMPLE.split(", "))


@register(
    "due_work",
    sql("""SELECT event_id AS item_id, ts AS created_at FROM events, bounds WHERE event_id % 4 IN (1, 3)
    AND ts + (event_id % 50) * INTERVAL 1 DAY <= last_ts"""),
)
def due_work(spark, d):
    state = F.element_at(F.array(*[F.lit(s) for s in ("UPLOADING", "READY", "ACKNOWLEDGED", "FAILED")]), (F.col("event_id") % 4 + 1).cast("int"))
    items = fx.events(spark, d).select(
        F.col("event_id").alias("item_id"), F.col("ts").alias("created_at"), state.alias("state"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 50) * 86_400_000_000).alias("next_attempt_at"),
    )
    return work.due_items(items, ["READY", "FAILED"], _now(spark, d)).select("item_id", "created_at")


@register("recent_batches", sql("SELECT batch_id, received_at FROM manifest ORDER BY received_at DESC, batch_id LIMIT 20"))
def recent_batches(spark, d):
    return query.recent_batches(fx.manifest(spark, d), 20).select("batch_id", "received_at")


@register(
    "failed_batches",
    sql("""SELECT batch_id, received_at FROM manifest m WHERE batch_no % 14 = 4 AND NOT EXISTS (
      SELECT 1 FROM attempt a WHERE a.batch_id = m.batch_id AND status = 'COMPLETED')"""),
)
def failed_batches(spark, d):
    folded = aggregate.fold_batch_status(fx.manifest(spark, d), fx.attempts(spark, d))
    return query.failed_batches(folded).select("batch_id", "received_at")


@register(
    "retention",
    sql("SELECT id, acknowledged_at FROM spool, bounds WHERE acknowledged_at IS NULL OR acknowledged_at >= last_ts - INTERVAL 7 DAY"),
)
def retention(spark, d):
    cutoff = F.lit(fx.bounds(spark, d)["last"] - timedelta(days=7))
    return work.prune(fx.spool(spark, d), "acknowledged_at", cutoff).select("id", "acknowledged_at")


# ---------------------------------------------------------------- documents and inspection


@register(
    "canonical_document",
    sql("""SELECT 'telemetry.sample.v1' AS contract, observation_id, asset_id, value::VARCHAR IS NOT NULL AS has_value, source_tag,
      source_sequence::VARCHAR AS source_sequence, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS observed_at FROM canonical"""),
)
def canonical_document(spark, d):
    # one parse for all fields of a document, one for those of its source
    fields = ["contractVersion", "observationId", "assetId", "value", "observedAt", "source"]
    read = documents.documents_as_json(_canonical(spark, d)).select(F.json_tuple("json", *fields).alias(*fields))
    return read.select(
        F.col("contractVersion").alias("contract"), F.col("observationId").alias("observation_id"),
        F.col("assetId").alias("asset_id"), F.col("value").isNotNull().alias("has_value"),
        F.json_tuple("source", "sourceTag", "sourceSequence").alias("source_tag", "source_sequence"),
        F.col("observedAt").alias("observed_at"),
    )


@register(
    "batch_inspection",
    sql("""SELECT batch_id, 'manifest' AS section, received_at AS at, observation_count AS n, NULL AS code FROM manifest
    UNION ALL SELECT batch_id, 'attempt', processed_at, count(*), 'COMPLETED' FROM decided GROUP BY batch_id, processed_at
    UNION ALL SELECT batch_id, 'rejection', processed_at, NULL, reason_code FROM decided WHERE outcome = 'REJECTED'"""),
)
def batch_inspection(spark, d):
    done = fx.stored(spark, d)
    lines = documents.inspect_batches(fx.processed_manifest(spark, d), done.attempts, done.rejections)
    field = lambda path: F.get_json_object("detail", path)
    return lines.select(
        "batch_id", "section", "at",
        F.coalesce(field("$.observation_count"), field("$.total_count")).cast("long").alias("n"),
        F.coalesce(field("$.reason_code"), field("$.status")).alias("code"),
    )


@register(
    "replay_inspection",
    sql(_REPLAY_BATCH + """ SELECT replay_id, 'run' AS section, NULL AS batch_id, CASE WHEN replay_id LIKE '%1' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM request
    UNION ALL SELECT replay_id, 'batch', batch_id, status FROM replay_batch"""),
)
def replay_inspection(spark, d):
    runs, batches, _ = _replay_tables(spark, d)
    return documents.inspect_replays(runs, batches).select(
        "replay_id", "section", "batch_id", F.get_json_object("detail", "$.status").alias("status")
    )


# ---------------------------------------------------------------- fleet

_FLEET = """, latest AS (SELECT * FROM heartbeat QUALIFY row_number() OVER (PARTITION BY collector_id ORDER BY received_at DESC, beat DESC) = 1)
SELECT collector_id, received_at AS last_heartbeat, spool_observation_count, oldest_unsent_observation_age_seconds, source_connected, {status} AS current_status FROM latest, bounds"""
_LIVE = "CASE WHEN source_connected THEN 'ONLINE' ELSE 'SOURCE_DISCONNECTED' END"


@register("latest_heartbeats", sql(_FLEET.format(status=_LIVE)))
def latest_heartbeats(spark, d):
    return fleet.latest_heartbeats(fx.heartbeats(spark, d), ("beat",))


@register("collector_inventory", sql(_FLEET.format(status=f"CASE WHEN received_at < last_ts - INTERVAL 2 HOUR - INTERVAL 90 SECOND THEN 'OFFLINE' ELSE {_LIVE} END")))
def collector_inventory(spark, d):
    now = F.lit(fx.bounds(spark, d)["last"] - timedelta(hours=2))
    return fleet.collector_inventory(fleet.latest_heartbeats(fx.heartbeats(spark, d), ("beat",)), now)


# ---------------------------------------------------------------- whole jobs

_RESULT = "batch_id, item_order, observation_id, asset_id, signal_id, unit, quality, flags, outcome, reason_code, reason, out_of_order"


@register("process_batches", sql(f"SELECT {_RESULT} FROM decided", mapping="1.1.0"))
def process_batches_(spark, d):
    return process_batches(fx.delivery(spark, d), fx.MAPPING_1, fx.QUALITY).outcomes.select(*_RESULT.split(", "))


@register("process_attempts", sql(f"SELECT batch_id, processed_at AS started_at, 'COMPLETED' AS status, {_COUNTS_SQL} FROM decided GROUP BY 1, 2", mapping="1.1.0"))
def process_attempts(spark, d):
    done = process_batches(fx.delivery(spark, d), fx.MAPPING_1, fx.QUALITY)
    return done.attempts.select("batch_id", "started_at", "status", *COUNTS, "total_count")


@register("process_twice", sql(f"SELECT batch_id, item_order, CASE WHEN reason_code IS NULL THEN 'DUPLICATE' ELSE 'REJECTED' END AS outcome FROM evaluated"))
def process_twice(spark, d):
    again = process_batches(fx.delivery(spark, d), fx.MAPPING_0, fx.QUALITY, canonical_prior=_canonical(spark, d))
    return again.outcomes.select("batch_id", "item_order", "outcome")


_REPEATED = "repeated AS (SELECT * FROM delivery UNION ALL SELECT * FROM delivery WHERE batch_no % 40 = 7)"
_REPEATED_SQL = f"{_REPEATED},{fx.decide_sql('3', '1.1.0', 'repeated')}"


class _Killed(RunStore):
    """Loses its job after the first output of a run."""

    def write(self, run, name, rows, day=None, order=()):
        super().write(run, name, rows, day, order)
        raise InterruptedError(name)


@register(
    "process_rerun",
    sql(f"""SELECT 'canonical' AS part, batch_id, observation_id, flags AS detail FROM canonical
      UNION ALL SELECT DISTINCT 'rejection', batch_id, observation_id, reason_code FROM evaluated WHERE reason_code IS NOT NULL
      UNION ALL SELECT 'attempt', batch_id, NULL, concat_ws('/', accepted_count, flagged_count, rejected_count, duplicate_count)
      FROM (SELECT batch_id, {_COUNTS_SQL} FROM decided GROUP BY 1)""", mapping="1.1.0"),
)
def process_rerun(spark, d):
    """Two runs, the second killed after its first output, run again and then called once more: the same as one run."""
    store, b = RunStore(spark, scratch_path(spark, "runs"), buckets=16), fx.bounds(spark, d)
    middle = F.lit(b["first"] + (b["last"] - b["first"]) / 2)
    run = lambda s, name, rows: job.process_run(s, name, rows, fx.MAPPING_1, fx.QUALITY)
    early, late = (fx.delivery(spark, d).where(c) for c in (F.col("received_at") < middle, F.col("received_at") >= middle))
    run(store, "early", early)
    try:
        run(_Killed(spark, store.root, store.buckets), "late", late)
    except InterruptedError:
        run(store, "late", late)
    run(store, "early", early)
    run(store, "late", late)
    counts = F.concat_ws("/", *[F.col(c).cast("string") for c in COUNTS])
    return (
        job.canonical(store).select(F.lit("canonical").alias("part"), F.col("raw_batch_id").alias("batch_id"), "observation_id", F.array_join("flags", ",").alias("detail"))
    ).unionByName(
        job.rejections(store).select(F.lit("rejection").alias("part"), "batch_id", "observation_id", F.col("reason_code").alias("detail"))
    ).unionByName(
        job.attempts(store).select(F.lit("attempt").alias("part"), "batch_id", F.lit(None).cast("string").alias("observation_id"), counts.alias("detail"))
    )


def _repeated(spark, d):
    """All deliveries, some batches of them read twice in one run."""
    once = fx.delivery(spark, d)
    return once.unionByName(once.where(fx.batch_number() % 40 == 7))


@register("process_repeated_batches", sql(f"SELECT {_RESULT} FROM decided3", extra=_REPEATED_SQL))
def process_repeated_batches(spark, d):
    return process_batches(_repeated(spark, d), fx.MAPPING_1, fx.QUALITY).outcomes.select(*_RESULT.split(", "))


@register("dedup_repeated_batches", sql("SELECT observation_id, count(*) AS arrivals, count(CASE WHEN is_canonical THEN 1 END) AS canonical_rows "
                                        "FROM decided3 WHERE reason_code IS NULL GROUP BY 1", extra=_REPEATED_SQL))
def dedup_repeated_batches(spark, d):
    evaluated = evaluate.evaluate_observations(_repeated(spark, d), fx.MAPPING_1, fx.QUALITY)
    settled = identity.dedup_first(evaluated).where(identity.not_rejected())
    return settled.groupBy("observation_id").agg(
        F.count(F.lit(1)).alias("arrivals"), F.count_if("is_canonical").alias("canonical_rows")
    )


@register("process_rejections", sql("SELECT observation_id, batch_id, reason_code, reason FROM evaluated3 WHERE reason_code IS NOT NULL GROUP BY ALL", extra=_REPEATED_SQL))
def process_rejections(spark, d):
    """A rejection is recorded once, however often its batch was read."""
    return process_batches(_repeated(spark, d), fx.MAPPING_1, fx.QUALITY).rejections.select(
        "observation_id", "batch_id", "reason_code", "reason"
    )


_BROKEN = """CASE WHEN batch_no % 31 = 4 THEN 'Raw object checksum verification failed'
  WHEN batch_no % 33 = 0 OR batch_no % 39 = 3 OR batch_no % 41 = 5 THEN 'Stored raw batch violates the worker envelope limits'
  WHEN batch_no % 35 = 1 THEN 'Batch manifest is missing: ' || batch_id
  WHEN batch_no % 37 = 2 THEN 'Stored raw batch holds an observation without event time' END"""


@register(
    "process_failures",
    sql(f"""SELECT batch_id, 'FAILED' AS status, any_value(error) AS last_error, 0::BIGINT AS total_count
      FROM (SELECT *, {_BROKEN} AS error FROM delivery) WHERE error IS NOT NULL GROUP BY 1
    UNION ALL SELECT batch_id, 'COMPLETED', NULL, count(*) FROM decided4 GROUP BY 1""",
        extra=f"sound AS (SELECT * FROM delivery WHERE {_BROKEN} IS NULL),{fx.decide_sql('4', '1.1.0', 'sound')}"),
)
def process_failures(spark, d):
    """Changed bytes, unreadable documents, a foreign version, too many observations, missing manifests and missing times fail their batch only."""
    n = fx.batch_number()
    rows = fx.delivery(spark, d)
    unreadable = n % 33 == 0
    damaged = rows.where(~unreadable | (F.col("item_order") == 0)).withColumns(
        {
            "item_order": F.when(~unreadable, F.col("item_order")),
            "source_sequence": F.when(~unreadable, F.col("source_sequence")),
            "observed_at": F.when(~(unreadable | (n % 35 != 1) & (n % 37 == 2) & (F.col("item_order") == 0)), F.col("observed_at")),
            "contract_version": F.concat(F.lit("raw-observation.batch.v"), F.when(n % 39 == 3, F.lit("9")).otherwise(F.lit("1"))),
            "item_count": F.when(n % 41 == 5, F.lit(501)).otherwise(F.lit(4)),
        }
    )
    manifests = fx.manifest(spark, d).where((n % 35 != 1) | (n % 31 == 4)).select("batch_id", "received_at", "checksum")
    digests = manifests.select("batch_id", F.when(n % 31 == 4, F.lit("sha256:changed")).otherwise(F.col("checksum")).alias("checksum"))
    done = process_batches(damaged, fx.MAPPING_1, fx.QUALITY, manifests=manifests, digests=digests)
    return done.attempts.select("batch_id", "status", "last_error", "total_count")


@register(
    "accept_batches",
    sql(""", delivered AS (
      SELECT batch_id, batch_no, checksum, received_at, observation_count, 0 AS k FROM manifest
      UNION ALL SELECT batch_id, batch_no, checksum, received_at + INTERVAL 1 SECOND, observation_count, 1 FROM manifest WHERE batch_no % 7 = 0
      UNION ALL SELECT batch_id, batch_no, 'sha256:other', received_at + INTERVAL 2 SECOND, observation_count, 2 FROM manifest WHERE batch_no % 11 = 0),
    valid AS (SELECT *, batch_no % 21 = 0 AND k = 0 AS refused FROM delivered)
    SELECT batch_id, k::BIGINT AS k, CASE WHEN refused THEN 'UNSUPPORTED_CONTRACT_VERSION' WHEN n = 1 THEN 'ACCEPTED'
      WHEN checksum = first_sum THEN 'ALREADY_ACCEPTED' ELSE 'BATCH_CHECKSUM_CONFLICT' END AS receipt,
      CASE WHEN NOT refused AND n = 1 THEN observation_count END AS manifest_count
    FROM (SELECT *, row_number() OVER w AS n, first_value(checksum) OVER w AS first_sum FROM valid
      WINDOW w AS (PARTITION BY batch_id, refused ORDER BY k))"""),
)
def accept_batches_(spark, d):
    keys = fx.manifest(spark, d).select(F.col("batch_id").alias("batchId"), "object_key", "checksum")
    base = fx.raw_documents(spark, d).join(keys, "batchId").withColumn("n", F.substring("batchId", 25, 12).cast("long"))
    delivered = base.withColumn("k", F.lit(0))
    for k, by, content in ((1, 7, F.col("checksum")), (2, 11, F.lit("sha256:other"))):
        again = base.where(F.col("n") % by == 0).withColumn("checksum", content).withColumn("k", F.lit(k))
        delivered = delivered.unionByName(
            again.withColumn("received_at", F.timestamp_micros(F.unix_micros("received_at") + k * 1_000_000))
        )
    refused = (F.col("n") % 21 == 0) & (F.col("k") == 0)
    delivered = delivered.withColumn(
        "contractVersion", F.when(refused, F.lit("raw-observation.batch.v2")).otherwise(F.col("contractVersion"))
    ).withColumn("delivery_id", F.concat_ws("/", "batchId", "k")).drop("n")
    done = accept_batches(delivered)
    counts = done.manifests.select("batch_id", F.lit("ACCEPTED").alias("receipt"), F.col("observation_count").alias("manifest_count"))
    return done.receipts.join(counts, ["batch_id", "receipt"], "left").select(
        "batch_id", F.element_at(F.split("delivery_id", "/"), -1).cast("long").alias("k"), "receipt", "manifest_count"
    )


_REPLAY_SQL = """
replayed AS (
  SELECT d.* REPLACE (last_ts + INTERVAL 2 DAY AS processed_at)
  FROM delivery d, bounds, (SELECT * FROM request WHERE replay_id LIKE '%1') r
  WHERE d.batch_id IN (SELECT batch_id FROM manifest, request WHERE replay_id LIKE '%1' AND minimum_observed_at < to_time AND maximum_observed_at >= from_time)
    AND observed_at >= from_time AND observed_at < to_time
),
positions AS (
  SELECT facility_id, source_system, source_epoch, source_tag, max(source_sequence) AS max_sequence, max(observed_at) AS max_observed_at
  FROM canonical GROUP BY ALL
),
""" + fx.decide_sql("2", "1.1.0", "replayed", "canonical", "positions")


@register("replay", sql(f"SELECT {_RESULT} FROM decided2", extra=_REPLAY_SQL))
def replay_(spark, d):
    return _replayed(spark, d).result.outcomes.select(*_RESULT.split(", "))


@register(
    "replay_outcome_rates",
    sql(f"SELECT {_bucket('processed_at', 300)} AS window_start, outcome, count(*) AS observations, count(*) / 300.0::DOUBLE AS per_second "
        "FROM decided2 GROUP BY 1, 2", extra=_REPLAY_SQL),
)
def replay_outcome_rates(spark, d):
    return aggregate.outcome_rates(_replayed(spark, d).result.outcomes, "5 minutes")


@register("replay_from_store", sql(f"SELECT {_RESULT} FROM decided2", extra=_REPLAY_SQL))
def replay_from_store(spark, d):
    """The same replay, reading only the selected batches of the raw store."""
    root = _raw_store(spark, d)
    read = lambda selected: raw.explode_observations(raw.scan_selected_batches(spark, root, selected, multiline=False))
    at = F.lit(fx.bounds(spark, d)["last"] + timedelta(days=2))
    done = replay(fx.replay_requests(spark, d)[0], fx.manifest(spark, d), read, _canonical(spark, d), at, fx.stored(spark, d).positions)
    return done.result.outcomes.select(*_RESULT.split(", "))


@register(
    "replay_run",
    sql(f"""SELECT r.replay_id, 'COMPLETED' AS status, (SELECT count(*) FROM {_OVERLAP} WHERE replay_id LIKE '%1') AS matching_batch_count,
      count(*) AS processed_observation_count, {_COUNTS_SQL.rsplit(',', 1)[0]} FROM decided2, request r WHERE r.replay_id LIKE '%1' GROUP BY 1""", extra=_REPLAY_SQL),
)
def replay_run(spark, d):
    return _replayed(spark, d).runs.select(
        "replay_id", "status", "matching_batch_count", "processed_observation_count", *COUNTS
    )


_REPLAY_STATES = f"""SELECT o.batch_id, CASE WHEN n.batch_no % 11 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
      CASE WHEN n.batch_no % 11 = 0 THEN 'Stored raw object is missing' END AS last_error,
      CASE WHEN n.batch_no % 11 = 0 THEN 0 ELSE coalesce(c.total, 0) END AS total_count, n.batch_no % 4 + 1 AS attempt_number
    FROM (SELECT * FROM {_OVERLAP} WHERE replay_id LIKE '%1') o JOIN manifest n ON n.batch_id = o.batch_id
    LEFT JOIN (SELECT batch_id, count(*) AS total FROM replayed GROUP BY 1) c ON c.batch_id = o.batch_id"""


def _replayed_with_gaps(spark, d):
    """One day again, with some objects missing in the store and batches that were attempted before."""
    at = F.lit(fx.bounds(spark, d)["last"] + timedelta(days=2))
    manifests = fx.manifest(spark, d).withColumn("processing_attempt_count", fx.batch_number() % 4)
    stored = fx.delivery(spark, d).where(fx.batch_number() % 11 != 0)
    return replay(fx.replay_requests(spark, d)[0], manifests, stored, _canonical(spark, d), at, fx.stored(spark, d).positions)


@register("replay_attempts", sql(_REPLAY_STATES, extra=_REPLAY_SQL))
def replay_attempts(spark, d):
    return _replayed_with_gaps(spark, d).result.attempts.select("batch_id", "status", "last_error", "total_count", "attempt_number")


@register(
    "replay_missing_object",
    sql(f"""SELECT r.replay_id, CASE WHEN count_if(s.status = 'FAILED') > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
      count(s.batch_id) AS matching_batch_count, coalesce(sum(s.total_count), 0)::BIGINT AS processed_observation_count
    FROM request r LEFT JOIN ({_REPLAY_STATES}) s ON true WHERE r.replay_id LIKE '%1' GROUP BY 1""", extra=_REPLAY_SQL),
)
def replay_missing_object(spark, d):
    return _replayed_with_gaps(spark, d).runs.select("replay_id", "status", "matching_batch_count", "processed_observation_count")


def _replayed(spark, d):
    at = F.lit(fx.bounds(spark, d)["last"] + timedelta(days=2))
    return replay(fx.replay_requests(spark, d)[0], fx.manifest(spark, d), fx.delivery(spark, d), _canonical(spark, d), at, fx.stored(spark, d).positions)


# ---------------------------------------------------------------- streaming


@register("stream_process", sql(f"SELECT {_RESULT} FROM decided"))
def stream_process(spark, d):
    """Files land in two steps in receipt order; each step is one micro-batch or more."""
    out, landing = scratch_path(spark, "stream"), scratch_path(spark, "landing")
    documents_ = fx.raw_documents(spark, d)
    middle = F.lit(fx.bounds(spark, d)["last"] - timedelta(days=15))
    manifests = fx.manifest(spark, d).select("batch_id", "received_at")
    for part in (F.col("received_at") < middle, F.col("received_at") >= middle):
        raw.write_raw_batches(documents_.where(part), landing)
        ingest.stream_process(
            spark, landing, f"{out}/checkpoint", out, fx.MAPPING_0, fx.QUALITY, lambda: manifests,
            F.timestamp_micros(F.unix_micros("received_at") + 1_000_000),
        ).awaitTermination()
    return spark.read.parquet(f"{out}/outcomes").select(*_RESULT.split(", "))


_STREAM_ERROR = """CASE WHEN batch_no % 39 = 3 THEN 'Stored raw batch violates the worker envelope limits'
  WHEN batch_no % 31 = 4 THEN 'Raw object checksum verification failed' END"""


@register(
    "stream_failures",
    sql(f"""SELECT batch_id, CASE WHEN error IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, error AS last_error,
      count(CASE WHEN error IS NULL THEN 1 END) AS total_count FROM (SELECT *, {_STREAM_ERROR} AS error FROM delivery) GROUP BY ALL"""),
)
def stream_failures(spark, d):
    """Batches of a foreign version and batches whose bytes changed get a failed attempt; the others are processed."""
    out, landing = scratch_path(spark, "stream"), scratch_path(spark, "landing")
    foreign = F.substring("batchId", 25, 12).cast("long") % 39 == 3
    version = F.when(foreign, F.lit("raw-observation.batch.v9")).otherwise(F.col("contractVersion"))
    raw.write_raw_batches(fx.raw_documents(spark, d).withColumn("contractVersion", version), landing)
    manifests = fx.manifest(spark, d).select("batch_id", "received_at", "checksum")
    changed = F.when(fx.batch_number() % 31 == 4, F.lit("sha256:changed")).otherwise(F.col("checksum"))
    ingest.stream_process(
        spark, landing, f"{out}/checkpoint", out, fx.MAPPING_0, fx.QUALITY, lambda: manifests,
        F.timestamp_micros(F.unix_micros("received_at") + 1_000_000), digests=lambda: manifests.withColumn("checksum", changed),
    ).awaitTermination()
    return spark.read.parquet(f"{out}/attempts").select("batch_id", "status", "last_error", "total_count")


@register("stream_order_state", sql("SELECT batch_id, item_order, out_of_order, flags FROM decided WHERE reason_code IS NULL"))
def stream_order_state(spark, d):
    out, landing = scratch_path(spark, "order"), scratch_path(spark, "landing")
    marked = identity.mark_canonical(_accepted(spark, d))
    middle = F.lit(fx.bounds(spark, d)["last"] - timedelta(days=15))
    for part in (F.col("received_at") < middle, F.col("received_at") >= middle):
        marked.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(marked.schema).parquet(landing)
        ingest.stream_order_state(stream, f"{out}/checkpoint", out).awaitTermination()
    return spark.read.parquet(f"{out}/flagged").select("batch_id", "item_order", "out_of_order", "flags")


@register(
    "stream_outcome_rates",
    sql(f"""SELECT {_bucket('processed_at', 300)} AS window_start, outcome, count(*) AS observations, count(*) / 300.0::DOUBLE AS per_second
    FROM decided GROUP BY 1, 2"""),
)
def stream_outcome_rates(spark, d):
    out, landing = scratch_path(spark, "rates"), scratch_path(spark, "landing")
    outcomes = _outcomes(spark, d).select("processed_at", "outcome")
    outcomes.write.parquet(landing)
    stream = spark.readStream.schema(outcomes.schema).parquet(landing)
    metrics.start_rates(stream, f"{out}/checkpoint", f"{out}/rates", "1 minute").awaitTermination()
    return metrics.read_rates(spark, f"{out}/rates", "5 minutes")


@register(
    "stream_rates_tiered",
    sql(f"""SELECT {_bucket('processed_at', 300)} AS window_start, outcome, count(*) AS observations, count(*) / 300.0::DOUBLE AS per_second
    FROM decided GROUP BY 1, 2"""),
)
def stream_rates_tiered(spark, d):
    """All outcomes in many micro-batches, whose counts are merged in tiers."""
    out, landing = scratch_path(spark, "rates"), scratch_path(spark, "landing")
    outcomes = _outcomes(spark, d).select("processed_at", "outcome")
    outcomes.repartition(20).write.parquet(landing)
    stream = spark.readStream.schema(outcomes.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    metrics.start_rates(stream, f"{out}/checkpoint", f"{out}/rates", "1 minute").awaitTermination()
    return metrics.read_rates(spark, f"{out}/rates", "5 minutes")


@register("stream_heartbeats", sql(_FLEET.format(status=_LIVE)))
def stream_heartbeats(spark, d):
    out, landing = scratch_path(spark, "fleet"), scratch_path(spark, "landing")
    beats = fx.heartbeats(spark, d)
    middle = F.lit(fx.bounds(spark, d)["last"] - timedelta(days=15))
    for part in (F.col("received_at") < middle, F.col("received_at") >= middle):
        beats.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(beats.schema).parquet(landing)
        metrics.stream_heartbeats(stream, f"{out}/checkpoint", f"{out}/status", ("beat",)).awaitTermination()
    return metrics.read_fleet_status(spark, f"{out}/status")


# the clock is the fleet's own: the latest heartbeat of all, in whole milliseconds
_OFFLINE = """, latest AS (SELECT collector_id, max(received_at) AS last_heartbeat, bool_or(source_connected) FILTER (received_at = newest) AS connected
    FROM (SELECT *, max(received_at) OVER (PARTITION BY collector_id) AS newest FROM heartbeat) GROUP BY 1),
  clock AS (SELECT max(epoch_ms(last_heartbeat)) AS now_ms FROM latest)
SELECT collector_id, last_heartbeat,
  CASE WHEN epoch_ms(last_heartbeat) + 90000 < now_ms THEN 'OFFLINE' WHEN connected THEN 'ONLINE' ELSE 'SOURCE_DISCONNECTED' END AS current_status
FROM latest, clock"""


@register("stream_offline", sql(_OFFLINE))
def stream_offline(spark, d):
    """Collectors that fall silent in the stream, without any row of theirs: the batch inventory at the time of the last heartbeat."""
    out, landing = scratch_path(spark, "absence"), scratch_path(spark, "landing")
    beats = fx.heartbeats(spark, d)
    middle = F.lit(fx.bounds(spark, d)["last"] - timedelta(days=15))
    for part in (F.col("received_at") < middle, F.col("received_at") >= middle):
        beats.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(beats.schema).parquet(landing)
        absence.stream_absence(stream, f"{out}/checkpoint", f"{out}/status", "event").awaitTermination()
    return absence.read_status(spark, f"{out}/status").drop("changed_at")
