"""Processing as a batch job whose effects repeat safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom import schemas
from sensorloom.operators.identity import REJECTION_KEY, merge_rejections, rejection_keys
from sensorloom.plans.process import process_batches
from sensorloom.rules import MappingRules, QualityRules
from sensorloom.runtime import materialize, scratch_scope
from sensorloom.sources.runs import RunStore

_TEXT, _LONG, _TIME = T.StringType(), T.LongType(), T.TimestampType()
_KINDS = {
    "observed_at": _TIME, "received_at": _TIME, "processed_at": _TIME, "created_at": _TIME, "value": T.DoubleType(),
    "flags": T.ArrayType(_TEXT), "source_sequence": _LONG, "max_sequence": _LONG, "max_observed_at": _TIME,
    "attempt_number": T.IntegerType(), "started_at": _TIME, "completed_at": _TIME,
    **{f"{c}_count": _LONG for c in ("accepted", "flagged", "rejected", "duplicate", "total")},
}


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, _KINDS.get(c, _TEXT)) for c in columns])


CANONICAL = _schema(schemas.CANONICAL_COLUMNS)
REJECTION = _schema(schemas.REJECTION_COLUMNS)
POSITION = _schema([*schemas.SOURCE_KEY, "max_sequence", "max_observed_at"])
ATTEMPT = _schema([
    "processing_attempt_id", "attempt_number", "batch_id", "replay_id", "mapping_version", "quality_rules_version",
    "accepted_count", "flagged_count", "rejected_count", "duplicate_count", "total_count", "status", "started_at",
    "completed_at", "last_error",
])
#: Ledgers: what new rows are compared with, laid out by the key they are compared by.
IDENTITY = _schema(["observation_id", "source_sequence", "observed_at"])
AUDIT = _schema(REJECTION_KEY)
BY_ID = ["observation_id"]


def canonical(store: RunStore) -> DataFrame:
    """Stored samples; filters on ``date``, the event day, prune folders."""
    return store.read("canonical", T.StructType([*CANONICAL.fields, T.StructField("date", T.DateType())]))


def rejections(store: RunStore) -> DataFrame:
    """Recorded rejections; filters on ``date``, the day of recording, prune folders."""
    return store.read("rejections", T.StructType([*REJECTION.fields, T.StructField("date", T.DateType())]))


def attempts(store: RunStore) -> DataFrame:
    return store.read("attempts", ATTEMPT)


def identities(store: RunStore) -> DataFrame:
    """Id, sequence and event time of every stored sample, bucketed by id."""
    return store.read_ledger("identities", IDENTITY, BY_ID)


def positions(store: RunStore) -> DataFrame | None:
    """Source maxima after the last recorded run, which holds those of all."""
    runs = store.records()
    return store.read("positions", POSITION, [runs[-1]["run"]]) if runs else None


def process_run(
    store: RunStore,
    run: str,
    obs: DataFrame,
    mapping: MappingRules,
    quality: QualityRules,
    manifests: DataFrame | None = None,
    processed_at: Column | None = None,
    replay_id: str | None = None,
    digests: DataFrame | None = None,
) -> bool:
    """Process ``obs`` as the run named ``run``; false if that run is recorded already and nothing was done.

    All outputs of the run count from its success record on, or none does: after a failure the same call does the
    run again and replaces what was left behind. The history is read only for ids that may be stored, and a join with it
    moves the new rows alone. ``processed_at`` should be fixed, so that a repeated run gives equal rows. The tables
    between steps are dropped at the end, whatever it is.
    """
    if store.recorded(run):
        return False
    spark = obs.sparkSession
    with scratch_scope(spark):
        seen = len(store.records())
        done = process_batches(
            obs, mapping, quality, manifests, lambda: identities(store), positions(store) if seen else None,
            processed_at, replay_id, digests, store.aligned,
        ) if seen else process_batches(obs, mapping, quality, manifests, None, None, processed_at, replay_id, digests)
        stored = materialize(done.canonical, "canonical")
        audit = store.read_ledger("audit", AUDIT, REJECTION_KEY) if seen else None
        rejected = materialize(merge_rejections(audit, done.rejections, store.aligned if seen else None), "rejected")
        store.write(run, "canonical", stored, "observed_at", ("facility_id", "asset_id", "signal_id", "observed_at"))
        store.write_ledger(run, "identities", stored.select(*IDENTITY.names), BY_ID)
        store.write(run, "rejections", rejected.select(*REJECTION.names), "created_at", ("batch_id",))
        store.write_ledger(run, "audit", rejection_keys(rejected), REJECTION_KEY)
        store.write(run, "attempts", done.attempts.select(*ATTEMPT.names))
        store.write(run, "positions", done.positions.select(*POSITION.names))
        counts = stored.agg(F.count("*")).first()[0], rejected.agg(F.count("*")).first()[0]
        store.record(run, seen, {"canonical": counts[0], "rejections": counts[1]})
    return True
