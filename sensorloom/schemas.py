"""Fixed, versioned table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed contract names and limits.
RAW_BATCH_CONTRACT = "raw-observation.batch.v1"
SAMPLE_CONTRACT = "telemetry.sample.v1"
MAX_OBSERVATIONS = 500
MAX_COMPRESSED_BYTES = 1024 * 1024
MAX_DECOMPRESSED_BYTES = 10 * 1024 * 1024
DEFAULT_MAPPING_VERSION = "controller-a-mapping-1.0.0"
DEFAULT_RULES_VERSION = "quality-rules-1.0.0"

RAW_OBSERVATION = T.StructType(
    [
        T.StructField("sourceSystem", T.StringType()),
        T.StructField("sourceEpoch", T.StringType()),
        T.StructField("sourceSequence", T.LongType()),
        T.StructField("sourceTag", T.StringType()),
        T.StructField("observedAt", T.TimestampType()),
        T.StructField("rawValue", T.VariantType()),
        T.StructField("rawUnit", T.StringType()),
        T.StructField("sourceQualityCode", T.IntegerType()),
    ]
)

RAW_BATCH = T.StructType(
    [
        T.StructField("contractVersion", T.StringType()),
        T.StructField("batchId", T.StringType()),
        T.StructField("collectorId", T.StringType()),
        T.StructField("collectorVersion", T.StringType()),
        T.StructField("facilityId", T.StringType()),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("observations", T.ArrayType(RAW_OBSERVATION)),
    ]
)

# Holds the text of a document that does not parse into the contract.
CORRUPT = "_corrupt_record"

# Partition folders of the raw store, by receipt time in UTC.
RAW_PARTITIONS = ["facility", "date", "hour", "collector"]

# A source position: sequences and times are compared within one of these keys.
SOURCE_KEY = ["facility_id", "source_system", "source_epoch", "source_tag"]

# Total arrival order of observations.
ARRIVAL = ["received_at", "batch_id", "item_order"]

# Tells apart rows of equal arrival: a batch that was read twice in one run.
DELIVERY = "delivery_no"
TOTAL_ARRIVAL = [*ARRIVAL, DELIVERY]

# Fixed field names of stored samples and rejections.
CANONICAL_COLUMNS = [
    "observation_id", "facility_id", "asset_id", "signal_id", "observed_at", "received_at",
    "processed_at", "value", "unit", "quality", "flags", "source_system", "source_sequence",
    "source_epoch", "source_tag", "collector_id", "collector_version", "mapping_version",
    "quality_rules_version", "raw_batch_id",
]

REJECTION_COLUMNS = [
    "observation_id", "batch_id", "replay_id", "source_tag", "reason_code", "reason",
    "mapping_version", "quality_rules_version", "processing_attempt_id", "created_at",
]
