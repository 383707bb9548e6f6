"""Versioned rule tables: tag mappings, quality rules and the signal registry.

They are a few rows each, pinned to a version for a whole run, so they stay on the
driver and turn into expressions or small DataFrames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # only needed to load rule files
    yaml = None

# Forms of version names.
MAPPING_NAME = re.compile(r"controller-a-mapping-[0-9]+\.[0-9]+\.[0-9]+")
RULES_NAME = re.compile(r"quality-rules-[0-9]+\.[0-9]+\.[0-9]+")


@dataclass(frozen=True)
class MappingRule:
    tag_pattern: str
    asset_id_template: str
    signal_id: str
    expected_source_unit: str
    canonical_unit: str

    @property
    def zone_group(self) -> int:
        """Position of the group named ``zone``."""
        return re.compile(self.tag_pattern.replace("(?<", "(?P<")).groupindex["zone"]


@dataclass(frozen=True)
class MappingRules:
    version: str
    rules: tuple[MappingRule, ...]


@dataclass(frozen=True)
class QualityRules:
    version: str
    future_flag_seconds: int
    future_reject_seconds: int
    late_flag_seconds: int
    good_quality_code: int
    ranges: dict[str, tuple[float, float]]


# The published mapping rules, first match wins.
_TEMPERATURE = MappingRule(
    r"CTRL_A\.ZONE\[(?<zone>\d{2})\]\.TEMP_PV", "zone-${zone}", "environment.air_temperature", "degC", "Cel"
)
_TEMPERATURE_AUX = MappingRule(
    r"CTRL_A\.ZONE\[(?<zone>\d{2})\]\.TEMP_AUX_PV", "zone-${zone}", "environment.air_temperature", "degC", "Cel"
)
_HUMIDITY = MappingRule(
    r"CTRL_A\.ZONE\[(?<zone>\d{2})\]\.RH_PV", "zone-${zone}", "environment.relative_humidity", "%", "%"
)
_FAN = MappingRule(r"CTRL_A\.ZONE\[(?<zone>\d{2})\]\.FAN_OUT", "zone-${zone}", "ventilation.output", "%", "%")

MAPPINGS = {
    m.version: m
    for m in (
        MappingRules("controller-a-mapping-1.0.0", (_TEMPERATURE, _HUMIDITY, _FAN)),
        MappingRules("controller-a-mapping-1.1.0", (_TEMPERATURE, _TEMPERATURE_AUX, _HUMIDITY, _FAN)),
    )
}

# Thresholds in seconds, good quality code, inclusive physical ranges.
QUALITY = {
    "quality-rules-1.0.0": QualityRules(
        "quality-rules-1.0.0",
        future_flag_seconds=5,
        future_reject_seconds=300,
        late_flag_seconds=300,
        good_quality_code=192,
        ranges={
            "environment.air_temperature": (-40.0, 125.0),
            "environment.relative_humidity": (0.0, 100.0),
            "ventilation.output": (0.0, 100.0),
        },
    )
}

# The signal registry.
SIGNALS = [
    ("environment.air_temperature", "Enclosure air temperature", "Cel", "double", -40.0, 125.0),
    ("environment.relative_humidity", "Enclosure relative humidity", "%", "double", 0.0, 100.0),
    ("ventilation.output", "Ventilation output", "%", "double", 0.0, 100.0),
]


def mapping_rules(version: str) -> MappingRules:
    if version not in MAPPINGS:
        raise ValueError("MAPPING_VERSION_NOT_FOUND")
    return MAPPINGS[version]


def quality_rules(version: str) -> QualityRules:
    if version not in QUALITY:
        raise ValueError("QUALITY_RULES_VERSION_NOT_FOUND")
    return QUALITY[version]


def _document(path: str | Path, name: re.Pattern, version_field: str) -> dict:
    if yaml is None:
        raise RuntimeError("reading rule files needs PyYAML")
    version = Path(path).stem
    if not name.fullmatch(version):
        raise ValueError(f"unsafe rule file name: {version}")
    document = yaml.safe_load(Path(path).read_text())
    if document[version_field] != version:
        raise ValueError("rule file name and version disagree")
    return document


def load_mapping(path: str | Path) -> MappingRules:
    """Read one mapping file and register its version."""
    document = _document(path, MAPPING_NAME, "mappingVersion")
    loaded = MappingRules(
        document["mappingVersion"],
        tuple(
            MappingRule(
                r["tagPattern"], r["assetIdTemplate"], r["signalId"], r["expectedSourceUnit"], r["canonicalUnit"]
            )
            for r in document["rules"]
        ),
    )
    MAPPINGS[loaded.version] = loaded
    return loaded


def load_quality(path: str | Path) -> QualityRules:
    """Read one quality-rules file and register its version."""
    d = _document(path, RULES_NAME, "qualityRulesVersion")
    loaded = QualityRules(
        d["qualityRulesVersion"],
        d["futureTimestampFlagSeconds"],
        d["futureTimestampRejectSeconds"],
        d["lateArrivalFlagSeconds"],
        d["goodSourceQualityCode"],
        {signal: (float(r["minimum"]), float(r["maximum"])) for signal, r in d["ranges"].items()},
    )
    QUALITY[loaded.version] = loaded
    return loaded


def mapping_table(spark: SparkSession, mapping: MappingRules) -> DataFrame:
    return spark.createDataFrame(
        [
            (mapping.version, i, r.tag_pattern, r.asset_id_template, r.signal_id, r.expected_source_unit,
             r.canonical_unit, r.zone_group)
            for i, r in enumerate(mapping.rules)
        ],
        "mapping_version string, rule_ordinal int, tag_pattern string, asset_id_template string, signal_id string, "
        "expected_source_unit string, canonical_unit string, zone_group int",
    )


def quality_table(spark: SparkSession, quality: QualityRules) -> DataFrame:
    return spark.createDataFrame(
        [
            (quality.version, quality.future_flag_seconds, quality.future_reject_seconds, quality.late_flag_seconds,
             quality.good_quality_code, signal, low, high)
            for signal, (low, high) in sorted(quality.ranges.items())
        ],
        "quality_rules_version string, future_flag_seconds int, future_reject_seconds int, late_flag_seconds int, "
        "good_quality_code int, signal_id string, minimum double, maximum double",
    )


def load_signals(path: str | Path) -> list[tuple]:
    """Rows of a signal registry file, for ``signal_registry``."""
    if yaml is None:
        raise RuntimeError("reading rule files needs PyYAML")
    return [
        (s["signalId"], s["displayName"], s["unit"], s["valueType"], float(s["minimum"]), float(s["maximum"]))
        for s in yaml.safe_load(Path(path).read_text())["signals"]
    ]


def signal_registry(spark: SparkSession, signals: list[tuple] = SIGNALS) -> DataFrame:
    return spark.createDataFrame(
        signals,
        "signal_id string, display_name string, unit string, value_type string, minimum double, maximum double",
    )


@dataclass(frozen=True)
class ReplayRequest:
    replay_id: str
    facility_id: str
    from_time: datetime
    to_time: datetime
    mapping_version: str
    reason: str
    quality_rules_version: str = "quality-rules-1.0.0"
    requested_at: datetime | None = None

    def check(self, maximum_range: timedelta = timedelta(hours=24)) -> "ReplayRequest":
        """Raise ``ValueError`` carrying the error code of the first failed check."""
        if not (self.facility_id or "").strip() or not self.from_time or not self.to_time or self.to_time <= self.from_time:
            raise ValueError("INVALID_REPLAY_REQUEST")
        if self.to_time - self.from_time > maximum_range:
            raise ValueError("REPLAY_RANGE_TOO_LARGE")
        mapping_rules(self.mapping_version)
        quality_rules(self.quality_rules_version)
        if not (self.reason or "").strip() or len(self.reason) > 500:
            raise ValueError("INVALID_REPLAY_REASON")
        return self


def check_query_range(from_time: datetime, to_time: datetime, maximum_range: timedelta = timedelta(hours=24)) -> None:
    if from_time is None or to_time is None or to_time <= from_time:
        raise ValueError("INVALID_TIME_RANGE")
    if to_time - from_time > maximum_range:
        raise ValueError("QUERY_RANGE_TOO_LARGE")


def check_page_size(page_size: int, maximum: int = 1000) -> None:
    if not 1 <= page_size <= maximum:
        raise ValueError("INVALID_PAGE_SIZE")
