"""Hand-made observations and a row-by-row restatement of the processing rules."""

from __future__ import annotations

import hashlib
import math
import random
import re
from datetime import datetime, timedelta

OBSERVATION = (
    "batch_id string, item_order long, facility_id string, collector_id string, collector_version string, "
    "source_system string, source_epoch string, source_sequence long, source_tag string, observed_at timestamp, "
    "value double, value_type string, raw_unit string, source_quality_code int, received_at timestamp, "
    "processed_at timestamp"
)
NAMES = [c.strip().split(" ")[0] for c in OBSERVATION.split(",")]
T0 = datetime(2024, 5, 1, 10, 0, 0)
EPOCH = "c3a1e7d9-62b4-4f58-8e10-7d95b03f2a6c"


def observation(**changes) -> dict:
    row = dict(
        batch_id="0b6f3c52-1d84-4e0f-9a37-5c2e8d7146aa", item_order=0, facility_id="facility-alpha",
        collector_id="edge-gateway-01", collector_version="1.0.0", source_system="controller-a", source_epoch=EPOCH,
        source_sequence=1, source_tag="CTRL_A.ZONE[03].TEMP_PV", observed_at=T0, value=21.5, value_type="number",
        raw_unit="degC", source_quality_code=192, received_at=T0, processed_at=T0,
    )
    row.update(changes)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], OBSERVATION)


def identity(row) -> str:
    parts = [row["facility_id"], row["source_system"], row["source_epoch"], str(row["source_sequence"]), row["source_tag"]]
    return hashlib.sha256("\x1f".join(p or "" for p in parts).encode()).hexdigest()


def floor_seconds(a: datetime, b: datetime) -> int:
    return math.floor((a - b) / timedelta(seconds=1))


def restated(rows, mapping, quality, stored=None):
    """Process rows one by one in arrival order; ``stored`` maps known ids to their rows."""
    stored = dict(stored or {})
    results = {}
    for row in sorted(rows, key=lambda r: (r["received_at"], r["batch_id"], r["item_order"])):
        key = (row["batch_id"], row["item_order"])
        rule = next((r for r in mapping.rules if re.fullmatch(r.tag_pattern.replace("(?<", "(?P<"), row["source_tag"])), None)
        code = None
        if rule is None:
            code = "UNKNOWN_SOURCE_TAG"
        elif row["raw_unit"] != rule.expected_source_unit:
            code = "UNSUPPORTED_RAW_UNIT"
        elif not quality.ranges[rule.signal_id][0] <= row["value"] <= quality.ranges[rule.signal_id][1]:
            code = "VALUE_OUT_OF_RANGE"
        elif floor_seconds(row["observed_at"], row["processed_at"]) > quality.future_reject_seconds:
            code = "TIMESTAMP_TOO_FAR_IN_FUTURE"
        if code:
            results[key] = ("REJECTED", code, (), False)
            continue
        flags = []
        if floor_seconds(row["observed_at"], row["processed_at"]) > quality.future_flag_seconds:
            flags.append("FUTURE_TIMESTAMP")
        if floor_seconds(row["received_at"], row["observed_at"]) > quality.late_flag_seconds:
            flags.append("LATE_ARRIVAL")
        source = ("facility_id", "source_system", "source_epoch", "source_tag")
        earlier = [s for s in stored.values() if all(s[c] == row[c] for c in source)]
        late = bool(earlier) and (
            row["source_sequence"] < max(s["source_sequence"] for s in earlier)
            or row["observed_at"] < max(s["observed_at"] for s in earlier)
        )
        if identity(row) in stored:
            results[key] = ("DUPLICATE", None, tuple(flags), late)
            continue
        if late:
            flags.append("OUT_OF_ORDER")
        stored[identity(row)] = row
        results[key] = ("FLAGGED" if flags else "ACCEPTED", None, tuple(flags), late)
    return results, stored


def random_rows(seed: int, count: int):
    """Deliveries with one hot source, one much re-delivered observation and many ties."""
    r = random.Random(seed)
    rows = []
    for i in range(count):
        hot = r.random() < 0.4
        tag = "CTRL_A.ZONE[01].TEMP_PV" if hot else f"CTRL_A.ZONE[{r.randint(1, 4):02d}].{r.choice(['TEMP_PV', 'RH_PV', 'FAN_OUT', 'DOOR'])}"
        sequence = 5 if r.random() < 0.3 else r.randint(0, count)
        received = T0 + timedelta(seconds=r.randint(0, 20) * 30)
        rows.append(
            observation(
                batch_id=f"00000000-0000-4000-8000-{r.randint(0, count // 4):012d}", item_order=i,
                source_sequence=sequence, source_tag=tag, raw_unit="degC" if tag.endswith("TEMP_PV") else "%",
                value=r.choice([-1.0, 20.0, 50.0, 300.0]), received_at=received,
                processed_at=received + timedelta(seconds=1),
                observed_at=T0 + timedelta(seconds=sequence * 10 + r.choice([0, 0, 0, -400, 700])),
            )
        )
    return rows
