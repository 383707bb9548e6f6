from __future__ import annotations

import base64
import gzip
import hashlib
import json
import tracemalloc
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import EPOCH, T0, frame, observation, random_rows
from sensorloom import schemas
from sensorloom.operators import documents, query, validate, work
from sensorloom.operators.evaluate import numeric_value
from sensorloom.plans.process import process_batches
from sensorloom.rules import mapping_rules, quality_rules
from sensorloom.sources import canonical, history, raw

V0 = mapping_rules("controller-a-mapping-1.0.0")
QUALITY = quality_rules("quality-rules-1.0.0")


def document(**changes):
    item = {
        "sourceSystem": "controller-a", "sourceEpoch": EPOCH, "sourceSequence": 5170,
        "sourceTag": "CTRL_A.ZONE[03].TEMP_PV", "observedAt": "2025-02-11T16:05:09.304Z", "rawValue": 21.5,
        "rawUnit": "degC", "sourceQualityCode": 192,
    }
    batch = {
        "contractVersion": "raw-observation.batch.v1", "batchId": "0b6f3c52-1d84-4e0f-9a37-5c2e8d7146aa",
        "collectorId": "edge-gateway-01", "collectorVersion": "1.0.0", "facilityId": "facility-alpha",
        "createdAt": "2025-02-11T16:05:12Z", "observations": [item],
    }
    for name, value in changes.items():
        target = item if name in item else batch
        if value is ...:
            target.pop(name)
        else:
            target[name] = value
    return batch


def store(root, batches):
    for i, b in enumerate(batches):
        folder = root / "facility=facility-alpha" / "date=2025-02-11" / "hour=16" / "collector=edge-gateway-01"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i:03d}.json.gz").write_bytes(gzip.compress(json.dumps(b, indent=1).encode()))
    return str(root)


def test_stored_documents_are_scanned(spark, tmp_path):
    root = store(tmp_path, [document(rawValue=v, extra={"a": 1}) for v in (21.5, "21.5", True, None)])
    batches = raw.scan_raw_batches(spark, root)
    assert batches.select("facility", "date", "hour", "collector").distinct().first() == (
        "facility-alpha", "2025-02-11", "16", "edge-gateway-01",
    )
    rows = numeric_value(raw.explode_observations(batches)).orderBy("object_path").collect()
    assert [r.value_type for r in rows] == ["number", "string", "boolean", "null"]
    assert rows[0].value == 21.5 and rows[0].observed_at == datetime(2025, 2, 11, 16, 5, 9, 304000)
    plan = raw.scan_raw_batches(spark, root).where("hour = '09'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan


def test_envelope_and_item_validation(spark, tmp_path):
    cases = [
        (document(), None),
        (document(contractVersion="raw-observation.batch.v2", batchId="x"), "UNSUPPORTED_CONTRACT_VERSION"),
        (document(facilityId=...), "INVALID_ENVELOPE"),
        (document(batchId="1-1-1-1-1"), None),
        (document(batchId="1-1-1-1"), "INVALID_ENVELOPE"),
        (document(collectorId="-edge"), "INVALID_ENVELOPE"),
        (document(collectorVersion="v" * 65), "INVALID_ENVELOPE"),
        (document(createdAt="not a time"), "INVALID_ENVELOPE"),
        (document(observations=[]), "INVALID_OBSERVATION_COUNT"),
        (document(observations=document()["observations"] * 500), None),
        (document(observations=document()["observations"] * 501), "INVALID_OBSERVATION_COUNT"),
        (document(rawValue="text"), None),
        (document(sourceSequence=-1), "INVALID_ENVELOPE"),
        (document(sourceTag="t" * 257), "INVALID_ENVELOPE"),
        (document(rawUnit=""), "INVALID_ENVELOPE"),
        (document(observedAt=...), "INVALID_ENVELOPE"),
        (document(rawValue=...), "INVALID_ENVELOPE"),
        (document(sourceEpoch="nope"), "INVALID_ENVELOPE"),
        (document(rawValue=None), None),
        (document(sourceSequence=...), None),
        (document(observedAt="yesterday", contractVersion="raw-observation.batch.v2"), "INVALID_ENVELOPE"),
        ({"contractVersion": 5}, "UNSUPPORTED_CONTRACT_VERSION"),
        ("no document", "INVALID_ENVELOPE"),
    ]
    root = store(tmp_path, [c for c, _ in cases])
    got = validate.validate_contract(raw.scan_raw_batches(spark, root)).orderBy("object_path").collect()
    assert [r.reason_code for r in got] == [e for _, e in cases]


def test_digests_are_over_the_exact_bytes(spark, tmp_path):
    root = store(tmp_path, [document(), document(rawValue=1)])
    rows = {r.object_key.rsplit("/", 1)[1]: r for r in raw.scan_object_digests(spark, root).collect()}
    for path in tmp_path.rglob("*.gz"):
        digest = hashlib.sha256(path.read_bytes())
        row = rows[path.name]
        assert row.checksum == "sha256:" + digest.hexdigest() and len(row.checksum) == 71
        assert row.content_digest == "sha-256=:" + base64.b64encode(digest.digest()).decode() + ":"
        assert row.length == path.stat().st_size
    manifests = spark.createDataFrame(
        [(r.object_key, r.checksum if n == "000.json.gz" else "sha256:0") for n, r in rows.items()], "object_key string, checksum string"
    )
    checked = validate.verify_objects(raw.scan_object_digests(spark, root), manifests).collect()
    assert sorted(r.reason_code or "" for r in checked) == ["", "CHECKSUM_MISMATCH"]


def test_object_sizes(spark, tmp_path):
    big = document(observations=document()["observations"] * 400)
    root = store(tmp_path, [document(), big])
    sizes = raw.scan_object_sizes(spark, root)
    rows = sizes.orderBy("object_key").collect()
    assert [r.decompressed_length for r in rows] == [len(json.dumps(d, indent=1)) for d in (document(), big)]
    limited = validate.check_object_sizes(sizes, max_decompressed=10_000).orderBy("object_key").collect()
    assert [r.reason_code for r in limited] == [None, "PAYLOAD_TOO_LARGE"]
    small = min(r.length for r in rows)
    tight = validate.check_object_sizes(raw.scan_object_sizes(spark, root, small), max_compressed=small).orderBy("length").collect()
    assert [r.reason_code for r in tight] == [None, "COMPRESSED_PAYLOAD_TOO_LARGE"] and tight[1].decompressed_length is None


def test_inflating_stops_at_the_limit(spark, tmp_path):
    bomb = gzip.compress(bytes(1 << 30), 1)
    assert raw.inflated_length(gzip.compress(b"abc") + gzip.compress(b"de"), 10) == 5
    assert [raw.inflated_length(c, 10) for c in (b"", b"no gzip", gzip.compress(b"x" * 10)[:-9], gzip.compress(b""))] == [None, None, None, 0]
    assert [raw.inflated_length(gzip.compress(b"x" * n), 10) for n in (9, 10, 11)] == [9, 10, 11]
    tracemalloc.start()
    assert raw.inflated_length(bomb, schemas.MAX_DECOMPRESSED_BYTES) == schemas.MAX_DECOMPRESSED_BYTES + 1
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    objects = {"bomb": gzip.compress(bytes(200 << 20)), "sound": gzip.compress(b"{}"), "large": bytes(schemas.MAX_COMPRESSED_BYTES + 1)}
    for name, content in objects.items():
        (tmp_path / f"{name}.json.gz").write_bytes(content)
    sizes = validate.check_object_sizes(raw.scan_object_sizes(spark, str(tmp_path)))
    assert {r.object_key.split("/")[-1]: r.reason_code for r in sizes.collect()} == {
        "bomb.json.gz": "PAYLOAD_TOO_LARGE", "sound.json.gz": None, "large.json.gz": "COMPRESSED_PAYLOAD_TOO_LARGE"
    }


def nested(spark, rows):
    flat = frame(spark, rows).withColumn("raw_value", F.parse_json(F.col("value").cast("string")))
    return raw.assemble_batches(flat.withColumn("created_at", F.col("received_at")))


def test_sink_keeps_the_first_receipt_and_microseconds(spark, tmp_path):
    at = T0 + timedelta(microseconds=123456)
    rows = [observation(item_order=i, source_sequence=i, observed_at=at) for i in (1, 0)]
    later = [dict(r, received_at=T0 + timedelta(hours=2), value=1.0) for r in rows]
    root = str(tmp_path / "store")
    raw.write_raw_batches(nested(spark, later + rows), root)
    raw.write_raw_batches(nested(spark, later), root)
    (batch,) = raw.scan_raw_batches(spark, root, multiline=False).collect()
    assert batch.hour == "10" and [o.sourceSequence for o in batch.observations] == [0, 1]
    assert batch.observations[0].observedAt == at


def test_interval_filter_prunes_days(spark, tmp_path):
    rows = [observation(source_sequence=i, item_order=i, observed_at=T0 - timedelta(days=i)) for i in range(5)]
    done = process_batches(frame(spark, rows), V0, QUALITY)
    path = str(tmp_path / "canonical")
    canonical.write_canonical(done.canonical, path)
    table = spark.read.parquet(path)
    kept = query.filter_interval(table, T0 - timedelta(days=2), T0)
    assert sorted(r.source_sequence for r in kept.collect()) == [1, 2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(observed_date" in plan and "PushedFilters: [IsNotNull(observed_at)" in plan
    assert query.filter_interval(table, None, T0).count() == 5


def test_pages_cover_the_query(spark, tmp_path):
    rows = [observation(source_sequence=i, item_order=i, observed_at=T0 + timedelta(seconds=i // 3)) for i in range(23)]
    samples = process_batches(frame(spark, rows), V0, QUALITY).canonical
    start, end = T0, T0 + timedelta(hours=1)
    whole = [r.observation_id for r in query.query_telemetry(samples, "facility-alpha", start, end).collect()]
    paged, cursor, pages = [], None, 0
    while True:
        page, cursor = query.telemetry_page(samples, "facility-alpha", start, end, page_size=7, cursor=cursor)
        paged += [r.observation_id for r in page.collect()]
        pages += 1
        if cursor is None:
            break
    assert paged == whole and len(whole) == 23 and pages == 4


def test_query_filters(spark):
    rows = [
        observation(), observation(source_sequence=2, item_order=1, source_quality_code=0, observed_at=T0 + timedelta(seconds=1)),
        observation(source_sequence=3, item_order=2, observed_at=T0 + timedelta(seconds=9)),
        observation(source_sequence=4, item_order=3, source_tag="CTRL_A.ZONE[09].RH_PV", raw_unit="%"),
    ]
    samples = process_batches(frame(spark, rows), V0, QUALITY).canonical
    ask = lambda **kw: sorted(
        r.source_sequence for r in query.query_telemetry(samples, "facility-alpha", T0, T0 + timedelta(hours=1), **kw).collect()
    )
    assert ask() == [1, 2, 3, 4]
    assert ask(include_flagged=False) == [1, 2, 4]
    assert ask(include_bad_quality=False) == [1, 3, 4]
    assert ask(asset="zone-09") == [4] and ask(signal="environment.air_temperature", asset=" ") == [1, 2, 3]


def test_documents_and_reconciliation(spark):
    samples = process_batches(frame(spark, [observation()]), V0, QUALITY).canonical
    made = json.loads(documents.documents_as_json(samples).first().json)
    assert made["contractVersion"] == "telemetry.sample.v1" and made["flags"] == []
    assert made["source"]["sourceTag"] == "CTRL_A.ZONE[03].TEMP_PV" and made["observedAt"] == "2024-05-01T10:00:00.000000Z"
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "object_key string")
    diff = work.reconcile_objects(keys("a", "b", "orphan"), keys("a", "b", "missing"))
    assert [tuple(r) for r in diff.collect()] == [("missing", "MISSING"), ("orphan", "ORPHAN")]
    healthy = work.reconciliation_summary(work.reconcile_objects(keys("a"), keys("a"))).first()
    assert healthy.healthy and healthy.orphan_objects == 0


def test_cursor_reads(spark):
    rows = spark.createDataFrame([(EPOCH, s) for s in range(1, 11)], "source_epoch string, source_sequence long")
    page = history.read_after_cursor(rows, EPOCH, 4, limit=3)
    assert [r.source_sequence for r in page.collect()] == [5, 6, 7]
    assert history.next_cursor(page, 4).first().next_sequence == 7
    assert history.next_cursor(rows.limit(0), 4).first().next_sequence == 4
    assert history.read_after_cursor(rows, "other", 4, current_epoch=EPOCH).count() == 10
    with pytest.raises(ValueError):
        history.read_after_cursor(rows, EPOCH, 0, limit=501)


def test_rejections_are_stored_by_day(spark, tmp_path):
    done = process_batches(frame(spark, random_rows(6, 200)), V0, QUALITY)
    path = str(tmp_path / "rejections")
    canonical.write_rejections(done.rejections, path)
    stored = spark.read.parquet(path)
    assert stored.count() == done.rejections.count() > 0
    assert canonical.quarantine_report(stored).agg(F.sum("rejections")).first()[0] == stored.count()


def test_selected_batches_touch_only_their_folders(spark, tmp_path):
    ids = [f"00000000-0000-4000-8000-{i:012d}" for i in range(6)]
    rows = [observation(batch_id=b, source_sequence=i, received_at=T0 + timedelta(hours=13 * i)) for i, b in enumerate(ids)]
    root = str(tmp_path / "store")
    raw.write_raw_batches(nested(spark, rows), root)
    receipts = frame(spark, rows).select("batch_id", "facility_id", "collector_id", "received_at")
    picked = receipts.where(F.col("batch_id").isin(ids[0], ids[3]))
    found = raw.scan_selected_batches(spark, root, picked, multiline=False)
    assert sorted(r.batchId for r in found.collect()) == [ids[0], ids[3]]
    assert {p.split("date=")[1][:10] for p in found.inputFiles()} == {"2024-05-01", "2024-05-03"}
    assert raw.scan_selected_batches(spark, root, receipts.limit(0), multiline=False).count() == 0


def test_oversized_batches_are_not_assembled(spark):
    with pytest.raises(Exception, match="too many observations"):
        nested(spark, [observation(item_order=500)]).collect()
