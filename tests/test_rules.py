from __future__ import annotations

import base64
from datetime import datetime, timedelta, timezone

import pytest

from sensorloom import rules
from sensorloom.functions.cursor import decode_cursor, encode_cursor

T = datetime(2024, 5, 1, tzinfo=timezone.utc)


def request(**changes):
    values = dict(
        replay_id="r", facility_id="facility-alpha", from_time=T, to_time=T + timedelta(hours=1),
        mapping_version="controller-a-mapping-1.1.0", reason="because",
    )
    values.update(changes)
    return rules.ReplayRequest(**values)


@pytest.mark.parametrize(
    ("changes", "code"),
    [
        ({"facility_id": " "}, "INVALID_REPLAY_REQUEST"),
        ({"to_time": T}, "INVALID_REPLAY_REQUEST"),
        ({"to_time": T + timedelta(hours=24, seconds=1)}, "REPLAY_RANGE_TOO_LARGE"),
        ({"mapping_version": "controller-a-mapping-7.0.0"}, "MAPPING_VERSION_NOT_FOUND"),
        ({"quality_rules_version": "quality-rules-7.0.0"}, "QUALITY_RULES_VERSION_NOT_FOUND"),
        ({"reason": ""}, "INVALID_REPLAY_REASON"),
        ({"reason": "x" * 501}, "INVALID_REPLAY_REASON"),
    ],
)
def test_replay_request_checks(changes, code):
    with pytest.raises(ValueError, match=code):
        request(**changes).check()
    assert request().check()


def test_query_checks():
    for args, code in (((T, T), "INVALID_TIME_RANGE"), ((T, T + timedelta(hours=25)), "QUERY_RANGE_TOO_LARGE")):
        with pytest.raises(ValueError, match=code):
            rules.check_query_range(*args)
    for size in (0, 1001):
        with pytest.raises(ValueError, match="INVALID_PAGE_SIZE"):
            rules.check_page_size(size)


@pytest.mark.parametrize("micros", [0, 217_000, 217_123])
def test_cursor_round_trip(micros):
    at = T + timedelta(microseconds=micros)
    text = encode_cursor(at, "abc")
    assert "=" not in text and decode_cursor(text) == (at, "abc")


@pytest.mark.parametrize("bad", ["%%%", "", "YWJj", base64.urlsafe_b64encode(b"yesterday\x1fid").decode()])
def test_bad_cursors(bad):
    with pytest.raises(ValueError, match="INVALID_CURSOR"):
        decode_cursor(bad)


def test_rule_files(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "controller-a-mapping-3.0.0.yaml"
    path.write_text(
        "mappingVersion: controller-a-mapping-3.0.0\nrules:\n  - tagPattern: 'P(?<zone>\\d)'\n"
        "    assetIdTemplate: 'z-${zone}'\n    signalId: s\n    expectedSourceUnit: u\n    canonicalUnit: c\n"
    )
    loaded = rules.load_mapping(path)
    assert loaded.rules[0].zone_group == 1 and rules.mapping_rules("controller-a-mapping-3.0.0") is loaded
    wrong = tmp_path / "controller-a-mapping-3.0.1.yaml"
    wrong.write_text(path.read_text())
    with pytest.raises(ValueError, match="disagree"):
        rules.load_mapping(wrong)
    with pytest.raises(ValueError, match="unsafe"):
        rules.load_quality(tmp_path / "other.yaml")


def test_registry_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "registry.yaml"
    path.write_text(
        "signals:\n  - signalId: s\n    displayName: Some signal\n    unit: u\n    valueType: double\n    minimum: 1\n    maximum: 2\n"
    )
    assert tuple(rules.signal_registry(spark, rules.load_signals(path)).first()) == ("s", "Some signal", "u", "double", 1.0, 2.0)


def test_registry_and_mapping_tables(spark):
    ranges = rules.quality_table(spark, rules.quality_rules("quality-rules-1.0.0"))
    assert {(r.signal_id, r.minimum, r.maximum) for r in ranges.collect()} == {
        (s[0], s[4], s[5]) for s in rules.SIGNALS
    }
    assert rules.signal_registry(spark).count() == 3
    table = rules.mapping_table(spark, rules.mapping_rules("controller-a-mapping-1.1.0"))
    assert [r.rule_ordinal for r in table.orderBy("rule_ordinal").collect()] == [0, 1, 2, 3]
