from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import T0, frame, identity, observation
from sensorloom.operators import evaluate
from sensorloom.operators.validate import check_field_limits
from sensorloom.rules import MappingRule, MappingRules, mapping_rules, quality_rules

V0, V1 = mapping_rules("controller-a-mapping-1.0.0"), mapping_rules("controller-a-mapping-1.1.0")
QUALITY = quality_rules("quality-rules-1.0.0")


def decide(spark, rows, mapping=V0, **kw):
    rows = [dict(r, item_order=i) for i, r in enumerate(rows)]
    return evaluate.evaluate_observations(frame(spark, rows), mapping, QUALITY, **kw).orderBy("item_order").collect()


def test_tags_map_to_asset_and_signal(spark):
    rows = [
        observation(),
        observation(source_tag="CTRL_A.ZONE[03].RH_PV", raw_unit="%"),
        observation(source_tag="CTRL_A.ZONE[03].FAN_OUT", raw_unit="%"),
        observation(source_tag="CTRL_A.ZONE[03].TEMP_AUX_PV"),
        observation(source_tag="CTRL_A.ZONE[03].TEMP_PV\n"),
        observation(source_tag="xCTRL_A.ZONE[03].TEMP_PV"),
    ]
    got = decide(spark, rows)
    assert [(r.asset_id, r.signal_id, r.unit) for r in got[:3]] == [
        ("zone-03", "environment.air_temperature", "Cel"),
        ("zone-03", "environment.relative_humidity", "%"),
        ("zone-03", "ventilation.output", "%"),
    ]
    assert [r.reason_code for r in got] == [None] * 3 + ["UNKNOWN_SOURCE_TAG"] * 3
    assert decide(spark, rows, V1)[3].signal_id == "environment.air_temperature"


@pytest.mark.parametrize("strategy", ["inline", "distinct", "indexed"])
def test_first_matching_rule_wins(spark, strategy):
    rules = MappingRules(
        "controller-a-mapping-9.9.9",
        (
            MappingRule(r"A(?<zone>\d)", "one-${zone}", "s1", "u1", "c1"),
            MappingRule(r"(A|B)(?<zone>\d)", "two-${zone}", "s2", "u2", "c2"),
        ),
    )
    obs = frame(spark, [observation(source_tag=t, item_order=i) for i, t in enumerate(["A1", "B2", "C3", "A1\n"])])
    got = evaluate.map_tags(obs, rules, strategy).orderBy("item_order").collect()
    assert [(r.asset_id, r.signal_id) for r in got] == [("one-1", "s1"), ("two-2", "s2"), (None, None), (None, None)]


def test_order_of_checks_and_texts(spark):
    far = T0 + timedelta(hours=1)
    rows = [
        observation(source_tag=" ", raw_unit="kelvin-ish"),
        observation(source_tag=None),
        observation(source_tag="t" * 257),
        observation(source_tag="nope", raw_unit="bad"),
        observation(value=None, value_type="string", raw_unit="bad"),
        observation(value=float("inf"), raw_unit="bad"),
        observation(value=float("nan")),
        observation(raw_unit="kelvin-ish", value=1e9),
        observation(value=125.1, observed_at=far),
        observation(observed_at=far),
        observation(),
    ]
    got = decide(spark, rows)
    assert [r.reason_code for r in got] == [
        "FIELD_TOO_LONG", "FIELD_TOO_LONG", "FIELD_TOO_LONG", "UNKNOWN_SOURCE_TAG", "NON_NUMERIC_VALUE",
        "NON_FINITE_VALUE", "NON_FINITE_VALUE", "UNSUPPORTED_RAW_UNIT", "VALUE_OUT_OF_RANGE",
        "TIMESTAMP_TOO_FAR_IN_FUTURE", None,
    ]
    assert got[7].reason == "Expected source unit degC but received kelvin-ish"
    assert got[3].reason == "No mapping rule recognizes the source tag"
    assert [r.outcome for r in got] == ["REJECTED"] * 10 + ["ACCEPTED"]
    assert all(r.flags == [] and r.quality is None for r in got[:10])


def test_missing_tag_only_without_field_limits(spark):
    got = decide(spark, [observation(source_tag=""), observation(source_tag=None)], field_limits=False)
    assert {r.reason_code for r in got} == {"MISSING_SOURCE_TAG"}


def test_range_ends_are_inclusive(spark):
    got = decide(spark, [observation(value=v) for v in (-40.0, 125.0, -40.0001, 125.0001)])
    assert [r.reason_code for r in got] == [None, None, "VALUE_OUT_OF_RANGE", "VALUE_OUT_OF_RANGE"]


def test_second_differences_are_floored(spark):
    shift = lambda s: T0 + timedelta(seconds=s)
    rows = [
        observation(observed_at=shift(300.9)),
        observation(observed_at=shift(301)),
        observation(observed_at=shift(5.9)),
        observation(observed_at=shift(6)),
        observation(observed_at=shift(-300.9)),
        observation(observed_at=shift(-301)),
        observation(observed_at=shift(18), received_at=shift(400)),
    ]
    got = decide(spark, rows)
    assert [r.reason_code for r in got] == [None, "TIMESTAMP_TOO_FAR_IN_FUTURE"] + [None] * 5
    assert [r.flags for r in got] == [
        ["FUTURE_TIMESTAMP"], [], [], ["FUTURE_TIMESTAMP"], [], ["LATE_ARRIVAL"], ["FUTURE_TIMESTAMP", "LATE_ARRIVAL"],
    ]


def test_bad_quality_alone_is_accepted(spark):
    got = decide(spark, [observation(source_quality_code=0), observation(source_quality_code=192)])
    assert [(r.quality, r.outcome) for r in got] == [("BAD", "ACCEPTED"), ("GOOD", "ACCEPTED")]


def test_raw_value_kinds(spark):
    texts = ["21.5", "29", '"21.5"', "true", "null", "1e999", '{"v":1}', "[1]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = evaluate.numeric_value(df.withColumn("raw_value", F.parse_json("t"))).orderBy("i").collect()
    assert [r.value_type for r in got] == [
        "number", "number", "string", "boolean", "null", "number", "object", "array", "absent",
    ]
    assert got[0].value == 21.5 and got[1].value == 29.0 and got[5].value == float("inf")
    assert all(got[i].value is None for i in (2, 3, 4, 6, 7, 8))


def test_identity_is_stable_and_null_is_empty(spark):
    rows = [observation(), observation(source_tag="CTRL_A.ZONE[08].TEMP_PV"), observation(source_epoch=None)]
    rows = [dict(r, item_order=i) for i, r in enumerate(rows)]
    got = evaluate.with_observation_id(frame(spark, rows)).orderBy("item_order").collect()
    assert [r.observation_id for r in got] == [identity(r) for r in rows]
    assert len({r.observation_id for r in got}) == 3


def test_field_limits_count_utf16_units(spark):
    rows = [
        observation(source_system="a" * 64), observation(source_system="a" * 65),
        observation(source_system="\U0001F600" * 32), observation(source_system="\U0001F600" * 33),
        observation(source_system="é" * 64), observation(raw_unit="　\t"), observation(raw_unit=" "),
    ]
    rows = [dict(r, item_order=i) for i, r in enumerate(rows)]
    got = check_field_limits(frame(spark, rows)).orderBy("item_order").collect()
    bad = "FIELD_TOO_LONG"
    assert [r.reason_code for r in got] == [None, bad, None, bad, None, bad, None]
