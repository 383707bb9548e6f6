"""Mapping and quality decisions, one narrow pass per observation.

Rules are pinned for a run and few, so they become CASE expressions inside one
whole-stage-codegen span: no shuffle, no join and a single read of the raw data. With
the strategy ``distinct`` each distinct tag is matched once and joined back instead; many
rules are found through an index of their literal beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.identity import observation_id
from sensorloom.functions.text import is_blank, literal_prefix
from sensorloom.functions.timing import floor_seconds
from sensorloom.operators.scan import lookup_join
from sensorloom.operators.validate import field_limit_failure
from sensorloom.rules import MappingRules, QualityRules

# Human readable reasons.
REASONS = {
    "FIELD_TOO_LONG": "A raw observation field exceeds its configured limit",
    "MISSING_SOURCE_TAG": "The source tag is missing",
    "UNKNOWN_SOURCE_TAG": "No mapping rule recognizes the source tag",
    "NON_NUMERIC_VALUE": "The raw value is not numeric",
    "NON_FINITE_VALUE": "The raw value is NaN or infinite",
    "VALUE_OUT_OF_RANGE": "The raw value is outside the configured physical range",
    "TIMESTAMP_TOO_FAR_IN_FUTURE": "The source timestamp is too far in the future",
}

_NUMERIC_VARIANT = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def whole(pattern: str) -> str:
    """Match the whole tag; ``$`` would accept a trailing newline."""
    return rf"\A(?:{pattern})\z"


def render_asset_id(tag: Column, pattern: str, template: str, group: int) -> Column:
    zone = F.regexp_extract(tag, whole(pattern), group)
    return F.replace(F.lit(template), F.lit("${zone}"), zone)


def numeric_value(obs: DataFrame, source: str = "raw_value") -> DataFrame:
    """Replace a variant value by ``value`` and ``value_type``.

    The type is tested first, since the cast alone would turn text and booleans into
    numbers.
    """
    kind = F.schema_of_variant(F.col(source))
    typed = (
        F.when(F.col(source).isNull(), F.lit("absent"))
        .when(kind.rlike(_NUMERIC_VARIANT), F.lit("number"))
        .when(kind == "VOID", F.lit("null"))
        .when(kind == "STRING", F.lit("string"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("object"))
    )
    return (
        obs.withColumn("value_type", typed)
        .withColumn("value", F.when(F.col("value_type") == "number", F.try_variant_get(F.col(source), "$", "double")))
        .drop(source)
    )


def _constant_by_rule(values: list[str]) -> Column:
    """Constant array lookup: far less generated code than a CASE over the rules."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("_rule"))


def _map_inline(obs: DataFrame, mapping: MappingRules) -> DataFrame:
    tag = F.col("source_tag")
    matched = F.when(F.lit(False), F.lit(0))
    for i, r in enumerate(mapping.rules):
        matched = matched.when(tag.rlike(whole(r.tag_pattern)), F.lit(i))
    assets = F.when(F.lit(False), F.lit(""))
    for i, r in enumerate(mapping.rules):
        assets = assets.when(F.col("_rule") == i, render_asset_id(tag, r.tag_pattern, r.asset_id_template, r.zone_group))
    return (
        obs.withColumn("_rule", matched)
        .withColumns(
            {
                "asset_id": assets,
                "signal_id": _constant_by_rule([r.signal_id for r in mapping.rules]),
                "expected_unit": _constant_by_rule([r.expected_source_unit for r in mapping.rules]),
                "unit": _constant_by_rule([r.canonical_unit for r in mapping.rules]),
            }
        )
        .drop("_rule")
    )


def _map_distinct(obs: DataFrame, mapping: MappingRules) -> DataFrame:
    tags = obs.select("source_tag").distinct()
    mapped = ["asset_id", "signal_id", "expected_unit", "unit"]
    return lookup_join(obs, _map_inline(tags, mapping), ["source_tag"], mapped)


def _index_rows(obs: DataFrame, mapping: MappingRules) -> DataFrame:
    """One row a rule: its place, the literal text every tag it matches begins with, and its pattern."""
    return obs.sparkSession.createDataFrame(
        [(i, literal_prefix(r.tag_pattern), whole(r.tag_pattern), r.zone_group, r.asset_id_template, r.signal_id,
          r.expected_source_unit, r.canonical_unit) for i, r in enumerate(mapping.rules)],
        "_rule int, _prefix string, _pattern string, _group int, _template string, signal_id string, expected_unit string, unit string",
    )


def _map_indexed(obs: DataFrame, mapping: MappingRules) -> DataFrame:
    """Distinct tags meet an index of the rules' literal beginnings in an equi-join; patterns are tried on these hits only.

    A tag is looked up once for each length of beginning that the rules have. Rules without one are tried on every tag.
    """
    lengths = sorted({len(literal_prefix(r.tag_pattern)) for r in mapping.rules})
    tags = obs.select("source_tag").where("source_tag is not null").distinct()
    probes = tags.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(
        F.length("source_tag") >= F.col("_length")
    )
    hits = (
        probes.withColumn("_prefix", F.expr("left(source_tag, _length)"))
        .join(_index_rows(obs, mapping), "_prefix")
        .where(F.expr("source_tag rlike _pattern"))
    )
    carried = ["_rule", "_pattern", "_group", "_template", "signal_id", "expected_unit", "unit"]
    first = hits.groupBy("source_tag").agg(F.min_by(F.struct(*carried), "_rule").alias("_first")).select("source_tag", "_first.*")
    zone = F.expr("regexp_extract(source_tag, _pattern, _group)")
    mapped = first.withColumn("asset_id", F.replace(F.col("_template"), F.lit("${zone}"), zone))
    return lookup_join(obs, mapped, ["source_tag"], ["asset_id", "signal_id", "expected_unit", "unit"])


#: Rules up to which each tag is tried on all of them inside the projection.
INLINE_RULES = 64


def map_tags(
    obs: DataFrame,
    mapping: MappingRules,
    strategy: str | None = None,
) -> DataFrame:
    """Add ``asset_id``, ``signal_id``, ``expected_unit`` and ``unit`` of the first matching rule.

    All four are null for an unknown tag. ``strategy`` is ``inline`` (a CASE over the rules), ``distinct`` (the
    same for distinct tags, joined back) or ``indexed`` (an index of the rules' literal beginnings); by default
    the number of rules decides.
    """
    strategy = strategy or ("inline" if len(mapping.rules) <= INLINE_RULES else "indexed")
    return {"inline": _map_inline, "distinct": _map_distinct, "indexed": _map_indexed}[strategy](obs, mapping)


def missing_tag() -> Column:
    return F.col("source_tag").isNull() | is_blank(F.col("source_tag"))


def unknown_tag() -> Column:
    return F.col("signal_id").isNull()


def non_numeric() -> Column:
    return F.col("value").isNull() | (F.col("value_type") != "number")


def non_finite() -> Column:
    return F.isnan("value") | (F.abs("value") == float("inf"))


def unsupported_unit() -> Column:
    return ~F.col("raw_unit").eqNullSafe(F.col("expected_unit"))


def unit_reason() -> Column:
    return F.concat(
        F.lit("Expected source unit "), F.col("expected_unit"), F.lit(" but received "),
        F.coalesce(F.col("raw_unit"), F.lit("null")),
    )


def out_of_range(quality: QualityRules) -> Column:
    """Outside the signal's inclusive range; a signal without a range always is."""
    signals = sorted(quality.ranges)
    position = (F.array_position(F.array(*[F.lit(x) for x in signals]), F.col("signal_id")) - 1).cast("int")
    bound = lambda side: F.get(F.array(*[F.lit(quality.ranges[x][side]) for x in signals]), position)
    return ~F.coalesce(F.col("value").between(bound(0), bound(1)), F.lit(False))


def future_seconds() -> Column:
    return floor_seconds(F.col("observed_at"), F.col("processed_at"))


def late_seconds() -> Column:
    return floor_seconds(F.col("received_at"), F.col("observed_at"))


def too_far_in_future(quality: QualityRules) -> Column:
    return future_seconds() > quality.future_reject_seconds


def quality_flags(quality: QualityRules) -> Column:
    """The raised flags in fixed order."""
    future = future_seconds() > quality.future_flag_seconds
    late = late_seconds() > quality.late_flag_seconds
    flag = {name: F.lit(name) for name in ("FUTURE_TIMESTAMP", "LATE_ARRIVAL")}
    return (
        F.when(future & late, F.array(*flag.values()))
        .when(future, F.array(flag["FUTURE_TIMESTAMP"]))
        .when(late, F.array(flag["LATE_ARRIVAL"]))
        .otherwise(F.array().cast("array<string>"))
    )


def quality_label(quality: QualityRules) -> Column:
    good = F.col("source_quality_code") == quality.good_quality_code
    return F.when(good, F.lit("GOOD")).otherwise(F.lit("BAD"))


def _reason_text() -> Column:
    texts = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.when(F.col("reason_code") == "UNSUPPORTED_RAW_UNIT", unit_reason()).otherwise(
        F.element_at(texts, F.col("reason_code"))
    )


def evaluate_observations(
    obs: DataFrame, mapping: MappingRules, quality: QualityRules, field_limits: bool = True
) -> DataFrame:
    """Decide every observation: first failing check wins, otherwise flags and a label.

    Needs ``value``, ``value_type``, ``received_at`` and ``processed_at``. Adds the
    mapped columns, ``reason_code``, ``reason``, ``flags``, ``quality``, ``outcome``,
    the versions and ``observation_id``. Store the result before filtering it: a filter
    on the outcome is pushed below the projection and would evaluate every rule again.
    """
    mapped = map_tags(obs, mapping)
    code = F.when(field_limit_failure(), F.lit("FIELD_TOO_LONG")) if field_limits else F.when(F.lit(False), F.lit(""))
    code = (
        code.when(missing_tag(), F.lit("MISSING_SOURCE_TAG"))
        .when(unknown_tag(), F.lit("UNKNOWN_SOURCE_TAG"))
        .when(non_numeric(), F.lit("NON_NUMERIC_VALUE"))
        .when(non_finite(), F.lit("NON_FINITE_VALUE"))
        .when(unsupported_unit(), F.lit("UNSUPPORTED_RAW_UNIT"))
        .when(out_of_range(quality), F.lit("VALUE_OUT_OF_RANGE"))
        .when(too_far_in_future(quality), F.lit("TIMESTAMP_TOO_FAR_IN_FUTURE"))
    )
    accepted = F.col("reason_code").isNull()
    no_flags = F.array().cast("array<string>")
    return (
        mapped.withColumn("reason_code", code)
        .withColumn("reason", _reason_text())
        .withColumn("flags", F.when(accepted, quality_flags(quality)).otherwise(no_flags))
        .withColumn("quality", F.when(accepted, quality_label(quality)))
        .withColumn(
            "outcome",
            F.when(~accepted, F.lit("REJECTED"))
            .when(F.size("flags") > 0, F.lit("FLAGGED"))
            .otherwise(F.lit("ACCEPTED")),
        )
        .withColumn("mapping_version", F.lit(mapping.version))
        .withColumn("quality_rules_version", F.lit(quality.version))
        .transform(with_observation_id)
        .drop("expected_unit")
    )


def with_observation_id(obs: DataFrame) -> DataFrame:
    return obs.withColumn(
        "observation_id",
        observation_id(*[F.col(c) for c in ("facility_id", "source_system", "source_epoch", "source_sequence", "source_tag")]),
    )
