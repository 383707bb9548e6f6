"""Every registered query beside its comparison SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import pytest

from checks.compare import difference, duck
from checks.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def engine():
    return duck(SF)


def test_every_comparison_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    table = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        assert difference(table, engine.execute(ORACLES[name]).to_arrow_table()) is None
    else:
        assert table.num_rows > 0


# Counts stated in FIXTURES.md, obtained independently of this library.
STATED = {
    ("sf0.001", "1.0.0"): (99, 396, 21, 418, 29, 74, 3, 24, 372, 0, 14),
    ("sf0.01", "1.0.0"): (2049, 2907, 196, 4192, 299, 707, 50, 259, 2646, 24, 217),
    ("sf0.001", "1.1.0"): (128, 540, 28, 212, 43, 86, 3, 35, 505, 0, 19),
    ("sf0.01", "1.1.0"): (2778, 3897, 262, 2104, 401, 884, 74, 350, 3543, 29, 286),
}


@pytest.mark.parametrize(("sf", "version"), sorted(STATED))
def test_stated_counts(spark, sf, version):
    from pyspark.sql import functions as F

    from checks import fixtures as fx
    from sensorloom.plans.process import process_batches
    from sensorloom.rules import mapping_rules

    deliveries = fx.delivery(spark, f"/root/testdata/{sf}")
    done = process_batches(deliveries, mapping_rules(f"controller-a-mapping-{version}"), fx.QUALITY)
    stored = F.col("outcome").isin("ACCEPTED", "FLAGGED")
    codes = ["UNKNOWN_SOURCE_TAG", "UNSUPPORTED_RAW_UNIT", "VALUE_OUT_OF_RANGE", "TIMESTAMP_TOO_FAR_IN_FUTURE"]
    row = done.outcomes.agg(
        *[F.count_if(F.col("outcome") == o) for o in ("ACCEPTED", "FLAGGED", "DUPLICATE")],
        *[F.count_if(F.col("reason_code") == c) for c in codes],
        *[F.count_if(stored & F.array_contains("flags", f)) for f in ("FUTURE_TIMESTAMP", "LATE_ARRIVAL", "OUT_OF_ORDER")],
        F.count_if("out_of_order"),
    ).first()
    assert tuple(row) == STATED[sf, version]
