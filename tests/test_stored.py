from __future__ import annotations

from checks import fixtures as fx
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_positions_come_from_the_stored_canonical_rows(spark, monkeypatch):
    read = {}

    def kept(df, label):
        read[label] = {f.split("/")[-2] for f in df.inputFiles()}
        return materialize(df, label)

    materialize = fx.materialize
    monkeypatch.setattr(fx, "_stored", {})
    monkeypatch.setattr(fx, "materialize", kept)
    done = fx.stored(spark, SF)
    assert len(read["positions"]) == 1 and read["positions"].pop().startswith("canonical-")
    other = fx.process_batches(fx.delivery(spark, SF), fx.MAPPING_0, fx.QUALITY).positions
    assert sorted(map(tuple, done.positions.collect())) == sorted(map(tuple, other.collect())) != []


def test_a_document_is_not_parsed_once_for_each_field(spark):
    plan = QUERIES["canonical_document"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("json_tuple") == 2
