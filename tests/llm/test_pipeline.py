"""The pipeline and the registered queries against versions that look at everything at once."""

from __future__ import annotations

import hashlib

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sensorloom.llm import language, quality, queries
from sensorloom.llm.tables import table
from tests.llm import cases
from tests.llm.test_dedup import brute_fingerprint, brute_line_dedup, reach
from tests.llm.test_text import brute_contamination

SF = "/root/testdata/sf0.001"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def groups(texts: dict[int, str]) -> dict[int, int]:
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    return reach(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])


def test_run_equals_the_stages_done_by_hand(spark):
    documents = table(spark, SF, "documents")
    model = quality.fit(documents, table(spark, SF, "labels"))
    texts = {r.doc_id: r.text for r in documents.collect()}
    texts = {i: t for i, t in texts.items() if model.score(quality.indicators(t)) >= quality.THRESHOLD}
    assert 0 < len(texts) < documents.count()
    texts = {i: t for (i, _), t in brute_line_dedup(sorted(texts.items())).items()}
    texts = {i: texts[i] for i, c in groups(texts).items() if i == c}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in brute_contamination(texts.items(), items) if r[-1]}
    assert bad
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in texts.items():
        if i not in bad:
            ids = library.encode(t, add_special_tokens=False).ids
            expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(expected)


def test_stages_on_hard_cases(spark):
    for docs in (cases.documents(spark), cases.no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns, name
            assert got.count() <= docs.count(), name


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.component_id for r in queries.op3_simhash(spark, SF).collect()} == groups(texts)


def test_bpe_query(spark):
    library = Tokenizer.from_file(queries.TOKENIZER)
    for r in queries.op2_bpe(spark, SF).join(table(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))


@pytest.mark.parametrize("name", ["op4_language_id", "op8_quality_classifier"])
def test_held_out_rows_are_those_of_the_contract(spark, name):
    import zlib

    parts, part = (language.HELD_OUT_PARTS, language.HELD_OUT_PART) if name.startswith("op4") else (quality.HELD_OUT_PARTS, quality.HELD_OUT_PART)
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1


def test_embedding_query(spark):
    rows = queries.op6_embedding_dedup(spark, SF).collect()
    assert len(rows) == table(spark, SF, "embeddings").count()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_substring_query_names_documents_that_share_a_long_line(spark):
    lines = table(spark, SF, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.size(F.split("line", " ")) >= 60)
    shared = lines.groupBy("line").agg(F.collect_set("doc_id").alias("ids")).where(F.size("ids") > 1).collect()
    found = {r.doc_id for r in queries.op7_substring_dedup(spark, SF).collect()}
    assert shared and {i for r in shared for i in r.ids} <= found
