from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sensorloom.llm import bpe, decontamination, language, language_model, licenses, quality
from sensorloom.llm.tables import table
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def key(r) -> str:
    return str(tuple(r))


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    expected = []
    for doc, text, *_ in cases.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(key, bpe.digests(cases.documents(spark), PATH).collect())) == sorted(map(key, expected))
    assert bpe.digests(cases.no_documents(spark), PATH).collect() == []


def test_bpe_words_of_all_kinds():
    library, known, rng = Tokenizer.from_file(PATH), bpe.Words(PATH), random.Random(3)
    parts = ["the", "it's", "I'LL", "aaaa" * 9, "ΣΑΣ", "é", "İ", "ǅ", "中文", "😀", "²", "Ⅷ", "12", "!!", "<|endoftext|>", "<|endo", "\x1c", "\x85", " ", "​", "\n\n", "_", "ﬁ", "𐐀", "ไ", "\x00", "hahaha" * 20]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    for text, words in zip(texts, known.of(iter(texts))):
        ids = [i for w in words for i in known.ids[w].tolist()]
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_encode_then_decode(spark):
    library = Tokenizer.from_file(PATH)
    docs = cases.documents(spark)
    encoded = bpe.encode(docs, PATH)
    got = sorted(key((r.doc_id, r.text)) for r in bpe.decode(encoded, PATH).collect())
    expected = [(d, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t, *_ in cases.rows()]
    assert got == sorted(map(key, expected))


def brute_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted(str(x) for x in found if x is not None)
        yield doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bits", [decontamination.BITMAP_BITS, 64])
def test_decontamination(spark, bits, monkeypatch):
    monkeypatch.setattr(decontamination.find_hits, "__defaults__", (decontamination.SIZE, bits))
    rows = cases.rows()
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    items = [(1, long[0]), (2, long[0][:60]), (3, "word word"), (4, None), (5, ""), (6, " ".join(long[1].split()[3:20])), (6, " ".join(long[1].split()[3:20])), (10, "X"), (None, long[2]), (7, "ÉLAN élan")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, w string")
    got = decontamination.contamination(cases.documents(spark), benchmark).drop("spans").collect()
    expected = list(brute_contamination([r[:2] for r in rows], items))
    assert sorted(map(key, got)) == sorted(map(key, expected))
    assert 0 < sum(r.contaminated for r in got) < len(got)
    kept = decontamination.drop_contaminated(cases.documents(spark), benchmark)
    assert {r.doc_id for r in kept.collect()}.isdisjoint({r[0] for r in expected if r[-1] and r[0] is not None})


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(cases.documents(spark), none).collect()
    assert len(got) == len(cases.rows()) and not any(r.contaminated or r.spans for r in got)
    one = spark.createDataFrame([(1, "word word")], "item_id long, text string")
    assert decontamination.contamination(cases.no_documents(spark), one).collect() == []


def test_quality_on_held_out_rows(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.score(documents, quality.fit(documents, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(60)] + [(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 1, 0)], "doc_id long, quality int, score int")
    docs = cases.documents(spark)
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    again = quality.score(docs, quality.fit(docs, labels)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == len(got) and quality.keep_good(docs, none).columns == docs.columns
    assert quality.score(cases.no_documents(spark), model).collect() == []


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[rng.integers(0, 400, 30), 500 + i % 2]).astype(np.int32) for i in range(200)]
    good = np.arange(200) % 2 == 1
    model = quality.train(rows, good, 0.5)
    assert np.mean([(model.margin(r) > 0) == g for r, g in zip(rows, good)]) > 0.98


def test_language_on_held_out_rows(spark):
    documents = table(spark, SF, "documents")
    got = language.identify(documents, language.fit(documents)).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97


def test_number_signs_are_no_letters():
    texts = ["²", "½ Ⅷ ①", "12 _ -", "", None, "a", "é²", "½ 中"]
    assert [language.has_letter(t) for t in texts] == [False] * 5 + [True] * 3


def test_language_edge_cases(spark):
    docs = cases.documents(spark)
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und")
    assert {r.lang_pred for r in got if r.doc_id in (40, 41, 42, 43, 44, 47)} == {"und"}
    none = language.fit(cases.no_documents(spark))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(cases.no_documents(spark), none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 20])
def test_codewords_differ(n):
    code = language.codewords(n)
    apart = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
    assert min(apart, default=1) >= (1 if n < 6 else 4)


def two_folds(rows, order):
    """Scores by stupid backoff with the counts of the other fold."""
    fold = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[0] >= "8")
    by_doc = {}
    for doc, text in rows:
        by_doc.setdefault(doc, []).append(language_model.words_of(text))
    counts = [[Counter(tuple(t[i : i + k]) for d, texts in by_doc.items() if fold(d) != f for t in texts for i in range(len(t) - k + 1))
               for k in range(1, order + 1)] for f in (0, 1)]

    def s(gram, c):
        if len(gram) == 1:
            return c[0].get(gram, language_model.UNSEEN) / max(1, sum(c[0].values()))
        seen = c[len(gram) - 1][gram]
        return seen / c[len(gram) - 2][gram[:-1]] if seen else language_model.BACKOFF * s(gram[1:], c)

    for d, texts in by_doc.items():
        grams = [tuple(t[max(0, j - order + 1) : j + 1]) for t in texts for j in range(len(t))]
        yield d, sum(map(len, texts)), sum(math.log(s(g, counts[fold(d)])) for g in grams)


@pytest.mark.parametrize(("order", "bits"), [(2, language_model.BITMAP_BITS), (3, language_model.BITMAP_BITS), (4, 64)])
def test_language_model(spark, order, bits):
    """Rare words, shared ones, short texts and repeated rows; with a bitmap that knows everything too."""
    rows = [r[:2] for r in cases.rows()] + [(900 + i, " ".join(f"u{i % 3}x{j}" for j in range(900))) for i in range(6)]
    rows += [(1000, "w1"), (1001, "only"), (1002, "w1 w2"), (1003, "two alone"), (1004, "w1 w2 w3"), (900, "u1x5 u1x6")]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), order, bits).collect()}
    expected = list(two_folds(rows, order))
    assert got.keys() == {d for d, _, _ in expected}
    for d, words, score in expected:
        assert got[d].log_score == pytest.approx(score, abs=1e-4) and got[d].n_words == words
        assert (got[d].mean_log_score is None) == (words == 0)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("share", [1, 8, 40, 10**9])
def test_language_model_wherever_records_meet(spark, order, share):
    """Nothing is frequent, some words, some words and longer n-grams, or all: the scores are the same."""
    rng = random.Random(share)
    rows = [(i if i % 9 else None, " ".join(rng.choices("abcdef", [20, 8, 4, 2, 1, 1], k=rng.choice([0, 1, 2, 3, 60])))) for i in range(60)]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), order, frequent_share=share).collect()}
    expected = list(two_folds(rows, order))
    assert got.keys() == {d for d, _, _ in expected}
    for d, words, score in expected:
        assert got[d].log_score == pytest.approx(score, abs=1e-6) and got[d].n_words == words


def test_language_model_moves_one_record_for_each_word():
    """What is dealt out does not grow with the order: a word has one record, or two around a frequent one."""
    rng = np.random.default_rng(5)
    word, sizes = rng.integers(0, 1 << 62, 30_000, dtype=np.uint64), np.full(30, 1000)
    word[::5] = 7
    packed = pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes()], pa.binary()) for x in (np.arange(30), np.zeros(30, np.uint8), sizes, word)], ["docs", "flags", "sizes", "words"]
    )
    frequent = language_model.Frequent(language_model._gram(word[:1], np.array([0]), 1), 64)
    slices = [[b for b in language_model._deal(3, frequent, 4, i)(iter([packed]))] for i in range(language_model.SLICES)]
    found = [sum(len(x.as_py()) // 8 for b in part for x in b["docs"]) for part in slices]
    assert sum(found) == 30_000 * 6 // 5 and max(found) < 1.2 * sum(found) / language_model.SLICES
    assert {x.as_py() % language_model.SLICES for b in slices[3] for x in b["group"]} == {3}


def test_language_model_groups_do_not_grow_with_the_corpus(spark, monkeypatch):
    """However many words there are, what is dealt to one place has a fixed number of records at most."""
    monkeypatch.setattr(language_model, "RECORDS_OF_GRAM", 100, raising=False)
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words, k=300))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = docs.selectExpr("struct(doc_id, 0 as fold) as id", "text").repartition(3).mapInArrow(language_model._packed, language_model.PACKED)
    frequent = language_model._frequent(packed, 3, 4, 64, 200 * 300)
    dealt = Counter()
    for row in packed.collect():
        sizes, word = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64)
        for kind, by, *_ in language_model._records(word, sizes, 1, frequent, lambda by: np.ones(len(by), bool)):
            dealt.update((kind, x) for x in by.tolist())
    assert max(dealt.values()) <= 200
    assert len(frequent.bitmap) > 4 * len(frequent.grams)
    got = {r.doc_id: r for r in language_model.score(docs, frequent_share=4).collect()}
    for d, n, score in two_folds(rows, 3):
        assert got[d].n_words == n and got[d].log_score == pytest.approx(score, abs=1e-6)


def test_language_model_of_hard_tables(spark):
    docs = cases.documents(spark)
    assert language_model.score(docs.limit(0)).collect() == []
    assert {r.doc_id: r.n_words for r in language_model.score(docs).collect()} == {d: n for d, n, _ in two_folds([r[:2] for r in cases.rows()], 2)}
    alone = language_model.score(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert alone.n_words == 3 and math.isfinite(alone.log_score)


def test_nonsense_scores_below_text(spark):
    """Text that only one document has, and text in a wrong order, score below the text itself."""
    rng = random.Random(11)
    following = {w: [rng.choice(cases.WORDS) for _ in range(3)] for w in cases.WORDS}

    def prose(n):
        out = [rng.choice(cases.WORDS)]
        while len(out) < n:
            out.append(rng.choice(following[out[-1]]))
        return out

    text = prose(300)
    shuffled = rng.sample(text, len(text))
    rows = [(i, " ".join(prose(400))) for i in range(60)]
    rows += [(1000, " ".join(text)), (1001, " ".join(shuffled)), (1002, " ".join(f"zq{i}" for i in range(300)))]
    got = {r.doc_id: r.mean_log_score for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1002] == min(got.values()) and got[1001] < got[1000] - 1
    assert got[1001] < min(v for d, v in got.items() if d < 1000)


def brute_licenses(files):
    words = lambda t: re.findall(r"[a-z0-9+]+", (t or "").lower())
    templates = [(n, Counter(words(t))) for n, t in licenses.TEMPLATES]
    known = {w for _, t in templates for w in t}
    total = len(files)
    idf = lambda w: math.log((1 + total) / (1 + sum(w in words(t) for _, t in files))) + 1
    cache = {w: idf(w) for w in known | {w for _, t in files for w in words(t)}}
    weigh = lambda c: {w: n * cache[w] for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(n, weigh(t)) for n, t in templates]
    own, given = [], {}
    for path, text in files:
        best = []
        for line, unit in [(-1, text or ""), *enumerate((text or "").split("\n"))]:
            v = weigh(Counter(words(unit)))
            if sum(w in known for w in words(unit)) < licenses.LEAST_TERMS:
                continue
            c, n = max(((round(sum(v.get(w, 0) * x for w, x in t.items()) / norm(t) / norm(v), 9), name) for name, t in vectors), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            if c >= licenses.THRESHOLD:
                best.append((-c, line, n))
                if line == -1 and path is not None:
                    d = path.rpartition("/")[0]
                    given[d] = min(given.get(d, (0, "", "")), (-c, path, n))
        own.append(min(best, default=None))
    for (path, _), o in zip(files, own):
        if o:
            yield path, o[2], -o[0], False
            continue
        d, found = (path or "").rpartition("/")[0], None
        while path is not None and found is None:
            found = given.get(d)
            if not d:
                break
            d = d.rpartition("/")[0]
        yield path, found[2] if found else None, -found[0] if found else 0.0, found is not None


def test_licenses(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice("the of code license version this under alpha beta gamma delta".split()) for _ in range(40))
    files = [
        ("LICENSE", "All rights reserved."), ("a/LICENSE", licenses.TEMPLATES[0][1]), ("a/x.py", prose()), ("a/b/c/y.py", prose() + "\n" + prose()),
        ("a/b/LICENSE", "Released under the MIT license"), ("a/b/COPYING", "Licensed under CC BY 4.0"), ("d/z.py", "# Licensed under the Apache License, Version 2.0\n" + prose()),
        ("d/e/w.py", prose()), (None, "All rights reserved."), (None, prose()), ("q", None), ("", ""), ("a/b/x", ""), ("a/x.py", prose()), ("a//u", "x" * 20_000),
        ("m/n", "\n".join([prose(), "This work is licensed under the GNU General Public License, version 3.", prose()])),
    ]
    table_ = spark.createDataFrame([(*f, 3, "k") for f in files], "path string, text string, file int, licence string")
    got = sorted(key((r.path, r.licence, round(r.cosine, 6), r.inherited)) for r in licenses.scan_licenses(table_).collect())
    assert got == sorted(key((p, n, round(c, 6), i)) for p, n, c, i in brute_licenses(files))
    assert licenses.scan_licenses(table_.limit(0)).collect() == []


@pytest.mark.parametrize("n", [100, 100_000])
def test_common_foreign_words_weigh_little(spark, n):
    """A notice among words that most files have is found however many files there are; rare words still hide it."""
    from pyspark.sql import functions as F

    files = spark.range(n).select(F.concat(F.lit("p/"), "id").alias("path"), F.when(
        F.col("id") == 0, "This file is released under the MIT license. See LICENSE for details.").when(
        F.col("id") == 1, "Zork is released under qux MIT foo license bar baz quux zip zap.").otherwise(
        "see this file for details of what it does").alias("text"))
    got = {r.path: r for r in licenses.scan_licenses(files).where("path in ('p/0', 'p/1')").collect()}
    assert got["p/0"].licence == "MIT" and got["p/0"].line == -1 and not got["p/0"].inherited
    assert got["p/1"].line is None


def test_licence_units_of_many_rare_words_are_discarded(spark):
    """A notice among 200 words that no other file has cannot match; the bound by word frequencies tells, before terms are exploded."""
    from pyspark.sql import functions as F

    notice = dict(licenses.TEMPLATES)["MPL-2.0"]
    rare = " ".join(f"rare{i}x" for i in range(200))
    files = [("a/long", f"{notice} {rare}"), ("b/short", f"{notice} thanks"), *[(f"c/{i}", "alpha beta gamma delta of the code") for i in range(300)]]
    table_ = spark.createDataFrame(files, "path string, text string")
    units, _, _ = licenses.candidate_units(table_, licenses.TEMPLATES, licenses.THRESHOLD)
    assert {r.path for r in units.where(F.size("units") > 0).collect()} == {"b/short"}
    got = {r.path: (r.licence, r.inherited) for r in licenses.scan_licenses(table_).collect()}
    assert got["b/short"] == ("MPL-2.0", False) and got["a/long"] == (None, False)
