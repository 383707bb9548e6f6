from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from sensorloom.llm import components, line_dedup, passages, simhash
from tests.llm import cases


def reach(nodes, linked):
    """Smallest node each node reaches, by search."""
    near = defaultdict(set)
    for a, b in linked:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = n
                stack.extend(near[x])
    return out


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    links = {
        "random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)],
        "path": [(i, i + 1) for i in range(-40, 60)],
        "star": [(500, i) for i in range(400)],
        "none": [],
    }[shape]
    table = spark.createDataFrame([*links, (None, 1), (3, 3)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.connected_components(table).collect()}
    expected = reach({x for e in links for x in e}, links)
    assert {k: v for k, v in got.items()} == {k: v for k, v in expected.items() if any(k in e and e[0] != e[1] for e in links)}


def brute_fingerprint(text):
    words = [w for w in _words(text)]
    if not words:
        return 0
    k = min(3, len(words))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _words(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


@pytest.mark.parametrize("limit", [simhash.GROUP_LIMIT, 2])
def test_simhash(spark, limit):
    docs = cases.documents(spark)
    got = simhash.near_duplicates(docs, group_limit=limit).collect()
    rows = cases.rows()
    prints = [brute_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    group = reach(range(len(rows)), links)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[group[i]] = r[0] if least[group[i]] is None else min(r[0], least[group[i]])
    expected = sorted((str(r[0]), f"{p:016x}", str(least[group[i]])) for i, (r, p) in enumerate(zip(rows, prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected


def test_simhash_agrees_with_spark_hash(spark):
    text = "One Two three FOUR é five"
    low = "one two three four é five".split()
    grams = [" ".join(low[i : i + 3]) for i in range(4)]
    hashes = [r[0] % (1 << 64) for r in spark.createDataFrame([(g,) for g in grams], "g string").selectExpr("xxhash64(g)").collect()]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 4)


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(3)
    for budget in (0, 1, 2, 3):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        keys = np.unique(np.array([int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(6)], np.uint64))
        a, b = simhash.trie_links(keys, np.zeros(len(keys), np.int64), budget)
        near = np.triu(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget, 1)
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_simhash_keeps_one_of_each_group(spark):
    docs = cases.documents(spark)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    assert {r.doc_id for r in kept.collect()} - {None} == set(groups.values())


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(cases.no_documents(spark)).collect() == []


def line_chunks(lines):
    """(start, end) of each multi-line chunk, those across boundaries after the others."""
    h = [int(hashlib.md5(line.encode()).hexdigest()[: line_dedup.HASH_DIGITS], 16) for line in lines]
    roll = [x + line_dedup.MULTIPLIER * (h[i - 1] if i else 0) for i, x in enumerate(h)]
    last = [i for i in range(1, len(h) - 2) if roll[i] < roll[i - 1] and roll[i] <= roll[i + 1]] + [len(h) - 1]
    chunks = [(a + 1, b + 1) for a, b in zip([-1, *last], last)]
    return [c for c in chunks if c[1] - c[0] > 1], [(i, i + 2) for i in last[:-1]]


def brute_line_dedup(rows):
    """What is left of each text, by (document, text): whole repeated chunks go, then all equal lines beside them, however far."""
    docs = {(doc, text): text.split("\n") for doc, text, *_ in rows if doc is not None and text is not None}
    order = sorted(docs, key=lambda d: (d[0], xxhash.xxh64_intdigest(d[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(d[1].encode(), 42) >> 63)))
    places = defaultdict(list)
    for d in order:
        plain, seams = line_chunks(docs[d])
        for start, end in sorted(plain + seams):
            places["\n".join(docs[d][start:end])].append((d, start, end))
    gone = {d: set() for d in order}
    cut_chunks = set()
    for found in places.values():
        cut_chunks.update(found[1:])
    for (first, at, _), *copies in places.values():
        for d, start, end in copies:
            gone[d].update(range(start, end))
            own, other = docs[d], docs[first]
            whole = [c for c in line_chunks(own)[0] if (d, *c) in cut_chunks]
            cut_before, cut_after = (any(a <= line < b for a, b in whole) for line in (start - 1, end))
            k = 1
            while not cut_before and min(start, at) >= k and own[start - k] == other[at - k]:
                gone[d].add(start - k)
                k += 1
            k, shift = end, at - start
            while not cut_after and k < len(own) and k + shift < len(other) and own[k] == other[k + shift]:
                gone[d].add(k)
                k += 1
    return {d: "\n".join(line for i, line in enumerate(docs[d]) if i not in gone[d]) for d in order}


def test_line_dedup(spark):
    rows = cases.rows(n=60)
    docs = cases.documents(spark, n=60)
    got = line_dedup.dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    got = got.collect()
    expected = brute_line_dedup(rows)
    wanted = [(r[0], expected[r[:2]] if None not in r[:2] else r[1]) for r in rows]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, wanted))
    assert sum(r["_n_cut_chunks"] for r in got) > 0
    assert line_dedup.dedup_lines(cases.no_documents(spark)).collect() == []


def test_line_dedup_of_pasted_blocks(spark):
    """Blocks at foreign offsets, of many lengths, in documents that share ids with others: equal to brute force."""
    rng = random.Random(4)
    lines = [f"line {rng.random()}" for _ in range(400)]
    rows = []
    for i in range(150):
        start, n = rng.randrange(380), rng.randint(1, 16)
        own = lambda: [f"own {rng.random()}" for _ in range(rng.randint(0, 3))]
        rows.append((i // 2, "\n".join(own() + lines[start : start + n] + own() + ["same"] * rng.randint(0, 4))))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_line_dedup(rows)
    assert sorted((r.doc_id, r.text) for r in got) == sorted((d, expected[d, t]) for d, t in rows)


def test_line_dedup_cuts_whole_blocks(spark):
    block = [f"the block has line {i} {i * i}" for i in range(8)]
    rows = [
        (1, "\n".join(block)), (2, "\n".join(["one before", *block, "one after"])), (3, "\n".join(["two", "before", *block])),
        (2, "another text of this id\nof two lines"), (4, "nothing here\nis shared"),
    ]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r["_n_cut_lines"]) for r in got) == [
        (1, rows[0][1], 0), (2, rows[3][1], 0), (2, "one before\none after", 8), (3, "two\nbefore", 8), (4, rows[4][1], 0),
    ]


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """With a hash that takes all chunks for equal, only equal bytes are cut."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"a{i % 3}\nb{i % 3}\nc{i % 3}") for i in range(9)], "doc_id long, text string")
    plain = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == plain


def test_passages_move_with_their_surroundings(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(4000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + ". "
    passage = "".join(say(13) for _ in range(5))
    near = passage.replace(passage.split()[30], "changed", 1)
    rows = [(i, "\n".join(say(12) * 1 + say(14) for _ in range(4)), 1) for i in range(12)]
    rows += [(20, say(12) + passage + say(11), 1), (21, passage.strip(), 1), (22, say(6) + say(9) + near, 1), (23, say(15) + "\n" + passage + "\n" + say(8), 1)]
    rows += [(30, None, 1), (31, "", 1), (None, passage, 1), (23, rows[-1][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {20, 21, 22, 23}
    assert {r.component_id for r in got} == {20}
    assert {r.doc_id: r.n_removed_words for r in got}[20] == 0
    cut = {r.doc_id: r.text for r in passages.cut_passages(docs).collect() if r.doc_id is not None}
    assert cut[21].strip() == "" and cut[20] == rows[12][1] and len(cut[23].split()) < 30
    assert cut[0] == rows[0][1]
    assert passages.repeated_passages(cases.no_documents(spark)).collect() == []


def test_passages_of_any_shape(spark):
    """Equal words at foreign offsets: no sentence ends, lines of three words, two sentences whose ends join foreign words."""
    rng = random.Random(6)
    fresh = iter(range(10**6))
    some = lambda n: [f"z{next(fresh)}" for _ in range(n)]
    plain, long, two = some(60), some(400), some(30) + some(30)
    two[29] += "."
    lines = lambda w: "\n".join(" ".join(w[i : i + 3]) for i in range(0, len(w), 3))
    short, few = some(60), some(49)
    say = " ".join
    rows = [(1, say(some(7) + plain + some(90))), (2, say(some(41) + plain + some(3))), (3, say(some(5) + long)), (4, say(some(97) + long + some(9))),
            (5, say(some(6)) + "\n" + lines(short) + "\n" + say(some(6))), (6, lines(some(1) + short)), (7, say(some(9) + two + some(8)) + "."), (8, say(some(13) + two + some(20)) + "."),
            (9, say(some(5) + few + some(5))), (10, say(some(8) + few + some(2))), (11, "same " * 300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed_words, r.component_id) for r in passages.repeated_passages(docs).collect()}
    assert got == {1: (60, 0, 1), 2: (60, 60, 1), 3: (400, 0, 3), 4: (400, 400, 3), 5: (60, 0, 5), 6: (60, 60, 5), 7: (60, 0, 7), 8: (60, 60, 7), 11: (300, 250, 11)}
    before = dict(rows)
    for doc, text in ((r.doc_id, r.text) for r in passages.cut_passages(docs).collect()):
        assert len(before[doc].split()) - len(text.split()) == got.get(doc, (0, 0))[1]


def test_passage_components_match_brute_force(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randint(12, 40))] for _ in range(15)]
    pieces = []
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(words)
            pieces.append(c)
    docs = spark.createDataFrame([(i, " ".join(p) + ".") for i, p in enumerate(pieces)], "doc_id long, text string")
    shingles = [{tuple((" ".join(p) + ".").split()[i : i + 5]) for i in range(len(p) - 4)} for p in pieces]
    links = [(i, j) for i in range(len(pieces)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    expected = reach(range(len(pieces)), links)
    for block in (passages.BLOCK, 3):
        found = passages.repeated_pieces(docs, min_words=1, block=block).collect()
        got = {r.doc_id: r.component_id for r in found}
        assert got == {i: c for i, c in expected.items() if any(i in e for e in links)}


def test_edge_cases_of_passages(spark):
    passages.repeated_passages(cases.documents(spark)).collect()
    cut = passages.cut_passages(cases.documents(spark))
    assert cut.columns == cases.documents(spark).columns and cut.count() == len(cases.rows())


def test_copies_name_no_runs_of_their_own(spark, monkeypatch):
    """Runs are named once for each different span around a repeated anchor, however many texts have it."""
    made, write = {}, passages.materialize

    def counted(df, label):
        out = write(df, label)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    text = " ".join(f"v{i}" for i in range(400))
    rows = [(i, text) for i in range(40)]
    rows += [(50, "x " + text[: text.index(" v120")] + " y"), (51, "z\n" + text[: text.index(" v120")])]
    rows += [(60, "p q " * 60)]
    got = sorted(map(tuple, passages.equal_runs(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "at", "till", "removed").collect()))
    assert [r[:3] for r in got if r[0] == 0] == [(0, 0, 400)] and {r for r in got if 0 < r[0] < 40} == {(i, 0, 400, True) for i in range(1, 40)}
    assert [r for r in got if r[0] in (50, 51)] == [(50, 1, 121, True), (51, 1, 121, True)]
    assert {r[0] for r in got} == {*range(40), 50, 51, 60}
    assert made["windows"] < 351  # one text has 351 runs, all have 14,000
