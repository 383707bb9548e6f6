"""Substring dedup: MinHash banding of paragraph pieces, exact verification, removal by components.

A paragraph (line) is cut at sentence ends, so that a passage keeps its pieces wherever it is
pasted. Pieces whose sketches of word shingles collide in a band are candidates; bands of two
minima are tuned for recall (0.998 at the threshold) and exact Jaccard similarity of the shingle
sets decides. Linked pieces form components; a passage is a run of neighbouring pieces that occur
elsewhere too, of at least ``MIN_WORDS`` words in all; one piece that does not, say for a changed
word, may lie between two that do. Every occurrence of a piece but the first goes.

Where texts have ``EXACT`` equal words in a row, wherever pieces, lines or sentences begin, those are a
passage too. Each run of ``EXACT`` words has an anchor, the smallest hash of ``ANCHOR`` words in it; neighbours
around one anchor make a span, known by the hash of all its words. Equal runs have equal anchors, so where an anchor has
one span only, all its runs occur where the span does; the runs of others are named and counted, once for each
different span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.components import connected_components
from sensorloom.llm.tables import bounded_batches, id_and_text
from sensorloom.runtime import materialize, materialize_alone

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 6, 2
MIN_WORDS = 40
EXACT = 50
ANCHOR = 16
MOST_BRIDGED = 1
LONGEST = 64
BLOCK = 2048
SEEN_PIECES = 300_000
CHARS_AT_ONCE = 250_000
SMALL_GROUP = 12
#: Parts, by name and by span, in which windows are matched and joined up one after the other, so that disk holds the shuffle of one.
SLICES = 4
SPANS = "doc_id long, at int, n int, span long, anchor long, place int, cuts array<tinyint>"
WINDOWS = "span long, k int, name long, first_id long, first_at int, last_id long, last_at int"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D  # odd, so its powers have inverses modulo 2**64
_rng = np.random.default_rng(7)
SCALE = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MULTIPLIER
    return x ^ x >> np.uint64(29)


def _runs(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run values[first:last], whatever its place, from one running sum."""
    up, down = _powers(1 << max(16, int(len(values)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(values * up[: len(values)])]
    return _mix((total[last] - total[first]) * down[first])


@dataclass(frozen=True)
class Cut:
    """Texts cut into pieces: words by hash, pieces by their first word and number of words."""

    joined: bytes
    text: np.ndarray  # of each piece: which text
    place: np.ndarray  # of each piece: its number in the text
    first: np.ndarray
    count: np.ndarray
    word: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray
    text_start: np.ndarray

    def names(self) -> np.ndarray:
        """Signed 64-bit name of each piece's words; 0 for those that are too short to shingle."""
        names = _runs(self.word, self.first, self.first + self.count) | np.uint64(1)
        return np.where(self.count < SHINGLE, np.uint64(0), names).view(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, its number in the text, anchor's number in the text) of each run of ``EXACT`` words."""
        none = np.empty(0, np.int64)
        if len(self.word) < EXACT:
            return none, none, none, none
        text = np.searchsorted(self.text_start, self.word_start, "right") - 1
        at = np.flatnonzero(text[: len(text) - EXACT + 1] == text[EXACT - 1 :])
        begin = np.arange(len(self.word) - ANCHOR + 1)
        grams = np.lib.stride_tricks.sliding_window_view(_runs(self.word, begin, begin + ANCHOR), EXACT - ANCHOR + 1)
        nearest = np.concatenate([none, *(grams[at[k : k + 10_000]].argmin(axis=1) for k in range(0, len(at), 10_000))])
        number = at - np.searchsorted(self.word_start, self.text_start)[text[at]]
        return text[at], at, number, number + nearest

    def places(self, word: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.first, word, "right") - 1]

    def words_of(self, piece: int) -> bytes:
        last = self.first[piece] + self.count[piece] - 1
        return self.joined[self.word_start[self.first[piece]] : self.word_end[last]]


def cut_texts(texts: list[str | None]) -> Cut:
    """Cut whole texts into pieces; words are runs without ASCII white space, A-Z lower-cased.

    A sentence (up to a word that ends in ".", "!" or "?", or the line's end) is a piece; one of fewer
    than ``SHINGLE`` words joins the piece before it in its line, if any. Sentences of more than
    ``LONGEST`` words are cut after each ``LONGEST``.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw).lower()
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    text_start = np.cumsum(lengths + 1) - lengths - 1
    b = np.frombuffer(joined, np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.r_[np.int8(1), white.view(np.int8), np.int8(1)])
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    none = np.empty(0, np.int64)
    if not len(start):
        return Cut(joined, none, none, none, none, np.empty(0, np.uint64), none, none, text_start)
    word = _runs(b.astype(np.uint64) + np.uint64(1), start, end)
    line = np.cumsum(b == 10)[start]
    new_line = np.r_[True, line[1:] != line[:-1]]
    closing = np.isin(b[end - 1], np.frombuffer(b".!?", np.uint8))
    opens = new_line | np.r_[True, closing[:-1]]
    first = np.flatnonzero(opens)
    size = np.diff(np.r_[first, len(start)])
    within = np.arange(len(start)) - np.repeat(first, size)
    piece = np.zeros(len(start), bool)
    piece[first[(size >= SHINGLE) | new_line[first]]] = True
    piece |= (np.repeat(size, size) > LONGEST) & (within % LONGEST == 0) & (within > 0)
    first = np.flatnonzero(piece)
    text = np.searchsorted(text_start, start[first], "right") - 1
    new_text = np.r_[True, text[1:] != text[:-1]]
    at = np.arange(len(first))
    place = at - np.maximum.accumulate(np.where(new_text, at, 0))
    return Cut(joined, text, place, first, np.diff(np.r_[first, len(start)]), word, start, end, text_start)


def shingles(cut: Cut, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the word shingles of the chosen pieces; shorter pieces are one shingle."""
    counts = np.maximum(1, cut.count[chosen] - SHINGLE + 1)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(cut.first[chosen], counts) + nth
    size = np.minimum(np.repeat(cut.count[chosen], counts), SHINGLE)
    out = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        out = out * MULTIPLIER + np.where(k < size, cut.word[np.minimum(at + k, len(cut.word) - 1)], np.uint64(0))
    return _mix(out), counts


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(pieces, BANDS) signed keys: each band's minima of ``ROWS`` rehashed shingle sets."""
    first = np.cumsum(counts) - counts
    keys = np.zeros((len(counts), BANDS), np.uint64)
    for j in range(BANDS * ROWS):
        mixed = hashes * SCALE[j]
        mixed ^= mixed >> np.uint64(31)
        mixed *= MULTIPLIER
        low = np.minimum.reduceat(mixed, first)
        keys[:, j // ROWS] = _mix(keys[:, j // ROWS] * SCALE[j] + low)
    return _mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _groups_of_texts(batch: pa.RecordBatch, chars: int = CHARS_AT_ONCE) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Ids and texts of a batch in groups of about ``chars`` characters: bounded arrays, few calls."""
    ids, texts, held = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py()
        ids.append(doc)
        texts.append(text)
        held += len(text or "") + 1
        if held >= chars:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _texts(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).where("doc_id is not null and text is not null")


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Cut, np.ndarray, np.ndarray]]:
    """(texts, pieces, names) of the pieces that this task has not met lately: copies meet early."""
    seen = np.empty(0, np.int64)  # sorted; an array has a tenth of a set's size
    for batch in batches:
        for _, texts in _groups_of_texts(batch):
            cut = cut_texts(texts)
            names, at = np.unique(cut.names(), return_index=True)
            if len(seen) > SEEN_PIECES:
                seen = seen[:0]
            place = np.searchsorted(seen, names)
            new = (names != 0) & (np.r_[seen, 0][place] != names)
            seen = np.insert(seen, place[new], names[new])
            if new.any():
                yield cut, at[new], names[new]


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut, at, names in _fresh(batches):
        keys = band_keys(*shingles(cut, at))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(names, BANDS))], ["band", "piece"])


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut, at, names in _fresh(batches):
        words = pa.array([cut.words_of(k) for k in at.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(names), words], ["piece", "words"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in _groups_of_texts(batch):
            cut = cut_texts(texts)
            names = cut.names()
            some = names != 0
            at = cut.first[some] - np.searchsorted(cut.word_start, cut.text_start)[cut.text[some]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)[cut.text[some]]), pa.array(cut.place[some].astype(np.int32)), pa.array(names[some]),
                 pa.array(cut.count[some].astype(np.int32)), pa.array(at.astype(np.int32))],
                ["doc_id", "place", "piece", "n", "at"],
            )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring runs of ``EXACT`` words around one anchor: ``n`` from word ``at`` on, and where pieces begin in them."""
    for batch in batches:
        for ids, texts in _groups_of_texts(batch):
            cut = cut_texts(texts)
            text, word, number, anchor = cut.windows()
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])] if len(text) else np.empty(0, bool))
            n = np.diff(np.r_[new, len(text)])
            first, begin = word[new], (word - number + anchor)[new]
            low, high = np.searchsorted(cut.first, first, "right"), np.searchsorted(cut.first, first + n + EXACT - 2, "right")
            nth = np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            cuts = cut.first[np.repeat(low, high - low) + nth] - np.repeat(first, high - low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)[text[new]]), pa.array(number[new].astype(np.int32)), pa.array(n.astype(np.int32)),
                 pa.array(_span_names(cut.word, first, n)), pa.array(_runs(cut.word, begin, begin + ANCHOR).view(np.int64)),
                 pa.array(cut.places(first).astype(np.int32) if len(first) else np.empty(0, np.int32)),
                 pa.ListArray.from_arrays(np.r_[0, np.cumsum(high - low)].astype(np.int32), cuts.astype(np.int8))],
                ["doc_id", "at", "n", "span", "anchor", "place", "cuts"],
            )


def _span_names(word: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _runs(word, first, first + n + EXACT - 1).view(np.int64)


def _named_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``EXACT`` words in the listed spans of each text, with the first and the last place that the span gives them."""
    for batch in batches:
        for listed, texts in _groups_of_texts(batch):
            cut = cut_texts(texts)
            start = np.searchsorted(cut.word_start, cut.text_start)
            size = np.diff(np.r_[start, len(cut.word)])
            at, n, span, doc_id, last_id, last_at = (np.array([x[c] for spans in listed for x in spans], np.int64) for c in ("at", "n", "span", "doc_id", "last_id", "last_at"))
            text = np.repeat(np.arange(len(listed)), [len(spans) for spans in listed])
            there = np.flatnonzero(at + n + EXACT - 1 <= size[text])
            there = there[_span_names(cut.word, (start[text] + at)[there], n[there]) == span[there]]  # ids may have several texts
            own = np.repeat(there, n[there])
            k = np.arange(len(own)) - np.repeat(np.cumsum(n[there]) - n[there], n[there])
            word = (start[text] + at)[own] + k
            yield pa.RecordBatch.from_arrays(
                [pa.array(span[own]), pa.array(k.astype(np.int32)), pa.array(_runs(cut.word, word, word + EXACT).view(np.int64)),
                 pa.array(doc_id[own]), pa.array((at[own] + k).astype(np.int32)), pa.array(last_id[own]), pa.array((last_at[own] + k).astype(np.int32))],
                ["span", "k", "name", "first_id", "first_at", "last_id", "last_at"],
            )


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of sorted ``key``."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[key].iloc[-1]
        if rest and batch[key].iloc[0] == last and rest[-1][key].iloc[-1] == last:
            rest.append(batch)
            continue
        done = batch[key] != last
        yield pd.concat([*rest, batch[done]], ignore_index=True)
        rest = [batch[~done]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _buckets(block: int):
    """Buckets of at least two different pieces; those over ``block`` become pairs of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, "band"):
            if not len(frame):
                continue
            band, piece = frame["band"].to_numpy(), frame["piece"].to_numpy()
            order = np.lexsort((piece, band))
            band, piece = band[order], piece[order]
            new = np.r_[True, (band[1:] != band[:-1]) | (piece[1:] != piece[:-1])]
            band, piece = band[new], piece[new]
            start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            size = np.diff(np.r_[start, len(band)])
            for s, n in zip(start[size > block].tolist(), size[size > block].tolist()):
                parts = np.array_split(piece[s : s + n], -(-n // block))
                for i in range(len(parts)):
                    for j in range(i + 1, len(parts)):
                        both = np.concatenate([parts[i], parts[j]])
                        yield pd.DataFrame({"piece": both, "task": np.full(len(both), _name(both), np.int64)})
            some = (size > 1) & (size <= block)
            keep = np.repeat(some, size)
            kept, counts = piece[keep], size[some]
            if len(kept):
                # a bucket is named by its pieces: equal buckets of several bands are one task
                first = np.cumsum(counts) - counts
                mixed = kept.view(np.uint64) * MULTIPLIER
                mixed ^= mixed >> np.uint64(29)
                names = np.add.reduceat(mixed * MULTIPLIER, first).view(np.int64)
                yield pd.DataFrame({"piece": kept, "task": np.repeat(names, counts)})

    return run


def _name(piece: np.ndarray) -> int:
    mixed = piece.view(np.uint64) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    return int((mixed * MULTIPLIER).sum(dtype=np.uint64).view(np.int64))


def spanning_links(sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Links of exact Jaccard at least ``threshold`` that connect all sets such links connect.

    A set that was reached is compared with those not reached yet only, through an inverted
    index of elements, so a tight group costs one comparison for each member.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    a, b = [], []
    waiting = np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            met = np.concatenate([owner[x:y] for x, y in zip(lo.tolist(), hi.tolist())])
            common = np.bincount(met[waiting[met]], minlength=len(sets))
            near = np.flatnonzero(common >= threshold * (sizes + sizes[i] - common) - 1e-9)
            near = near[waiting[near] & (common[near] > 0)]
            waiting[near] = False
            for j in near.tolist():
                a.append(i)
                b.append(j)
                stack.append(j)
    return a, b


def pair_links(keys: np.ndarray, counts: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of all pairs within many small groups of rows at once; rows have ``counts`` distinct ``keys`` each."""
    first = np.cumsum(size) - size
    a, b = [], []
    for x in range(int(size.max(initial=0))):
        for y in range(x + 1, int(size.max(initial=0))):
            has = size > y
            a.append(first[has] + x)
            b.append(first[has] + y)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    begin = np.cumsum(counts) - counts
    owned = np.sort(_mix(keys + np.repeat(np.arange(len(counts), dtype=np.uint64), counts) * MULTIPLIER))
    links = []
    for at in range(0, len(a), 50_000):
        p, q = a[at : at + 50_000], b[at : at + 50_000]
        n = counts[p]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wanted = _mix(keys[np.repeat(begin[p], n) + nth] + np.repeat(q, n).astype(np.uint64) * MULTIPLIER)
        place = np.minimum(np.searchsorted(owned, wanted), len(owned) - 1)
        common = np.add.reduceat((owned[place] == wanted).astype(np.int64), np.cumsum(n) - n)
        links.append(common >= threshold * (counts[p] + counts[q] - common) - 1e-9)
    linked = np.concatenate(links)
    return a[linked], b[linked]


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, sorted within the row."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])] if len(owner) else np.empty(0, bool)
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, "task"):
            if not len(frame):
                continue
            frame = frame.drop_duplicates(["task", "piece"]).sort_values(["task", "piece"], kind="stable")
            task, piece = frame["task"].to_numpy(), frame["piece"].to_numpy()
            cut = cut_texts([w.replace(b"\n", b" ").decode("utf-8", "surrogatepass") for w in frame["words"]])
            whole = _whole_texts(cut, len(frame))
            hashes, counts = _distinct(*shingles(whole, np.arange(len(frame))))
            first = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
            size = np.diff(np.r_[first, len(task)])
            small = np.repeat(size <= SMALL_GROUP, size)
            keep = np.repeat(small, counts)
            a, b = pair_links(hashes[keep], counts[small], size[size <= SMALL_GROUP], threshold)
            yield pd.DataFrame({"a": piece[small][a], "b": piece[small][b]})
            ends = np.cumsum(counts)
            for f, n in zip(first[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist()):
                sets = [hashes[ends[k] - counts[k] : ends[k]] for k in range(f, f + n)]
                x, y = spanning_links(sets, threshold)
                yield pd.DataFrame({"a": piece[f:][x], "b": piece[f:][y]})

    return run


def _whole_texts(cut: Cut, n: int) -> Cut:
    """The same words with each text as one piece: the texts are pieces already."""
    first = np.searchsorted(cut.word_start, cut.text_start)
    return replace(cut, text=np.arange(n), place=np.zeros(n, np.int64), first=first, count=np.diff(np.r_[first, len(cut.word)]))


def piece_links(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links between pieces that connect all similar colliding pieces."""
    texts = _texts(docs)
    candidates = materialize(
        texts.mapInArrow(_band_rows, "band long, piece long")
        .repartition("band").sortWithinPartitions("band")
        .mapInPandas(_buckets(block), "piece long, task long").distinct(),
        "candidates",
    )
    with_words = candidates.join(texts.mapInArrow(_piece_rows, "piece long, words binary"), "piece")
    return with_words.repartition("task").sortWithinPartitions("task").mapInPandas(_verify(threshold), "a long, b long")


def repeated_pieces(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, place, n, at, run, component_id, removed) of the pieces of passages that occur more than once."""
    nodes = materialize_alone(docs.sparkSession, lambda: connected_components(piece_links(docs, threshold, block)), "pieces")
    found = materialize(_texts(docs).mapInArrow(_occurrences, "doc_id long, place int, piece long, n int, at int"), "occurrences")
    named = materialize(
        found.join(nodes.toDF("node", "class"), found["piece"] == F.col("node"), "left")
        .select("doc_id", "place", "n", "at", F.coalesce("class", "piece").alias("class")), "named",
    )
    place = F.struct("doc_id", "place")
    # written first, so that the join deals out both sides anew and may split a hot class
    classes = materialize(
        named.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last")).select("class", "first"), "classes",
    )
    repeated = named.join(classes, "class")
    in_doc = Window.partitionBy("doc_id").orderBy("place")  # a document's pieces are bounded by its length
    apart = F.when(F.col("place") - F.lag("place").over(in_doc) <= 1 + MOST_BRIDGED, 0).otherwise(1)
    return (
        repeated.select("doc_id", "place", "n", "at", "first").distinct().withColumn("apart", apart)
        .withColumn("run", F.struct("doc_id", F.sum("apart").over(in_doc).alias("run")))
        .withColumn("run_words", F.sum("n").over(Window.partitionBy("run")))
        .where(F.col("run_words") >= min_words)
        .select("doc_id", "place", "n", "at", F.col("run.run").alias("run"), F.col("first.doc_id").alias("component_id"),
                (F.struct("doc_id", "place") != F.col("first")).alias("removed"))
    )


def equal_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, at, till, low, high, component_id, removed) of runs of words, ``EXACT`` at least, that occur more than once.

    Words ``at`` to ``till`` of the text, in its pieces ``low`` to ``high``. Runs overlap; ``removed`` ones have their
    first occurrence elsewhere. Of a run that overlaps its own first occurrence the rest goes.
    """
    spans = materialize(_texts(docs).mapInArrow(_spans, SPANS), "spans")
    equal = materialize_alone(docs.sparkSession, lambda: _equal_parts(docs, spans), "equal_parts")
    at = F.col("at") + F.col("low")
    first = F.struct(F.col("first_id").alias("doc_id"), F.col("first_at").alias("at"))
    place = lambda word: F.col("place") + F.size(F.filter("cuts", lambda x: x <= word))
    found = materialize(
        spans.join(equal, "span").select(
            "doc_id", at.alias("at"), (F.col("at") + F.col("high") + EXACT).alias("till"), place(F.col("low")).alias("low"),
            place(F.col("high") + EXACT - 1).alias("high"), F.col("first_id").alias("component_id"),
            (F.struct("doc_id", at.alias("at")) != first).alias("removed"), "first_at",
        ).withColumn("begin", F.when((F.col("component_id") == F.col("doc_id")) & F.col("removed"), F.greatest("at", F.col("first_at") + EXACT)).otherwise(F.col("at")))
        .drop("first_at"),
        "found",
    )
    # neighbours become one run: a document's spans are bounded by its length
    by = Window.partitionBy("doc_id", "component_id", "removed").orderBy("at", "begin", "till")
    apart = F.when((F.col("at") + EXACT - F.lag("till").over(by) <= 1) & (F.col("begin") <= F.lag("till").over(by)), 0).otherwise(1)
    return (
        found.repartition("doc_id").distinct().withColumn("apart", apart).withColumn("run", F.sum("apart").over(by))
        .groupBy("doc_id", "component_id", "removed", "run")
        .agg(F.min("at").alias("at"), F.min("begin").alias("begin"), F.max("till").alias("till"), F.min("low").alias("low"), F.max("high").alias("high")).drop("run")
    )


def _slice(column: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit("slice")), F.lit(SLICES))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _equal_parts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(span, low, high, first_id, first_at): runs ``low`` to ``high`` of a span occur more than once, first one after the other from that word on."""
    place = F.struct("doc_id", "at")
    different = materialize(
        spans.groupBy("span").agg(F.max("anchor").alias("anchor"), F.max("n").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "different",
    )
    varied = materialize(different.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor"), "varied")
    whole = different.where(F.col("first") != F.col("last")).join(varied, "anchor", "left_anti").select(
        "span", F.lit(0).alias("low"), (F.col("n") - 1).alias("high"), F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at"),
    )
    listed = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("at"), "n", "span", F.col("last.doc_id").alias("last_id"), F.col("last.at").alias("last_at"))
    around = materialize(
        different.join(varied, "anchor").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(listed).alias("listed")), "around",
    )
    windows = materialize(bounded_batches(_texts(docs).join(around, "doc_id").select("listed", "text")).mapInArrow(_named_windows, WINDOWS), "windows")
    found = _union([_found(windows.where(_slice("name") == i)) for i in range(SLICES)])
    same = Window.partitionBy("span", "first_id", "ahead").orderBy("k")

    def runs(part: DataFrame) -> DataFrame:
        one = part.repartition("span").distinct().withColumn("ahead", F.col("first_at") - F.col("k"))
        return (
            one.withColumn("run", F.col("k") - F.row_number().over(same)).groupBy("span", "first_id", "ahead", "run")
            .agg(F.min("k").alias("low"), F.max("k").alias("high"), F.min("first_at").alias("first_at")).select("span", "low", "high", "first_id", "first_at")
        )

    return _union([whole, *[materialize(runs(found.where(_slice("span") == i)), "runs") for i in range(SLICES)]])


def _found(windows: DataFrame) -> DataFrame:
    """(span, k, first_id, first_at) of the windows whose name occurs more than once."""
    first = F.min(F.struct(F.col("first_id").alias("doc_id"), F.col("first_at").alias("at")))
    last = F.max(F.struct(F.col("last_id").alias("doc_id"), F.col("last_at").alias("at")))
    firsts = materialize(
        windows.groupBy("name").agg(first.alias("first"), last.alias("last")).where(F.col("first") != F.col("last"))
        .select("name", F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at")),
        "first_windows",
    )
    return materialize(windows.select("span", "k", "name").join(firsts, "name").select("span", "k", "first_id", "first_at"), "found")


def _parts(docs: DataFrame, threshold: float, min_words: int, block: int) -> DataFrame:
    """(doc_id, at, begin, till, low, high, component_id, removed, counted): repeated pieces, equal runs, and the spans of runs of pieces."""
    spark = docs.sparkSession
    pieces = materialize_alone(
        spark, lambda: repeated_pieces(docs, threshold, min_words, block).withColumn("till", F.col("at") + F.col("n")), "repeated_pieces",
    )
    runs = materialize_alone(spark, lambda: equal_runs(docs), "equal_runs")
    columns = ["doc_id", "at", "begin", "till", "low", "high", "component_id", "removed", "counted"]
    one = pieces.select("doc_id", "at", F.col("at").alias("begin"), "till", F.col("place").alias("low"), F.col("place").alias("high"), "component_id", "removed", F.lit(True).alias("counted"))
    span = pieces.groupBy("doc_id", "run").agg(F.min("at").alias("at"), F.max("till").alias("till"), F.min("place").alias("low"), F.max("place").alias("high"), F.min("component_id").alias("component_id"))
    span = span.select("doc_id", "at", F.col("at").alias("begin"), "till", "low", "high", "component_id", F.lit(False).alias("removed"), F.lit(False).alias("counted"))
    return one.union(span).union(runs.withColumn("counted", F.lit(True)).select(columns))


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """One row for each repeated passage of a document: doc_id, first_piece, n_pieces, n_words, n_removed_words, component_id.

    Passages are runs of repeated pieces and runs of ``EXACT`` equal words; those that overlap are one, and
    each word counts once. ``n_pieces`` are those with repeated words. ``component_id`` is the smallest doc_id
    that has one of the passage's pieces or words first; documents without such a passage have no row. Words
    stay at their first occurrence (smallest doc_id, then place) and go elsewhere (``n_removed_words``). Null
    texts and doc_ids have no pieces, empty texts neither; rows that share a doc_id and equal texts count
    once. Other columns are ignored.
    """
    parts = _parts(docs, threshold, min_words, block)
    before = Window.partitionBy("doc_id").orderBy("at", "till", "counted", "removed", "begin").rowsBetween(Window.unboundedPreceding, -1)
    in_doc = Window.partitionBy("doc_id").orderBy("at", "till", "counted", "removed", "begin").rowsBetween(Window.unboundedPreceding, 0)
    by_begin = Window.partitionBy("doc_id").orderBy("begin", "till").rowsBetween(Window.unboundedPreceding, -1)

    def new_words(begin: str, which: str, over: Window):
        reached = F.coalesce(F.max(F.when(F.col(which), F.col("till"))).over(over), F.lit(0))
        return F.when(F.col(which), F.greatest(F.lit(0), F.col("till") - F.greatest(F.col(begin), reached))).otherwise(0)

    apart = F.when(F.col("at") < F.max("till").over(before), 0).otherwise(1)
    return (
        parts.withColumn("apart", apart).withColumn("words", new_words("at", "counted", before)).withColumn("gone", new_words("begin", "removed", by_begin))
        .withColumn("run", F.sum("apart").over(in_doc)).groupBy("doc_id", "run")
        .agg(F.min("low").cast("long").alias("first_piece"),
             F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("counted"), F.sequence("low", "high")))))).cast("long").alias("n_pieces"),
             F.sum("words").cast("long").alias("n_words"), F.sum("gone").cast("long").alias("n_removed_words"), F.min("component_id").alias("component_id"))
        .drop("run")
    )


def cut_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """``docs`` with all removed words cut from ``text``; other columns, null texts and null ids stay as they are."""
    gone = _parts(docs, threshold, min_words, block).where("removed and begin < till").groupBy("doc_id").agg(
        F.collect_set(F.struct("begin", "till")).alias("_gone")
    ).withColumnRenamed("doc_id", "_id")
    names = list(docs.columns)
    at = names.index("text")
    columns = [f"_{i}" for i in range(len(names))]  # by place: no clash of names
    plain = docs.toDF(*columns)
    joined = plain.join(gone, plain[f"_{names.index('doc_id')}"] == gone["_id"], "left").select(*columns, "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if text is not None and places:
                    cut, raw = cut_texts([text]), text.encode("utf-8", "surrogatepass")
                    kept, done, reached = [], 0, 0
                    for part in sorted(places, key=lambda x: (x["begin"], x["till"])):
                        begin, till = max(part["begin"], reached), min(part["till"], len(cut.word))
                        if begin < till:
                            kept.append(raw[done : cut.word_start[begin]])
                            done, reached = cut.word_end[till - 1], till
                    text = b"".join([*kept, raw[done:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(joined).mapInArrow(run, docs.schema)
