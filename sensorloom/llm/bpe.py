"""BPE encoding and decoding with a public word-level vocabulary, in numpy merge rounds.

Texts are cut into words as the vocabulary's file states (NFC, white space runs to one
blank, lower case; contractions, letter runs, single digits, runs of other signs). All words
of a batch that were not met before are encoded together: their symbols lie in one flat
array, each round finds every word's lowest-ranked adjacent pair by binary search over the
sorted pair keys and merges it, until no pair is left.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorloom.llm.tables import id_and_text

WORDS_KEPT = 200_000
CHARS_AT_ONCE = 4_000_000
WHITE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BEYOND = re.compile("[\U00010000-\U0010ffff]")
NO_RANK = np.iinfo(np.int64).max


def _class(kind: str) -> str:
    """Regular-expression ranges of the code points below 2**16 of a general category."""
    points = [i for i in range(0x10000) if unicodedata.category(chr(i))[0] == kind]
    cuts = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
    return "".join(f"{re.escape(chr(points[a]))}-{re.escape(chr(points[b - 1]))}" for a, b in zip(cuts, cuts[1:]))


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    letters, numbers = _class("L"), _class("N")
    return re.compile(f"[{WHITE}]+"), re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^ {letters}{numbers}]+")


@cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """The vocabulary and merges of one file, as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token = {i: t for t, i in {**ids, **self.special}.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = max(self.token) + 1
        self.digits = {i: str(i) for i in self.token}
        self.letter = np.array([ids[c] for c in byte_letters()], np.int64)
        self.last_letter = np.array([ids[c + self.end] for c in byte_letters()], np.int64)
        keys, made = [], []
        for left, right in model["merges"]:
            keys.append(ids[left] * self.size + ids[right])
            made.append(ids[left + right])
        keys, made = np.array(keys, np.int64), np.array(made, np.int64)
        tokens, times = np.unique(made, return_counts=True)
        self.ambiguous = np.zeros(self.size, bool)  # made by several merges: then one merge at a time
        self.ambiguous[tokens[times > 1]] = True
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}

    def split_words(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        Which signs beyond the basic plane are letters depends on the Unicode version, so texts with
        such signs are split by the library's own rules.
        """
        composed = unicodedata.normalize("NFC", text)
        if not composed.isascii() and BEYOND.search(composed):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, p)).decode("utf-8") for p, _ in pieces]
        white, words = _patterns()
        text = white.sub(" ", composed)
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # no word-final sigma
        return words.findall(text)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; all words go through the merge rounds together."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.letter[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last_letter[np.frombuffer(bytes(r[-1] for r in raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        done: list[np.ndarray | None] = [None] * len(raw)
        while len(symbols):
            at, rank = self._ranks(symbols, owner)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            ended = best == NO_RANK
            if ended.any():
                stops = np.r_[first[1:], len(symbols)]
                for word, start, stop in zip(owner[first[ended]].tolist(), first[ended].tolist(), stops[ended].tolist()):
                    done[word] = symbols[start:stop].copy()
                on = np.repeat(~ended, np.diff(np.r_[first, len(symbols)]))
                symbols, owner, rank, at = symbols[on], owner[on], rank[on], at[on]
                if not len(symbols):
                    break
                first, best = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), best[~ended]
            counts = np.diff(np.r_[first, len(symbols)])
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            hit = self._apart(hit, owner, self.ambiguous[self.made[at[hit]]])
            symbols[hit] = self.made[at[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return done

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol, the place and rank of the pair it begins within its word."""
        pair = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1][known] = self.rank[at[known]]
        return np.r_[at, 0], rank

    @staticmethod
    def _apart(hit: np.ndarray, owner: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Places to merge in this round: from the left, none overlapping, one a word if ``alone``."""
        new_run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        keep = (np.arange(len(hit)) - start) % 2 == 0
        first = np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]
        return hit[keep & (first | ~alone)]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, special ones included, joined by blanks: the file names no other decoder."""
        return " ".join([self.token[i] for i in ids.tolist() if i in self.token])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Words:
    """The ids of the words met lately, as arrays and as the text forms that digests are made of."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, np.ndarray] = {}
        self.digits: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        for text, i in self.vocabulary.special.items():
            self._add("\0" + text, np.array([i]))

    def _add(self, word: str, ids: np.ndarray) -> None:
        self.ids[word] = ids
        listed = ids.tolist()
        self.digits[word] = " ".join(map(self.vocabulary.digits.__getitem__, listed))
        self.tokens[word] = " ".join(map(self.vocabulary.token.__getitem__, listed))

    def of(self, texts: Iterator[str]) -> Iterator[list[str]]:
        """The words of each text, known by then; special tokens are marked by a leading NUL.

        Texts are handled in groups of about ``CHARS_AT_ONCE``, whose new words are encoded together.
        """
        group, held = [], 0
        for text in texts:
            group.append(self._split(text))
            held += len(text)
            if held >= CHARS_AT_ONCE:
                yield from self._known(group)
                group, held = [], 0
        yield from self._known(group)

    def _known(self, group: list[list[str]]) -> Iterator[list[str]]:
        if len(self.ids) > WORDS_KEPT:
            self.forget()
        new = list(set().union(*group) - self.ids.keys())
        for word, ids in zip(new, self.vocabulary.encode_words(new)):
            self._add(word, ids)
        for words in group:
            yield words

    def _split(self, text: str) -> list[str]:
        special = self.vocabulary.special_pattern
        if not special or not special.search(text):
            return self.vocabulary.split_words(text)
        parts = special.split(text)
        return [w for k, part in enumerate(parts) for w in (["\0" + part] if k % 2 else self.vocabulary.split_words(part))]


def _texts(column: pa.Array) -> Iterator[str]:
    return (x.as_py() or "" for x in column)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text; null is the empty text, which has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(path)
        for batch in batches:
            out = [
                np.concatenate([known.ids[w] for w in words]).astype(np.int32) if words else []
                for words in known.of(_texts(batch.column(1)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): tokens joined by blanks; null or no ids give the empty text, unknown ids nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = [known.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, all of the whole text.

    Null counts as empty: no ids, and the digests of the empty string. Repeated rows stay rows of
    their own, a null doc_id stays null, other columns are ignored. Words of any length are encoded
    whole; only the ids of the latest ``WORDS_KEPT`` words are remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(path)
        sha = hashlib.sha256
        for batch in batches:
            count, ids, decoded = [], [], []
            for words in known.of(_texts(batch.column(1))):
                digits = " ".join(map(known.digits.__getitem__, words))
                count.append(digits.count(" ") + 1 if words else 0)
                ids.append(sha(digits.encode("ascii")).hexdigest())
                decoded.append(sha(" ".join(map(known.tokens.__getitem__, words)).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
