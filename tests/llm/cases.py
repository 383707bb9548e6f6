"""Small inputs with everything that may go wrong: nulls, empty and long texts, ties, copies, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASHES = ["print", "key", "group", "hash", "row", "w", "window", "_at", "_id", "gram", "n", "word", "piece", "lines", "units", "x", "class", "score", "file"]

WORDS = [f"w{i}" for i in range(60)] + ["The", "und", "élan", "Straße", "naïve", "a1", "don't"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def texts(seed: int = 0, n: int = 40) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = []
    for _ in range(n):
        out.append("\n".join(sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))))
    shared = "\n".join(sentence(rng, 18) for _ in range(4))
    out += [None, None, "", "", " \t\n", "\n", "\n\n\n", "!!! ... ???", "x", out[0], out[0], out[1] + " tail"]
    out += [sentence(rng, 9) + "\n" + shared + "\n" + sentence(rng, 7) for _ in range(4)]
    out += ["word " * 30_000, "\n".join(["same line here"] * 3_000), "a" * 20_000, "\x00 \x85 \xa0 ​ \U0001f600 𝒜 Σ"]
    return out


def rows(seed: int = 0, n: int = 40) -> list[tuple[int | None, str | None, str | None, str | None, int]]:
    rng = random.Random(seed + 1)
    out = [(i, t, rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src1", None]), len(t or "")) for i, t in enumerate(texts(seed, n))]
    return out + [out[3], out[3], (5, "another text of five", "en", "src0", 20), (None, "no id but text here", None, None, 0), (None, None, None, None, 0)]


def documents(spark: SparkSession, seed: int = 0, n: int = 40, clashes: bool = True) -> DataFrame:
    docs = spark.createDataFrame(rows(seed, n), "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES]) if clashes else docs


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
