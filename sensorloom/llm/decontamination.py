"""Benchmark decontamination: scan token windows of training texts for normalised test n-grams.

Every window of ``size`` consecutive benchmark words (an item of fewer words is one window)
goes into a set. A fixed-size bitmap of the hashes of the windows' first words, small whatever
the benchmark's size, discards almost every position inside the scan of the documents; the
windows that remain meet the set in a join on their words, so each hit is verified exactly.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.runtime import materialize

SIZE = 13
HEAD = 4
BITMAP_BITS = 1 << 18
BROADCAST_WINDOWS = 200_000
CONTAMINATED_PART = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(plain, BETWEEN_WORDS), lambda w: w != "")


def _slot(words: Column, at: Column, n: int, bits: int) -> Column:
    """Bitmap position of the ``n`` words from the 0-based index ``at``."""
    return F.pmod(F.xxhash64(*[F.get(words, at + k) for k in range(n)]), F.lit(bits))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, n, item_id): each distinct window of each item, as its words joined by spaces."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return items.select(
        "item_id", n.alias("n"),
        F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("window"),
    ).select("window", "n", "item_id").distinct()


def _bitmap(windows: DataFrame, head: int, bits: int) -> Column:
    """The set bits of all windows of at least ``head`` words (of exactly fewer), as a constant array of longs."""
    slot = _slot(F.split("window", " "), F.lit(0), head, bits)
    whole = F.col("n") >= HEAD if head == HEAD else F.col("n") == head
    set_bits = (
        windows.where(whole).select((slot / 64).cast("int").alias("at"), (slot % 64).cast("int").alias("bit")).distinct()
        .groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )
    packed = dict(set_bits.collect())  # at most bits / 64 rows, whatever the benchmark's size
    values = ",".join(str(packed.get(i, 0)) for i in range(bits // 64))
    return F.split(F.lit(values), ",").cast("array<bigint>")


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, bitmap_bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has row, doc_id, n_words of each row of ``docs``; hits has row, start, n, window.

    ``start`` is the 0-based word at which a benchmark window of ``n`` words occurs.
    """
    windows = materialize(benchmark_windows(benchmark, size), "windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ``size`` values
    scanned = docs.select(F.col("doc_id"), words_of(F.col("text")).alias("w"))
    candidates = [
        F.transform(
            F.filter(
                F.sequence(F.lit(0), F.size("w") - n),
                _maybe(min(n, HEAD), _bitmap(windows, min(n, HEAD), bitmap_bits), bitmap_bits),
            ),
            _window(n),
        )
        for n in lengths
    ]
    found = "array<struct<start:int,n:int,window:string>>"
    parts = [F.when(F.size("w") >= n, c.cast(found)).otherwise(F.array().cast(found)) for n, c in zip(lengths, candidates)]
    marked = materialize(
        scanned.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"),
            (F.concat(*parts) if parts else F.array().cast(found)).alias("maybe"),
        ),
        "candidates",
    )
    known = windows.select("window").distinct()
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    maybe = marked.where(F.size("maybe") > 0).select("row", F.explode("maybe").alias("m")).select("row", "m.*")
    return marked.select("row", "doc_id", "n_words"), maybe.join(known, "window", "left_semi")


def _window(n: int) -> Callable[[Column], Column]:
    """The ``n`` words at a position."""
    return lambda i: F.struct(
        i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("window")
    )


def _maybe(head: int, bitmap: Column, bits: int) -> Callable[[Column], Column]:
    """Whether the bitmap knows the ``head`` words at a position."""

    def known(i: Column) -> Column:
        slot = _slot(F.col("w"), i, head, bits)
        bit = slot.bitwiseAND(F.lit(63)).cast("int")
        return F.bit_get(F.get(bitmap, F.shiftright(slot, 6).cast("int")), bit) == 1

    return known


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word is hit if it lies in any occurrence of a benchmark window; ``spans`` lists the hit runs
    as (first word, number of words). ``contaminated``: n_hit > 0 and at least one word in 20 hit.
    Null and empty texts have no words and are clean; benchmark items without words have no
    windows; equal items all count, repeated item rows once, null item ids are left out of the
    list. Rows that repeat or share a doc_id are judged one by one. Other columns are ignored.
    """
    benchmark = benchmark.select(F.col("item_id"), F.col("text"))
    rows, hits = find_hits(docs, benchmark, size)
    hits = materialize(hits, "hits")
    covered = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("at")).select(
        "row",
        F.aggregate(
            "at",
            F.array().cast("array<struct<start:int,n:int>>"),
            lambda runs, x: F.when(
                (F.size(runs) > 0) & (x["start"] <= F.element_at(runs, -1)["start"] + F.element_at(runs, -1)["n"]),
                F.concat(
                    F.slice(runs, 1, F.size(runs) - 1),
                    F.array(F.struct(
                        F.element_at(runs, -1)["start"].alias("start"),
                        F.greatest(F.element_at(runs, -1)["n"], x["start"] + x["n"] - F.element_at(runs, -1)["start"]).alias("n"),
                    )),
                ),
            ).otherwise(F.concat(runs, F.array(x))),
        ).alias("spans"),
    )
    items = (
        hits.select("row", "window").distinct()
        .join(benchmark_windows(benchmark, size).select("window", "item_id").where("item_id is not null"), "window")
        .select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["n"]), F.lit(0).cast("long"))
    return (
        rows.join(covered.join(items, "row", "left"), "row", "left")
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (CONTAMINATED_PART * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            "spans",
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without the documents that are contaminated; rows with a null doc_id are judged together.

    Where rows share a doc_id, one contaminated row takes them all.
    """
    bad = contamination(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]), "left_anti")


ORACLE_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bn as (select item_id, w, least(len(w), {SIZE}) as n from b where len(w) > 0),
bi as (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from bn),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from bi),
dn as (select doc_id, w, n from d cross join (select distinct n from win)),
di as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from dn),
hit as (select doc_id, i, n, item_id from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from di) join win using (win, n)),
words as (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as p from hit),
nh as (select doc_id, count(*) as n_hit from words group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join nh using (doc_id) left join it using (doc_id)
"""
