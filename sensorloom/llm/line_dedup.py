"""Line dedup: content-defined chunks of lines, removed where they repeat anywhere.

A rolling hash over the hashes of the last ``window`` lines is taken at each line; a chunk ends where it has a local
minimum, so inserted or removed lines shift only the chunks around them and every chunk has two lines or more. The two lines
on both sides of a boundary are a small chunk of their own, so that a block with a single boundary is met too. Chunks are
counted over all documents by hash; those that repeat are compared byte by byte, and all but the first occurrence (smallest
doc_id, then position) are cut. What lies beside a cut chunk is then compared with what lies beside its first occurrence,
line by line to both sides, so that blocks go up to their true ends. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.runtime import materialize

WINDOW = 2
MIN_LINES = 2
HASH_DIGITS = 8
MULTIPLIER = 31


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5: any engine computes the same."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def _lines() -> Column:
    return F.split(F.col("text").cast("string"), "\n")


def _with_chunks(named: DataFrame, window: int) -> DataFrame:
    """``named`` (_id, _key, _text) with _lines and _chunks, an array of (pos, n, seam, back, ahead) of its multi-line chunks.

    A ``seam`` is the chunk of two lines across a boundary. ``back`` and ``ahead`` count the lines beside, up to the next
    boundaries. Each step is a projection of its own, so that no lambda computes an array anew.
    """

    def rolling(h: Column, i: Column) -> Column:
        for k in range(1, window):
            h = h + F.coalesce(F.get("_hashes", i - k), F.lit(0)) * MULTIPLIER**k
        return h

    def ends_here(i: Column) -> Column:
        least = (F.get("_rolling", i) < F.get("_rolling", i - 1)) & (F.get("_rolling", i) <= F.get("_rolling", i + 1))
        return ((i >= 1) & (i < F.size("_rolling") - 2) & least) | (i == F.size("_rolling") - 1)

    def chunk(pos: Column, n: Column, seam: bool, back: Column, ahead: Column) -> Column:
        return F.struct(pos.alias("pos"), n.alias("n"), F.lit(seam).alias("seam"), back.alias("back"), ahead.alias("ahead"))

    return (
        named.select("_id", "_key", F.split("_text", "\n").alias("_lines"))
        .withColumn("_hashes", F.transform("_lines", line_hash))
        .withColumn("_rolling", F.transform("_hashes", rolling))
        .withColumn("_last", F.filter(F.sequence(F.lit(0), F.size("_rolling") - 1), ends_here))
        .withColumn("_before", F.concat(F.array(F.lit(-1)), "_last"))
        .withColumn("_sizes", F.zip_with("_last", "_before", lambda last, before: last - before))
        .withColumn("_chunks", F.transform("_last", lambda last, i: chunk(
            last - F.get("_sizes", i) + 1, F.get("_sizes", i), False,
            F.coalesce(F.get("_sizes", i - 1), F.lit(0)), F.coalesce(F.get("_sizes", i + 1), F.lit(0)),
        )))
        .withColumn("_seams", F.transform(F.slice("_last", 1, F.size("_last") - 1), lambda last, i: chunk(
            last, F.lit(MIN_LINES), True, F.get("_sizes", i) - 1, F.get("_sizes", i + 1) - 1
        )))
        .select("_id", "_key", "_lines", F.filter(F.concat("_chunks", "_seams"), lambda c: c["n"] >= MIN_LINES).alias("_chunks"))
    )


def _chunk_text(c: Column) -> Column:
    return F.array_join(F.slice("_lines", c["pos"] + 1, c["n"]), "\n")


def find_repeats(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(joined, kept): ``docs`` with the repeated chunks of each document, and chunks that are no repeats after all.

    ``joined`` has _key (a hash of the text) and _at, the document's chunks whose hash occurs elsewhere: (pos, n, seam,
    back, ahead, hash, first: document, key and position). ``kept`` (_id, _key, _pos) lists those whose bytes differ from the first.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    named = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").alias("_id"), key.alias("_key"), F.col("text").cast("string").alias("_text")
    )
    cut = _with_chunks(named, window).select(
        "_id", "_key",
        F.explode(F.transform("_chunks", lambda c: F.struct(
            *[c[name].alias(name) for name in ("pos", "n", "seam", "back", "ahead")], F.xxhash64(_chunk_text(c)).alias("hash")
        ))).alias("c"),
    )
    hashed = materialize(cut.select("_id", "_key", "c.*"), "chunks")
    place = F.struct("_id", "_key", "pos")
    firsts = hashed.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("latest")).where(
        F.col("first") != F.col("latest")
    ).select("hash", "first")
    # written first, so that the join deals out both sides anew and may split a hot chunk
    firsts = materialize(firsts, "firsts")
    repeats = hashed.join(firsts, "hash").groupBy("_id", "_key").agg(
        F.array_sort(F.collect_set(F.struct("pos", "n", "seam", "back", "ahead", "hash", "first"))).alias("_at")
    ).withColumnRenamed("_key", "_same")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    slim = docs.select("doc_id", "text", key.alias("_key"), *([F.struct(*others).alias("_others")] if others else []))  # no clash of names
    joined = slim.join(repeats, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_same")), "left").drop("_id", "_same")
    joined = materialize(joined, "joined")
    compared = (
        joined.where("_at is not null")
        .select(F.col("doc_id").alias("_id"), "_key", _lines().alias("_lines"), "_at")
        .select("_id", "_key", F.explode(F.transform(
            "_at", lambda c: F.struct(c["pos"].alias("pos"), c["hash"].alias("hash"), c["first"].alias("first"), _chunk_text(c).alias("chunk"))
        )).alias("c"))
        .select("_id", "_key", "c.*")
    )
    kept = (
        compared.groupBy("hash", "first", "chunk").agg(F.min(place).alias("own"))
        .where(F.col("own") != F.col("first"))
        .select(F.col("own._id").alias("_id"), F.col("own._key").alias("_key"), F.col("own.pos").alias("_pos"))
    )
    return joined, materialize(kept, "kept")


def _with_cuts(joined: DataFrame, kept: DataFrame) -> DataFrame:
    """``joined`` with _cut, its chunks in order that have an earlier equal one."""
    kept = kept.groupBy("_id", F.col("_key").alias("_same")).agg(F.collect_set("_pos").alias("_not"))
    all_ = joined.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_same")), "left").drop("_id", "_same")
    cut = F.filter("_at", lambda c: ~_is_first(c) & ~F.coalesce(F.array_contains("_not", c["pos"]), F.lit(False)))
    return all_.withColumn("_cut", F.coalesce(cut, F.array().cast(joined.schema["_at"].dataType.simpleString()))).drop("_not")


def _is_first(c: Column) -> Column:
    return (c["first"]["_id"] == F.col("doc_id")) & (c["first"]["_key"] == F.col("_key")) & (c["first"]["pos"] == c["pos"])


def _beside(c: Column, slack: int) -> tuple[Column, Column]:
    """Lines before a chunk, nearest first, and after it: those of the chunk beside and ``slack`` more.

    Equal lines never reach farther: they would set the same boundaries, and the chunk beside would be cut itself.
    """
    start = F.greatest(c["pos"] - c["back"] - slack, F.lit(0))
    return F.reverse(F.slice("_lines", start + 1, c["pos"] - start)), F.slice("_lines", c["pos"] + c["n"] + 1, c["ahead"] + slack)


def _equal_lines(a: str, b: str) -> Column:
    """How many of the first elements of two arrays are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def extend(cuts: DataFrame, window: int) -> DataFrame:
    """(_id, _key, _more): runs of lines (pos, n) beside cut chunks that equal those beside the first occurrence."""
    slack = window + 1
    lined = cuts.where("_at is not null").select("doc_id", "_key", "_at", "_cut", _lines().alias("_lines"))
    none = F.array().cast("array<string>")

    def first_sides(c: Column) -> Column:
        back, ahead = _beside(c, slack)
        return F.struct(c["hash"].alias("hash"), back.alias("a_back"), ahead.alias("a_ahead"))

    def cut_at(i: Column, line: Column) -> Column:
        other = F.get("_cut", i)
        return F.coalesce(~other["seam"] & (other["pos"] <= line) & (line < other["pos"] + other["n"]), F.lit(False))

    def own_sides(c: Column, i: Column) -> Column:
        back, ahead = _beside(c, slack)
        # in the order of positions the chunk beside is the next one, or the next but one after a seam
        cut_before = cut_at(i - 1, c["pos"] - 1) | cut_at(i - 2, c["pos"] - 1)
        cut_after = cut_at(i + 1, c["pos"] + c["n"]) | cut_at(i + 2, c["pos"] + c["n"])
        return F.struct(
            c["pos"].alias("pos"), c["n"].alias("n"), c["hash"].alias("hash"),
            F.when(cut_before, none).otherwise(back).alias("b_back"), F.when(cut_after, none).otherwise(ahead).alias("b_ahead"),
        )

    firsts = materialize(
        lined.select(F.explode(F.transform(F.filter("_at", _is_first), first_sides)).alias("c")).select("c.*"), "sides"
    )
    edges = lined.select(F.col("doc_id").alias("_id"), "_key", F.explode(F.transform("_cut", own_sides)).alias("c")).select(
        "_id", "_key", "c.*"
    ).where("size(b_back) + size(b_ahead) > 0")
    reach = edges.join(firsts, "hash").select(
        "_id", "_key", "pos", "n", _equal_lines("b_back", "a_back").alias("back"), _equal_lines("b_ahead", "a_ahead").alias("ahead")
    )
    runs = reach.select("_id", "_key", F.explode(F.array(
        F.struct((F.col("pos") - F.col("back")).alias("pos"), F.col("back").alias("n")),
        F.struct((F.col("pos") + F.col("n")).alias("pos"), F.col("ahead").alias("n")),
    )).alias("run")).where("run.n > 0")
    return runs.groupBy("_id", F.col("_key").alias("_same")).agg(F.collect_set("run").alias("_more"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, plus _n_lines, _n_cut_lines, _n_cut_chunks.

    Lines end at "\\n" alone. Of equal chunks the one in the smallest doc_id stays, there the one at the smallest position;
    lines beside a cut chunk that equal those beside the one that stays go with it (they count as lines, not as chunks; the
    two lines across a boundary count as a chunk beside the chunks that they belong to). Each line that goes has an equal one earlier. Rows that share a doc_id are documents of their own, in the order of a hash of
    their text; repeated rows count as one document and are cut alike. Rows with a null doc_id or text pass unchanged (a
    null text has 0 lines, an empty one 1). A text whose every line is cut becomes empty. Other columns are kept as they
    are, but for columns that have the names of the three counts.
    """
    joined, kept = find_repeats(docs, window)
    cuts = _with_cuts(joined, kept)
    marked = cuts.join(extend(cuts, window), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_same")), "left").withColumn("_lines", _lines())
    runs = F.concat(
        F.transform("_cut", lambda c: F.sequence(c["pos"], c["pos"] + c["n"] - 1)),
        F.transform(F.coalesce("_more", F.array().cast("array<struct<pos:int,n:int>>")), lambda c: F.sequence(c["pos"], c["pos"] + c["n"] - 1)),
    )
    marked = marked.withColumn("_stay", F.when(
        F.size("_cut") > 0, F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.flatten(runs))
    ))
    made = ("_n_lines", "_n_cut_lines", "_n_cut_chunks")
    text = F.when(F.col("_stay").isNotNull(), F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")).otherwise(F.col("text"))
    return marked.select(
        *[text.alias(c) if c == "text" else F.col(c if c == "doc_id" else f"_others.`{c}`").alias(c) for c in docs.columns if c not in made],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("_n_lines"),
        F.when(F.col("_stay").isNotNull(), F.size("_lines") - F.size("_stay")).otherwise(0).cast("long").alias("_n_cut_lines"),
        F.size("_cut").cast("long").alias("_n_cut_chunks"),
    )


ORACLE_SQL = f"""
with d as (select doc_id, string_split(text, chr(10)) as ls from documents where doc_id is not null and text is not null),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i, len(ls) as size from d),
h as (select *, ('0x' || substr(md5(line), 1, {HASH_DIGITS}))::bigint as h from l),
r as (select *, h + coalesce(lag(h) over w, 0) * {MULTIPLIER} as r from h window w as (partition by doc_id order by i)),
e as (select *, i = size - 1 or (i >= 1 and i < size - 2 and r < lag(r) over w and r <= lead(r) over w) as ends
  from r window w as (partition by doc_id order by i)),
g as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from e),
c as (select doc_id, chunk, min(i) as pos, count(*) as n, string_agg(line, chr(10) order by i) as txt, last(line order by i) as final, first(line order by i) as head
  from g group by doc_id, chunk),
b as (select *, coalesce(lag(n) over w, 0) as back, coalesce(lead(n) over w, 0) as ahead, lead(head) over w as next from c window w as (partition by doc_id order by chunk)),
u as (select doc_id, chunk, false as seam, pos, n, txt, back, ahead from b where n >= {MIN_LINES}
  union all select doc_id, chunk, true, pos + n - 1, {MIN_LINES}, final || chr(10) || next, n - 1, ahead - 1 from b where ahead > 0),
f as (select *, row_number() over w > 1 as cut, first_value(doc_id) over w as first_id, first_value(pos) over w as first_pos,
  first_value(back) over w as first_back, first_value(ahead) over w as first_ahead from u window w as (partition by txt order by doc_id, pos)),
z as (select doc_id, chunk from f where cut and not seam),
s as (select f.*, p.chunk is not null as cut_before, q.chunk is not null as cut_after
  from f left join z p on p.doc_id = f.doc_id and p.chunk = f.chunk - (not seam)::int left join z q on q.doc_id = f.doc_id and q.chunk = f.chunk + 1),
m as (select s.*, own.ls as own, first.ls as other,
  case when cut_before then 0 else least(pos, first_pos, back + {WINDOW + 1}, first_back + {WINDOW + 1}) end as most_back,
  case when cut_after then 0 else least(len(own.ls) - pos - n, len(first.ls) - first_pos - n, ahead + {WINDOW + 1}, first_ahead + {WINDOW + 1}) end as most_ahead
  from s join d own using (doc_id) join d first on first.doc_id = first_id where cut),
x as (select doc_id,
  pos - len(list_filter(range(1, most_back + 1), lambda j: own[pos - j + 1 : pos] = other[first_pos - j + 1 : first_pos])) as low,
  pos + n + len(list_filter(range(1, most_ahead + 1), lambda j: own[pos + n + 1 : pos + n + j] = other[first_pos + n + 1 : first_pos + n + j])) as high from m),
gone as (select distinct doc_id, unnest(range(low, high)) as i from x),
k as (select doc_id, count(*) as n_chunks from x group by doc_id),
t as (select doc_id, count(*) as n_lines, count(gone.i) as n_cut, string_agg(line, chr(10) order by l.i) filter (gone.i is null) as kept
  from l left join gone using (doc_id, i) group by doc_id)
select documents.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_cut, 0)::bigint as n_cut_lines,
  coalesce(n_chunks, 0)::bigint as n_cut_chunks,
  md5(case when documents.text is null then null else coalesce(kept, '') end) as text_md5
from documents left join t using (doc_id) left join k using (doc_id)
"""
