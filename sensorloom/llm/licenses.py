"""Licence scans: sparse TF-IDF cosine to notice templates, then inheritance down the directories.

Every line of a file (a possible header or notice) and the whole file are compared with the
templates. Weights are term frequency times inverse document frequency over all files, for words that no
template has too: they are counted once it is known which units they matter for. An upper bound of the cosine, summed inside the scan, discards units
that cannot reach the threshold, first by the least weight a word can have, then by that of the most frequent words; the rest are exploded to terms, weighed and joined exactly. A file
without a notice of its own inherits from the nearest directory above it that has a licence
file. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.runtime import materialize

THRESHOLD = 0.6
FILE_THRESHOLD = 0.6
LEAST_TERMS = 2
BETWEEN_WORDS = r"[^a-z0-9+]+"
#: Ranks, by files that have them, at which the most frequent words are cut into groups of like weight.
RANKS = [16, 64, 256, 1024]

#: Notices as projects state them in a line or a licence file, by their public licence identifiers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
]


def terms(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and "+", lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN_WORDS), lambda w: w != "")


def template_terms(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, licence, term, tf) of the templates, whose number is fixed by the caller."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    return (
        spark.createDataFrame(rows, "template int, licence string, notice string")
        .select("template", "licence", F.explode(terms(F.col("notice"))).alias("term"))
        .groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    )


def candidate_units(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, vectors, weights): rows has file, path and units, an array of (line, words) that may match.

    ``vectors`` has the templates' terms with their inverse document frequency and unit weight, ``weights``
    (term, idf) the inverse document frequency of all terms of the units.
    """
    spark = files.sparkSession
    vocabulary = template_terms(spark, templates)
    known = sorted({r[0] for r in vocabulary.select("term").distinct().collect()})  # the templates' words
    # the empty term counts the files
    spread = materialize(
        files.select(F.explode(F.concat(F.array_distinct(terms(F.col("text"))), F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")),
        "spread",
    )
    frequency = spread.where(F.col("term").isin(known))
    total = (spread.where("term = ''").agg(F.sum("df")).first()[0]) or 0
    idf = (
        vocabulary.select("term").distinct().join(F.broadcast(frequency), "term", "left")
        .select("term", (F.log((1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"))
    )
    weighed = vocabulary.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = materialize(
        weighed.join(F.broadcast(norms), "template").select("template", "licence", "term", "idf", (F.col("w") / F.col("norm")).alias("unit")), "templates"
    )
    # for the bound: a term's idf, and the largest share any template gives it
    bounds = vectors.groupBy("term").agg(F.max("idf").alias("idf"), F.max("unit").alias("unit")).collect()
    weight = F.create_map(*[x for r in bounds for x in (F.lit(r["term"]), F.struct(F.lit(r["idf"]).alias("i"), F.lit(r["unit"]).alias("u")))])

    def bound(words: Column) -> Column:
        """Own words, sum of idf times largest share, sum of squared idf: each word's share of what the cosine can be."""
        start = F.struct(F.lit(0).alias("own"), F.lit(0.0).alias("dot"), F.lit(0.0).alias("square"))
        return F.aggregate(
            F.transform(F.filter(words, lambda w: w.isin(known)), lambda w: F.element_at(weight, w)), start,
            lambda s, x: F.struct((s["own"] + 1).alias("own"), (s["dot"] + x["i"] * x["u"]).alias("dot"), (s["square"] + x["i"] * x["i"]).alias("square")),
        )

    def may_match(n: Column, own: Column, dot: Column, square: Column) -> Column:
        """A squared cosine is at most dot^2 / (sum of squared weights), where tf^2 is at least tf and each idf at least 1."""
        return (own >= LEAST_TERMS) & (dot * dot >= (threshold - 1e-9) ** 2 * (square + (n - own)))

    frequent = spread.where((F.col("term") != "") & ~F.col("term").isin(known)).orderBy(F.desc("df"), "term").limit(RANKS[-1] + 1).collect()
    groups = [frequent[low:high] for low, high in zip([0, *RANKS], [*RANKS, RANKS[-1] + 1])]

    def can_match(words: Column) -> Column:
        """As ``may_match``, each foreign word weighing no less than the most frequent one of its group."""
        least = lambda group: (math.log((1.0 + total) / (1.0 + group[0]["df"])) + 1.0) ** 2
        weights = [([r["term"] for r in g], least(g)) for g in groups if g]
        # words beyond the last group are as rare as its first or rarer; without one, no word is left
        rest = weights.pop()[1] if groups[-1] else 1.0

        def of_word(w: Column) -> Column:
            case = F.when(w.isin(known), F.lit(0.0))
            for group, value in weights:
                case = case.when(w.isin(group), F.lit(value))
            return case.otherwise(F.lit(rest))

        b = F.aggregate(words, F.lit(0.0), lambda s, w: s + of_word(w))
        return F.exists(F.array(bound(words)), lambda x: x["dot"] * x["dot"] >= (threshold - 1e-9) ** 2 * (x["square"] + b))

    lines = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), terms)
    marked = files.select("path", lines.alias("lines")).withColumn("bounds", F.transform("lines", bound))
    total_of = lambda name, kind: F.aggregate("bounds", F.lit(0).cast(kind), lambda s, b: s + b[name])
    words_in_all = F.aggregate("lines", F.lit(0), lambda s, w: s + F.size(w))
    units = F.concat(
        F.when(may_match(words_in_all, total_of("own", "int"), total_of("dot", "double"), total_of("square", "double")),
               F.array(F.struct(F.lit(-1).alias("line"), F.flatten("lines").alias("words")))).otherwise(F.array()),
        F.transform(
            F.filter(
                F.zip_with(F.sequence(F.lit(0), F.size("lines") - 1), "bounds", lambda i, b: F.struct(i.alias("line"), b.alias("b"))),
                lambda u: may_match(F.size(F.get("lines", u["line"])), u["b"]["own"], u["b"]["dot"], u["b"]["square"]),
            ),
            lambda u: F.struct(u["line"].alias("line"), F.get("lines", u["line"]).alias("words")),
        ),
    )
    rows = materialize(marked.select(F.monotonically_increasing_id().alias("file"), "path", F.filter(units, lambda u: can_match(u["words"])).alias("units")), "units")
    wanted = materialize(rows.select(F.explode(F.array_distinct(F.flatten(F.transform("units", lambda u: u["words"])))).alias("term")).distinct(), "wanted")
    weights = wanted.join(spread, "term").select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    return rows, vectors, materialize(weights, "weights")


def match_notices(rows: DataFrame, vectors: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(file, line, licence, cosine): the best template of each unit of at least ``threshold``.

    ``line`` is the line from 0, or -1 for the whole file. Equal cosines are decided by the licence's name.
    """
    candidates = rows.select("file", F.explode("units").alias("u")).select("file", "u.line", "u.words")
    tf = candidates.select("file", "line", F.explode("words").alias("term")).groupBy("file", "line", "term").agg(F.count("*").alias("tf"))
    values = tf.join(weights, "term").select("file", "line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = values.groupBy("file", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = values.join(F.broadcast(vectors.select("template", "licence", "term", "unit")), "term").groupBy("file", "line", "licence", "template").agg(
        F.sum(F.col("w") * F.col("unit")).alias("dot")
    )
    cosine = dots.join(length, ["file", "line"]).select("file", "line", "licence", F.round(F.col("dot") / F.col("length"), 9).alias("cosine"))
    return cosine.where(F.col("cosine") >= threshold).groupBy("file", "line").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best")
    ).select("file", "line", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"))


def _directories(path: Column) -> Column:
    """The directories above a path with their depth: "a/b/c" is below "a/b", "a" and ""."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("directory"))
    )


def scan_licenses(
    files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, file_threshold: float = FILE_THRESHOLD
) -> DataFrame:
    """One row per row of ``files`` (path, text): path, licence, cosine, line, inherited, directory.

    The best notice of a file decides (cosine, then the first unit, whole file first). A file that
    as a whole matches a template with ``file_threshold`` is a licence file of its directory; of
    several the best, then the smallest path, decides. Files without a notice take the licence of the
    nearest directory above them; without one, and for null paths, licence is null and cosine 0.
    Null and empty texts have no notice. Repeated rows and equal paths stay rows of their own; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    plain = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    numbered, vectors, weights = candidate_units(plain, templates, threshold)
    notices = materialize(match_notices(numbered, vectors, weights, threshold), "notices")
    best = notices.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "line", "licence")).alias("own")).select(
        "file", F.col("own.licence").alias("own"), (-F.col("own.c")).alias("cosine"), F.col("own.line").alias("line")
    )
    rows = numbered.select("file", "path").join(best, "file", "left")
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    placed = materialize(rows.withColumn("parent", F.when(F.col("path").isNotNull(), parent)), "placed")
    of_directory = materialize(
        placed.join(notices.where((F.col("line") == -1) & (F.col("cosine") >= file_threshold)).select("file", F.col("licence").alias("l"), F.col("cosine").alias("c")), "file")
        .where("parent is not null")
        .groupBy(F.col("parent").alias("directory")).agg(F.min(F.struct((-F.col("c")).alias("c"), "path", "l")).alias("d"))
        .select("directory", F.col("d.l").alias("given"), (-F.col("d.c")).alias("given_cosine")), "directories",
    )
    # each distinct directory finds its nearest licensed ancestor once; files then join by directory
    distinct = placed.where("parent is not null").select("parent").distinct()
    nearest = materialize(
        distinct.select("parent", F.explode(_directories(F.concat(F.col("parent"), F.when(F.col("parent") == "", "x").otherwise("/x")))).alias("a"))
        .select("parent", "a.depth", "a.directory").join(of_directory, "directory")
        .groupBy("parent").agg(F.max(F.struct("depth", "directory", "given", "given_cosine")).alias("n"))
        .select(F.col("parent").alias("below"), F.col("n.directory").alias("from"), F.col("n.given").alias("given"), F.col("n.given_cosine").alias("given_cosine")), "nearest",
    )
    found = placed.join(nearest, placed["parent"] == nearest["below"], "left")
    inherits = F.col("own").isNull() & F.col("given").isNotNull()
    return found.select(
        "path", F.coalesce("own", "given").alias("licence"), F.coalesce("cosine", "given_cosine", F.lit(0.0)).alias("cosine"), "line",
        inherits.alias("inherited"), F.when(inherits, F.col("from")).alias("directory"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: For documents as files "source/lang/doc_id".
ORACLE_SQL = f"""
with t(template, licence, notice) as (values {", ".join(f"({i}, {_quoted(n)}, {_quoted(x)})" for i, (n, x) in enumerate(TEMPLATES))}),
tt as (select template, licence, term, count(*) as tf from (select template, licence, unnest(regexp_extract_all(lower(notice), '[a-z0-9+]+')) as term from t) group by all),
known as (select distinct term from tt),
f as (select doc_id, concat_ws('/', source, lang, doc_id::varchar) as path, coalesce(text, '') as text from documents),
n as (select count(*)::double as n from f),
u as (select doc_id, -1 as line, text as unit from f
  union all select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1, unnest(string_split(text, chr(10))) from f),
w as (select doc_id, line, term, count(*) as tf from (select doc_id, line, unnest(regexp_extract_all(lower(unit), '[a-z0-9+]+')) as term from u) group by all),
df as (select term, count(*) as df from w where line = -1 group by term),
idf as (select term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 as idf, known.term is not null as own
  from df full join known using (term) cross join n),
tv as (select template, licence, term, tf * idf as w from tt join idf using (term)),
tn as (select template, sqrt(sum(w * w)) as norm from tv group by template),
x as (select doc_id, line, term, tf, tf * idf as w, own from w join idf using (term)),
xl as (select doc_id, line, sqrt(sum(w * w)) as len from x group by all having sum(case when own then tf else 0 end) >= {LEAST_TERMS}),
dots as (select doc_id, line, licence, template, sum(x.w * tv.w / norm) as dot from x join tv using (term) join tn using (template) group by all),
c as (select doc_id, line, licence, round(dot / len, 9) as cosine from dots join xl using (doc_id, line)),
unit as (select * from c where cosine >= {THRESHOLD} qualify row_number() over (partition by doc_id, line order by cosine desc, licence) = 1),
own as (select * from unit qualify row_number() over (partition by doc_id order by cosine desc, line, licence) = 1),
p as (select *, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as parent from f),
g as (select parent as directory, licence as given, cosine as given_cosine from unit join p using (doc_id) where line = -1 and cosine >= {FILE_THRESHOLD}
  qualify row_number() over (partition by parent order by cosine desc, path, licence) = 1),
d as (select distinct parent from p),
near as (select parent, directory, given, given_cosine from d join g on parent = directory or directory = '' or starts_with(parent, directory || '/')
  qualify row_number() over (partition by parent order by length(directory) desc) = 1)
select p.doc_id, path, coalesce(own.licence, given) as licence, coalesce(own.cosine, given_cosine, 0.0)::double as cosine, line::integer as line,
  own.licence is null and given is not null as inherited, case when own.licence is null then directory end as directory
from p left join own using (doc_id) left join near using (parent)
"""
