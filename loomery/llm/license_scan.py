"""License scans by diagonal voting, in DataFrame functions only.

Every pair of neighbouring words of a text is joined to the places of that pair in the templates (by hash, the words
themselves decide). A hit votes for its diagonal, which is the place in the text minus the place in the template.
A phrase stands in the text exactly where a diagonal has all of the phrase's votes. Longer templates may be quoted
with words left out or put in: diagonals of a template that lie within `slack` of each other and overlap are merged
into a span. A span is verified by its longest chain of hits: the chain goes up in the template and in the
text, and each step changes the diagonal by `slack` at most; of hits at one place of the template the latest is what later
hits continue. Its share of the template's places is the span's score, which must reach `least`.

The templates are a fixed list of some dozens of lines, so their table is broadcast. Texts are scanned once and never
shuffled: hits, and one row for each document with its number of words, are written out, and all sums are formed from them.

Defined results: null text is empty; a text without words has n_words 0, no spans and score 0; rows that repeat are
rows of their own; ids may be null; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm.common import staged, table

#: A word of lower-cased text; the plain class is many times faster than the negated one that it equals.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Phrases that count wherever they stand whole (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Lines by which texts state a license; the labels are this operator's own (fixed values).
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "no part of this publication may be reproduced without prior written permission": "reserved",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed": "bsd",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license version 3": "agpl-3.0",
    "made available under the terms of the eclipse public license 2 0": "epl-2.0",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-1.0",
    "distributed under the boost software license version 1 0": "bsl-1.0",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "unauthorized copying of this file via any medium is strictly prohibited": "reserved",
}
SLACK, LEAST = 3, 0.75
#: Number of the entry that a document's own row meets.
DOCUMENT = -1


def template_pairs(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each pair of neighbouring words of each template: its words, place and the template's facts."""
    rows = [("", "", DOCUMENT, 0, 0, None, None)]
    for t, (line, label, base) in enumerate([(p, x, True) for p, x in phrases.items()] + [(p, x, False) for p, x in templates.items()]):
        w = line.split(" ")
        rows += [(w[i], w[i + 1], t, i, len(w), label, base) for i in range(len(w) - 1)]
    d = spark.createDataFrame(rows, "t1 string, t2 string, template int, place int, length int, label string, base boolean")
    return d.withColumn("gram", F.xxhash64("t1", "t2"))


def words(text: Column) -> Column:
    """Words with A-Z as a-z. The Kelvin sign, the only other character that becomes a plain letter, is kept from it."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b"))), F.lit(WORD), F.lit(0))


def hits(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """docs (doc_id, text) -> row (a number of its own), doc_id, n_words, at, and the facts of the template place hit there.

    Each document has one row of template DOCUMENT: its first pair is made of two empty words.
    """
    w = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    blank = F.array(F.lit(""))
    pairs = F.arrays_zip(F.concat(blank, "w").alias("a"), F.concat(blank, F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))).alias("b"))
    each = w.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(pairs).alias("at", "x"))
    each = each.select("row", "doc_id", "n_words", (F.col("at") - 1).alias("at"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    found = each.withColumn("gram", F.xxhash64("a", "b")).join(F.broadcast(template_pairs(docs.sparkSession, phrases, templates)), "gram")
    return found.where("a = t1 and b = t2").drop("gram", "a", "b", "t1", "t2")


def _chain(found: Column, length: Column, slack: int) -> Column:
    """Hits (at, back: minus the place) in order -> the longest verified chain."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("d"))
    start = F.struct(F.array_repeat(none, length).alias("by"), F.lit(0).alias("best"))

    def step(acc: Column, h: Column) -> Column:
        place = -h["back"]
        d = h["at"] - place
        known = F.transform(F.slice(acc["by"], F.lit(1), place), lambda s: F.when(F.abs(s["d"] - d) <= slack, s["n"]).otherwise(0))
        n = 1 + F.coalesce(F.array_max(known), F.lit(0))
        by = F.transform(acc["by"], lambda s, i: F.when(i == place, F.struct(n.alias("n"), d.alias("d"))).otherwise(s))
        return F.struct(by.alias("by"), F.greatest(acc["best"], n).alias("best"))

    return F.aggregate(found, start, step)["best"]


def spans(found: DataFrame, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """hits() -> every span: row, label, base, first_word, last_word (exclusive), score."""
    fact = ["row", "template", "length", "label", "base"]
    lines = found.where(F.col("template") != DOCUMENT).groupBy(*fact, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_list("at").alias("ats"), F.min("at").alias("lo"), (F.max("at") + 2).alias("hi")
    )
    place = [F.col("lo").alias("first_word"), F.col("hi").alias("last_word")]
    exact = lines.where("base and size(ats) = length - 1").select("row", "label", "base", *place, F.lit(1.0).alias("score"))
    order = Window.partitionBy(*fact).orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= slack) & (F.col("lo") - F.lag("hi").over(order) <= F.col("length"))
    merged = lines.where("not base").withColumn("_new", F.when(near, 0).otherwise(1))
    merged = merged.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.transform("ats", lambda at: F.struct(at.alias("at"), (F.col("diagonal") - at).alias("back")))
    merged = merged.withColumn("ats", one).groupBy(*fact, "_span").agg(F.array_sort(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    enough = F.size(F.array_distinct(F.transform("ats", lambda h: h["back"]))) >= least * (F.col("length") - 1)
    loose = merged.where(enough).withColumn("score", _chain(F.col("ats"), F.col("length"), slack) / (F.col("length") - 1)).where(F.col("score") >= least)
    return exact.unionByName(loose.select("row", "label", "base", *place, "score"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, **options) -> DataFrame:
    """One row per document: counts, place of the first and last phrase, labels and the best span's score."""
    found = staged(hits(docs.select("doc_id", "text"), phrases, templates), "license-hits")
    every = found.where(F.col("template") == DOCUMENT).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    both = every.unionByName(spans(found, **options), allowMissingColumns=True)
    base = F.col("base")
    both = both.groupBy("row").agg(
        F.any_value("doc_id", True).alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    return both.drop("row")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same by lists and a recursive chain over the hits of each span."""
    rows, lines = [], [(p, x, "true") for p, x in PHRASES.items()] + [(p, x, "false") for p, x in TEMPLATES.items()]
    for t, (line, label, base) in enumerate(lines):
        w = line.split(" ")
        rows += [f"('{w[i]}', '{w[i + 1]}', {t}, {i}, {len(w)}, '{label}', {base})" for i in range(len(w) - 1)]
    return rf"""
WITH RECURSIVE known(t1, t2, tpl, place, length, label, base) AS (VALUES {", ".join(rows)}),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w))) AS i FROM w), h AS (SELECT r, i - 1 AS pos, tpl, place, length, label, base, i - 1 - place AS dg FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b FROM i) JOIN known ON a = t1 AND b = t2),
l AS (SELECT r, tpl, length, label, base, dg, count(*) AS votes, min(pos) AS lo, max(pos) + 2 AS hi FROM h GROUP BY ALL), x AS (SELECT r, label, lo FROM l WHERE base AND votes = length - 1),
n AS (SELECT *, CASE WHEN dg - lag(dg) OVER o <= {SLACK} AND lo - lag(hi) OVER o <= length THEN 0 ELSE 1 END AS fresh FROM l WHERE NOT base WINDOW o AS (PARTITION BY r, tpl ORDER BY dg)), s AS (SELECT r, tpl, dg, sum(fresh) OVER (PARTITION BY r, tpl ORDER BY dg) AS span FROM n),
c AS (SELECT h.*, s.span, row_number() OVER (PARTITION BY h.r, h.tpl, s.span ORDER BY pos, place DESC) AS k FROM h JOIN s USING (r, tpl, dg)), e AS (SELECT r, tpl, span FROM c GROUP BY ALL HAVING count(DISTINCT place) >= {LEAST} * (any_value(length) - 1)), d AS (SELECT c.* FROM c JOIN e USING (r, tpl, span)),
z AS (SELECT r, tpl, span, length, label, k, list_transform(range(0, length), lambda q: CASE WHEN q = place THEN 1 ELSE 0 END) AS many, list_transform(range(0, length), lambda q: CASE WHEN q = place THEN dg ELSE 0 END) AS far, 1 AS best FROM d WHERE k = 1 UNION ALL
SELECT r, tpl, span, length, label, k, list_transform(range(0, length), lambda q: CASE WHEN q = place THEN v ELSE many[q + 1] END), list_transform(range(0, length), lambda q: CASE WHEN q = place THEN dg ELSE far[q + 1] END), greatest(best, v)
FROM (SELECT d.r, d.tpl, d.span, d.length, d.label, d.k, d.place, d.dg, z.many, z.far, z.best, 1 + coalesce(list_max(list_transform(range(1, d.place + 1), lambda q: CASE WHEN abs(z.far[q] - d.dg) <= {SLACK} THEN z.many[q] ELSE 0 END)), 0) AS v FROM z JOIN d ON d.r = z.r AND d.tpl = z.tpl AND d.span = z.span AND d.k = z.k + 1)),
f AS (SELECT r, label, max(best) / (any_value(length) - 1) AS score FROM z GROUP BY r, tpl, span, label HAVING max(best) >= {LEAST} * (any_value(length) - 1)),
a AS (SELECT r, label, 1.0::DOUBLE AS score, lo FROM x UNION ALL SELECT r, label, score, NULL FROM f)
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(lo) AS n_base, min(lo)::BIGINT AS first_word, max(lo)::BIGINT AS last_word, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (lo IS NOT NULL))), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list(label))), ','), '') AS labels, coalesce(max(score), 0.0::DOUBLE) AS score FROM w LEFT JOIN a USING (r) GROUP BY r
"""


SQL = _sql()
