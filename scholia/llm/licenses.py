"""License scans by diagonal voting, with DataFrame operations alone.

Every pair of neighbouring words of every text is hashed and joined to its places in the license templates, and the words
themselves are compared in the join. A hit votes for the diagonal at which the text would hold the template in full, its
place in the text less that in the template. Neighbouring diagonals of MIN_VOTES votes or more are merged, so a few words more
or less do not part a span, while single pairs that stand everywhere do not chain spans together; a span counts if it covers
enough of the template's pairs without being stretched. The short base phrases need all their pairs on a single diagonal, which
is then the place of the phrase.

A text is read once: beside its pairs it sends one row without a vote, which carries its number of words. Only that row and the
hits are shuffled, keyed by document and template, so a frequent word pair or a group of copies meets in no one task: a group
is one text's hits, combined by diagonal where they are found. The templates are constant, and so is the broadcast.

Null and empty texts have no words and no labels. Rows repeated in id and text share one search and all stay. Only doc_id and
text of the input are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import LOWER, UPPER, ascii_lower, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand consecutively.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Openings of well-known public licenses and of the usual notices, as lower-case words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
#: Votes that a diagonal of a template needs to be merged with its neighbours.
MIN_VOTES = 2
MERGE, COVER, STRETCH = 6, 0.6, 1.5


def _templates() -> list[tuple[int, str, bool, str]]:
    return [(i, label, i < len(PHRASES), text) for i, (label, text) in enumerate(PHRASES + TEMPLATES)]


def _pairs() -> list[tuple[int, int, str, str]]:
    """The templates' pairs: template, place, first and second word."""
    found = []
    for i, _, _, text in _templates():
        w = text.split()
        found += [(i, j, a, b) for j, (a, b) in enumerate(zip(w, w[1:]))]
    return found


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _facts() -> list[tuple]:
    """template, label, whether it is a phrase, voting pairs, words."""
    votes = [p[0] for p in _pairs()]
    return [(i, label, phrase, votes.count(i), len(text.split())) for i, label, phrase, text in _templates()]


def _parts(text: Column) -> Column:
    """What stands between the gaps of a text, lower-cased: nothing, its words, and nothing again if it ends in a gap."""
    lower = ascii_lower(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))))
    return F.split(lower, GAP, -1)


def _hits(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text), n (words), i, t, j: the pairs that hit, and for each input row one with i = -1 and t null.

    That row is the pair of the nothing ahead of a text and its first word. The array is exploded as outer since Spark would
    otherwise split each text a second time, to leave out empty arrays, of which there are none.
    """
    pairs = docs.sparkSession.sql(f"SELECT t, j, a AS ta, b AS tb, xxhash64(a, b) AS tg FROM VALUES {_values(_pairs())} AS x(t, j, a, b)")
    words = docs.select("doc_id", F.xxhash64("text").alias("_h"), _parts(F.col("text")).alias("w"))
    grams = words.select("doc_id", "_h", "w", F.posexplode_outer("w").alias("i", "a"))
    n = F.size("w") - 1 - (F.element_at("w", -1) == "").cast("int")
    grams = grams.select("doc_id", "_h", F.when(F.col("i") == 0, n).alias("n"), "i", "a", F.get("w", F.col("i") + 1).alias("b"))
    # keyed by the hash alone, a single number; the words are compared behind the join
    hits = grams.join(F.broadcast(pairs), F.xxhash64("a", "b") == F.col("tg"), "left")
    same = (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))
    hits = hits.where(same | (F.col("i") == 0))
    return hits.select("doc_id", "_h", "n", (F.col("i") - 1).alias("i"), F.when(same, F.col("t")).alias("t"), "j")


def _spans(hits: DataFrame) -> DataFrame:
    """The verified spans, and the rows without a vote as they are (t null), with the number of their repeats in c."""
    facts = hits.sparkSession.sql(f"SELECT * FROM VALUES {_values(_facts())} AS x(t, label, phrase, voters, length)")
    by = ["doc_id", "_h", "t"]
    diagonals = hits.groupBy(*by, (F.col("i") - F.col("j")).alias("d")).agg(
        F.collect_set("j").alias("js"), F.min("i").alias("low"), F.max("i").alias("high"), F.max("n").alias("n"), F.count("*").alias("c")
    )
    diagonals = diagonals.join(F.broadcast(facts), "t", "left").where(f"t IS NULL OR phrase OR size(js) >= {MIN_VOTES}")
    gap = F.col("d") - F.lag("d").over(Window.partitionBy(*by).orderBy("d"))
    fresh = F.when(gap.isNull() | (gap > MERGE) | F.col("phrase"), 1).otherwise(0)
    merged = diagonals.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy(*by, "label", "phrase", "voters", "length", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("votes"), F.min("low").alias("start"), (F.max("high") + 2).alias("end"), F.max("n").alias("n"), F.max("c").alias("c")
    )
    found = found.withColumn("cover", F.col("votes") / F.col("voters"))
    good = F.when(F.col("phrase"), F.col("votes") == F.col("voters")).otherwise((F.col("cover") >= COVER) & (F.col("end") - F.col("start") <= STRETCH * F.col("length")))
    return found.where(F.col("t").isNull() | good)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text), template, label, phrase, start, end (words, exclusive), cover: one row per verified span."""
    found = _spans(_hits(docs.select("doc_id", "text")).where("t IS NOT NULL"))
    return found.select("doc_id", "_h", F.col("t").alias("template"), "label", "phrase", "start", "end", "cover")


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, places of the base phrases, labels, score, and the spans as text."""
    found = _spans(_hits(docs.select("doc_id", "text")))
    place = F.when(F.col("phrase"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    hit = F.col("t").isNotNull()
    told = F.array_sort(F.collect_list(F.when(hit, F.struct("start", "end", "label", "t"))))
    long = lambda c, name: c.cast("long").alias(name)
    by_text = found.groupBy("doc_id", "_h").agg(
        long(F.max("n"), "n_words"), F.max(F.when(~hit, F.col("c"))).alias("c"), F.count(place).alias("n_base"), long(F.min(place), "first_word"), long(F.max(place), "last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max(F.when(hit, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(told, lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
    rows = by_text.select("*", F.explode(F.sequence(F.lit(1), F.col("c"))))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
u AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM d),
g AS (SELECT rid, i, a, lead(a) OVER (PARTITION BY rid ORDER BY i) AS b FROM u),
p AS (SELECT * FROM (VALUES {_values(_pairs())}) x(t, j, a, b)),
f AS (SELECT * FROM (VALUES {_values(_facts())}) x(t, label, phrase, voters, length)),
h AS (SELECT rid, t, i, j, i - j AS d FROM g JOIN p USING (a, b) QUALIFY t < {len(PHRASES)} OR count(DISTINCT j) OVER (PARTITION BY rid, t, i - j) >= {MIN_VOTES}),
o AS (SELECT rid, h.t, i, j, d, CASE WHEN phrase OR d - lag(d) OVER x > {MERGE} OR lag(d) OVER x IS NULL THEN 1 ELSE 0 END AS fresh, phrase FROM h JOIN f USING (t) WINDOW x AS (PARTITION BY rid, h.t ORDER BY d, i, j)),
r AS (SELECT *, CASE WHEN phrase THEN d ELSE sum(fresh) OVER (PARTITION BY rid, t ORDER BY d, i, j ROWS UNBOUNDED PRECEDING) END AS run FROM o),
s AS (SELECT rid, r.t, label, f.phrase, voters, length, count(DISTINCT j) AS votes, min(i) AS s, max(i) + 2 AS e FROM r JOIN f USING (t) GROUP BY rid, r.t, label, f.phrase, voters, length, run),
v AS (SELECT *, votes / voters AS cover FROM s WHERE CASE WHEN phrase THEN votes = voters ELSE votes / voters >= {COVER} AND e - s <= {STRETCH} * length END),
z AS (SELECT rid, count(*) FILTER (phrase) AS n_base, min(s) FILTER (phrase) AS first_word, max(s) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score,
  string_agg(label || ':' || s || ':' || e, ',' ORDER BY s, e, label, t) AS spans FROM v GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (rid)
"""

QUERIES = {"op1_licenses": op1_licenses}
SQL = {"op1_licenses": OP1_SQL}
