"""License scans by diagonal voting.

Rolling hashes of word pairs are joined to the positions of known phrases.  A hit at word p
for position t of a phrase votes for the diagonal p - t; a phrase that stands in the text
puts all its hits on one diagonal, and one with a word more or less on neighbouring ones.
Diagonals that are close and follow each other, in the text and in the phrase, are merged,
and a span is verified by the share of the phrase that it covers in order.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count only as a whole, word for word.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Opening or standard wordings of notices, which may be changed a little.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is dedicated to the public domain", "public-domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights", "cc0-1.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache-2.0"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu affero general public license version 3", "agpl-3.0"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "bsl-1.0"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl"),
    ("is made available under the open database license", "odbl"),
    ("no part of this publication may be reproduced distributed or transmitted in any form", "proprietary"),
    ("unauthorized copying of this file via any medium is strictly prohibited", "proprietary"),
)
#: Share of a notice's word pairs that a span must cover.
MIN_COVER = 0.75
#: Diagonals this close, with a gap of so many words at most, are one span.
NEAR, GAP = 3, 4
_END = -1  # a row per document that carries its number of words


def _templates(spark: SparkSession) -> DataFrame:
    """(hash, phrase, at): every word pair of every phrase; fixed size, a few hundred rows."""
    rows = [(k, at, *pair) for k, (phrase, _) in enumerate(BASE + NOTICES) for at, pair in enumerate(zip(phrase.split(), phrase.split()[1:], strict=False))]
    pairs = spark.createDataFrame(rows, "phrase int, at int, a string, b string").select(F.xxhash64("a", "b").alias("hash"), "phrase", "at")
    end = spark.range(1).select(F.lit(0).cast("long").alias("hash"), F.lit(_END).alias("phrase"), F.lit(0).alias("at"))
    return F.broadcast(pairs.unionByName(end))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, spans (phrase's label, base, start, end,
    cover), in words from 0, end exclusive.

    A null or empty text has no words and no spans; a text of any length is read whole.
    Rows that repeat an id keep a row each, a null id stays null, and no rows give no rows.
    Other columns of docs are not read, whatever their names.
    """
    spark = docs.sparkSession
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    templates = _templates(spark)
    known = sorted({r.hash for r in templates.collect()} - {0})
    words = F.regexp_extract_all(F.translate(F.coalesce(text_col, F.lit("")), upper, upper.lower()), F.lit(WORD), F.lit(0))
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("words"))
    # only pairs that some phrase has become rows, and one row for the number of words
    pairs = F.transform("words", lambda w, i: F.struct(i.alias("p"), F.xxhash64(w, F.get(F.col("words"), i + 1)).alias("hash")))
    end = F.struct(F.size("words").alias("p"), F.lit(0).cast("long").alias("hash"))
    df = df.select("row", "doc_id", F.explode(F.concat(F.filter(pairs, lambda x: x["hash"].isin(known)), F.array(end))).alias("x")).select("row", "doc_id", "x.p", "x.hash")

    votes = df.join(templates, "hash").select("row", "doc_id", "phrase", "p", "at", (F.col("p") - F.col("at")).alias("diagonal"))
    seen = F.bit_or(F.expr("shiftleft(1L, at)"))  # a diagonal's pairs of the phrase; its places follow
    diagonals = votes.groupBy("row", "doc_id", "phrase", "diagonal").agg(
        F.bit_count(seen).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.min("p").alias("start"), (F.max("p") + 2).alias("end")
    )
    diagonals = durable(diagonals, "license-diagonals")
    phrases = BASE + NOTICES
    sizes = F.array(*[F.lit(len(p.split()) - 1) for p, _ in phrases])
    labels = F.array(*[F.lit(label) for _, label in phrases])
    diagonals = diagonals.withColumn("size", F.get(sizes, F.col("phrase")))

    # base phrases need every pair on one diagonal; a document's end row passes as it is
    exact = diagonals.filter((F.col("phrase") < len(BASE)) & F.when(F.col("phrase") == _END, True).otherwise(F.col("n") == F.col("size")))
    exact = exact.select("row", "doc_id", "phrase", "start", "end", F.lit(1.0).alias("cover"))

    loose = diagonals.filter(F.col("phrase") >= len(BASE))
    ordered = Window.partitionBy("row", "phrase").orderBy("start", "diagonal")
    # a span goes on in the order of its phrase: pairs that stood in it already begin another
    apart = (
        (F.col("start") - F.lag("end").over(ordered) > GAP)
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(ordered)) > NEAR)
        | (F.col("low") <= F.lag("high").over(ordered))
    )
    loose = loose.withColumn("span", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
    loose = loose.withColumn("span", F.sum("span").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # so each pair of the phrase counts once in n
    merged = loose.groupBy("row", "doc_id", "phrase", "span").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("size").alias("size"))
    merged = merged.withColumn("cover", F.col("n") / F.col("size"))
    # a span far longer than its phrase is the phrase's words at random
    verified = merged.filter((F.col("cover") >= MIN_COVER) & (F.col("end") - F.col("start") <= 2 * (F.col("size") + 1)))
    spans = exact.unionByName(verified.select("row", "doc_id", "phrase", "start", "end", "cover"))

    label = F.get(labels, F.col("phrase"))
    span = F.struct(label.alias("label"), (F.col("phrase") < len(BASE)).alias("base"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("cover").alias("cover"))
    own = F.col("phrase") != _END
    found = spans.groupBy("row", "doc_id").agg(F.max(F.when(~own, F.col("start"))).cast("long").alias("n_words"), F.collect_list(F.when(own, span)).alias("all"))

    def outdone(s: Column) -> Column:
        """An altered notice where a wording that fits better stands."""
        return (s["cover"] < 1) & F.exists("all", lambda o: ~o["base"] & (o["cover"] > s["cover"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]))

    return found.select("doc_id", "n_words", F.filter("all", lambda s: ~outdone(s)).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def joined(spans) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


_ROWS = ", ".join(f"({k}, '{label}', {str(k < len(BASE)).lower()}, string_split('{phrase}', ' '))" for k, (phrase, label) in enumerate(BASE + NOTICES))
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
f(k, label, base, w) AS (VALUES {_ROWS}),
t AS (SELECT k, label, base, len(w) - 1 AS size, unnest(range(1, len(w))) AS i, w FROM f),
g AS (SELECT r, unnest(range(1, len(w))) AS i, w FROM d),
v AS (
  SELECT g.r, k, label, base, size, g.i - 1 AS p, t.i - 1 AS pos
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b FROM g) g JOIN (SELECT *, w[i] AS a, w[i + 1] AS b FROM t) t USING (a, b)),
x AS (
  SELECT r, k, label, base, size, p - pos AS diagonal, count(DISTINCT pos) AS n, min(pos) AS low, max(pos) AS high, min(p) AS s, max(p) + 2 AS e
  FROM v GROUP BY ALL),
y AS (
  SELECT *, CASE WHEN s - lag(e) OVER o > {GAP} OR abs(diagonal - lag(diagonal) OVER o) > {NEAR} OR low <= lag(high) OVER o OR lag(e) OVER o IS NULL THEN 1 ELSE 0 END AS new
  FROM x WHERE NOT base WINDOW o AS (PARTITION BY r, k ORDER BY s, diagonal)),
z AS (SELECT *, sum(new) OVER (PARTITION BY r, k ORDER BY s, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM y),
m AS (SELECT r, label, size, sum(n)::DOUBLE / size AS cover, min(s) AS s, max(e) AS e FROM z GROUP BY r, k, label, size, span),
q AS (SELECT r, label, cover, s, e FROM m WHERE cover >= {MIN_COVER} AND e - s <= 2 * (size + 1)),
a AS (
  SELECT r, label, true AS base, s, 1.0::DOUBLE AS cover FROM x WHERE base AND n = size
  UNION ALL
  SELECT r, label, false, s, cover FROM q WHERE cover = 1 OR NOT EXISTS (SELECT 1 FROM q o WHERE o.r = q.r AND o.cover > q.cover AND o.s < q.e AND q.s < o.e))
SELECT d.doc_id, any_value(len(d.w))::BIGINT AS n_words, count(*) FILTER (WHERE a.base)::BIGINT AS n_base,
       min(a.s) FILTER (WHERE a.base)::BIGINT AS first_word, max(a.s) FILTER (WHERE a.base)::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list(a.label) FILTER (WHERE a.base))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list(a.label) FILTER (WHERE a.label IS NOT NULL))), ','), '') AS labels, coalesce(max(a.cover), 0) AS score
FROM d LEFT JOIN a USING (r) GROUP BY d.r, d.doc_id
"""
