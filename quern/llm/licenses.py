"""License scans by diagonal voting.

The words of every text are hashed in rolling k-grams and joined to the places that
their hashes have in license templates; a hit counts if its words are the template's, one
by one. A place in the text less its place in the template is a diagonal; a copy of a
template is many k-grams on one diagonal, or on neighbouring ones where words were added or
left out. Diagonals are summed up, and those that neighbour each other merged into bands.
Bands that follow each other in the text and in the template, at most :data:`GAP` words
apart, are one span, and a span counts as a copy if the template words under its k-grams
make up enough of the template. Of copies that share words of the text, as those of two
versions of one license do, the one with most words stays.

Three phrases are also looked for directly; the places where they stand are counted.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import documents, text_of

#: Words of a k-gram; neighbouring diagonals differ by at most so much; words of the text
#: between bands of one span, at most; and the share of a template's words that a span covers.
GRAM = 3
NEIGHBOURS = 3
GAP = 60
COVER = 0.8

#: Score of a text with a phrase and no copy.
PHRASE_SCORE = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are labels by themselves.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices by which the licenses are commonly declared.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    (
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    (
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring "
        "rights to this work.",
    ),
    ("cc0-1.0", "CC0 1.0 Universal"),
    (
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 "
        "of the License, or (at your option) any later version.",
    ),
    (
        "lgpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
]

_WORD = re.compile(WORD.encode())
_PLACES = [
    (label, re.compile(rb"(?= " + phrase.encode() + rb" )"), phrase.encode())
    for phrase, label in PHRASES.items()
]


def key_of(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("tid"), F.octet_length(text).alias("size")]


def words_of(text: Column) -> Column:
    """The words of ``text``, lower-cased in A-Z."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(text, upper, lower), F.lit(WORD), F.lit(0))


def gram_hashes(words: Column, k: int = GRAM) -> Column:
    """Hashes of all rolling k-grams of ``words``."""
    return F.transform(
        F.array(F.transform(words, lambda w: F.xxhash64(w))),  # named, to be computed once
        lambda h: F.when(F.size(h) < k, F.array().cast("array<long>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (k - 1))),
                lambda i: F.xxhash64(F.slice(h, i, k)),
            )
        ),
    )[0]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``(hash, gram, template, at, label, words)``: a row for each place in each template."""
    rows = [
        (i, label, text, len(_WORD.findall(text.encode().lower())))
        for i, (label, text) in enumerate(templates)
    ]
    table = spark.createDataFrame(rows, "template int, label string, text string, words int")
    table = table.withColumn("w", words_of(F.col("text")))
    table = table.select("template", "label", "words", "w", F.posexplode(gram_hashes(F.col("w"))).alias("at", "hash"))
    return table.withColumn("gram", F.slice("w", F.col("at") + 1, F.lit(GRAM))).drop("w")


def copies(
    docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None
) -> DataFrame:
    """``(tid, size, label, start, end, n, cover)``: spans of texts that copy a template.

    ``start`` and ``end`` are words, from 0, the end excluded; ``n`` are the words of the
    text that are the template's, and ``cover`` is their share of the template. Lone k-grams
    join no other band. Equal texts are found once.
    """
    k = GRAM
    # The templates are fixed and few, so their places fit in every task.
    places = F.broadcast(template_grams(docs.sparkSession, templates or TEMPLATES))
    body = text_of(text)
    told = docs.select(*key_of(body), words_of(body).alias("w"))
    grams = told.select("tid", "size", "w", F.posexplode(gram_hashes(F.col("w"))).alias("pos", "hash"))
    hits = grams.join(places, "hash").filter(F.slice("w", F.col("pos") + 1, F.lit(k)) == F.col("gram"))
    lane = ["tid", "size", "template", "label", "words"]
    votes = hits.groupBy(*lane, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set(F.struct("pos", "at")).alias("found")
    )
    along = Window.partitionBy("tid", "size", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS, F.lit(True))
    bands = (
        votes.withColumn("new", apart.cast("int"))
        .withColumn("band", F.sum("new").over(along))
        .groupBy(*lane, "band")
        .agg(F.flatten(F.collect_list("found")).alias("found"))
        .withColumn("lone", F.size("found") == 1)
    )
    each = lambda name: F.transform("found", lambda f: f[name])
    for name, least, most in (("pos", "start", "stop"), ("at", "low", "high")):
        bands = bands.withColumn(least, F.array_min(each(name))).withColumn(most, F.array_max(each(name)))
    # Bands in order of the text: one that goes on in the template goes on a span.
    after = Window.partitionBy("tid", "size", "template", "lone").orderBy("start", "low", "band")
    before = lambda c: F.lag(c).over(after)
    follows = (
        ~F.col("lone")
        & (F.col("stop") > before("stop"))
        & (F.col("low") > before("low"))
        & (F.col("high") > before("high"))
        & (F.col("start") - before("stop") <= GAP + k)
    )
    spans = (
        bands.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int"))
        .withColumn("span", F.sum("new").over(after))
        .groupBy(*lane, "lone", "span")
        .agg(
            F.flatten(F.collect_list("found")).alias("found"),
            F.min("start").alias("start"),
            (F.max("stop") + k).alias("end"),
        )
    )
    covered = lambda name: F.size(
        F.array_distinct(F.flatten(F.transform("found", lambda f: F.sequence(f[name], f[name] + (k - 1)))))
    )
    kept = (
        spans.withColumn("cover", covered("at") / F.col("words"))
        .filter(F.col("cover") >= COVER)
        .select("tid", "size", "template", "label", "start", "end", covered("pos").alias("n"), "cover")
    )
    # Copies that share words are one cluster.
    text_order = Window.partitionBy("tid", "size").orderBy("start", "end", "template", "n")
    reached = F.max("end").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    clusters = kept.withColumn("apart", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    clusters = clusters.withColumn("cluster", F.sum("apart").over(text_order))
    best = Window.partitionBy("tid", "size", "cluster").orderBy(F.desc("n"), F.desc("cover"), "template", "start")
    return (
        clusters.withColumn("rank", F.row_number().over(best))
        .filter("rank = 1")
        .select("tid", "size", "label", "start", "end", "n", "cover")
    )


def phrase_places(text: Column) -> Column:
    """Words of each text, places of the phrases, the first and last, and the labels."""

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base array<string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = _WORD.findall(text.encode().lower())
            line = b" " + b" ".join(words) + b" "
            places, labels = [], []
            for label, pattern, phrase in _PLACES:
                if phrase in line:
                    found = [m.start() for m in pattern.finditer(line)]
                    if found:
                        labels.append(label)
                        places += found
            first = line.count(b" ", 0, min(places)) if places else None
            last = line.count(b" ", 0, max(places)) if places else None
            out.append((len(words), len(places), first, last, sorted(labels)))
        made = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base"])
        return made.astype({"first_word": "Int64", "last_word": "Int64"})

    return of(text)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labels of every row of ``docs`` with what they rest on.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are
    their smallest and largest word, null without any; ``base_labels`` are their labels and
    ``labels`` also those of copied templates. ``score`` is the largest share of a
    template covered by a copy, at least :data:`PHRASE_SCORE` where a phrase stands, else
    0. Null texts have no words. Rows with equal
    keys or texts are returned as they come; an empty table gives an empty result.
    """
    body = text_of(text)
    found = copies(docs, text).groupBy("tid", "size").agg(
        F.collect_set("label").alias("own"), F.max("cover").alias("cover")
    )
    rows = docs.select(F.col(key).alias("_k"), *key_of(body), phrase_places(body).alias("p"))
    base = F.col("p.base")
    return rows.join(found, ["tid", "size"], "left").select(
        F.col("_k").alias(key),
        "p.n_words",
        "p.n_base",
        "p.first_word",
        "p.last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))), ","
        ).alias("labels"),
        F.greatest(
            F.coalesce("cover", F.lit(0.0)), F.when(F.col("p.n_base") > 0, PHRASE_SCORE).otherwise(0.0)
        ).alias("score"),
    )


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and copied notices of every document."""
    return scanned(documents(spark, folder))


QUERIES = {"op9_license_scan": op9_license_scan}


def _sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))
    split = (
        "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz'), '" + WORD + "')"
    )
    stands = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        here = " AND ".join(f"w[i + {n}] = {quoted(word)}" for n, word in enumerate(words))
        stands.append(f"SELECT r, i - 1 AS place, {quoted(label)} AS label FROM places WHERE {here}")
    return f"""
WITH told AS (
  SELECT row_number() OVER () AS r, doc_id, {split.format("coalesce(text, '')")} AS w FROM documents
), places AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM told
), base AS (
  SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
  FROM ({" UNION ALL ".join(stands)}) GROUP BY r
), templates AS (
  SELECT t, label, {split.format("text")} AS w FROM (VALUES {table}) v(t, label, text)
), template_places AS (
  SELECT t, label, w, len(w) AS words, unnest(range(1, len(w) - 1)) AS i FROM templates
), hits AS (
  SELECT p.r, q.t, q.label, q.words, q.i - 1 AS place, p.i - 1 AS pos, p.i - q.i AS diagonal
  FROM places p JOIN template_places q
    ON p.w[p.i] = q.w[q.i] AND p.w[p.i + 1] = q.w[q.i + 1] AND p.w[p.i + 2] = q.w[q.i + 2]
), diagonals AS (
  SELECT r, t, diagonal,
         CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) <= {NEIGHBOURS}
           THEN 0 ELSE 1 END AS s
  FROM (SELECT DISTINCT r, t, diagonal FROM hits)
), numbered AS (
  SELECT r, t, diagonal, sum(s) OVER (PARTITION BY r, t ORDER BY diagonal) AS band FROM diagonals
), banded AS (
  SELECT * FROM hits JOIN numbered USING (r, t, diagonal)
), bands AS (
  SELECT r, t, band, count(*) = 1 AS lone, min(pos) AS low_pos, max(pos) AS high_pos,
         min(place) AS low, max(place) AS high
  FROM banded GROUP BY r, t, band
), followed AS (
  SELECT *, CASE WHEN NOT lone AND high_pos > lag(high_pos) OVER a AND low > lag(low) OVER a
                   AND high > lag(high) OVER a AND low_pos - lag(high_pos) OVER a <= {GAP + GRAM}
              THEN 0 ELSE 1 END AS s
  FROM bands WINDOW a AS (PARTITION BY r, t, lone ORDER BY low_pos, low, band)
), linked AS (
  SELECT r, t, band, lone,
         sum(s) OVER (PARTITION BY r, t, lone ORDER BY low_pos, low, band) AS span FROM followed
), spans AS (
  SELECT r, t, lone, span, any_value(label) AS label, min(pos) AS first, max(pos) + {GRAM} AS past,
         count(DISTINCT pos + j) AS n, count(DISTINCT place + j) / any_value(words) AS cover
  FROM (SELECT *, unnest([0, 1, 2]) AS j FROM banded JOIN linked USING (r, t, band))
  GROUP BY r, t, lone, span
), kept AS (
  SELECT *, CASE WHEN first >= max(past) OVER (PARTITION BY r ORDER BY first, past, t, n
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS s
  FROM spans WHERE cover >= {COVER}
), clusters AS (
  SELECT *, sum(s) OVER (PARTITION BY r ORDER BY first, past, t, n) AS cluster FROM kept
), best AS (
  SELECT * FROM clusters
  QUALIFY row_number() OVER (PARTITION BY r, cluster ORDER BY n DESC, cover DESC, t, first) = 1
), found AS (
  SELECT r, list(DISTINCT label) AS labels, max(cover) AS cover FROM best GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
       CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(
         list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       greatest(coalesce(f.cover, 0.0::DOUBLE), CASE WHEN b.n > 0 THEN {PHRASE_SCORE}::DOUBLE ELSE 0 END) AS score
FROM told LEFT JOIN base b USING (r) LEFT JOIN found f USING (r)
"""


SQL = {"op9_license_scan": _sql()}
