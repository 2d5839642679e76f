"""License statements in documents, with DataFrame functions only.

A template of n words is looked for in windows of 2 * n words that overlap by half, so
that a run of n words lies whole in one of them. Shingles have three words. A window is
cut down to the shingles that templates of its length have; MinHash bands (one minimum
each) of what is left retrieve templates, and exact containment of the template's
shingles, at least CONTAINED, verifies them. A window that contains so much of a
template has a similarity of 0.2 or more even where it holds pieces of several others,
and then shares one of the BANDS minima with a probability above 1 - 0.8 ** 64 > 0.999999.

Texts without any of a few anchor words are passed over first. Nothing is lost by that:
more than 1 - CONTAINED of each template's shingles have an anchor in them.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE, BANDS, CONTAINED = 3, 64, 0.8

#: License identifier and wording; a license may have several.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def anchors(templates: list[tuple[str, str]]) -> list[str]:
    """Words, the longest first, until each template has one in more than 1 - CONTAINED of its shingles."""
    chosen: set[str] = set()
    for _, text in templates:
        words = words_of(text)
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        for word in sorted(set(words), key=lambda w: (w not in chosen, -len(w), w)):
            if sum(any(w in chosen for w in s) for s in shingles) > (1 - CONTAINED) * len(shingles) + 1e-9:
                break
            chosen.add(word)
    return sorted(chosen)


def _tokens(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(text, upper, upper.lower()), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: str) -> Column:
    """Hashes of the shingles of an array column; an empty array if there are fewer words than one has."""
    at = lambda i, k: F.get(F.col(words), i + k)
    places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) >= SHINGLE, F.transform(places, lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: str) -> Column:
    """BANDS minima, each as a struct of its number and value."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(F.col(shingles), lambda x: F.xxhash64(x, b))).alias("low")))


@lru_cache(1)
def _anchor_pattern() -> str:
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(anchors(TEMPLATES))})(?![a-z0-9])"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (the best), n_windows, first_word (where the first window begins).

    One row for each document and license found in it; ids that repeat with the same text
    are one document, with another text they share rows. Null, empty and short texts have
    none; a null id is kept.
    """
    spark = docs.sparkSession
    known = spark.sql(f"SELECT template, license, split(t, ' ') AS w FROM VALUES {_values()} AS v(template, license, n, t)")
    known = known.select("template", "license", F.size("w").alias("n"), F.array_distinct(_shingles("w")).alias("own"))
    vocabulary = known.select("n", F.explode("own").alias("shingle")).distinct()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(_anchor_pattern()))
    words = texts.select("doc_id", F.xxhash64("text").alias("key"), _tokens(F.col("text")).alias("w"))
    shingles = words.select("doc_id", "key", F.posexplode(_shingles("w")).alias("pos", "shingle"))
    hits = shingles.join(F.broadcast(vocabulary), "shingle")  # bounded by the templates
    number = F.floor(F.col("pos") / F.col("n")).cast("int")
    windows = hits.select("doc_id", "key", "n", "shingle", F.explode(F.array(number, number - 1)).alias("k")).where("k >= 0")
    windows = windows.groupBy("doc_id", "key", "n", "k").agg(F.collect_set("shingle").alias("held"))
    retrieved = windows.select("*", F.explode(_bands("held")).alias("b")).select("doc_id", "key", "n", "k", "held", "b.band", "b.low")
    bands = known.select("template", "license", "n", "own", F.explode(_bands("own")).alias("b")).select("template", "license", "n", "own", "b.band", "b.low")
    candidates = retrieved.join(F.broadcast(bands), ["n", "band", "low"])
    contained = F.size(F.array_intersect("held", "own")) / F.size("own")
    found = candidates.select("doc_id", "license", (F.col("k") * F.col("n")).alias("first"), "key", "template", contained.alias("c")).where(F.col("c") >= CONTAINED)
    found = found.groupBy("doc_id", "key", "template", "first", "license").agg(F.max("c").alias("c"))
    return found.groupBy("doc_id", "license").agg(F.max("c").alias("containment"), F.count("*").alias("n_windows"), F.min("first").alias("first_word"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ", ".join(f"({i}, '{name}', {len(words_of(text))}, '{' '.join(words_of(text))}')" for i, (name, text) in enumerate(TEMPLATES))


OP8_SQL = f"""
WITH t(template, license, n, text) AS (VALUES {_values()}),
tw AS (SELECT template, license, n, string_split(text, ' ') AS w FROM t),
own AS (SELECT DISTINCT template, license, n, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM tw)),
sizes AS (SELECT template, count(*) AS size FROM own GROUP BY template),
d AS (
  SELECT DISTINCT doc_id, text,
    list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), s AS (SELECT doc_id, text, i - 1 AS pos, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT doc_id, text, template, license, n, s.s AS s, pos // n AS k FROM s JOIN own ON s.s = own.s),
w AS (SELECT DISTINCT doc_id, text, template, license, n, s, k FROM h UNION SELECT DISTINCT doc_id, text, template, license, n, s, k - 1 FROM h WHERE k > 0),
c AS (SELECT doc_id, text, template, license, n, k, count(*) AS held FROM w GROUP BY ALL),
f AS (SELECT doc_id, license, CAST(held AS DOUBLE) / size AS c, k * n AS first FROM c JOIN sizes USING (template) WHERE CAST(held AS DOUBLE) / size >= {CONTAINED})
SELECT doc_id, license, max(c) AS containment, count(*) AS n_windows, CAST(min(first) AS INTEGER) AS first_word FROM f GROUP BY doc_id, license
"""
