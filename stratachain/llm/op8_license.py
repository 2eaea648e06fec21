"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams. DataFrame functions only.

Lines, paragraphs and the whole text are each a unit. A unit is normalised (A-Z lowered, all but a-z, 0-9 and inner dots blank),
cut to words, and compared by its set of bigrams with the templates whose size the Dice bound admits: with likeness t a
unit of n bigrams can only match templates of n*t/(2-t) to n*(2-t)/t bigrams. Besides, all stretches of the text that have
as many bigrams as a template, at every position, over line ends and comment marks, are compared with it in the same way, so that a notice
is found inside a longer line. A unit counts for the template that it is most like, of equally like ones for all; a stretch counts for its
template unless another id's is more like a stretch that begins within a fifth of the template's length of it. So versions of a licence, whose
texts are alike, are told apart. Texts without any word that a match must hold aren't cut up at all. Everything happens within a row;
nothing is shuffled. The SQL knows the units only: it finds the same or less.

Cases: null and empty texts, and units of one word, match nothing (no id, score 0); of templates that match a unit equally well the
first id in order counts; repeated rows are scanned each; an empty table gives an empty result; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .op10_bpe import documents

LIKE = 0.8

#: Public licence notices and texts by SPDX id. A parameter of ``scan``.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pairs(text: str) -> list[str]:
    text = re.sub(r"[^a-z0-9.]+", " ", text.translate(str.maketrans(_UPPER, _LOWER)))
    words = [w for w in re.sub(r"\.+( |$)", " ", text).split(" ") if w]
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _bigrams(text: str) -> list[str]:
    return list(dict.fromkeys(_pairs(text)))


def compiled(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(id, bigrams) of each template text, by id."""
    return [(k, g) for k in sorted(templates) for t in templates[k] if (g := _bigrams(t))]


def anchors(made: list[tuple[str, list[str]]], like: float = LIKE) -> str:
    """A pattern that every matching unit holds. A match shares t/(2-t) of a template's bigrams, so it holds one of
    any few more than the rest; the ones with the longest words are asked for, by their longest word."""
    words = set()
    for _, grams in made:
        few = len(grams) - math.ceil(len(grams) * like / (2 - like) - 1e-9) + 1
        longest = sorted((max(g.split(), key=lambda w: (len(w), w)) for g in grams), key=lambda w: (-len(w), w))
        words |= set(longest[:few])
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, sorted(words)))})(?![a-z0-9])"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often a lambda in ``use`` asks for it."""
    return F.transform(F.array(value), use)[0]


def _sequence(unit: Column) -> Column:
    """All bigrams in order, repeats too; null where there is none."""
    text = F.regexp_replace(F.translate(unit, _UPPER, _LOWER), "[^a-z0-9.]+", " ")
    words = F.filter(F.split(F.regexp_replace(text, r"\.+( |$)", " "), " "), lambda w: w != "")
    size = F.size(words)
    return F.when(size > 1, F.zip_with(F.slice(words, 1, F.greatest(size - 1, F.lit(0))), F.slice(words, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def _windows(grams: Column, templates: Column, known: Column, like: float) -> Column:
    """(score, id) of every stretch of ``grams`` as long as a template and at least so like it. ``known``: all templates' bigrams."""

    def windows(t: Column, hits: Column) -> Column:
        # a match holds t["need"] bigrams of the template; starts are all from which so many lie within its length
        dense = F.filter(F.sequence(F.lit(0), F.size(hits) - t["need"]), lambda k: hits[k + t["need"] - 1] - hits[k] < t["length"])
        starts = F.array_distinct(F.flatten(F.transform(dense, lambda k: F.sequence(F.greatest(hits[k] - t["length"] + 1, F.lit(0)), F.least(hits[k], F.size(grams) - t["length"])))))
        dice = lambda w, u: _let(w, lambda w: F.size(F.array_intersect(w, u["grams"])) * 2.0 / (F.size(w) + u["n"]))
        near = lambda i: F.sequence(F.greatest(i - t["shift"], F.lit(0)), i + t["shift"])
        beaten = lambda i, own: F.exists(t["rivals"], lambda u: F.exists(near(i), lambda j: dice(F.array_distinct(F.slice(grams, j + 1, u["length"])), u) > own))
        best = lambda i, own: F.when((own >= like) & ~beaten(i, own), F.struct(own.alias("score"), t["id"].alias("id")))
        hits = F.transform(starts, lambda i: _let(dice(F.array_distinct(F.slice(grams, i + 1, t["length"])), t), lambda own: best(i, own)))
        return F.filter(hits, lambda d: d.isNotNull())

    def placed(t: Column) -> Column:
        return _let(F.filter(F.transform(grams, lambda g, p: F.when(F.array_contains(t["grams"], g), p)), lambda p: p.isNotNull()), lambda hits: windows(t, hits))

    def fitting(some: Column) -> Column:
        fits = F.filter(templates, lambda t: (t["length"] <= F.size(grams)) & (F.size(F.array_intersect(some, t["grams"])) >= t["need"]))
        return F.flatten(F.transform(fits, placed))

    return _let(F.array_intersect(grams, known), fitting)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, like: float = LIKE, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, license_id (best match), score (its Dice coefficient, 0 without match), licenses (all matching ids, by comma)."""
    made = compiled(templates if templates is not None else TEMPLATES)
    by_id = templates if templates is not None else TEMPLATES
    lengths = [len(p) for k in sorted(by_id) for t in by_id[k] if (p := _pairs(t))]
    need = lambda g: math.ceil(len(g) * like / (2 - like) - 1e-9)
    look = lambda g, m: [F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n"), F.lit(m).alias("length")]
    every = [(k, g, m) for (k, g), m in zip(made, lengths, strict=True)]
    # what is nearer than another to a stretch that is 0.8 like that shares half of its bigrams
    rivals = lambda k, g: F.array(*(F.struct(*look(h, m)) for j, h, m in every if j != k and 4 * len(set(g) & set(h)) >= len(g) + len(h))).cast("array<struct<grams:array<string>,n:int,length:int>>")
    table = F.array(*(F.struct(F.lit(k).alias("id"), *look(g, m), F.lit(need(g)).alias("need"), F.lit(m // 5 + 1).alias("shift"), rivals(k, g).alias("rivals")) for k, g, m in every))
    known = F.array(*map(F.lit, sorted({x for _, g in made for x in g})))
    least, most = min(len(g) for _, g in made), max(len(g) for _, g in made)
    low, high = like / (2 - like), (2 - like) / like
    text = F.coalesce("text", F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))
    pattern = anchors(made, like)
    some = F.when(text.rlike(pattern), F.filter(units, lambda u: u.rlike(pattern))).otherwise(F.array().cast("array<string>"))
    grams = F.filter(F.transform(some, lambda u: F.array_distinct(_sequence(u))), lambda g: g.isNotNull() & F.size(g).between(least * low, most * high))

    def matched(g: Column) -> Column:
        fits = F.filter(F.col("_templates"), lambda t: (t["n"] >= F.size(g) * low) & (t["n"] <= F.size(g) * high))
        dice = F.transform(fits, lambda t: F.struct((F.size(F.array_intersect(g, t["grams"])) * 2.0 / (F.size(g) + t["n"])).alias("score"), t["id"].alias("id")))
        good = F.filter(dice, lambda d: d["score"] >= like)
        return _let(F.array_max(F.transform(good, lambda d: d["score"])), lambda top: F.filter(good, lambda d: d["score"] == top))

    # the best of all: the highest score, then the first id
    best = F.aggregate("_hits", F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("id")), lambda a, d: F.when((d["score"] > a["score"]) | ((d["score"] == a["score"]) & (d["id"] < a["id"])), d).otherwise(a))
    inside = F.when(text.rlike(pattern), _let(F.coalesce(_sequence(text), F.array().cast("array<string>")), lambda g: _windows(g, F.col("_templates"), known, like)))
    hits = F.concat(F.flatten(F.transform(grams, matched)), F.coalesce(inside, F.array().cast("array<struct<score:double,id:string>>")))
    out = docs.select(*columns, "text").withColumn("_templates", table).select(*columns, hits.alias("_hits"))
    out = out.withColumn("_best", best)
    return out.select(*columns, F.col("_best.id").alias("license_id"), F.round("_best.score", 6).alias("score"), F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda d: d["id"]))), ",").alias("licenses"))


def oracle_sql(templates: dict[str, list[str]] | None = None, like: float = LIKE) -> str:
    made = compiled(templates if templates is not None else TEMPLATES)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, [{', '.join(map(quote, g))}])" for k, g in made)
    low, high = like / (2 - like), (2 - like) / like
    return f"""
WITH templates(id, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (SELECT DISTINCT r, u FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS u FROM docs
  UNION ALL SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM docs
  UNION ALL SELECT r, text FROM docs)),
words AS (SELECT r, list_filter(string_split(regexp_replace(regexp_replace(translate(u, '{_UPPER}', '{_LOWER}'), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM units),
grams AS (SELECT row_number() OVER () AS k, r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
hits AS (SELECT k, r, id, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS score FROM grams JOIN templates
  ON len(grams) >= len(g) * {low!r} AND len(grams) <= len(g) * {high!r}),
kept AS (SELECT * FROM hits WHERE score >= {like} QUALIFY score = max(score) OVER (PARTITION BY k)),
best AS (SELECT r, id, score FROM kept QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) = 1),
all_ids AS (SELECT r, string_agg(id, ',' ORDER BY id) AS licenses FROM (SELECT DISTINCT r, id FROM kept) GROUP BY r)
SELECT doc_id, best.id AS license_id, round(coalesce(best.score, 0), 6) AS score, coalesce(licenses, '') AS licenses
FROM docs LEFT JOIN best USING (r) LEFT JOIN all_ids USING (r)"""


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
