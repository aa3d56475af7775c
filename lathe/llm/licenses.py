"""License scans by MinHash bands over text windows (operator 4). DataFrame functions only.

Texts and templates become words of lower-case ASCII letters and digits; shingles are three words.
Templates are license notices; longer ones are cut into sections of at most 25 words. Windows
overlap by half: of 16 words for sections of up to 9 words, of 48 for the others, so a section lies whole in
at least one window. Of a window, the shingles that some section of its size class has are
sketched; shingles of no template can't tell one template from another.

Sketch: 64 hash functions, each a band of one row, so a window and a section of Jaccard similarity s
meet in a band with probability 1 - (1 - s)^64. A section that reaches the containment of 0.8 has s of at
least 0.17 (3 of 14 shingles, or 7 of 46, when the rest of the window is filled with other templates):
above 0.9999. Candidates are verified: a section matches if the window has 80 % of its shingles, exactly.

Edge cases: null text is the empty text; texts of any length are scanned whole; rows that repeat an id
and a text give one row a match; null ids are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import common

#: Wordings of public licenses' notices, and short licenses whole.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or at your option any later version"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
SHINGLE = 3
SECTION = 25
#: Class of sections (at most so many words): window and step in words.
CLASSES = ((9, 16, 8), (SECTION, 48, 24))
BANDS = 64
CONTAINMENT = 0.8


def words_of_template(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def sections(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, int, int, list[str]]]:
    """(section number, license, template number, class, distinct shingles)."""
    out = []
    for t, (name, text) in enumerate(templates):
        words = words_of_template(text)
        pieces = -(-len(words) // SECTION)
        step = -(-len(words) // pieces)
        for at in range(0, len(words), step):
            part = words[at : at + step]
            shingles = sorted({" ".join(part[k : k + SHINGLE]) for k in range(len(part) - SHINGLE + 1)})
            if shingles:
                out.append((len(out), name, t, next(c for c, (most, _, _) in enumerate(CLASSES) if len(part) <= most), shingles))
    return out


def _sketch(hashes: Column) -> Column:
    """The BANDS minima of a set of hashes, as an array of (band, least)."""
    return F.array(*(F.struct(F.lit(b).alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(b)))).alias("least")) for b in range(BANDS)))


def hits(docs: DataFrame, id_col: str, text_col: str, parts: list) -> DataFrame:
    """id, copy, at, gram: where a text has a shingle of some template (copy: a hash of the text)."""
    grams = sorted({g for p in parts for g in p[4]})
    firsts = sorted({g.split(" ")[0] for g in grams})
    text = F.coalesce(F.col(text_col), F.lit(""))
    cleaned = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), F.split(cleaned, " ").alias("words"))
    starts = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*firsts), i)), lambda i: i.isNotNull())
    rows = rows.select("id", "copy", "words", starts.alias("starts")).where(F.size("starts") > 0)
    found = rows.select("id", "copy", "words", F.explode("starts").alias("at")).select("id", "copy", "at", F.array_join(F.slice("words", F.col("at") + 1, SHINGLE), " ").alias("gram"))
    return found.where(F.col("gram").isin(*grams))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """id, license, template, section, containment, first_word for each section that a text contains
    (the window with the highest containment, of these the first; words count from 0)."""
    spark = docs.sparkSession
    parts = sections(templates)
    known = spark.createDataFrame([(c, g) for _, _, _, c, grams in parts for g in grams], "class int, gram string").distinct()
    found = hits(docs, id_col, text_col, parts).join(F.broadcast(known), "gram")
    step = F.element_at(F.array(*(F.lit(s) for _, _, s in CLASSES)), F.col("class") + 1)
    first = F.floor(F.col("at") / step)
    reach = F.element_at(F.array(*(F.lit(w - SHINGLE) for _, w, _ in CLASSES)), F.col("class") + 1)
    placed = found.withColumn("window", F.explode(F.array(first, first - 1))).where((F.col("window") >= 0) & (F.col("at") <= F.col("window") * step + reach))
    windows = placed.groupBy("id", "copy", "class", "window").agg(F.collect_set(F.xxhash64("gram")).alias("set"), F.sort_array(F.collect_set(F.struct("at", F.xxhash64("gram").alias("h")))).alias("where"))
    table = spark.createDataFrame([(s, name, t, c, grams) for s, name, t, c, grams in parts], "section int, license string, template int, class int, grams array<string>")
    table = table.withColumn("own", F.transform("grams", lambda g: F.xxhash64(g))).drop("grams")
    index = table.select("section", "class", F.explode(_sketch(F.col("own"))).alias("b")).select("section", "class", "b.band", "b.least")
    met = windows.withColumn("b", F.explode(_sketch(F.col("set")))).select("id", "copy", "class", "window", "set", "where", "b.band", "b.least")
    met = met.join(F.broadcast(index), ["class", "band", "least"]).groupBy("id", "copy", "class", "window", "section").agg(F.first("set").alias("set"), F.first("where").alias("where"))
    share = F.size(F.array_intersect("set", "own")) / F.size("own")
    checked = met.join(F.broadcast(table.drop("class")), "section").withColumn("containment", share).where(F.col("containment") >= containment)
    begin = F.filter("where", lambda x: F.array_contains(F.col("own"), x["h"]))[0]["at"]
    best = checked.groupBy("id", "copy", "section", "license", "template").agg(F.min(F.struct((-F.col("containment")).alias("c"), begin.alias("at"))).alias("best"))
    return best.select("id", "license", "template", "section", (-F.col("best.c")).alias("containment"), F.col("best.at").cast("long").alias("first_word"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "template", "section", F.round("containment", 6).alias("containment"), "first_word")


def _oracle() -> str:
    rows = ", ".join(f"({s}, '{name}', {t}, {c}, {len(grams)}, '{g}')" for s, name, t, c, grams in sections() for g in grams)
    classes = ", ".join(f"({c}, {w}, {s})" for c, (_, w, s) in enumerate(CLASSES))
    return f"""
WITH parts(section, license, template, class, size, gram) AS (VALUES {rows}), classes(class, width, step) AS (VALUES {classes}),
d AS (SELECT row_number() OVER () AS doc, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc, doc_id, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram FROM (SELECT doc, doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
hit AS (SELECT doc, doc_id, section, license, template, size, gram, pos, width, step, unnest([pos // step, pos // step - 1]) AS win FROM s JOIN parts USING (gram) JOIN classes USING (class)),
per AS (SELECT doc, doc_id, section, license, template, win, count(DISTINCT gram) / size::DOUBLE AS share, min(pos) AS first_word
  FROM hit WHERE win >= 0 AND pos <= win * step + width - {SHINGLE} GROUP BY doc, doc_id, section, license, template, size, win HAVING count(DISTINCT gram) / size::DOUBLE >= {CONTAINMENT})
SELECT doc_id, license, template, section, round(share, 6) AS containment, first_word
FROM per QUALIFY row_number() OVER (PARTITION BY doc, section ORDER BY share DESC, first_word) = 1
"""


ORACLE_SQL = _oracle()
