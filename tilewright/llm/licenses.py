"""License scans by diagonal voting, in DataFrame expressions only.

All rolling 3-word hashes of every document are joined to the positions of the same hashes in the license templates (a fixed list, so
its broadcast is bounded). A shared passage lines up on one offset diagonal (place in the document less place in the template), and an
inserted or missing word moves it to a neighbouring one: votes are aggregated by diagonal, neighbouring diagonals are merged, and a merged
span is verified by the share of the template's words that it covers. Verified spans are taken by rank (most words
covered, then the larger share, then the earlier template, then the earlier place), each if it overlaps none taken before, so that a notice isn't read as its near relation.
Defined results: null and empty texts have no words and score 0; repeated rows each get the labels of their text; null ids are kept; no two spans
have equal ranks; very long texts are one array of words each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, documents

#: The phrases of the base labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Common license notices.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("reserved", "All rights reserved."),
    ("mit", "Released under the MIT Licence."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("bsd", "BSD-3-Clause"),
    ("bsd", "BSD-2-Clause"),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES'),
    ("isc", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES'),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
)
GRAM, APART, COVERAGE = 3, 2, 0.75


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams_of(words: Column) -> Column:
    """(place, hash) of each run of GRAM words."""
    places = F.when(F.size(words) >= GRAM, F.sequence(F.lit(0), F.size(words) - GRAM)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]).alias("gram")))


def template_grams(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), words_of(F.lit(text)).alias("words")) for n, (label, text) in enumerate(TEMPLATES)])
    listed = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    return listed.select("template", "label", F.size("words").alias("length"), F.explode(grams_of(F.col("words"))).alias("g")).select("template", "label", "length", F.col("g.place").alias("at"), F.col("g.gram").alias("gram"))


def license_spans(keyed: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text_key, template, label, first, last, coverage) of each verified span of `keyed` (doc_id, text_key, text)."""
    key = ["doc_id", "text_key", "template"]
    grams = keyed.select("doc_id", "text_key", words_of(F.col("text")).alias("words")).select("doc_id", "text_key", F.explode(grams_of(F.col("words"))).alias("g"))
    hits = grams.select("doc_id", "text_key", F.col("g.place").alias("place"), F.col("g.gram").alias("gram")).join(F.broadcast(template_grams(keyed.sparkSession)), "gram")
    diagonals = hits.groupBy(*key, "label", "length", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > APART, F.lit(True))
    merged = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(along))
    spans = merged.groupBy(*key, "label", "length", "span").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min(F.col("diagonal") + F.array_min("at")).alias("first"), F.max(F.col("diagonal") + F.array_max("at") + GRAM - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(*[p + k for k in range(GRAM)])))))
    return spans.select(*key, "label", "first", "last", covered.alias("n"), (covered / F.col("length")).alias("coverage")).where(F.col("coverage") >= coverage)


def best_spans(spans: DataFrame) -> DataFrame:
    """doc_id, text_key, spans: of each document's verified spans those that overlap no better one that stays itself.

    Spans are taken by rank within stretches of overlapping ones, so the work grows with the spans of a stretch, not of a document.
    """
    doc = ["doc_id", "text_key"]
    before = Window.partitionBy(*doc).orderBy("first", "last", "template").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("fresh", (F.coalesce(F.max("last").over(before), F.lit(-1)) < F.col("first")).cast("int"))
    dealt = fresh.withColumn("stretch", F.sum("fresh").over(Window.partitionBy(*doc).orderBy("first", "last", "template").rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct((-F.col("n")).alias("n"), (-F.col("coverage")).alias("share"), "template", "first", "last", "label", "coverage")
    ranked = dealt.groupBy(*doc, "stretch").agg(F.array_sort(F.collect_list(row)).alias("all"))
    apart = lambda s, o: (o["last"] < s["first"]) | (s["last"] < o["first"])
    none = F.slice("all", 1, 0)
    stay = F.aggregate("all", none, lambda kept, s: F.when(F.forall(kept, lambda o: apart(s, o)), F.array_append(kept, s)).otherwise(kept))
    return ranked.groupBy(*doc).agg(F.flatten(F.collect_list(stay)).alias("spans"))


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of `docs`."""
    keyed = documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = best_spans(license_spans(keyed, coverage)).select("doc_id", "text_key", F.col("spans.label").alias("found"), F.array_max("spans.coverage").alias("best"))
    rows = keyed.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    rows = rows.select("*", F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" ")).alias("flat"))
    held = [F.col("flat").contains(f" {phrase} ") for phrase, _ in PHRASES]
    starts = lambda i: [all_of([F.get("words", i + k) == F.lit(w) for k, w in enumerate(phrase.split())]) for phrase, _ in PHRASES]
    places = F.when(any_of(held), F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: any_of(starts(i)))).otherwise(F.array().cast("array<int>"))
    base = F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(held, PHRASES, strict=True)]))
    rows = rows.select("doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"), places.alias("places"), base.alias("base"))
    out = rows.alias("r").join(found.alias("f"), F.expr("r.doc_id <=> f.doc_id AND r.text_key = f.text_key"), "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    n = F.size("places")
    return out.select(
        "r.doc_id", "n_words", n.cast("bigint").alias("n_base"),
        F.when(n > 0, F.array_min("places").cast("bigint")).alias("first_word"), F.when(n > 0, F.array_max("places").cast("bigint")).alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("best", F.when(n > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
    )


def all_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


_LISTED = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(TEMPLATES))
_HELD = " OR ".join(f"w[i:i + {len(phrase.split()) - 1}] = {phrase.split()}" for phrase, _ in PHRASES)
_LABEL = " ".join(f"WHEN '{phrase.split()[0]}' THEN '{label}'" for phrase, label in PHRASES)
#: The same for tables whose ids are distinct; words stand in the place of their hashes.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
t AS (SELECT template, label, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM (VALUES {_LISTED}) AS v(template, label, text)),
tg AS (SELECT template, label, len(w) AS length, i - 1 AS pos, array_to_string(w[i:i + {GRAM - 1}], ' ') AS gram FROM t, unnest(range(1, len(w) - {GRAM - 2})) AS u(i)),
dg AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + {GRAM - 1}], ' ') AS gram FROM d, unnest(range(1, len(w) - {GRAM - 2})) AS u(i)),
hits AS (SELECT doc_id, template, label, length, pos, place - pos AS diagonal FROM dg JOIN tg USING (gram)),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {APART} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, template, diagonal FROM hits)),
spans AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM fresh),
covered AS (SELECT doc_id, template, label, min(diagonal + pos) AS first, max(diagonal + pos + k) AS last, count(DISTINCT pos + k) AS n, count(DISTINCT pos + k) / length AS coverage
  FROM hits JOIN spans USING (doc_id, template, diagonal), unnest(range(0, {GRAM})) AS u(k) GROUP BY doc_id, template, label, length, span HAVING count(DISTINCT pos + k) / length >= {COVERAGE}::DOUBLE),
ranked AS (SELECT doc_id, list([{{'n': -n, 'share': -coverage, 'template': template, 'first': first, 'last': last, 'label': label, 'coverage': coverage}}] ORDER BY n DESC, coverage DESC, template, first, last) AS listed FROM covered GROUP BY doc_id),
taken AS (SELECT doc_id, unnest(list_reduce(listed, lambda kept, s: CASE WHEN len(list_filter(kept, lambda o: o.first <= s[1].last AND s[1].first <= o.last)) = 0 THEN kept || s ELSE kept END)) AS s FROM ranked),
found AS (SELECT doc_id, list(DISTINCT s.label) AS labels, max(s.coverage) AS best FROM taken GROUP BY doc_id),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT CASE w[i] {_LABEL} END) AS labels FROM d, unnest(range(1, len(w) + 1)) AS u(i) WHERE {_HELD} GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
coalesce(best, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
