"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

The units of a text are its lines, its pairs of lines (notices that wrap, titles), its blocks between empty lines (header
comments, paragraphs of a licence file), runs of two to four blocks, and the whole text (the last two, and long lines and blocks, for templates of ``LONG`` words or more).  Templates are of four tiers: a bare
line of rights, short notices, header notices, and titles and texts of licences.  Words weigh term frequency times inverse
template frequency; a word that no template has weighs most.  A unit's cosine to each template is one grouped sum over the
two or more words they share (the templates' words are a small broadcast table, as long as the parameter).  Texts and units whose shared
words could not reach the threshold with any template are left out before that, by bounds worked out from the templates.  A
file's licence is that of the highest tier that reaches the threshold, there the most similar; files without one take that of
the nearest directory above them that has one, by joins on paths.  A line of rights never stands against a licence, and says
nothing of other files.  All of it is DataFrame functions, no Python runs on the executors.

More whole texts are a parameter (``with_texts``, ``read_texts``).  Null and empty texts have no licence of their own.  A null path is the root directory.  A row is its id, path and text: rows
without an id, or that repeat one, are looked at each by itself.  Ties of tier and cosine: the licence's name; among files of
a directory the same.  Texts of any length are looked at whole.  Other columns are not looked at, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaward.llm.common import materialize, read_table, text_or_empty

#: Notices, header notices and texts of licences as published; a parameter of ``licences``.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0. See LICENSE for details."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD 3-Clause License", "Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0, Creative Commons Attribution International.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", "This file is licensed under the MIT license.", "Licensed under the MIT license.", "Licensed under the MIT License. See LICENSE for details."],
    "MPL-2.0": ["Subject to the terms of the Mozilla Public License, version 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will "
    "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} "
    "for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
#: Header notices, as the licences recommend them for source files.
HEADERS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work "
        "for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "
        '"License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ],
    "GPL-2.0": [_GNU.format(what="program", name="General Public License", version="2")],
    "GPL-3.0": [_GNU.format(what="program", name="General Public License", version="3")],
    "LGPL-2.1": [_GNU.format(what="library", name="Lesser General Public License", version="2.1")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
}
TEXTS = {
    "BSD-2-Clause": [_TWO + _AS_IS],
    "BSD-3-Clause": [
        _TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. " + _AS_IS
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ],
}
#: Titles, and sentences that name the licence, of licence files that have no short text.
TITLES = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.0": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "PSF-2.0": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
}
#: Tiers of templates.
RIGHTS, NOTICE, HEADER, TEXT = range(4)


def _templates() -> list[tuple[str, int, str]]:
    """(licence, tier, text) of each template; each licence but the line of rights has its short identifier line too."""
    out = [(n, RIGHTS if n == "Proprietary" else NOTICE, t) for n in NOTICES for t in NOTICES[n]]
    out += [(n, NOTICE, f"SPDX-License-Identifier: {n}") for n in {*NOTICES, *HEADERS, *TEXTS, *TITLES} - {"Proprietary"}]
    out += [(n, HEADER, t) for n in HEADERS for t in HEADERS[n]]
    return sorted(out + [(n, TEXT, t) for table in (TEXTS, TITLES) for n in table for t in table[n]])


TEMPLATES = _templates()
THRESHOLD = 0.8
#: Runs of blocks, whole texts, and lines and blocks of more than ``MANY`` words are held against templates of at least ``LONG``
#: different words only; shorter notices fit in a block of their own.
LONG, MANY = 20, 100
#: Words of ordinary prose: lines that share only these with the templates are not looked at further.
COMMON = set("a an and are as at be by for from in into is it of on or that the this to under use was with".split())
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def with_texts(texts: dict[str, str], templates=None) -> list[tuple[str, int, str]]:
    """The templates (or those given) and whole licence texts by name."""
    return sorted([*(TEMPLATES if templates is None else templates), *((n, TEXT, t) for n, t in texts.items())])


def read_texts(spark: SparkSession, path: str) -> dict[str, str]:
    """Whole licence texts from a folder, named as their files without an ending: a parameter of some dozens of texts."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt|\.md)?$", 1).alias("n"), "value")
    return {r.n: r.value for r in found.collect()}


def template_weights(templates) -> tuple[dict[str, float], list[tuple[str, int, dict[str, float]]], float]:
    """Weight of one occurrence of each word; of each template its licence, tier and its words' weights, scaled to length 1;
    the weight of words that no template has."""
    counts = [(n, tier, Counter(re.findall(_WORD, t.lower()))) for n, tier, t in templates]
    held = Counter(w for _, _, c in counts for w in c)
    weight = {w: math.log((1 + len(counts)) / (1 + held[w])) + 1 for w in sorted(held)}
    scaled = []
    for n, tier, c in counts:
        norm = math.sqrt(sum((k * weight[w]) ** 2 for w, k in c.items()))
        scaled.append((n, tier, {w: k * weight[w] / norm for w, k in c.items()}))
    return weight, scaled, math.log(1 + len(counts)) + 1


def deciding_words(templates, threshold: float) -> list[str]:
    """Words of which a unit needs at least one: those without them share less than ``threshold`` with any template.

    Words are set aside, common ones first, as long as those of each template keep a norm under the threshold.
    """
    weight, scaled, _ = template_weights(templates)
    limit = (threshold - 1e-6) ** 2
    sums = [0.0] * len(scaled)
    aside: set[str] = set()
    for w in sorted(weight, key=lambda w: (w not in COMMON, len(w), w)):
        new = [s + t.get(w, 0.0) ** 2 for s, (_, _, t) in zip(sums, scaled, strict=True)]
        if all(s < limit for s in new):
            sums, aside = new, aside | {w}
    return sorted(set(weight) - aside)


def least_shared(templates, threshold: float, long: bool = False) -> list[list[tuple[tuple[str, ...], int]]]:
    """Of each template (with ``long``: the long ones) sets of its words, and how many different ones of each a unit needs.

    The cosine is at most the norm of the template's words that the unit has.  So, even with all the lighter words, the others
    must make up for the rest; with the heaviest of these first, those that reach it are the fewest that can.  A unit that fails
    one of the sets cannot reach the threshold.
    """
    out, limit = [], (threshold - 1e-6) ** 2
    for _, _, t in template_weights(templates)[1]:
        if long and len(t) < LONG:
            continue
        falling = sorted(t, key=lambda w: (-t[w], w))
        tests: dict[int, int] = {}
        for light in (0.9 * limit, 0.6 * limit, 0.3 * limit, 0.0):
            size, mass = len(falling), 0.0
            while size and mass + t[falling[size - 1]] ** 2 <= light:
                size -= 1
                mass += t[falling[size]] ** 2
            n = 0
            while mass < limit:
                mass += t[falling[n]] ** 2
                n += 1
            tests[size] = max(n, min(2, size)) if size == len(falling) else n
        out.append([(tuple(falling[:size]), n) for size, n in sorted(tests.items()) if n])
    return out


def unit_licences(files: DataFrame, key: str, text: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, licence, similarity, tier of the best unit of each row that has one; rows of one key are looked at together."""
    spark = files.sparkSession
    weight, scaled, rare = template_weights(templates)
    postings = F.broadcast(spark.createDataFrame([(w, i, n, tier, len(t) >= LONG, weight[w] * v) for i, (n, tier, t) in enumerate(scaled) for w, v in t.items()], "word string, template int, licence string, tier int, long boolean, product double"))
    weights = F.broadcast(spark.createDataFrame(list(weight.items()), "word string, weight double"))
    literals = lambda ws: F.array(*(F.lit(w) for w in ws))
    asked, known = literals(deciding_words(templates, threshold)), literals(sorted(weight))
    weights_of = F.create_map(*(F.lit(x) for pair in weight.items() for x in pair))
    words = lambda c: F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))

    def possible(held: Column, long: bool) -> Column:
        tests = [[(literals(ws), n) for ws, n in one] for one in least_shared(templates, threshold, long)]

        def enough(own: Column) -> Column:
            some = F.lit(False)
            for one in tests:
                good = F.size(own) >= max((n for _, n in one), default=0)
                for ws, n in one:
                    good = good & (F.size(F.array_intersect(own, ws)) >= n)
                some = some | good
            return some

        def outweighed(h: Column, own: Column) -> Column:
            """Whether words that no template has, each counted once, keep any cosine under the threshold."""
            square = lambda a, w: a + F.pow(F.size(F.filter(h, lambda x: x == w)) * F.element_at(weights_of, w), F.lit(2.0))
            inside = F.aggregate(own, F.lit(0.0), square)
            return inside < (threshold - 1e-6) ** 2 * (inside + F.size(F.array_except(h, known)) * F.lit(rare * rare))

        # A variable of a lambda is worked out once, not for each use.  The words that templates have are picked first.
        near = lambda h: F.exists(F.array(F.array_intersect(h, known)), lambda own: enough(own) & ~outweighed(h, own))
        return F.exists(F.array(held), lambda h: F.arrays_overlap(h, asked) & near(h))

    # Most texts lack the words asked for: they are left out before they are cut into units, and most units again.
    whole = files.select(F.col(key), F.lower(text_or_empty(text)).alias("body")).filter(F.arrays_overlap(words(F.col("body")), asked))
    cut = whole.select(key, "body", F.split("body", "\n").alias("lines"), F.split("body", "\n[ \t\r]*\n").alias("blocks"))

    def runs(parts: str, n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(parts) - (n - 1))
        return F.when(F.size(parts) >= n, F.transform(places, lambda i: F.concat_ws(" ", F.slice(parts, i, n)))).otherwise(F.array().cast("array<string>"))

    def units(texts: Column, long: bool) -> DataFrame:
        one = cut.select(key, F.explode(texts).alias("unit")).select(key, words(F.col("unit")).alias("words"), F.xxhash64("unit").alias("unit"))
        marked = one.withColumn("large", F.lit(long) | (F.size("words") > MANY))
        return marked.filter(possible(F.col("words"), True) if long else F.when(F.col("large"), possible(F.col("words"), True)).otherwise(possible(F.col("words"), False)))

    # A unit that a text repeats counts its words as often, which leaves the cosine as it is.
    near = units(F.concat("lines", runs("lines", 2), "blocks"), False).unionByName(units(F.concat(*(runs("blocks", n) for n in (2, 3, 4)), F.array("body")), True))
    group = [key, "unit", "large"]
    counts = materialize(near.select(*group, F.explode("words").alias("word")).groupBy(*group, "word").agg(F.count(F.lit(1)).alias("tf")), "licence-words")
    weighed = counts.join(weights, "word", "left").withColumn("w", F.col("tf") * F.coalesce("weight", F.lit(rare)))
    norms = F.sqrt(F.sum(F.col("w") * F.col("w")))
    shared = counts.join(postings, "word").filter("long OR NOT large").groupBy(*group, "template", "licence", "tier").agg(F.sum(F.col("tf") * F.col("product")).alias("dot"), F.count(F.lit(1)).alias("words")).filter("words > 1")
    scored = shared.join(weighed.groupBy(*group).agg(norms.alias("norm")), group)
    good = scored.withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("similarity") >= threshold)
    return good.groupBy(key).agg(_best(templates, "licence", "similarity", "tier").alias("b")).select(key, "b.licence", "b.similarity", "b.tier")


def _best(templates, *columns: str) -> Column:
    """The columns of the row of the highest tier, there the most similar, there the first name."""
    names = F.array(*(F.lit(n) for n in sorted({n for n, _, _ in templates})))
    return F.max_by(F.struct(*columns), F.struct("tier", "similarity", F.lit(-1) * F.array_position(names, F.col("licence"))))


def licences(files: DataFrame, key: str, path: str = "path", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, path, licence, similarity, origin (own, inherited, none) and ``from_directory`` of each row."""
    body = text_or_empty(text)
    row = F.xxhash64(F.col(key).cast("string"), F.col(path).cast("string"), body).alias("row")  # tells rows apart that lack an id or repeat one
    rows = files.select(F.col(key), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), row)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    own = unit_licences(files.select(row, body.alias("body")), "row", "body", templates, threshold)
    placed = rows.join(own, "row", "left").withColumn("directory", folder)
    held = placed.filter(F.col("tier") > RIGHTS).groupBy("directory").agg(_best(templates, "licence").alias("b")).select(F.col("directory").alias("above"), F.col("b.licence").alias("theirs"))
    # Directories look up their ancestors once, so that files only join their own directory.
    parts = F.split("directory", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit("")))
    folders = placed.select("directory").distinct().withColumn("above", F.explode(F.array_distinct(above)))
    nearest = F.max_by(F.struct("theirs", "above"), F.length("above"))
    given = folders.join(held, "above").groupBy("directory").agg(nearest.alias("g")).select("directory", "g.theirs", "g.above")
    out = placed.join(given, "directory", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("theirs").isNotNull(), "inherited").otherwise("none")
    return out.select(
        key,
        "path",
        F.coalesce("licence", "theirs").alias("licence"),
        "similarity",
        origin.alias("origin"),
        F.when(origin == "inherited", F.col("above")).alias("from_directory"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: source / thousands / fifties / id (the table has no paths of its own)."""
    n = F.col("doc_id")
    part = lambda size: F.floor(n / F.lit(size)).cast("string")
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), part(1000), part(50), n.cast("string")).alias("path"), "text")


def op7_licence_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(document_files(read_table(spark, sf_dir, "documents")), "doc_id")


def _sql() -> str:
    weight, scaled, rare = template_weights(TEMPLATES)
    w = ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in weight.items())
    p = ", ".join(f"('{k}', {i}, '{n}', {tier}, {len(t) >= LONG}, CAST({weight[k] * v!r} AS DOUBLE))" for i, (n, tier, t) in enumerate(scaled) for k, v in t.items())
    return f"""
WITH weights(word, weight) AS (VALUES {w}), postings(word, template, licence, tier, long, product) AS (VALUES {p}),
files AS (SELECT doc_id, coalesce(source, '') || '/' || CAST(doc_id // 1000 AS VARCHAR) || '/' || CAST(doc_id // 50 AS VARCHAR) AS directory,
 CAST(doc_id AS VARCHAR) AS name, lower(coalesce(text, '')) AS body FROM documents),
lines AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS unit, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM files),
blocks AS (SELECT doc_id, regexp_split_to_array(body, '\\n[ \\t\\r]*\\n') AS bs FROM files),
units AS (SELECT doc_id, unit, false AS large FROM lines UNION SELECT a.doc_id, a.unit || ' ' || b.unit, false FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.n = a.n + 1
 UNION SELECT doc_id, unnest(bs), false FROM blocks UNION SELECT doc_id, array_to_string(bs[i:i + k - 1], ' '), true FROM (SELECT doc_id, bs, k, unnest(generate_series(1, len(bs) - k + 1)) AS i FROM blocks, (SELECT unnest([2, 3, 4]) AS k))
 UNION SELECT doc_id, body, true FROM files),
told AS (SELECT DISTINCT doc_id, unit, large OR len(regexp_extract_all(unit, '{_WORD}', 0)) > {MANY} AS large FROM units),
counts AS (SELECT doc_id, unit, large, word, count(*) AS tf FROM (SELECT doc_id, unit, large, unnest(regexp_extract_all(unit, '{_WORD}', 0)) AS word FROM told) GROUP BY ALL),
norms AS (SELECT doc_id, unit, large, sqrt(sum(tf * coalesce(weight, {rare!r}) * tf * coalesce(weight, {rare!r}))) AS norm FROM counts LEFT JOIN weights USING (word) GROUP BY ALL),
dots AS (SELECT doc_id, unit, large, template, licence, tier, sum(tf * product) AS dot FROM counts JOIN postings USING (word) WHERE long OR NOT large GROUP BY ALL HAVING count(*) > 1),
good AS (SELECT doc_id, licence, tier, round(dot / norm, 6) AS similarity FROM dots JOIN norms USING (doc_id, unit, large) WHERE round(dot / norm, 6) >= {THRESHOLD}),
own AS (SELECT doc_id, licence, similarity, tier FROM good QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier DESC, similarity DESC, licence) = 1),
placed AS (SELECT f.doc_id, directory, name, licence, similarity, tier FROM files f LEFT JOIN own USING (doc_id)),
held AS (SELECT directory AS above, licence AS theirs FROM placed WHERE tier > {RIGHTS}
 QUALIFY row_number() OVER (PARTITION BY directory ORDER BY tier DESC, similarity DESC, licence) = 1),
given AS (SELECT d.directory, theirs, above FROM (SELECT DISTINCT directory FROM placed) d JOIN held h ON d.directory = h.above OR starts_with(d.directory, h.above || '/')
 QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(above) DESC) = 1)
SELECT doc_id, directory || '/' || name AS path, coalesce(licence, theirs) AS licence, similarity,
 CASE WHEN licence IS NOT NULL THEN 'own' WHEN theirs IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
 CASE WHEN licence IS NULL THEN above END AS from_directory
FROM placed LEFT JOIN given USING (directory)"""


QUERIES = {"op7_licence_tfidf": op7_licence_tfidf}
SQL = {"op7_licence_tfidf": _sql()}
