"""License scans by MinHash bands over overlapping text windows.

Texts and templates become five-word shingles; a template of fewer words is one shingle of all its words, and
is looked for among a text's shingles of that width.  A template of s shingles belongs to the scale S, the
power of two from s on.  At each width and scale a text is cut into windows of 2S shingles, S apart, so any S
shingles in a row lie whole within one window.  A band is one min-hash of a window; windows and templates that
share a band are candidates.  A window with 0.8 of a template has a Jaccard similarity with it of 0.8 / 4.2 at
least, so ``BANDS`` bands miss it with a probability of at most (1 - 0.19) ** 64, about one in a million.
Candidates are then verified by exact containment: the share of the template's shingles in the window.

Before any hashing, texts and windows without a single anchor word are passed over.  Anchors are words
chosen from the templates so that at least one is in every set of 0.8 of a template's shingles: what is
passed over cannot hold a match, whatever the corpus.  All of it is DataFrame operations.  Templates are a
dictionary or a table; their bands are broadcast if their estimated size is small.  Beyond that, bands alone
are shuffled, and windows are joined back to the candidates.

Cases: words are the runs of letters and digits of the lower-cased text; null or blank texts have none; a
template without words never matches; repeated rows and equal ids give one row for each pair of ids, with
the best containment; a null id is an id like any other; empty tables give an empty result; texts are read
whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import words_of

WORDS, CONTAINED, BANDS = 5, 0.8, 64
#: Estimated size of the templates' bands up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
ANCHORS = 48

#: Public license notices, as text.
TEMPLATES = {
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-statement": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT-warranty": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "GPL-statement": "Licensed under the GNU General Public License.",
    "Unlicense-statement": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
    "All-rights-reserved-statement": "This document is protected by copyright and all rights are reserved.",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def shingles_of_template(text: str) -> list[tuple[str, ...]]:
    words = template_words(text)
    width = min(WORDS, len(words))
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)] if words else []


def anchors(templates: list[str], contained: float = CONTAINED, limit: int = ANCHORS) -> list[str] | None:
    """Words of which one is in every ``contained`` part of any template's shingles; None if they are many.

    Greedy: of words of six letters or more (these are rarer), else of all, the one in most shingles of
    templates that are not covered yet.
    """
    shingles = {t: set(shingles_of_template(t)) for t in templates}
    shingles = {t: s for t, s in shingles.items() if s}
    chosen: list[str] = []

    def open_() -> list[str]:
        # Exact in integers of hundredths: 100 * (shingles without an anchor) >= contained * all.
        return [t for t, s in shingles.items() if 100 * sum(not set(x) & set(chosen) for x in s) >= round(100 * contained) * len(s)]

    while left := open_():
        votes: dict[str, int] = {}
        for t in left:
            for x in shingles[t]:
                if not set(x) & set(chosen):
                    for w in set(x):
                        votes[w] = votes.get(w, 0) + 1
        long = {w: n for w, n in votes.items() if len(w) >= 6} or votes
        chosen.append(max(long, key=lambda w: (long[w], len(w), w)))
        if len(chosen) > limit:
            return None
    return chosen


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of ``width`` words in a row, in order."""
    places = F.sequence(F.lit(0), F.size(words) - width)
    # Single elements: a slice inside a lambda would copy all words for each shingle.
    each = F.transform(places, lambda k: F.xxhash64(F.concat_ws(" ", *[F.get(words, k + j) for j in range(width)])))
    return F.when(F.size(words) >= width, each).otherwise(F.array().cast("array<bigint>"))


def bands_of(shingles: Column) -> Column:
    """(band, value): the min-hash of the shingles under each band's hash function."""
    ids = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(ids, lambda j: F.struct(j.alias("band"), F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))).alias("value")))


def scan(
    docs: DataFrame,
    templates: dict[str, str] | DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    contained: float = CONTAINED,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each document and template it holds: ``doc_id``, ``license``, ``matched`` and ``of``
    (shingles), and ``first_shingle``, where the first best window starts.

    ``templates`` maps names to texts, or is a table (license, body).
    """
    templates = TEMPLATES if templates is None else templates
    spark: SparkSession = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list(templates.items()), "license string, body string")
    templates = templates.select("license", "body").where("body is not null")
    # A shingle takes 8 bytes in each band's row, and a row some 64 more.
    size = templates.agg(F.coalesce(F.sum(F.octet_length("body") * 2 + 64), F.lit(0))).first()[0] * BANDS
    small = size <= broadcast_bytes
    known = templates.select("license", words_of(F.col("body")).alias("words")).where(F.size("words") > 0)
    t = reduce(lambda other, w: F.when(F.size("words") == w, shingles_of(F.col("words"), w)).otherwise(other), range(1, WORDS), shingles_of(F.col("words"), WORDS))
    known = known.select("license", F.least(F.lit(WORDS), F.size("words")).alias("width"), F.array_distinct(t).alias("t"))
    known = known.withColumn("scale", F.pow(F.lit(2), F.ceil(F.log2(F.size("t")))).cast("int"))
    forms = sorted(map(tuple, known.select("width", "scale").distinct().collect()))  # at most five widths by 31 scales
    marks = anchors([r["body"] for r in templates.collect()], contained) if small else None
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if marks:
        low = F.lower("text")
        out = out.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in marks]))
    out = out.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), words_of(F.col("text")).alias("words"))
    widths = sorted({w for w, _ in forms})
    out = out.select("*", *[shingles_of(F.col("words"), w).alias(f"s{w}") for w in widths])
    each = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(k).alias("scale")) for w, k in forms]) if forms else F.array().cast("array<struct<width:int,scale:int>>")
    out = out.withColumn("form", F.explode(each))
    chosen = reduce(lambda other, w: F.when(F.col("form.width") == w, F.col(f"s{w}")).otherwise(other), widths, F.array().cast("array<bigint>"))
    out = out.select("doc_id", "doc", "words", "form.width", "form.scale", chosen.alias("s"))
    # The last window may be short; a start of which the window before holds all is left out.
    starts = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - F.col("scale") - 1), F.col("scale")))
    out = out.withColumn("start", F.explode(starts))
    if marks:
        part = F.slice("words", F.col("start") + 1, 2 * F.col("scale") + F.col("width") - 1)
        out = out.where(F.arrays_overlap(part, F.array(*[F.lit(w) for w in marks])))
    form, place = ["width", "scale"], ["doc", "width", "scale", "start"]
    windows = out.select("doc_id", *place, F.array_distinct(F.slice("s", F.col("start") + 1, 2 * F.col("scale"))).alias("w"))
    bands = known.select("license", *form, "t", F.explode(bands_of(F.col("t"))).alias("x")).select("license", *form, "t", "x.band", "x.value")
    if small:
        probes = windows.select("*", F.explode(bands_of(F.col("w"))).alias("x")).select("doc_id", *place, "w", "x.band", "x.value")
        found = probes.join(F.broadcast(bands), [*form, "band", "value"])
    else:
        probes = windows.select(*place, F.explode(bands_of(F.col("w"))).alias("x")).select(*place, "x.band", "x.value")
        pairs = probes.join(bands.drop("t"), [*form, "band", "value"]).select(*place, "license").distinct()
        found = pairs.join(windows, place).join(known.select("license", *form, "t"), ["license", *form])
    found = found.withColumn("matched", F.size(F.array_intersect("w", "t"))).where(F.col("matched") >= F.lit(contained) * F.size("t"))
    found = found.groupBy("doc_id", "license", F.size("t").cast("bigint").alias("of")).agg(F.max(F.struct(F.col("matched"), (-F.col("start")).alias("back"))).alias("x"))
    return found.select("doc_id", "license", F.col("x.matched").cast("bigint").alias("matched"), "of", (-F.col("x.back")).cast("bigint").alias("first_shingle"))


def oracle(templates: dict[str, str] | None = None) -> str:
    """The same windows, all compared with all templates of their width and scale."""
    values = ", ".join("('{}', '{}')".format(t, x.replace("'", "''")) for t, x in (TEMPLATES if templates is None else templates).items())
    return rf"""
WITH raw(license, body) AS (VALUES {values}),
tw AS (SELECT license, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM raw),
ts AS (
  SELECT license, least(5, len(w)) AS width, list_distinct([array_to_string(w[k:k + least(5, len(w)) - 1], ' ') FOR k IN range(1, len(w) - least(5, len(w)) + 2)]) AS t
  FROM tw WHERE len(w) > 0
), tt AS (SELECT license, width, len(t) AS n, CAST(pow(2, ceil(log2(len(t)))) AS BIGINT) AS scale, unnest(t) AS g FROM ts),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT rid, doc_id, width, len(w) - width + 1 AS n, w, unnest(range(0, len(w) - width + 1)) AS p FROM d, (SELECT DISTINCT width FROM ts) WHERE len(w) >= width
), g AS (SELECT rid, doc_id, width, n, p, array_to_string(w[p + 1:p + width], ' ') AS g FROM s),
m AS (SELECT rid, doc_id, g.n AS size, p, license, tt.n AS n, scale, g FROM g JOIN tt USING (width, g)),
x AS (SELECT DISTINCT rid, doc_id, license, n, scale, g, q * scale AS start FROM m, (VALUES (0), (1)) v(o), (SELECT 1) z, LATERAL (SELECT p // scale - o AS q) y
      WHERE q >= 0 AND q * scale <= greatest(0, size - scale - 1)),
c AS (SELECT rid, doc_id, license, n, start, count(*) AS matched FROM x GROUP BY ALL HAVING count(*) >= 0.8 * n)
SELECT doc_id, license, CAST(max(matched) AS BIGINT) AS matched, CAST(n AS BIGINT) AS "of",
       CAST(first(start ORDER BY matched DESC, start) AS BIGINT) AS first_shingle
FROM c GROUP BY doc_id, license, n
"""
