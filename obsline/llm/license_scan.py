"""License scans by MinHash bands over overlapping text windows (operator 4), in DataFrame functions only.

Templates are grouped into classes by length. For a class of c words, windows of c + s words start every s
words, so that any occurrence of a template lies within one of them. A window and a template meet on a band
(one MinHash value); the number of bands of a class is set so that an occurrence which keeps 80 % of the
template's shingles fails to meet it with a chance of at most MISS. Exact shingle containment then decides.

Before that, texts and windows without any of KEYWORDS are passed over. More than a fifth of each template's
shingles hold such a word (checked on use), so no text with 80 % of the shingles can lack them all.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5
CONTAINED = 0.8
#: The chance that bands miss an occurrence at the threshold.
MISS = 1e-4
#: Words of a text whose windows are cut together.
SEGMENT = 4096
#: Lengths of the classes grow by this factor.
GROWTH = 1.5

# Notices of common licences, as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
     "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
     "PURPOSE. See the GNU General Public License for more details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
     "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
]
# Words of which licence notices are full.
KEYWORDS = ["license", "licensed", "licenses", "copyright", "warranty", "warranties", "permission", "permissions", "permitted", "software", "redistribution",
            "redistributions", "redistribute", "distributed", "mozilla", "mpl", "disclaimer", "modification", "sublicense"]


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def shingles_of(words: list[str]) -> set[str]:
    """Distinct shingles; a shorter text is one shingle."""
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def classes(templates: list[tuple[str, str]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(class length, window, stride, bands, templates) for each class that has templates."""
    sizes, out, c = [len(plain_words(t)) for _, t in templates], [], SHINGLE
    while any(n >= c for n in sizes) or not out:
        nxt = max(c + 1, math.floor(c * GROWTH))
        held = [i for i, n in enumerate(sizes) if (n < nxt and n >= c) or (c == SHINGLE and n < c)]
        if held:
            length = max(sizes[i] for i in held)
            stride = max(1, length // 4)
            window = length + stride
            most = window - SHINGLE + 1
            # The least Jaccard similarity of a window and a template of which it holds 80 % of the shingles.
            least = min(math.ceil(CONTAINED * n) / (most + n - math.ceil(CONTAINED * n)) for n in (len(shingles_of(plain_words(templates[i][1]))) for i in held))
            bands = math.ceil(math.log(MISS) / math.log(1 - min(least, 0.999)))
            out.append((length, window, stride, bands, held))
        c = nxt
    return out


def _check(templates: list[tuple[str, str]], keywords: list[str]) -> None:
    for name, text in templates:
        found = shingles_of(plain_words(text))
        if sum(bool(set(s.split()) & set(keywords)) for s in found) <= (1 - CONTAINED) * len(found):
            raise ValueError(f"the keywords do not cover the template of {name}")


def _hashes(words: Column) -> Column:
    """64-bit hashes of the distinct shingles of an array of words."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " "))))


def _band(hashes: str, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed))))


def _windows(number: int, window: int, stride: int, wanted: Column) -> Column:
    """The windows of a class that start in a segment (base, words, total) and hold a keyword."""
    base = F.col("x.base")
    first = F.ceil(base / stride).cast("int") * stride
    last = F.least(base + SEGMENT - 1, F.greatest(F.col("x.total") - window + stride - 1, F.lit(0)))
    starts = F.when(first <= last, F.sequence(first, last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(F.lit(number).alias("class"), i.alias("at"), F.slice("x.words", i - base + 1, window).alias("w")))
    return F.filter(cut, lambda x: F.arrays_overlap(x["w"], wanted))


def _segments(words: Column, reach: int) -> Column:
    """A text's words in parts: SEGMENT starting places each, and as many words after them as a window may reach."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(SEGMENT))
    return F.transform(starts, lambda i: F.struct(i.alias("base"), F.slice(words, i + 1, SEGMENT + reach).alias("words"), F.size(words).alias("total")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, keywords: list[str] = KEYWORDS) -> DataFrame:
    """doc_id, license, containment, first_word: a row for each document and license that it holds.

    containment is the greatest share of a template's shingles in a window, first_word the place of the first
    window with at least 80 %. Null and empty texts hold none. Rows of one id, and those with a null id, count
    together. An empty table gives an empty result. Other columns are not read. Texts are read whole. No row is
    shuffled but matches: the templates' bands are broadcast, at most some hundred rows for each template.
    """
    spark = docs.sparkSession
    _check(templates, keywords)
    words = F.filter(F.split(F.translate("text", UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")
    # The alternation is in lower case, and so is what it looks at.
    held = docs.select("doc_id", "text").filter(F.translate("text", UPPER, LOWER).rlike("|".join(keywords))).select("doc_id", words.alias("words")).filter(F.size("words") > 0)
    wanted, found = F.array(*map(F.lit, keywords)), classes(templates)
    bands = max(n for *_, n, _ in found)

    def banded(df: DataFrame) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*(_band("hashes", i) for i in range(bands)))).alias("band", "value"))

    # Windows are cut from segments, so that a very long text never has all of its windows in one row.
    parts = held.select("doc_id", F.explode(_segments(F.col("words"), max(w for _, w, *_ in found))).alias("x")).filter(F.arrays_overlap("x.words", wanted))
    windows = parts.select("doc_id", F.explode(F.concat(*(_windows(k, w, s, wanted) for k, (_, w, s, _, _) in enumerate(found)))).alias("x"))
    met = banded(windows.select("doc_id", F.col("x.class").alias("class"), F.col("x.at").alias("at"), _hashes(F.col("x.w")).alias("hashes")))
    listed = [F.struct(F.lit(k).alias("class"), F.lit(templates[i][0]).alias("license"), F.array(*map(F.lit, plain_words(templates[i][1]))).alias("t"))
              for k, (*_, members) in enumerate(found) for i in members]
    table = banded(spark.range(1).select(F.inline(F.array(*listed))).select("class", "license", _hashes(F.col("t")).alias("hashes"))).withColumnRenamed("hashes", "t")
    share = F.size(F.array_intersect("hashes", "t")) / F.size("t")
    hits = met.join(F.broadcast(table), ["class", "band", "value"]).select("doc_id", "license", "at", share.alias("share")).filter(F.col("share") >= CONTAINED)
    return hits.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same by comparing every window with every template of its class."""
    rows = []
    for _, window, stride, _, members in classes(TEMPLATES):
        for i in members:
            found = sorted(shingles_of(plain_words(TEMPLATES[i][1])))
            rows += [f"('{TEMPLATES[i][0]}', {i}, {window}, {stride}, {len(found)}, '{s}')" for s in found]
    return f"""WITH S(license, tid, win, stride, n, shingle) AS (VALUES {", ".join(rows)}),
W AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
P AS (SELECT doc_id, len(w) AS size, unnest(range(0, greatest(len(w) - {SHINGLE} + 1, 1))) AS pos, w FROM W WHERE len(w) > 0),
G AS (SELECT doc_id, size, pos, array_to_string(w[pos + 1:pos + {SHINGLE}], ' ') AS shingle FROM P),
H AS (SELECT G.doc_id, license, tid, n, win, stride, size, pos, G.shingle FROM G JOIN S ON G.shingle = S.shingle),
K AS (SELECT *, unnest(range(greatest(0, pos + {SHINGLE} - win + stride - 1) // stride * stride, pos + 1, stride)) AS at_ FROM H),
C AS (SELECT doc_id, license, tid, at_, count(DISTINCT shingle) / any_value(n) AS share FROM K WHERE at_ <= greatest(size - win + stride - 1, 0) AND pos + {SHINGLE} <= at_ + win GROUP BY doc_id, license, tid, at_)
SELECT doc_id, license, max(share) AS containment, min(at_) AS first_word FROM C WHERE share >= {CONTAINED} GROUP BY doc_id, license"""


OP4_SQL = _sql()
