"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices and licence texts as published, in alphabetical order of their names.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
     "the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used "
     "to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
     "to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
     "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. " + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
     "held liable for any damages arising from the use of this software."),
)


def _normal(text):
    """Lower-case words of ASCII letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _with_bigrams(rows: DataFrame, norm, out: str) -> DataFrame:
    """``rows`` with the bigrams of a normal form, each with its number among equal ones ('a b#0', 'a b#1'), so that
    common elements are counted as often as they occur. Every step is a column of its own: inside a lambda function
    an expression would be computed for each element."""
    words = rows.withColumn("_words", F.split(norm, " "))
    pairs = words.withColumn("_pairs", F.sort_array(F.transform(
        F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))),
        lambda w, i: F.concat_ws(" ", F.get("_words", i), w))))
    return pairs.withColumn(out, F.transform("_pairs", lambda p, i: F.concat_ws("#", p, F.when(
        F.get("_pairs", i - 1) == p, (i + 1 - F.array_position("_pairs", p)).cast("string")).otherwise("0")))).drop(
        "_words", "_pairs")


def markers(texts: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Words one of which every text like a template has.

    A text of a Dice coefficient of t has at least t / (2 - t) of the template's bigrams. For each template its longest
    words are taken until the bigrams without any of them are fewer than that.
    """
    out: set[str] = set()
    for text in texts:
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        need = math.ceil((len(words) - 1) * threshold / (2 - threshold) - 1e-9)
        chosen: set[str] = set()
        for w in sorted(set(words), key=lambda w: (len(w), w), reverse=True):
            if sum(a not in chosen and b not in chosen for a, b in zip(words, words[1:])) < need:
                break
            chosen.add(w)
        out |= chosen
    return sorted(out)


def _size(norm):
    """Bigrams of a normal form."""
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))


def templates(spark: SparkSession, rows: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each template and each size that a similar text can have: by the Dice coefficient a text of a
    bigrams is like a template of b only if t / (2 - t) <= a / b <= (2 - t) / t. A few thousand rows."""
    numbered = [(i, name, text) for i, (name, text) in enumerate(rows)]
    base = spark.createDataFrame(numbered, "template int, license string, template_text string").withColumn(
        "norm", _normal(F.col("template_text"))).withColumn("template_size", _size(F.col("norm")))
    base = _with_bigrams(base, F.col("norm"), "template_bigrams")
    low = F.ceil(F.col("template_size") * (threshold / (2 - threshold)) - 1e-9)
    high = F.floor(F.col("template_size") * ((2 - threshold) / threshold) + 1e-9)
    return base.select("template", "license", "template_size", "template_bigrams",
                       F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"))


def _units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The parts of each text that are compared: lines, paragraphs of several lines, and a text of several
    paragraphs as a whole, with a row number for each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = lambda name, parts: F.transform(parts, lambda p, i: F.struct(
        F.lit(name).alias("kind"), i.alias("number"), p.alias("part")))
    lines, blocks = F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n")
    several = F.filter(kind("paragraph", blocks), lambda u: F.contains(u["part"], F.lit("\n")))
    whole = F.when(F.size(blocks) > 1, F.array(F.struct(
        F.lit("text").alias("kind"), F.lit(0).alias("number"), F.col("text").alias("part"))))
    every = F.concat(kind("line", lines), several, F.coalesce(whole, F.array().cast(
        "array<struct<kind:string,number:int,part:string>>")))
    return rows.select("row", "doc_id", F.explode(every).alias("unit")).select("row", "doc_id", "unit.*")


def _compared(docs: DataFrame, id_col: str, text_col: str, threshold: float, known) -> DataFrame:
    """Every part of every document with each template that its size allows, or with none: row, doc_id, kind, number,
    template, license and dice (null below the threshold)."""
    parts = _units(docs, id_col, text_col).withColumn("norm", _normal(F.col("part"))).withColumn("size", _size(F.col("norm")))
    table = templates(docs.sparkSession, known, threshold)
    low, high = table.agg(F.min("size"), F.max("size")).first()
    marked = F.arrays_overlap(F.split("norm", " "), F.array(*[F.lit(w) for w in markers([t for _, t in known], threshold)]))
    possible = parts.select("row", "doc_id", "kind", "number", "norm", F.when(
        F.col("size").between(low, high) & marked, F.col("size")).alias("size"))
    near = possible.join(F.broadcast(table), "size", "left")
    near = _with_bigrams(near, F.when(F.col("template").isNotNull(), F.col("norm")), "bigrams")
    common = F.size(F.array_intersect("bigrams", "template_bigrams"))
    dice = F.when(F.col("template").isNotNull(), F.lit(2.0) * common / (F.col("size") + F.col("template_size")))
    return near.withColumn("dice", dice).withColumn("dice", F.when(F.col("dice") >= threshold, F.col("dice"))).select(
        "row", "doc_id", "kind", "number", "template", "license", "dice")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
            known: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Every part of a document that is like a template: doc_id, kind, number, template, license, dice.

    Parts are lines, paragraphs (between blank lines) of several lines, and the whole of a text of several
    paragraphs. Bigrams are those of the normal form (lower-case runs of ASCII letters and digits) with their counts;
    dice = 2 * common / (a + b). Only templates that the sizes allow are compared, and only with parts that have one of
    the words that no similar text can lack. Null texts count as empty; parts
    of fewer than two words have no bigrams and are like nothing.
    """
    return _compared(docs, id_col, text_col, threshold, known).filter("dice IS NOT NULL").drop("row")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
         known: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, the license of its best match (null for none), its dice, and n_matches, the
    number of pairs of a part and a template that ``matches`` would list.

    Of equal matches the earlier template counts. Null and empty texts match nothing; rows that repeat an id are
    documents of their own, null ids too. Other columns are not read. All parts of a document lie in one task, so
    that nearly nothing is left to shuffle.
    """
    found = _compared(docs, id_col, text_col, threshold, known)
    rank = F.when(F.col("dice").isNotNull(), F.floor(F.col("dice") * (1 << 40)).cast("long") * 4096 + 4095 - F.col("template"))
    names = F.array(*[F.lit(name) for name, _ in known])
    return found.groupBy("row", "doc_id").agg(
        F.max(rank).alias("best"), F.max("dice").alias("dice"), F.count("dice").alias("n_matches")).select(
        "doc_id", F.get(names, (4095 - F.col("best") % 4096).cast("int")).alias("license"), "dice", "n_matches")
