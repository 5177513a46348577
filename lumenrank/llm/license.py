"""License scans by an exact set-similarity join, in DataFrame functions only.

Base labels: places where the words of a phrase stand consecutively. The method's labels: every text
block that holds at least ``CONTAINMENT_PERCENT`` of a template's distinct words. Blocks are windows
over the words of the whole text, whatever its lines, sized by the template: the smallest of 64, 128,
256, ... words that is twice as long as the template or longer, every half of it, so any copy of the
template lies in one block. The template words get one global order, rarest in the corpus first; a
template is met only by a block with one of its first ``size - needed + 1`` words (prefix filter),
with at least ``needed`` template words (length filter), and with enough words left behind the met
one (positional filter); what passes is verified by the exact intersection.

Defined results: a null or empty text has no words, null first and last words, empty labels and score
0; repeated rows are scanned each; an empty table gives an empty result; words are compared with A-Z
lower-cased only; a template without words meets nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import materialise

#: Fixed values of the contract: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices of public licenses, label and text.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Whole texts of public licenses and of the headers that stand for the longest ones, without names and years.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_HOPE = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
)
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the Software. " + _AS_IS),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies. " + _ISC_AS_IS),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_AS_IS),
    ("bsd-2-clause", _BSD_CONDITIONS + _BSD_AS_IS),
    ("bsd-3-clause", _BSD_CONDITIONS + _BSD_THIRD + _BSD_AS_IS),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
             "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
             "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
                  "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
                "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
                "whom the Software is furnished to do so."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
                "version 2 of the License, or (at your option) any later version. This program " + _GNU_HOPE + "See the GNU General Public License for more details."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
                "version 3 of the License, or (at your option) any later version. This program " + _GNU_HOPE + "See the GNU General Public License for more details."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
                 "either version 2.1 of the License, or (at your option) any later version. This library " + _GNU_HOPE + "See the GNU Lesser General Public License for more details."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
                 "either version 3 of the License, or (at your option) any later version. This program " + _GNU_HOPE + "See the GNU Affero General Public License for more details."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
                "http://mozilla.org/MPL/2.0/."),
)
TEMPLATES = NOTICES + TEXTS
CONTAINMENT_PERCENT, LEAST_BLOCK = 80, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """Words of ``text``, A-Z lower-cased, one space apart."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def words(text: str) -> list[str]:
    """The words of a template, by the same rule."""
    return re.sub(SEPARATORS, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def needed(n: int, percent: int = CONTAINMENT_PERCENT) -> int:
    return -(-n * percent // 100)


def block_size(n_words: int) -> int:
    """Words of the blocks that a template of ``n_words`` words is compared with."""
    size = LEAST_BLOCK
    while size < 2 * n_words:
        size *= 2
    return size


def _text_array(values: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def phrase_places(words: str, phrase: str) -> str:
    """SQL for the starts of ``phrase`` in the word array ``words``, from 0."""
    parts = phrase.split()
    hit = " AND ".join(f"{words}[i + {k}] = '{p}'" for k, p in enumerate(parts))
    n = f"size({words}) - {len(parts)}"
    return f"CASE WHEN {n} >= 0 THEN filter(sequence(0, {n}), i -> {hit}) ELSE CAST(array() AS array<int>) END"


def scan(docs: DataFrame, *, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the blocks met.

    ``templates`` is a constant of a few hundred texts at most; it and its word counts are all that
    is broadcast or sent to the driver. A block met is its first word, size, label and containment.
    """
    templates = [(label, words(t)) for label, t in templates if words(t)]
    sets = [sorted(set(t)) for _, t in templates]
    sizes = [block_size(len(t)) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    d = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_norm", normal(F.col("text")))
    d = d.withColumn("_words", F.split("_norm", " ")).withColumn("_padded", F.concat(F.lit(" "), "_norm", F.lit(" ")))
    for k, (phrase, _) in enumerate(phrases):
        d = d.withColumn(f"_p{k}", F.expr(f"CASE WHEN contains(_padded, ' {phrase} ') THEN {phrase_places('_words', phrase)} ELSE CAST(array() AS array<int>) END"))
    d = d.withColumn("_hits", F.expr(f"array_intersect(_words, {_text_array(vocabulary)})"))
    # a block that meets a template lies in a document that does; by size of the blocks
    may = {b: F.expr(" OR ".join(f"size(array_intersect(_hits, {_text_array(s)})) >= {needed(len(s), percent)}" for s, size in zip(sets, sizes) if size == b)) for b in sorted(set(sizes))}
    places = F.concat(*[F.col(f"_p{k}") for k in range(len(phrases))])
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))))
    rows = d.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id",
        F.when(F.col("_norm") == "", 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        base.alias("_base"), "_hits", F.array_compact(F.array(*[F.when(m, F.lit(b)) for b, m in may.items()])).alias("_may"), "text",
    ).withColumn("_text", F.when(F.size("_may") > 0, F.col("text"))).drop("text")
    rows = materialise(rows, "license-rows")  # narrow: whole texts only where a template may be met
    counts = {r.w: r.n for r in rows.select(F.explode("_hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    met = [
        template_join(rows.filter(F.array_contains("_may", b)).select("_row", F.col("_text").alias("text")), [t for t, size in zip(templates, sizes) if size == b], counts, percent, b)
        for b in may
    ]
    met = reduce(DataFrame.unionByName, met)
    found = met.groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_containment"), F.array_sort(F.collect_set(F.struct("first", "size", "label", "containment"))).alias("blocks"))
    out = rows.drop("_text", "_hits", "_may").join(found, "_row", "left")
    both = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("_containment", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"), "blocks")


def template_join(texts: DataFrame, templates: Sequence[tuple[str, Sequence[str]]], counts: Mapping[str, int], percent: int, size: int) -> DataFrame:
    """_row, first (word of the block), size, label, containment of every block of ``size`` words that meets a template."""
    spark = texts.sparkSession
    ordered = sorted({w for _, t in templates for w in t}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(ordered)}
    postings = []
    for label, t in templates:
        mine = sorted(set(t), key=rank.__getitem__)
        need = needed(len(mine), percent)
        postings += [(mine[i], label, mine, len(mine), need, i) for i in range(len(mine) - need + 1)]
    index = spark.createDataFrame(postings, "token string, label string, mine array<string>, n int, need int, at int")
    step = size // 2
    blocks = texts.select("_row", F.split(normal(F.col("text")), " ").alias("_words"))
    blocks = blocks.withColumn("first", F.explode(F.expr(f"sequence(0, greatest(size(_words) - {step} - 1, 0), {step})")))
    tokens = F.expr(f"array_intersect({_text_array(ordered)}, slice(_words, first + 1, {size}))")  # in the global order
    blocks = blocks.select("_row", "first", tokens.alias("_tokens"))
    met = blocks.select("*", F.posexplode("_tokens").alias("_at", "token"), F.size("_tokens").alias("_n")).join(F.broadcast(index), "token")
    left = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))  # words from the met one on; it is the first in common
    shared_before = F.expr("exists(slice(mine, 1, at), t -> array_contains(_tokens, t))")
    met = met.filter((F.col("_n") >= F.col("need")) & (left >= F.col("need")) & ~shared_before)
    overlap = F.size(F.array_intersect("_tokens", "mine"))
    return met.withColumn("_o", overlap).filter("_o >= need").select("_row", "first", F.lit(size).alias("size"), "label", F.round(F.col("_o") / F.col("n"), 6).alias("containment"))
