r"""Licence scans: parts of texts compared with licence templates by Dice over word bigrams.

A text's parts are the whole text, its paragraphs (between blank lines) and its lines. A part and a template
are normalised alike: copyright lines go, letters are lower-cased, and everything but letters and digits
separates words. The measure is Dice over multisets of bigrams, 2 |A and B| / (|A| + |B|), and a multiset of
bigrams is one smaller than the words, so sizes are known before any bigram is made: a template of size b
can reach the threshold t only for a in [b t / (2 - t), b (2 - t) / t]. Parts that no template's bounds admit
are dropped first; the others' bigrams meet the templates' in an equi-join with a broadcast table of fixed
size. All is done with DataFrame functions.

A notice that is longer than a line and shorter than its paragraph or text, such as a licence of several
paragraphs inside a longer document or a header in a comment block, is found as a run of consecutive lines
(``runs``). A run can only reach a template if it holds one of its anchors (rare bigrams, one more of
them than a matching run can lack), so only texts with an anchor's word are cut into bigrams; of these only
texts that hold enough of a template's bigrams go on. The best run that begins at a line is reported
where it says more than what overlaps it: no run of other lines is better (ties go to fewer lines, then to the
first), and no part matches the same licence at least as well, or holds the run and matches.
A notice that begins or ends inside a longer line is not found.

Null and empty texts have no parts with words and match nothing. Rows that repeat a document are scanned
each, with the same result. A template matches at most once per part; ties go to the first licence by name. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgauge.llm.common import broadcast_if_small, scratch, without, written

THRESHOLD = 0.85

# Notices and texts of public licences, as their stewards publish them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This file is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-3.0",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    (
        "ISC",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Proprietary", "All rights reserved."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
)

#: Words that are no sign of a licence; which they are decides work and never results.
_FREQUENT = frozenset("a an and any are as at be by can for in is it may not of on or that the this to under with you".split())

_NOT_WORD = r"[^\p{L}\p{N}]+"
_COPYRIGHT = r"(?i)^[^\p{L}\p{N}]*copyright\b"
_BLANK = r"\n[ \t]*\n\s*"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest size that can reach the threshold against ``size``."""
    lo, hi = size * threshold / (2 - threshold), size * (2 - threshold) / threshold
    return math.ceil(lo - 1e-9), math.floor(hi + 1e-9)


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(licence, template number, size, least size, greatest size, first word, second word, times) of every bigram."""
    rows = []
    for no, (name, text) in enumerate(templates):
        words = template_words(text)
        times = Counter(zip(words, words[1:], strict=False))
        lo, hi = bounds(len(words) - 1, threshold)
        rows += [(name, no, len(words) - 1, lo, hi, a, b, n) for (a, b), n in sorted(times.items())]
    return rows


def _bigram_table(spark: SparkSession, templates, threshold: float) -> DataFrame:
    """The templates' bigrams by hash; its size is that of the templates."""
    table = spark.createDataFrame(template_rows(templates, threshold), "license string, template int, size int, least int, most int, w1 string, w2 string, times int")
    return table.select("license", "template", "size", "least", "most", F.xxhash64("w1", "w2").alias("bigram"), "times")


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _line_words(line: Column) -> Column:
    words = F.filter(F.split(F.lower(line), _NOT_WORD), lambda w: w != "")
    return F.when(line.rlike(_COPYRIGHT), F.array().cast("array<string>")).otherwise(words)


def parts(text: Column, most: int) -> Column:
    """(part, words) of the whole text, its paragraphs if it has more than one, and its lines if it has more than one.

    Lines are normalised once; longer parts are put together from their lines, unless they have more than
    ``most`` words and can match nothing.
    """

    def lines_of(body: Column) -> Column:
        return F.transform(F.split(body, "\n", -1), _line_words)

    def whole(lines: Column) -> Column:
        n = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.size(x))
        return F.when(n <= most, F.flatten(lines)).otherwise(F.array().cast("array<string>"))

    def numbered(parts_: Column, name: str) -> Column:
        return F.transform(parts_, lambda words, i: F.struct(F.concat(F.lit(name), i.cast("string")).alias("part"), words.alias("words")))

    def both(lines: Column) -> Column:
        single = F.when(F.size(lines) > 1, numbered(lines, "line")).otherwise(F.array().cast("array<struct<part:string,words:array<string>>>"))
        return F.concat(numbered(F.array(whole(lines)), "text"), single)

    paragraphs = F.when(text.rlike(_BLANK), numbered(F.transform(F.split(text, _BLANK, -1), lambda x: whole(lines_of(x))), "paragraph"))
    paragraphs = F.coalesce(paragraphs, F.array().cast("array<struct<part:string,words:array<string>>>"))
    return F.concat(F.flatten(F.transform(F.array(lines_of(text)), both)), paragraphs)


def matches(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, part, license, dice): the best template of every part that reaches the threshold."""
    rows, table = template_rows(templates, threshold), _bigram_table(docs.sparkSession, templates, threshold)
    sizes = sorted({(r[3], r[4]) for r in rows})
    text = F.coalesce(F.col(text_col), F.lit(""))
    fits = lambda p: (F.size(p["words"]) > min(lo for lo, _ in sizes)) & (F.size(p["words"]) <= max(hi for _, hi in sizes) + 1)
    units = docs.select(F.col(id_col).alias("doc_id"), _text_key(text).alias("text_key"), F.inline(F.filter(parts(text, max(hi for _, hi in sizes) + 1), fits)))
    units = units.withColumn("n", F.size("words") - 1)
    admitted = F.lit(False)
    for lo, hi in sizes:
        admitted = admitted | F.col("n").between(lo, hi)
    pairs = units.filter(admitted & (F.col("n") > 0)).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n"))))
    pairs = pairs.select("doc_id", "text_key", "part", "n", "at", F.xxhash64(F.element_at("words", F.col("at")), F.element_at("words", F.col("at") + 1)).alias("bigram"))
    met = pairs.join(F.broadcast(table), "bigram").filter(F.col("n").between(F.col("least"), F.col("most")))
    key = ["doc_id", "text_key", "part", "n", "license", "template", "size"]
    met = met.select(*key, "bigram", "times", "at").distinct()  # rows that repeat a document count once
    shared = met.groupBy(*key, "bigram", "times").agg(F.count(F.lit(1)).alias("seen")).groupBy(*key).agg(F.sum(F.least("seen", "times")).alias("both"))
    scored = shared.withColumn("dice", 2 * F.col("both") / (F.col("n") + F.col("size"))).filter(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id", "text_key", "part").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best"))
    return best.select("doc_id", "text_key", "part", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"))


def anchors(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Per template: the bigrams of which every matching run holds one, each with the rarer of its words."""
    counts = [Counter(zip(w, w[1:], strict=False)) for w in (template_words(text) for _, text in templates)]
    common = Counter(w for (_, text) in templates for w in set(template_words(text)))
    rank = lambda w: (w in _FREQUENT, len(w) < 5, common[w], w)
    out = []
    for times in counts:
        # Of b bigrams a match shares t b / (2 - t) at least, as it has that many itself at least, or more of a larger size.
        size = sum(times.values())
        lacks = size - math.ceil(size * threshold / (2 - threshold) - 1e-9)
        chosen, n = {}, 0
        for gram in sorted(times, key=lambda g: min(rank(w) for w in g)):
            if n > lacks:
                break
            chosen[gram] = min(gram, key=rank)
            n += times[gram]
        out.append(chosen)
    return out


_DOC = ("doc_id", "text_key")


def _numbered_lines(docs: DataFrame, anchor_words: list[str], text_col: str, id_col: str) -> DataFrame:
    """The lines with words of texts that hold an anchor's word: line, paragraph, k (its number among them), words, begin (words before it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has = F.exists(F.split(F.lower(text), _NOT_WORD), lambda w: w.isin(anchor_words))
    rows = docs.filter(F.contains(text, F.lit("\n")) & has).select(F.col(id_col).alias("doc_id"), _text_key(text).alias("text_key"), F.split(text, "\n", -1).alias("lines"))
    said = F.transform(
        "lines",
        lambda x, i: F.struct(_line_words(x).alias("words"), x.rlike(r"^\s*$").alias("space"), (x.rlike(r"^[ \t]*$") & (i > 0) & (i < F.size("lines") - 1)).alias("blank")),
    )
    lines = rows.select(*_DOC, F.posexplode(said).alias("line", "x")).select(*_DOC, "line", "x.*").filter((F.size("words") > 0) | F.col("blank") | ~F.col("space")).dropDuplicates([*_DOC, "line"])
    # A blank line parts paragraphs unless only space lies between it and one before it that does.
    before = W.partitionBy(*_DOC).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    full, last_blank = F.max(F.when(~F.col("space"), F.col("line"))).over(before), F.max(F.when(F.col("blank"), F.col("line"))).over(before)
    parting = F.col("blank") & (last_blank.isNull() | F.coalesce(last_blank < full, F.lit(False)))
    lines = lines.withColumn("parting", parting.cast("int"))
    lines = lines.withColumn("paragraph", F.sum("parting").over(before.rowsBetween(W.unboundedPreceding, W.currentRow))).filter(F.size("words") > 0)
    return lines.select(*_DOC, "line", "paragraph", F.row_number().over(W.partitionBy(*_DOC).orderBy("line")).alias("k"), "words", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)).alias("begin"))


def runs(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, part, license, dice): runs of two lines or more that reach the threshold and say more than the matching parts ``found``.

    Words are numbered through a text's lines, and a bigram is known by the place of its first word. For a run that begins at line s,
    a bigram counts unless as many as the template has of it lie between s and it already. A best run begins and
    ends at lines with bigrams of the template, so only such lines are tried, and their words lie within the
    greatest size: pairs are found in cells of that many words.
    """
    table = _bigram_table(docs.sparkSession, templates, threshold)
    anchor_words = sorted({w for chosen in anchors(templates, threshold) for w in chosen.values()})
    lines = _numbered_lines(docs, anchor_words, text_col, id_col)
    following = W.partitionBy(*_DOC).orderBy("k")
    after = [F.lead(c).over(following).alias(f"{c}_after") for c in ("words", "line", "paragraph")]
    lines = lines.select("*", *after)
    ends = F.col("begin") + F.size("words")
    more = F.coalesce(F.slice("words_after", 1, 1), F.array().cast("array<string>"))
    row = F.concat("words", more)
    grams = F.transform(F.slice(row, 1, F.size(row) - 1), lambda w, j: F.struct(F.xxhash64(w, F.get(row, j + 1)).alias("bigram"), (F.col("begin") + j).alias("at"), (j == F.size("words") - 1).alias("crosses")))
    own, last = F.struct("k", "line", "paragraph", ends.alias("end")), F.struct((F.col("k") + 1).alias("k"), F.col("line_after").alias("line"), F.col("paragraph_after").alias("paragraph"), (ends + F.size("words_after")).alias("end"))
    placed = lines.select(*_DOC, F.struct("k", "line", "paragraph", "begin").alias("first"), own.alias("own"), last.alias("next"), F.inline(grams))
    hits = placed.join(F.broadcast(table), "bigram").withColumn("last", F.when(F.col("crosses"), F.col("next")).otherwise(F.col("own"))).drop("own", "next", "crosses")
    hits = written(hits)
    key = [*_DOC, "template"]
    held = hits.groupBy(*key, "size", "bigram", "times").agg(F.count(F.lit(1)).alias("seen")).groupBy(*key, "size").agg(F.sum(F.least("seen", "times")).alias("both"))
    enough = written(held.filter(F.col("both") >= F.col("size") * threshold / (2 - threshold) - 1e-9).select(*key))
    hits = hits.join(enough, key)
    # The place of the bigram that is one too many before this one, if any.
    in_order = W.partitionBy(*key, "bigram").orderBy("at")
    spent = F.coalesce(*[F.when(F.col("times") == n, F.lag("at", n).over(in_order)) for n in sorted({r[7] for r in template_rows(templates, threshold)})])
    hits = written(hits.withColumn("spent", spent).withColumn("cell", F.floor(F.col("at") / (F.col("most") + 1))))
    cells = F.floor(F.col("first.begin") / (F.col("most") + 1))
    starts = hits.select(*key, "first", "most").distinct().select(*key, F.col("first").alias("from"), F.explode(F.array(cells, cells + 1)).alias("cell"))
    met = starts.join(hits.drop("first"), [*key, "cell"]).filter((F.col("at") >= F.col("from.begin")) & (F.col("spent").isNull() | (F.col("spent") < F.col("from.begin"))))
    met = met.filter(F.col("last.end") - F.col("from.begin") - 1 <= F.col("most"))
    ended = met.groupBy(*key, "license", "size", "least", "from", "last").agg(F.count(F.lit(1)).alias("own"))
    both = F.sum("own").over(W.partitionBy(*key, "from").orderBy("last.k"))
    ended = ended.withColumn("both", both).withColumn("n", F.col("last.end") - F.col("from.begin") - 1)
    scored = ended.withColumn("dice", 2 * F.col("both") / (F.col("n") + F.col("size"))).filter((F.col("dice") >= threshold) & (F.col("n") >= F.col("least")) & (F.col("last.k") > F.col("from.k")))
    rank = F.struct((-F.col("dice")).alias("minus"), (F.col("last.k") - F.col("from.k")).alias("more"), F.col("from.k").alias("k"), "license")
    best = scored.groupBy(*_DOC, F.col("from.k").alias("k")).agg(F.min(F.struct(rank.alias("rank"), "from", "last")).alias("best"))
    best = written(best.select(*_DOC, "k", "best.*"))
    return _telling(best, found)


def _telling(best: DataFrame, found: DataFrame) -> DataFrame:
    """The runs that no better run and no part makes needless."""
    run = [*_DOC, "k"]
    covered = best.select(*run, "rank", F.explode(F.sequence(F.col("from.k"), F.col("last.k"))).alias("covers"))
    leaders = covered.groupBy(*_DOC, "covers").agg(F.min("rank").alias("leader"))
    beaten = covered.join(leaders, [*_DOC, "covers"]).filter(F.col("leader") < F.col("rank")).select(*run).distinct()
    best = written(best.join(beaten, run, "left_anti"))
    names = F.concat(
        F.array(F.lit("text0")),
        F.transform(F.sequence(F.col("from.line"), F.col("last.line")), lambda i: F.concat(F.lit("line"), i.cast("string"))),
        F.transform(F.sequence(F.col("from.paragraph"), F.col("last.paragraph")), lambda i: F.concat(F.lit("paragraph"), i.cast("string"))),
    )
    holds = F.col("part").startswith("text") | F.col("part").startswith("paragraph") & (F.col("from.paragraph") == F.col("last.paragraph"))
    meeting = best.withColumn("part", F.explode(names)).join(found.select(*_DOC, "part", F.col("license").alias("said"), F.col("dice").alias("as_good")), [*_DOC, "part"])
    same, as_good = F.col("said") == F.col("rank.license"), F.col("as_good") >= -F.col("rank.minus")
    needless = meeting.filter((same | holds) & as_good | same & holds).select(*run).distinct()
    part = F.concat(F.lit("lines"), F.col("from.line").cast("string"), F.lit("-"), F.col("last.line").cast("string"))
    return best.join(needless, run, "left_anti").select(*_DOC, part.alias("part"), F.col("rank.license").alias("license"), (-F.col("rank.minus")).alias("dice"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with licenses: (license, part, dice) of every matching part, by part; empty if there is none."""
    docs = without(docs, "licenses")
    with scratch(docs.sparkSession) as keep:
        parts_found = written(matches(docs, threshold, templates, text_col, id_col))
        found = parts_found.unionByName(runs(docs, parts_found, threshold, templates, text_col, id_col))
        found = found.groupBy(*_DOC).agg(F.sort_array(F.collect_set(F.struct("part", "license", "dice"))).alias("licenses"))
        found = keep(found.select(F.col("doc_id").alias("_of_id"), F.col("text_key").alias("_of_key"), "licenses"))
    # The text's key is a column of its own, so that the text does not go through the join unless it is asked for.
    keyed = docs.select("*", _text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("_text_key"))
    joined = keyed.join(broadcast_if_small(found, 64 * F.size("licenses")), F.col(id_col).eqNullSafe(F.col("_of_id")) & (F.col("_text_key") == F.col("_of_key")), "left")
    none = F.array().cast("array<struct<part:string,license:string,dice:double>>")
    return joined.select(*[keyed[c] for c in docs.columns], F.coalesce("licenses", none).alias("licenses"))


def read_templates(spark: SparkSession, folder: str, least_words: int = 8) -> tuple[tuple[str, str], ...]:
    """Templates from a folder of licence texts, named by licence: each whole text, and its paragraphs of ``least_words`` words or more.

    The texts are brought to the driver and their bigrams broadcast, so the folder may hold 16 MB at most.
    """
    files = spark.read.format("binaryFile").load(folder)
    if (files.agg(F.sum("length")).first()[0] or 0) > 16 << 20:
        raise ValueError("licence templates of more than 16 MB")
    out = []
    for r in files.select("path", F.decode("content", "utf-8").alias("text")).orderBy("path").collect():
        name = re.sub(r"\.(txt|md)$", "", r.path.rpartition("/")[2])
        parts_ = [r.text, *(p for p in re.split(_BLANK, r.text) if len(template_words(p)) >= least_words)]
        out += [(name, p) for p in dict.fromkeys(parts_) if len(template_words(p)) > 1]
    return tuple(out)
