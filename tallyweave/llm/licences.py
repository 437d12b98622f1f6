"""Licence scans: normalised segments compared with licence templates by the Dice coefficient of their word bigrams, in
DataFrame functions only.

Segments of a text are its lines, its paragraphs (between blank lines) and itself. Normalising lower-cases and turns all
but letters and digits into single spaces. Dice is 2 |A and B| / (|A| + |B|) over distinct bigrams. Templates are a table
of their bigrams: segments' bigrams are joined with it and counted. A template of n bigrams is only compared with segments
of t / (2 - t) * n to (2 - t) / t * n distinct bigrams: outside, the coefficient cannot reach the threshold t.

Most texts are dismissed before any bigram is made. To reach t a segment must hold at least t / (2 - t) of a template's
bigrams, so it cannot miss all of any larger share of them. `anchors` picks words such that every template has more
bigrams with such a word than a match may miss: a text without any of these words matches nothing.

Null and empty texts: no segments, no match. Equal best scores: the alphabetically first licence. Rows are independent.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _base
from tallyweave.llm._spans import let

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(name: str, version: str, later: str = "or (at your option) any later version") -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either {version} of the License, {later}. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. "
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Whole texts of short public licences, and the notices by which files name the long ones.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL,),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _gnu("GNU Affero General Public License", "version 3")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", f"{_BSD_HEAD} {_BSD_TAIL}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _gnu("GNU General Public License", "version 2")),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _gnu("GNU General Public License", "version 3"),
    ),
    "ISC": (_ISC, f"{_ISC} {_ISC_TAIL}"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("GNU Lesser General Public License", "version 3")),
    "MIT": ("Released under the MIT License.", _MIT, f"{_MIT} {_AS_IS}"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
}


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _grams(text: str) -> list[str]:
    w = _words(text)
    return list(dict.fromkeys(map(" ".join, zip(w, w[1:], strict=False))))


#: Frequent words, taken as anchors last of all: it only decides how many texts are looked at.
_FREQUENT = frozenset("a and any are as be by for from in is it not of on or that the this to under was will with you".split())


def anchors(templates: dict[str, tuple[str, ...]], least: float) -> list[str]:
    """Words of which every match holds at least one: long words first, each the one that covers most of what is still open."""
    low = least / (2 - least)
    texts = [g for ts in templates.values() for t in ts if (g := _grams(t))]
    open_ = [set(g) for g in texts]
    needed = [len(g) - math.ceil(low * len(g) - 1e-9) + 1 for g in texts]
    chosen: list[str] = []
    for shortest, spare in ((6, _FREQUENT), (2, _FREQUENT), (1, frozenset())):
        while True:
            gain = Counter()
            for g, n in zip(open_, needed, strict=True):
                if n > 0:
                    for gram in g:
                        gain.update({w for w in gram.split() if len(w) >= shortest and w not in spare})
            if not gain:
                break
            word = min(gain, key=lambda w: (-gain[w], w))
            chosen.append(word)
            for k, g in enumerate(open_):
                hit = {gram for gram in g if word in gram.split()}
                needed[k] -= len(hit)
                open_[k] = g - hit
        if all(n <= 0 for n in needed):
            break
    return chosen


def licences(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """Per document row: keep and matches, an array of struct(dice, licence, segment), best first."""
    spark = docs.sparkSession
    flat = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    own = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), flat.alias("__f"))
    names = [f"__k{i}" for i in range(len(keep))]
    table = [(k, name, len(g), x) for k, (name, g) in enumerate((name, _grams(t)) for name, ts in sorted(templates.items()) for t in ts) for x in g]
    low, high = least / (2 - least), (2 - least) / least
    words = anchors(templates, least)
    short = "|".join(w for w in words if len(w) < 6)
    tests = [f"contains({{0}}, '{w}')" for w in words if len(w) >= 6] + ([f"{{0}} RLIKE '(^|[ \\n])({short})($|[ \\n])'"] if short else [])
    anchored = lambda c: "(" + (" OR ".join(tests) or "false").format(c) + ")"
    sizes = [n for _, _, n, _ in table] or [1]
    possible = f"size(w) > 1 AND size(w) - 1 >= {low * min(sizes) - 1e-6:.6f} AND size(array_distinct(w)) - 1 <= {high * max(sizes) + 1e-6:.6f}"
    segments = "array_distinct(flatten(array(split(__f, '\\n'), split(__f, ' ?\\n( ?\\n)+'), array(__f))))"
    some = f"filter(transform(filter({segments}, s -> {anchored('s')}), s -> split(trim(replace(s, '\\n', ' ')), ' +')), w -> {possible})"
    scanned = own.select(*names, F.expr(f"CASE WHEN {anchored('__f')} THEN array_distinct(transform({some}, w -> array_join(w, ' '))) ELSE CAST(array() AS array<string>) END").alias("__s"))
    scanned = _base.staged(scanned.withColumn("__id", F.monotonically_increasing_id()), "licences")
    grams = spark.createDataFrame(table, "t int, licence string, n int, gram string")  # as large as the templates that were passed
    # the few segments left are dealt evenly: work, not bytes, decides how long they take
    held = scanned.where(F.size("__s") > 0).select("__id", F.posexplode("__s").alias("p", "s")).repartition(4 * spark.sparkContext.defaultParallelism)
    held = held.select("__id", "p", F.expr(let("split(s, ' ')", "w", "array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (x, y) -> concat(x, ' ', y)))")).alias("b"))
    found = held.select("__id", "p", F.size("b").alias("m"), F.explode("b").alias("gram")).join(F.broadcast(grams) if len(table) <= _base.SENT_ROWS else grams, "gram").where(F.col("m").between(low * F.col("n") - 1e-6, high * F.col("n") + 1e-6))
    dice = (F.lit(2.0) * F.count(F.lit(1)) / (F.col("m") + F.col("n"))).alias("dice")
    scored = found.groupBy("__id", "p", "t", "licence", "m", "n").agg(dice).where(F.col("dice") >= least)
    best = scored.groupBy("__id").agg(F.collect_set(F.struct("dice", "licence", "p")).alias("m"))
    out = scanned.join(best, "__id", "left").withColumn("matches", F.expr("transform(coalesce(m, array()), x -> named_struct('dice', x.dice, 'licence', x.licence, 'segment', __s[x.p]))"))
    ordered = F.array_sort("matches", lambda a, b: F.when(a.dice > b.dice, -1).when(a.dice < b.dice, 1).when(a.licence < b.licence, -1).when(a.licence > b.licence, 1).when(a.segment < b.segment, -1).when(a.segment > b.segment, 1).otherwise(0))
    return out.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), ordered.alias("matches"))


def _first(field: str) -> Column:
    return F.get("matches", F.lit(0))[field]


def op10_licences(spark, sf_dir: str) -> DataFrame:
    """Every document with its best licence (null: none), that one's coefficient, all licences found and the matching segments' count."""
    out = licences(_base.table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda x: x.licence))), ",")
    return out.select("doc_id", _first("licence").alias("licence"), F.round(_first("dice"), 6).alias("dice"), names.alias("licences"), F.size(F.array_distinct(F.transform("matches", lambda x: x.segment))).cast("long").alias("n_segments"))


def _oracle(least: float = 0.8) -> str:
    """Every segment against every template that shares a bigram with it: no bound at all."""
    rows = ", ".join(f"({k}, '{name}', {len(g)}, [{', '.join(chr(39) + x + chr(39) for x in g)}])" for k, (name, g) in enumerate((name, _grams(t)) for name, ts in sorted(TEMPLATES.items()) for t in ts))
    return rf"""
WITH tpl(t, licence, n, b) AS (VALUES {rows}),
grams AS (SELECT t, licence, n, unnest(b) AS gram FROM tpl),
f AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS f FROM documents),
seg AS (SELECT DISTINCT doc_id, trim(regexp_replace(replace(s, chr(10), ' '), ' +', ' ', 'g')) AS s FROM (SELECT doc_id, unnest(list_concat(string_split(f, chr(10)), list_concat(string_split_regex(f, ' ?\n( ?\n)+'), [f]))) AS s FROM f)),
w AS (SELECT doc_id, s, string_split(s, ' ') AS ws FROM seg WHERE contains(s, ' ')),
g AS (SELECT doc_id, s, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS b FROM w),
m AS (SELECT doc_id, s, t, licence, 2.0::DOUBLE * count(*) / (any_value(m) + any_value(n)) AS dice FROM (SELECT doc_id, s, len(b) AS m, unnest(b) AS gram FROM g) JOIN grams USING (gram) GROUP BY doc_id, s, t, licence),
k AS (SELECT * FROM m WHERE dice >= {least}),
best AS (SELECT doc_id, licence, dice FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence, s) = 1),
a AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(DISTINCT s) AS n_segments FROM k GROUP BY doc_id)
SELECT d.doc_id, best.licence, round(best.dice, 6) AS dice, coalesce(a.licences, '') AS licences, coalesce(a.n_segments, 0)::BIGINT AS n_segments
FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN a ON d.doc_id = a.doc_id
"""


ORACLE_SQL = _oracle()
