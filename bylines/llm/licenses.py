"""Licence statements by Dice coefficient over word bigrams, in built-in functions only.

A text is cut into statements: its lines and the sentences in them. A template is compared with single
statements and with runs of joined statements of about its size, so notices broken over lines, grant
paragraphs, standard headers and whole licence texts are found too. Both sides are sets of word bigrams,
compared by 2 * common / (size + size). For a coefficient of at least t the sizes can differ by the factor
(2 - t) / t at most, and a text must hold t / (2 - t) of a template's bigrams; few texts hold any word
that this takes, and the rest need no comparison. All of it happens within a row; nothing is shuffled.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame

THRESHOLD = 0.8

# Short notices of public licences, as their stewards or common practice word them.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Grant paragraphs and standard headers, compared with statements and runs of them as well.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction, including without limitation the"
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
    " permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION"
    " OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:"
)
BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
BSD_REST = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,"
    " INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
    " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF"
    " LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY"
    " OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies."
)
ISC_REST = (
    " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER"
    " IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
APACHE_GRANT = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
    " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
    ' on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
    " the specific language governing permissions and limitations under the License."
)
UNLICENSE_GRANT = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
    " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
    " purpose, commercial or non-commercial, and by any means."
)
UNLICENSE_REST = (
    " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all"
    " copyright interest in the software to the public domain. We make this dedication for the benefit of the public at"
    " large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of"
    " relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE"
    " IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
    " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE"
    " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT"
    " OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please"
    " refer to http://unlicense.org/"
)
MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)


def gnu_header(name: str, version: str) -> tuple[str, str]:
    """The first paragraph of the header that a GNU licence asks for, and the whole header."""
    grant = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        f" {name}General Public License as published by the Free Software Foundation, either version {version} of the"
        " License, or (at your option) any later version."
    )
    rest = (
        " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        f" {name}General Public License for more details. You should have received a copy of the GNU"
        f" {name}General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    )
    return grant, grant + rest


GNU = (
    ("GPL-2.0", "", "2"),
    ("GPL-3.0", "", "3"),
    ("LGPL-2.1", "Lesser ", "2.1"),
    ("LGPL-3.0", "Lesser ", "3"),
    ("AGPL-3.0", "Affero ", "3"),
)
PASSAGES = (
    ("MIT", MIT_GRANT),
    ("MIT", MIT_GRANT + MIT_REST),
    ("BSD-3-Clause", BSD_GRANT),
    ("BSD-2-Clause", BSD_GRANT + BSD_TWO),
    ("BSD-3-Clause", BSD_GRANT + BSD_TWO + BSD_THIRD),
    ("BSD-2-Clause", BSD_GRANT + BSD_TWO + BSD_REST),
    ("BSD-3-Clause", BSD_GRANT + BSD_TWO + BSD_THIRD + BSD_REST),
    ("ISC", ISC_GRANT),
    ("ISC", ISC_GRANT + ISC_REST),
    ("Apache-2.0", APACHE_GRANT),
    ("Apache-2.0", APACHE_GRANT + APACHE_REST),
    ("Unlicense", UNLICENSE_GRANT),
    ("Unlicense", UNLICENSE_GRANT + UNLICENSE_REST),
    ("MPL-2.0", MPL_HEADER),
    *((license_, text) for license_, name, version in GNU for text in gnu_header(name, version)),
)
# SPDX names in tags, alone and in the pairs that are common.
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Apache-2.0 OR MIT", "BSD-2-Clause",
    "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0",
    "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0 WITH Linux-syscall-note", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MIT OR Apache-2.0", "MPL-2.0", "Unlicense", "Zlib",
)
TAGS = tuple((re.sub(r"-only|-or-later|\+| WITH .*", "", tag), f"SPDX-License-Identifier: {tag}") for tag in SPDX)
# Whole texts of the longer licences, as their stewards publish them.
WHOLE = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
EVERY = (*TEMPLATES, *PASSAGES, *TAGS, *WHOLE)

UNITS = 24  # a run is a row of units; of texts over 20 * UNITS words, a unit is lines of a UNITS-th of the words
COMMON = frozenset(
    "0 1 2 3 a above all also an and any are as at be been but by can do each for from has have if in is it its may"
    " must no not of on one only or other our s see shall should so some such than that the their them there these they"
    " this those to under use we when where which who will with work works would you your".split()
)


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams in order of first appearance; letters and digits of ASCII make words."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def sql_list(values: list[str]) -> str:
    return f"split('{'|'.join(values)}', '[|]')"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def joined_pairs(words: str) -> str:
    n = f"greatest(size({words}) - 1, 0)"
    return f"zip_with(slice({words}, 1, {n}), slice({words}, 2, {n}), (a, b) -> concat(a, ' ', b))"


def telling_words(built: list[tuple[str, int, list[str]]], share: float) -> list[str]:
    """Words of which a text that holds at least ``share`` of some template's bigrams holds one at least."""
    chosen: set[str] = set()
    for _, _, own in sorted(built, key=lambda t: len(t[2])):
        left = [b.split(" ") for b in own if chosen.isdisjoint(b.split(" "))]
        while left and len(left) >= 0.999 * share * len(own):
            counts = Counter(w for pair in left for w in dict.fromkeys(pair))
            best = max(counts, key=lambda w: (w not in COMMON, counts[w]))
            chosen.add(best)
            left = [pair for pair in left if best not in pair]
    return sorted(chosen)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = EVERY,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id and matches, an array of (license, dice), one for each matching statement or run in order.

    A run has at most (2 - t) / t times the words of the template; single statements are compared
    whatever their length. A statement or run matches a template if their coefficient reaches
    ``threshold``. Of matches that overlap, the one with most common bigrams, times the coefficient,
    stays; of equal ones the first template in the list. Statements of fewer than two words match
    nothing by themselves, nor do NULL and empty texts, which have no matches. Every row gets a result,
    repeated rows too. Other columns are ignored, whatever their names.
    """
    built = [(name, len(re.findall("[a-z0-9]+", text.lower())), bigrams(text)) for name, text in templates]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    table = ", ".join(
        f"named_struct('license', '{name}', 'nth', {i}, 'words', {n}, 'size', {len(own)},"
        f" 'step', {n / UNITS if n > 20 * UNITS else 1}D, 'own', {sql_list(own)})"
        for i, (name, n, own) in enumerate(built)
    )
    lower = f"translate(coalesce(`{text_col}`, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    statements = f"split(regexp_replace({lower}, '([.!?])[ \\\\t]+', '$1\\n'), '\\n')"
    words = f"filter(transform({statements}, s -> filter(split(s, '[^a-z0-9]+'), w -> w <> '')), w -> size(w) > 0)"

    # Templates that the text holds enough of; the bounds leave room for rounding.
    enough = f"size(array_intersect(d, t.own)) >= {0.999 * low}D * t.size"
    held = f"filter(array({table}), t -> size(d) >= {0.999 * low}D * t.size AND {enough})"
    telling = sql_list(telling_words(built, low))
    gated = f"if(arrays_overlap(f, {telling}), f, slice(f, 1, 0))"

    # Places are counted in words: u are starts of units, h places of the template's bigrams, n is the end of the text.
    firsts = "flatten(transform(v, p -> transform(p, (x, i) -> i = 0)))"
    starts = f"filter(transform({firsts}, (x, i) -> if(x, i, -1)), x -> x >= 0)"
    units = "if(t.step <= 1, o, filter(o, (x, i) -> i = 0 OR floor(x / t.step) > floor(o[i - 1] / t.step)))"
    hits = "filter(transform(g, (x, i) -> if(array_contains(t.own, x), i, -1)), x -> x >= 0)"
    bounds = (
        f"transform(u, (x, i) -> struct(x AS x, if(i + 1 < size(u), u[i + 1], n) AS k,"
        f" greatest(x + {high}D * t.words, if(i + 1 < size(u), u[i + 1], n)) AS reach))"
    )
    begins = (
        f"filter({bounds}, s -> exists(h, y -> y >= s.x AND y < s.k)"
        f" AND size(filter(h, y -> y >= s.x AND y < s.reach)) >= {0.999 * low}D * t.size)"
    )
    ends = f"filter(concat(u, array(n)), z -> z > s.x + {0.999 * low}D * t.size AND z <= s.reach)"
    own = "array_distinct(slice(g, s.x + 1, z - s.x - 1))"
    close = f"t.size >= {low} * size(q) AND t.size <= {high} * size(q)"
    measured = let(
        own,
        "q",
        let(
            f"if({close}, size(array_intersect(q, t.own)), 0)", "c", "struct(c, 2.0D * c / (t.size + size(q)) AS dice)"
        ),
    )
    compared = f"transform({ends}, z -> " + let(
        measured,
        "m",
        "struct(-m.c * m.dice AS weight, t.nth AS nth, s.x AS first, z AS last, m.dice AS dice,"
        " t.license AS license)",
    ) + ")"
    runs = f"flatten(transform({begins}, s -> filter({compared}, r -> r.dice >= {threshold})))"
    found = "flatten(transform(c, t -> " + let(units, "u", let(hits, "h", runs)) + "))"
    apart = (
        "aggregate(r, slice(r, 1, 0), (kept, x) -> if(exists(kept, y -> y.first < x.last AND x.first < y.last), kept,"
        " concat(kept, array(x))))"
    )
    in_order = f"array_sort(transform({apart}, r -> struct(r.first AS first, r.license AS license, r.dice AS dice)))"
    matches = f"transform({in_order}, r -> struct(r.license AS license, r.dice AS dice))"
    none = "CAST(array() AS array<struct<license: string, dice: double>>)"
    chosen = let(f"array_sort({found})", "r", matches)
    searched = let(starts, "o", let("size(f)", "n", let(joined_pairs("f"), "g", chosen)))
    by_text = let(held, "c", f"if(size(c) = 0, {none}, {searched})")
    pairs = f"array_distinct({joined_pairs('f')})"
    looked = let(gated, "f", f"if(size(f) < 2, {none}, {let(pairs, 'd', by_text)})")
    whole = let(words, "v", let("flatten(v)", "f", looked))
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"{whole} AS matches")


def oracle(threshold: float = THRESHOLD) -> str:
    """The result of the registered query, as SQL over single statements and all templates of fitting size."""
    rows = ", ".join(
        f"({i}, '{name}', [{', '.join(repr(b) for b in bigrams(text))}])" for i, (name, text) in enumerate(TEMPLATES)
    )
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return rf"""
        WITH templates(nth, license, own) AS (VALUES {rows}),
        lowered AS (
          SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t
          FROM documents
        ), statements AS (
          SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS s
          FROM lowered
        ), worded AS (
          SELECT doc_id, row_number() OVER () AS piece, regexp_extract_all(s, '[a-z0-9]+') AS w FROM statements
        ), paired AS (
          SELECT doc_id, piece,
            list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS b FROM worded WHERE len(w) > 1
        ), scored AS (
          SELECT doc_id, piece, license,
            2.0::DOUBLE * len(list_intersect(own, b)) / (len(own) + len(b)) AS dice,
            row_number() OVER (
              PARTITION BY piece
              ORDER BY 2.0::DOUBLE * len(list_intersect(own, b)) / (len(own) + len(b)) DESC, nth) AS place
          FROM paired JOIN templates ON len(own) >= {low} * len(b) AND len(own) <= {high} * len(b)
        ), found AS (SELECT * FROM scored WHERE place = 1 AND dice >= {threshold})
        SELECT doc_id, count(piece) AS n_statements, max(dice) AS best_dice,
          coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
        FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
