"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams. Built-in functions only.

Normalising lower-cases A-Z and turns all other ASCII but digits into spaces. Templates are short notices and whole licence
texts. A template of L words is compared with windows of L words of the whole text, across lines and paragraphs, at every
L / 8 words (every word for templates under 16); a text shorter than that is one window. The best window of a template is its
match if its coefficient reaches ``least``. Of matches that share words of the text the better one stays: the higher
coefficient, then the longer template, then the first name, then the first template.

A window and a template with m and n distinct bigrams share at most min(m, n) of them, so a coefficient of t needs
t / (2 - t) <= m / n <= (2 - t) / t and at least t / (2 - t) of the template's bigrams. A text that holds fewer of them
altogether, wherever they stand, prunes the template before any window is made; and since any set of more than the rest of a
template's bigrams has one in every match, a text without any of the words that such sets are made of is passed over after
one split. Everything happens within the row, so there is no shuffle, and no group can be hot.

Defined cases: null and empty texts have no match (null licence, dice 0, empty list); a text of fewer than two words has no
bigrams and no match; long texts are scanned whole; repeated rows are each scanned; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Common licence notices and whole licence texts, by name.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("0BSD", _ISC_GRANT + "." + _ISC_END),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("MIT", _MIT_GRANT + ", subject to the following conditions: " + _MIT_NOTICE + _MIT_END),
    ("MIT", _MIT_GRANT + ", subject to the following conditions:"),
    ("MIT-0", _MIT_GRANT + ". " + _MIT_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

#: Words of templates that common prose is full of; they are chosen last.
_COMMON = frozenset("a above all an and any are as at be but by can copy event following for from if in is it may must no not of on or other out person provided shall so software that the this to under use will with without work you your".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MATCH = "array<struct<dice:double,n:int,licence:string,start:int,stop:int,k:int>>"


def words_of(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split()


def bigrams_of(text: str) -> list[str]:
    """The distinct bigrams of a template, sorted."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def step_of(length: int) -> int:
    """How many words lie between the windows for a template of so many."""
    return max(1, length // 8)


def telling_words(bigrams: list[str], low: float) -> set[str]:
    """Words, long ones first, one of which is in every text that holds ``low`` of the bigrams: they touch all the others and
    one more."""
    spare = len(bigrams) - math.ceil(len(bigrams) * low - 1e-6)
    chosen: set[str] = set()
    for word in sorted({w for b in bigrams for w in b.split(" ")}, key=lambda w: (w in _COMMON, -len(w), w)):
        if sum(bool(chosen & set(b.split(" "))) for b in bigrams) > spare:
            break
        chosen.add(word)
    return chosen


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, though the body uses it inside loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def matches(text: Column, templates: list[tuple[str, str]], least: float) -> Column:
    """An array of (dice, n, licence, start, stop, k): the matches of a text, in words from 0; n bigrams, template number k."""
    ready = [(name, b, len(words_of(t))) for name, t in sorted(templates) if (b := bigrams_of(t))]
    if not ready:
        return F.array().cast(_MATCH)
    low = least / (2 - least) - 1e-9  # rounding must not drop an exact hit
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n"), F.lit(size - 1).alias("width"), F.lit(step_of(size)).alias("step"), F.lit(k).alias("k")) for k, (name, b, size) in enumerate(ready)])
    telling = F.array(*map(F.lit, sorted({w for _, b, _ in ready for w in telling_words(b, low)})))
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), lambda w: w != "")

    def windows(t: Column, bigrams: Column) -> Column:
        """The best window of a template: its coefficient, and where it starts (negative, so that the first wins)."""
        last = F.greatest(F.size(bigrams) - t["width"], F.lit(0))
        starts = F.sequence(F.lit(0), F.ceil(last / t["step"]).cast("int"))

        def score(i: Column) -> Column:
            return _let(F.slice(bigrams, F.least(i * t["step"], last) + 1, t["width"]), lambda w: F.struct((2 * F.size(F.array_intersect(w, t["b"])) / (F.size(F.array_distinct(w)) + t["n"])).alias("dice"), (-F.least(i * t["step"], last)).alias("at")))

        return F.array_max(F.transform(starts, score))

    def found(bigrams: Column) -> Column:
        fits = _let(F.array_distinct(bigrams), lambda d: F.filter(table, lambda t: F.size(F.array_intersect(t["b"], d)) >= t["n"] * low))
        best = F.transform(fits, lambda t: _let(windows(t, bigrams), lambda w: F.struct(w["dice"].alias("dice"), t["n"].alias("n"), t["licence"].alias("licence"), (-w["at"]).alias("start"), (F.least(t["width"], F.size(bigrams)) + 1 - w["at"]).alias("stop"), t["k"].alias("k"))))
        good = F.filter(best, lambda m: m["dice"] >= least)
        better = lambda x, y: (x["dice"] > y["dice"]) | ((x["dice"] == y["dice"]) & ((x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["k"] < y["k"]))))
        return _let(good, lambda g: F.filter(g, lambda m: ~F.exists(g, lambda o: better(o, m) & (o["start"] < m["stop"]) & (m["start"] < o["stop"]))))

    some = F.arrays_overlap(F.split(F.lower(text), _BETWEEN), telling)  # more than A-Z is lowered here, which no telling word holds
    return F.when(F.coalesce(some, F.lit(False)), _let(_joined(words), found)).otherwise(F.array().cast(_MATCH))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, licence and dice of the best match, n_matches and licences (all found, sorted, comma-joined) of every row."""
    found = docs.select(docs[doc_id].alias("doc_id"), matches(docs[text].cast("string"), TEMPLATES if templates is None else templates, least).alias("m"))
    top = lambda a, x: F.when(a["dice"].isNull() | (x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & ((x["n"] > a["n"]) | ((x["n"] == a["n"]) & (x["k"] < a["k"])))), x).otherwise(a)
    best = F.aggregate("m", F.lit(None).cast(_MATCH[6:-1]), top)
    told = found.select("doc_id", best.alias("best"), "m")
    return told.select(
        "doc_id", F.col("best.licence").alias("licence"), F.coalesce(F.round("best.dice", 6), F.lit(0.0)).alias("dice"), F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["licence"]))), ",").alias("licences"),
    )
