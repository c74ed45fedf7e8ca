"""Licence scan with DataFrame functions only: Dice coefficient of word bigrams against licence templates.

A passage (a line, or a whole text) is normalised and compared with a template only if their sizes allow the
threshold: with a and b distinct bigrams Dice is at most 2 min(a, b) / (a + b). Then the windows of words are compared,
across lines: a best window begins with a bigram of the template and its length is bounded by the template's, so only
such places are tried from which enough of the template's bigrams follow in reach. No row is joined or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dice coefficient in hundredths from which a passage counts as a licence.
LEAST = 85

# Public licence notices and permission texts with their SPDX identifiers.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Full permission texts, compared with windows only. The first parts are among TEMPLATES.
_FIRST = {name: text for name, text in TEMPLATES if len(text) > 100}
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
FULL_TEXTS = [
    ("BSD-2-Clause", " ".join(_BSD[:3] + _BSD[4:])),
    ("BSD-3-Clause", " ".join(_BSD)),
    ("ISC", _FIRST["ISC"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", _FIRST["MIT"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def template_bigrams() -> list[tuple[str, list[str]]]:
    """Distinct word bigrams of each normalised template."""
    return [(name, list(dict.fromkeys(_bigrams(text)))) for name, text in TEMPLATES]


def size_bounds(n: int, least: int) -> tuple[int, int]:
    """Fewest and most bigrams of a passage that can reach the threshold against n."""
    return -(-least * n // (200 - least)), (200 - least) * n // least


def _match(passage: Column, number: Column, templates: list[tuple[str, list[str]]], least: int) -> Column:
    """The best template of a passage as (dice, name reversed for ties, ...) or null."""
    words = F.split(F.trim(F.regexp_replace(F.translate(passage, _UPPER, _LOWER), "[^a-z0-9]+", " ")), " ")

    def compare(bigrams: Column) -> Column:
        n = F.size(bigrams)
        options = []
        for name, own in templates:
            low, high = size_bounds(len(own), least)
            shared = F.size(F.array_intersect(bigrams, F.array(*[F.lit(x) for x in own])))
            dice = F.when(n.between(low, high), F.round(2 * shared / (n + len(own)), 6))
            options.append(F.struct(dice.alias("dice"), F.lit(name).alias("license")))
        good = F.filter(F.array(*options), lambda o: o["dice"] * 100 >= least)
        return F.array_max(good)

    def bigrams_of(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))
        # A passage with one word has none; repeated bigrams shorten the set, so only a lower bound on words is safe.
        return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))

    found = F.element_at(F.transform(F.array(words), lambda w: F.element_at(F.transform(F.array(bigrams_of(w)), compare), 1)), 1)
    return F.struct(number.alias("passage"), found.alias("best"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")


_WINDOW = "array<struct<dice:double,size:int,license:string,begin:int,end:int>>"


def _windows(bigrams: Column, least: int) -> Column:
    """The windows of `bigrams` that reach the threshold against a template and do not overlap a better one, best first.

    Windows have at most as many bigrams as a passage of the template's length can have; begin and end count bigrams from 1.
    """
    every = [(name, _bigrams(text)) for name, text in TEMPLATES + FULL_TEXTS]
    known = sorted({b for _, own in every for b in own})
    at = F.transform(bigrams, lambda b, i: F.struct((i + 1).alias("at"), b.alias("b")))

    def of_template(hits: Column, name: str, own: list[str]) -> Column:
        distinct = list(dict.fromkeys(own))
        n, reach = len(distinct), size_bounds(len(own), least)[1]
        need = size_bounds(n, least)[0]

        def best(begin: Column) -> Column:
            def add(acc, b):
                size, shared = acc["size"] + 1, acc["shared"] + b.isin(distinct).cast("int")
                dice = F.round(2 * shared / (size + F.lit(n)), 6)
                better = dice > acc["dice"]
                return F.struct(
                    size.alias("size"), shared.alias("shared"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"),
                    F.when(better, b).otherwise(acc["last"]).alias("last"))

            def found(piece):
                start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit("").alias("last"))
                return _let(F.aggregate(F.array_distinct(piece), start, add), lambda acc: F.struct(
                    acc["dice"].alias("dice"), F.lit(n).alias("size"), F.lit(name).alias("license"), begin.alias("begin"),
                    (begin + F.array_position(piece, acc["last"]).cast("int") - 1).alias("end")))
            return _let(F.slice(bigrams, begin, F.lit(reach)), found)

        def starts(places: Column) -> Column:
            # The place that is `need` hits ahead must be in reach.
            near = F.filter(places, lambda p, i: F.coalesce(F.get(places, i + F.lit(need - 1)) - p < reach, F.lit(False)))
            return F.filter(F.transform(near, best), lambda w: w["dice"] * 100 >= least)

        places = F.transform(F.filter(hits, lambda h: h["b"].isin(distinct)), lambda h: h["at"])
        return F.when(F.size(hits) >= need, _let(places, starts)).otherwise(F.array().cast(_WINDOW))

    def found(hits: Column) -> Column:
        each = F.flatten(F.array(*[of_template(hits, name, own) for name, own in every]))
        return _apart(F.reverse(F.array_sort(each)))

    return F.when(F.size(bigrams) > 0, _let(F.filter(at, lambda h: h["b"].isin(known)), found)).otherwise(F.array().cast(_WINDOW))


def _apart(windows: Column) -> Column:
    """Windows that overlap no earlier one that is kept."""
    def add(kept, w):
        return F.when(F.exists(kept, lambda o: (o["begin"] <= w["end"]) & (w["begin"] <= o["end"])), kept).otherwise(F.concat(kept, F.array(w)))
    return F.aggregate(windows, F.array().cast(_WINDOW), add)


def scan_licenses(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string): doc_id, n_passages, matches.

    matches lists (passage, license, dice) of the passages that reach the threshold, in order: lines from 1 on and 0
    for a whole text of several lines; of equally similar templates the last name counts. Then windows of words that
    reach it, under the line in which they begin, unless they share a line with a listed passage of the same license or
    of no less similarity; of overlapping windows the most similar counts. Null and empty texts have
    no match and no passage. Rows that repeat a doc_id are separate. An empty table gives an empty result. Other
    columns are not read.
    """
    templates = template_bigrams()
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    passages = F.when(F.size(lines) > 1, F.concat(F.array(F.coalesce("text", F.lit(""))), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    found = F.filter(F.transform(passages, lambda p, i: _match(p, i, templates, least)), lambda m: m["best"].isNotNull())
    matches = F.transform(found, lambda m: F.struct(m["passage"].cast("int").alias("passage"), m["best"]["license"].alias("license"), m["best"]["dice"].alias("dice")))
    filled = F.size(F.filter(lines, lambda p: p != ""))

    def with_windows(known: Column, windows: Column) -> Column:
        # The last word of each line, counted from 1; a window of bigrams a to b has the words a to b + 1.
        ends = F.aggregate(lines, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.size(_words(p)))))

        def added(ends: Column) -> Column:
            line = lambda word: (F.size(F.filter(ends, lambda e: e < word)) + 1).cast("int")
            placed = F.transform(windows, lambda w: F.struct(line(w["begin"]).alias("a"), line(w["end"] + 1).alias("b"), w["license"].alias("license"), w["dice"].alias("dice")))
            new = F.filter(placed, lambda w: ~F.exists(known, lambda m: ((m["passage"] == 0) | m["passage"].between(w["a"], w["b"])) & ((m["license"] == w["license"]) | (m["dice"] >= w["dice"]))))
            return F.array_sort(F.concat(known, F.transform(new, lambda w: F.struct(w["a"].alias("passage"), w["license"].alias("license"), w["dice"].alias("dice")))))
        return F.when(F.size(windows) == 0, known).otherwise(_let(ends, added))

    pairs = _let(_words(F.coalesce("text", F.lit(""))), lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>")))
    windows = _let(pairs, lambda b: _windows(b, least))
    matches = _let(F.struct(matches.alias("known"), windows.alias("windows")), lambda s: with_windows(s["known"], s["windows"]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled.cast("long").alias("n_passages"), matches.alias("matches"))
