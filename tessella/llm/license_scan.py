"""Operator 4: licence scan by Dice coefficient over word bigrams. DataFrame functions only, no shuffle.

Text is normalised (lower case, everything but letters and digits becomes one space). The lines of a document,
its paragraphs and the whole document are compared with each template: Dice = 2 |A n B| / (|A| + |B|) over sets of
word bigrams. Notices inside a longer line or wrapped among other text are found by windows: where the text holds one of a
template's ``anchor_bigrams``, the words around it, as many as the template has and laid so that the bigram falls on its place,
are compared with that template. Only templates whose size can reach the threshold are tried: |A| must lie within
t/(2-t) |B| and (2-t)/t |B|. A second bound skips most units: a match shares at least t/(2-t) |B| bigrams with
its template, so a few words of each template (``marker_words``) must occur in it, and one of any |B| - need + 1 of its bigrams.

Defined results: null and empty texts have no licence (licence null, dice 0, no matches); ties between templates go
to the one with more bigrams, then to the first in name order; repeated rows are scanned each; very long texts are scanned whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .host_rules import let

THRESHOLD = 0.85

# Notices that licences ask for and the texts of the short licences, as their publishers word them.
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause-full": _BSD_TERMS + _BSD_WARRANTY,
    "BSD-3-Clause-full": _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def normalised_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())

#: A window's place is its template times this plus its first word.
START = 1 << 32


def bigrams(text: str) -> set[str]:
    words = normalised_words(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def by_size(templates: dict[str, str]) -> list[str]:
    """Names, those with most bigrams first: a text that holds a notice also holds the shorter ones within it."""
    return sorted(templates, key=lambda name: (-len(bigrams(templates[name])), name))


def marker_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every match of some template holds one: without them too few of its bigrams are left."""
    chosen: list[str] = []
    left = {name: bigrams(text) for name, text in templates.items()}
    spare = {name: math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9) - 1 for name, grams in left.items()}  # bigrams that may stay unmarked
    while open_ := [name for name in left if len(left[name]) > spare[name]]:
        gains: dict[str, int] = {}
        for name in open_:
            seen = Counter(w for g in left[name] for w in set(g.split()))
            for w, n in seen.items():
                gains[w] = gains.get(w, 0) + min(n, len(left[name]) - spare[name])
        chosen.append(max(gains, key=lambda w: (len(w) >= 6, gains[w], len(w), w)))  # long words are rare ones
        left = {name: {g for g in grams if chosen[-1] not in g.split()} for name, grams in left.items()}
    return chosen


def anchor_bigrams(text: str, threshold: float) -> list[tuple[str, int]]:
    """(bigram, its place in words), every place, of the longest bigrams of a template: so many that no match shares none of them."""
    words, grams = normalised_words(text), bigrams(text)
    need = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
    chosen = set(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - need + 1])
    return [(g, i) for i, g in enumerate(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)) if g in chosen]


def _constant(value, schema: str) -> Column:
    """A nested value as one literal: Catalyst folds the parse, where a literal for each entry takes seconds to plan."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    return let(words, lambda ws: F.when(F.size(ws) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.slice(ws, i, 2))))).otherwise(F.array().cast("array<string>")))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (best template at or above the threshold, or null), dice (of that, else 0), n_matches (units), n_licenses (different templates, by units or windows)."""
    names = by_size(templates)
    known = [(name, sorted(bigrams(templates[name]))) for name in names]
    marks = marker_words(templates, threshold)
    bound = threshold / (2 - threshold)
    table = _constant([{"rank": len(known) - i, "at": i, "n": len(grams), "words": len(normalised_words(templates[name])), "grams": grams} for i, (name, grams) in enumerate(known)], "array<struct<rank:int,at:int,n:int,words:int,grams:array<string>>>")

    def best(grams: Column) -> Column:
        n = F.size(grams)
        fits = F.filter(table, lambda t: (n >= bound * t["n"]) & (n * bound <= t["n"]))
        scored = F.transform(fits, lambda t: F.struct((2 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("dice"), t["rank"].alias("rank"), t["at"].alias("at")))
        return F.array_max(scored)

    contained = lambda u: _any([F.contains(u, F.lit(m)) for m in marks]) if marks else F.lit(False)
    marked = lambda u: let(F.lower(u), contained)  # noqa: E731  lower-cased once, not once for each word
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text)))
    cleaned = F.filter(F.array_distinct(F.transform(F.filter(units, marked), _normal)), contained)
    hits = F.filter(F.transform(cleaned, lambda u: let(_bigrams(F.split(u, " ")), best)), lambda b: b.isNotNull() & (b["dice"] >= threshold))

    places: dict[str, list[tuple[int, int]]] = {}
    for at, name in enumerate(names):
        for gram, place in anchor_bigrams(templates[name], threshold):
            places.setdefault(gram, []).append((at, place))
    none = F.array().cast("array<struct<at:int,place:int>>")
    targets = _constant({gram: [{"at": a, "place": p} for a, p in them] for gram, them in places.items()}, "map<string,array<struct<at:int,place:int>>>")
    firsts = sorted({gram.split(" ")[0] for gram in places})

    def near(words: Column) -> Column:
        """Templates that a window of their own length, laid over a shared bigram, reaches: structs as of ``best``."""
        gram = lambda i: F.concat_ws(" ", F.slice(words, i + 1, 2))
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())
        # a place is one long, so that distinct ones are found by hashing; then every distinct window content is tried once
        laid = F.flatten(F.transform(at, lambda i: F.transform(F.coalesce(F.try_element_at(targets, gram(i)), none), lambda t: t["at"].cast("long") * START + F.greatest(i - t["place"], F.lit(0)))))
        content = lambda p: F.concat_ws(" ", F.floor(p / START).cast("string"), F.slice(words, F.pmod(p, F.lit(START)).cast("int") + 1, F.get(table, F.floor(p / START).cast("int"))["words"]))

        def dice(window: Column) -> Column:
            def told(ws: Column) -> Column:
                t = F.get(table, ws[0].cast("int"))
                return let(_bigrams(F.slice(ws, F.lit(2), F.size(ws) - 1)), lambda g: F.struct((2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"), t["rank"].alias("rank"), t["at"].alias("at")))

            return let(F.split(window, " "), told)

        return F.filter(F.transform(F.array_distinct(F.transform(F.array_distinct(laid), content)), dice), lambda b: b["dice"] >= threshold)

    both = F.struct(hits.alias("units"), let(F.split(_normal(text), " "), near).alias("windows"))
    scanned = docs.select(F.col("doc_id").alias("doc_id"), F.when(marked(text), both).alias("found"))
    scanned = scanned.select("doc_id", F.col("found.units").alias("hits"), F.concat("found.units", "found.windows").alias("all"))
    top = F.array_max(F.col("all"))
    return scanned.select(
        "doc_id", F.get(F.lit([n for n, _ in known]), top["at"]).alias("license"),
        F.round(F.coalesce(top["dice"], F.lit(0.0)), 6).alias("dice"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.size(F.array_distinct(F.transform("all", lambda h: h["at"]))), F.lit(0)).cast("long").alias("n_licenses"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
