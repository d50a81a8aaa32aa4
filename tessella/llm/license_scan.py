"""License scans: Dice coefficient over word bigrams against templates (native)."""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, narrow

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
# Texts and notices by which works name their licence, with their identifiers.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_GNU_COPY = "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
_LGPL_3 = "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_LGPL_2 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
_AGPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_MPL_2 = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_ZLIB_DISCLAIMER = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_ZLIB_GRANT = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
TEMPLATES = (
    ("AGPL-3.0", _AGPL_3),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO}"),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_THREE),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE} {_BSD_DISCLAIMER}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", _GPL_2),
    ("GPL-2.0", f"{_GPL_2} {_GNU_WARRANTY}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_3),
    ("GPL-3.0", f"{_GPL_3} {_GNU_WARRANTY} {_GNU_COPY}"),
    ("ISC", _ISC_GRANT),
    ("ISC", f"{_ISC_GRANT} {_ISC_DISCLAIMER}"),
    ("LGPL-2.1", _LGPL_2),
    ("LGPL-3.0", _LGPL_3),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE}"),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_DISCLAIMER}"),
    ("MPL-2.0", _MPL_2),
    ("MPL-2.0", f"{_MPL_2} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", f"{_ZLIB_DISCLAIMER} {_ZLIB_GRANT}"),
)


#: What parts paragraphs: a line without letter or digit.
BLANK = r"\n[^\p{L}\p{N}\n]*\n"


def normal(text: str) -> list[str]:
    """The words of a template: lower-case runs of ASCII letters and digits."""
    return re.findall("[a-z0-9]+", text.lower())


def grams(tokens: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams with which a Dice coefficient of the threshold is possible at all."""
    t = Fraction(str(threshold))  # exact: a bound may be a whole number
    return math.ceil(size * t / (2 - t)), math.floor(size * (2 - t) / t)


def needed(known: list[tuple], threshold: float, texts: list[list[str]]) -> list[str]:
    """Words of which every unit that matches any template holds at least one.

    A match with a template of n bigrams shares at least threshold * (n + lower bound) / 2 of them; the words chosen touch
    so many bigrams that without them too few are left.  Long words first: they are rare in other texts."""
    chosen: list[str] = []
    most = [n - math.ceil(Fraction(str(threshold)) * (n + lo) / 2) for _, _, n, lo, _ in known]
    bare = [{g for g in k[1]} for k in known]  # bigrams that no chosen word touches yet
    for least in (7, 5, 1):
        while open_ := [i for i in range(len(known)) if known[i][2] - len(bare[i]) <= most[i]]:
            words = sorted({w for i in open_ for w in texts[i] if len(w) >= least} - set(chosen))
            lacking = {i: most[i] + 1 - (known[i][2] - len(bare[i])) for i in open_}
            gain = {w: sum(min(lacking[i], sum(w in g.split() for g in bare[i])) for i in open_) for w in words}
            if not any(gain.values()):
                break
            chosen.append(max(words, key=lambda w: (gain[w], len(w))))
            bare = [{g for g in b if chosen[-1] not in g.split()} for b in bare]
    # a word that holds another needn't be looked for
    return [w for w in chosen if not any(x != w and x in w for x in chosen)]


@lru_cache
def prepared(templates: tuple, threshold: float) -> tuple[list[tuple], list[str]]:
    """name, bigrams, their number and bounds of each template, and the words needed."""
    known = [(name, g, len(g), *bounds(len(g), threshold)) for name, text in templates if (g := grams(normal(text)))]
    return known, needed(known, threshold, [normal(text) for _, text in templates if len(normal(text)) > 1])


def tokens(unit: Column) -> Column:
    """A unit's words after the same normalisation as the templates'."""
    return F.array_remove(F.split(F.lower(unit), "[^a-z0-9]+"), "")


def bigrams(words: Column) -> Column:
    """The distinct pairs of adjacent words, of at least two words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, license_id, dice, n_units: a row for each document and licence that one of its units matches.

    Units are the lines, the paragraphs between lines without letter or digit (so the marks of a comment don't join them) and the
    whole text, each distinct one once.  Dice is
    twice the number of shared distinct bigrams over the sum of both numbers of distinct bigrams.  A template is compared
    only with units within its size bounds, and units without any of the words that a match needs are never split.  n_units
    counts the units that match, dice is the best.  Null, empty and unmatched texts give no row, an empty table none; a document
    that comes twice gives its rows twice; other columns aren't read.  All of it happens within the row: no shuffle, and only fixed templates in the plan."""
    known, keys = prepared(tuple(templates), threshold)
    low, high = min(k[3] for k in known), max(k[4] for k in known)
    holds = lambda text: let(F.lower(text), lambda t: reduce(or_, [t.contains(k) for k in keys]))
    blank = BLANK
    text = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.when(text.rlike(blank), F.split(text, blank)).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(F.split(text, "\n"), paragraphs, F.array(text)))
    units = F.filter(units, lambda u: (F.length(u) > 2 * low) & holds(u))  # `low` pairs need more characters
    table = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(n).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*[F.lit(x) for x in g]).alias("g")) for name, g, n, lo, hi in known])
    none = F.array().cast("array<struct<license_id:string,dice:double>>")

    def matches(grams: Column) -> Column:
        size = F.size(grams)
        near = F.filter(table, lambda t: (size >= t["lo"]) & (size <= t["hi"]))
        scored = F.transform(near, lambda t: F.struct(t["license_id"].alias("license_id"), (2.0 * F.size(F.array_intersect(t["g"], grams)) / (t["n"] + size)).alias("dice")))
        return F.when((size >= low) & (size <= high), F.filter(scored, lambda s: s["dice"] >= threshold)).otherwise(none)

    pairs = lambda words: F.when(F.size(words) > low, let(bigrams(words), matches)).otherwise(none)
    hits = F.filter(F.transform(units, lambda u: let(tokens(u), pairs)), lambda m: F.size(m) > 0)
    found = narrow(docs, "doc_id", "text").filter(holds(F.coalesce("text", F.lit("")))).select("doc_id", hits.alias("_hits"))
    # no filter here: it would be pushed down and compute all of this once more; explode drops the empty ones
    found = found.select("doc_id", "_hits", F.explode(F.array_distinct(F.flatten(F.transform("_hits", lambda m: F.transform(m, lambda s: s["license_id"]))))).alias("license_id"))
    own = F.filter(F.transform("_hits", lambda m: F.array_max(F.transform(F.filter(m, lambda s: s["license_id"] == F.col("license_id")), lambda s: s["dice"]))), lambda d: d.isNotNull())
    return found.select("doc_id", "license_id", own.alias("_d")).select("doc_id", "license_id", F.array_max("_d").alias("dice"), F.size("_d").cast("long").alias("n_units"))
