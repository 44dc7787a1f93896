"""Licence scan: normalised passages against licence templates by the Dice coefficient of word bigrams.

A passage is a run of words of a whole text, wherever lines end: a notice inside a sentence
and a licence wrapped at every word are found alike. Bigrams count as often as they occur.
Sizes prune first: at a Dice of t, a passage has between t / (2 - t) and (2 - t) / t times
the bigrams of the template, and shares as many as the former bound; places with fewer of
the template's bigrams ahead are never compared. Templates are a fixed list, so what workers
hold does not grow.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LEAST_DICE = 0.8
WORD_RE, WORD_BYTES = re.compile(r"[A-Za-z0-9]+"), re.compile(rb"[a-z0-9]+")

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software."
)
AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} "
    "for more details."
)
# Public licence texts and the notices that point to them.
TEMPLATES = {
    "MIT": MIT_GRANT + " " + AS_IS,
    "MIT-grant": MIT_GRANT,
    "MIT-notice": "Released under the MIT License.",
    "BSD-2-Clause": BSD_TERMS + " " + BSD_AS_IS,
    "BSD-2-Clause-terms": BSD_TERMS,
    "BSD-3-Clause": BSD_TERMS + " " + BSD_NAMES + " " + BSD_AS_IS,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": GPL_NOTICE.format("General Public License"),
    "LGPL-3.0": GPL_NOTICE.format("Lesser General Public License"),
    "AGPL-3.0": GPL_NOTICE.format("Affero General Public License"),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
}


def words_of(text: str) -> list[bytes]:
    """Words of ASCII letters and digits, lower-cased; any other character only parts them."""
    return WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower())


class Template:
    """Bigrams of a licence with their counts, as codes of pairs of word numbers."""

    def __init__(self, codes: list[int]):
        self.counts = Counter(codes)
        self.size = len(codes)

    def windows(self, at: np.ndarray, codes: np.ndarray, least: float) -> list[tuple[float, int, int, int]]:
        """(dice, shared, first, last bigram) of the best windows, none overlapping, by the places `at` of its bigrams.

        A window that reaches the coefficient has between t / (2 - t) and (2 - t) / t times
        the template's bigrams and shares at least the former number. It begins and ends with
        a shared bigram, else a shorter one would do better. Starts with too few of the
        template's bigrams ahead are left out; from the others all ends are scored at once:
        a bigram counts while the window has fewer of it than the template.
        """
        ratio = (2 - least) / least
        need, most = self.size / ratio, int(self.size * ratio)
        if len(at) < need:
            return []
        ahead = np.searchsorted(at, at + most) - np.arange(len(at))
        starts = np.flatnonzero(ahead >= need)
        if not len(starts):
            return []
        # Where the window must begin after for a bigram to count still: that many of it lie before.
        seen: dict[int, list[int]] = {}
        before = np.full(len(at), -1)
        for k, code in enumerate(codes.tolist()):
            held, n = seen.setdefault(code, []), self.counts[code]
            if len(held) >= n:
                before[k] = held[-n]
            held.append(k)
        found = []
        for i in starts.tolist():
            j = i + int(ahead[i])
            shared = np.cumsum(before[i:j] < i)
            if shared[-1] < need:
                continue
            dice = 2 * shared / (at[i:j] - at[i] + 1 + self.size)
            k = int(dice.argmax())
            if dice[k] >= least:
                found.append((float(dice[k]), int(shared[k]), int(at[i]), int(at[i + k])))
        return apart(found, lambda x: (-x[0], x[2], -x[3]))


def apart(found: list[tuple], order) -> list[tuple]:
    """In this order those that overlap none before, over their third and fourth entries (first and last bigram)."""
    starts: list[int] = []
    kept: list[tuple] = []
    for x in sorted(found, key=order):
        k = bisect(starts, x[2])
        # Neighbouring bigrams share a word.
        if (not k or kept[k - 1][3] + 1 < x[2]) and (k == len(kept) or x[3] + 1 < kept[k][2]):
            starts.insert(k, x[2])
            kept.insert(k, x)
    return kept


class Scanner:
    """Licence templates with the numbers of their words."""

    def __init__(self, texts: dict[str, str], least: float = LEAST_DICE):
        self.least = least
        self.words: dict[bytes, int] = {}
        coded = {k: [self.words.setdefault(w, len(self.words) + 1) for w in words_of(v)] for k, v in texts.items()}
        self.base = len(self.words) + 1
        self.templates = {k: Template([x * self.base + y for x, y in zip(c, c[1:])]) for k, c in coded.items() if len(c) > 1}
        self.known = np.array(sorted(set().union(*(t.counts for t in self.templates.values()))), dtype=np.int64)
        order = {c: i for i, c in enumerate(self.known.tolist())}
        for t in self.templates.values():
            t.counts = Counter({order[c]: n for c, n in t.counts.items()})
        self.member = {k: np.array([i in t.counts for i in range(len(self.known))]) for k, t in self.templates.items()}

    def places(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bigrams that some template has, and their numbers among all such."""
        number = self.words.get
        ids = np.fromiter((number(w, 0) for w in words), dtype=np.int64, count=len(words))
        # A pair with an unknown word is no template's.
        pairs = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        codes = ids[pairs] * self.base + ids[pairs + 1] if len(pairs) else pairs
        found = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        sure = self.known[found] == codes if len(pairs) else np.zeros(0, dtype=bool)
        return pairs[sure], found[sure]

    def passages(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, start, end, dice) of the best passages, none overlapping, in order. A null text has none."""
        at, codes = self.places(words_of(text or ""))
        found = [(*x, name) for name, t in self.templates.items() for x in t.windows(at[self.member[name][codes]], codes[self.member[name][codes]], self.least)] if len(at) else []
        best = apart(found, lambda x: (-x[1], -x[0], x[2], x[4]))
        if not best:
            return []
        places = [m.span() for m in WORD_RE.finditer(text)]
        return [(name, places[i][0], places[j + 1][1], round(dice, 6)) for dice, _, i, j, name in best]


FOUND = T.ArrayType(T.StructType().add("licence", "string").add("start", "integer").add("end", "integer").add("dice", "double"))


def scan(spark: SparkSession, docs: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """docs with a column licences: passages in code points, end exclusive.

    Null and empty texts have none. Of passages that overlap, the one that shares most bigrams
    stays, then the one of higher coefficient, the earlier and the first by name; rows are kept one by one; a column licences that docs has is replaced.
    """
    scanner = Scanner(texts or TEMPLATES, least)

    def licences(batch: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("licence", "start", "end", "dice"), p)) for p in scanner.passages(t)] for t in batch])

    licences.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return docs.withColumn("licences", F.pandas_udf(licences, FOUND)("text"))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document, with where they stand. Edges as in `scan`."""
    found = scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.transform("licences", lambda p: F.concat_ws(":", p["licence"], p["start"].cast("string"), p["end"].cast("string")))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join(shown, ",").alias("licences"), F.array_max(F.transform("licences", lambda p: p["dice"])).alias("best_dice")
    )
