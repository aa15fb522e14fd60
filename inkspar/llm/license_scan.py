"""License scans by winnowed fingerprints and banded alignment.

Templates are cut into grams of two or three words; of every few grams in a row the one with the smallest hash is a fingerprint.  An
inverted index from fingerprint to (template, place) picks candidates and the diagonals they lie on, and an alignment in a band
around each diagonal says which words match, hence the matched share of the template and the spans in the text.  The index
depends on the templates alone and travels with the function.

Length of grams and window follow from the wanted coverage c and the number of words n of a template, so that no match is overlooked that
differs in at most e = n - ceil(c n) words (left out, replaced or put in): e changes leave a run of ceil((n - e) / (e + 1))
words as they are, and every run of that length holds a fingerprint (`reach_of`).  An occurrence with more words put in than that
is found if a fingerprint is left, and is then as good as any other.  Texts are looked up with all their grams.  Where the guaranteed run
is of two words, which are common in any text, a place also needs as many different words of the template around it as a match has.

Defined results: words are compared in lower case without punctuation around them; null and empty texts match
nothing; where matches overlap, the one with the larger coverage stays, then the longer, then the earlier name; repeated
matches in one text are all reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .prob_minhash import by_bytes, mix

#: Words of a gram, at most.
GRAM = 3
BAND = 12
REACH = 3
COVERAGE = 0.8
SCHEMA = "doc_id long, license string, coverage double, start long, end long, matched_words long, spans string"

#: Notices and texts as their publishers word them (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_EDGE = re.compile(r"^\W+|\W+$")
_WORD = re.compile(r"\S+")


def bare(word: str) -> str:
    return _EDGE.sub("", word.lower())


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words without the punctuation around them, and where each run of characters begins and ends."""
    words, start, end = [], [], []
    for m in _WORD.finditer(text):
        w = bare(m[0])
        if w:
            words.append(w)
            start.append(m.start())
            end.append(m.end())
    return words, start, end


def hash_words(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out + h[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the smallest hash of each window, the last one of equals."""
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.empty(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(g, window)
    at = np.arange(len(w)) + window - 1 - np.argmin(w[:, ::-1], 1)
    return np.unique(at)


def reach_of(n: int, coverage: float) -> tuple[int, int]:
    """Gram and window for a template of n words: together one word longer than the run that is left by as many changes as may be."""
    need = ceil(coverage * n - 1e-9)
    run = max(1, ceil(need / (n - need + 1)))
    gram = min(GRAM, run)
    return gram, run - gram + 1


class Index:
    """Fingerprints of the templates, for each length of grams."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words = [words_of(templates[n])[0] for n in self.names]
        self.need = [ceil(coverage * len(w) - 1e-9) for w in self.words]
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            if words:
                gram, window = reach_of(len(words), coverage)
                g = grams(hash_words(words), gram)
                for p in winnow(g, window):
                    found[gram][int(g[p])].append((t, int(p)))
        self.postings = {gram: dict(p) for gram, p in found.items()}
        self.prints = {gram: np.array(sorted(p), np.uint64) for gram, p in found.items()}
        # templates with short grams: the bits of each of their words
        self.short = {t: {w: 1 << k for k, w in enumerate(sorted(set(self.words[t])))} for t in {t for gram, p in found.items() if gram < GRAM for ts in p.values() for t, _ in ts} if len(set(self.words[t])) < 63}

    def hits(self, g: np.ndarray, gram: int) -> np.ndarray:
        """Which grams are fingerprints of a template."""
        prints = self.prints[gram]
        return prints[np.minimum(np.searchsorted(prints, g), len(prints) - 1)] == g

    def places(self, words: list[str], h: np.ndarray, around: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, list[tuple[int, int]]]:
        """Template -> (diagonal, place) of its fingerprints; around says for which places enough of its words are near."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gram in self.prints:
            g = grams(h, gram)
            for p in np.flatnonzero(self.hits(g, gram)).tolist():
                for t, q in self.postings[gram][int(g[p])]:
                    out[t].append((p - q, p))
        for t in [t for t in out if t in self.short]:
            near = around(t, np.array([p for _, p in out[t]]))
            out[t] = [d for d, ok in zip(out[t], near.tolist(), strict=True) if ok]
        return out


def enough_near(bits: np.ndarray, places: np.ndarray, n: int, need: int) -> np.ndarray:
    """Of places: are there that many different words of the template, of n words, as far around as an alignment looks?"""
    reach = REACH * n
    padded = np.concatenate([np.zeros(reach, np.int64), bits, np.zeros(2 * reach, np.int64)])
    seen = np.zeros(len(places), np.int64)
    for k in range(3 * reach):
        seen |= padded[places + k]
    return np.array([v.bit_count() for v in seen.tolist()], np.int64) >= need


def align(template: list[str], words: list[str], low: int, high: int) -> list[tuple[int, int]]:
    """Matched (template place, word place) of the best alignment of the whole template with diagonals low..high.

    Match 2, mismatch -1, gap -1; words before and after cost nothing.
    """
    width = high - low + 1
    rows = []
    score = [0] * width
    for i, t in enumerate(template):
        new, back = [-(10**6)] * width, [0] * width
        for k in range(width):
            j = i + low + k
            if 0 <= j < len(words):
                best, how = score[k] + (2 if words[j] == t else -1), 1
            else:
                best, how = -(10**6), 0
            # template word left out: from the row above, one diagonal to the right
            if k + 1 < width and score[k + 1] - 1 > best:
                best, how = score[k + 1] - 1, 2
            if k and new[k - 1] - 1 > best and 0 <= j < len(words):
                best, how = new[k - 1] - 1, 3
            new[k], back[k] = best, how
        rows.append(back)
        score = new
    k = max(range(width), key=lambda q: score[q])
    i, out = len(template) - 1, []
    while i >= 0:
        how = rows[i][k]
        if how == 1:
            if words[i + low + k] == template[i]:
                out.append((i, i + low + k))
            i -= 1
        elif how == 2:
            i, k = i - 1, k + 1
        elif how == 3:
            k -= 1
        else:
            break
    return out[::-1]


def repeats(template: list[str], words: list[str], hits: list[tuple[int, int]], coverage: float) -> Iterator[list[tuple[int, int]]]:
    """Alignments of enough coverage around hits (place, diagonal), sorted, none of which shares a word with another.

    After an alignment the words on both sides of it are looked at in the same way.  An inserted word costs half a match, so an
    occurrence spans at most REACH times the template's words: windows of twice that around the first hit see it whole.
    """
    reach = REACH * len(template)
    ranges = [(0, len(words), 0)]
    while ranges:
        low, high, after = ranges.pop()
        inside = hits[bisect_left(hits, (max(low, after), -len(words))) : bisect_left(hits, (high, -len(words) - len(template)))]
        if not inside:
            continue
        first = inside[0][0]
        a, b = max(low, first - reach), min(high, first + 2 * reach)
        ds = [d for p, d in inside if p < b]
        if not ds:
            continue
        matched = [(i, j + a) for i, j in align(template, words[a:b], min(ds) - BAND - a, max(ds) + BAND - a)]
        if len(matched) / len(template) >= coverage:
            yield matched
            ranges += [(low, matched[0][1], after), (matched[-1][1] + 1, high, after)]
        else:
            # all that holds a hit up to first + reach lay in the window
            ranges.append((low, high, first + reach + 1))


def scan(text: str, index: Index, coverage: float = COVERAGE) -> list[tuple]:
    """(license, coverage, start, end, matched words, spans) of one text."""
    words, start, end = words_of(text)

    def around(t: int, places: np.ndarray) -> np.ndarray:
        bits = index.short[t]
        return enough_near(np.fromiter((bits.get(w, 0) for w in words), np.int64, len(words)), places, len(index.words[t]), min(index.need[t], len(bits)))

    diagonals = {t: ds for t, ds in index.places(words, hash_words(words), around).items() if ds}
    found = []
    for t, ds in diagonals.items():
        template = index.words[t]
        ds = sorted(set(ds))
        groups = [[ds[0]]]
        for d in ds[1:]:
            if d[0] - groups[-1][-1][0] > BAND:
                groups.append([])
            groups[-1].append(d)
        for group in groups:
            for matched in repeats(template, words, sorted((p, d) for d, p in group), coverage):
                share = len(matched) / len(template)
                places = [j for _, j in matched]
                runs = [[places[0], places[0]]]
                for j in places[1:]:
                    if j == runs[-1][1] + 1:
                        runs[-1][1] = j
                    else:
                        runs.append([j, j])
                spans = ",".join(f"{start[a]}-{end[b]}" for a, b in runs)
                found.append((index.names[t], round(share, 6), start[places[0]], end[places[-1]], len(matched), spans))
    found.sort(key=lambda f: (-f[1], -f[4], f[0], f[2]))
    taken: list[tuple] = []
    for f in found:
        if all(f[3] <= o[2] or f[2] >= o[3] for o in taken):
            taken.append(f)
    return sorted(taken, key=lambda f: f[2])


def candidates(texts: pa.Array, index: Index) -> np.ndarray:
    """Numbers of the texts that may match: one pass over all words of the batch."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if not distinct:
        return np.empty(0, np.int64)
    cleaned = [bare(w) for w in distinct]
    h = hash_words(cleaned)
    filled = np.array([bool(w) for w in cleaned])
    index_of = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    keep = filled[index_of]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    index_of = index_of[keep]
    h = h[index_of]
    out = []
    for gram in index.prints:
        g = grams(h, gram)
        if not len(g):
            continue
        places = np.flatnonzero(index.hits(g, gram) & (doc[: len(g)] == doc[gram - 1 :]))
        if gram < GRAM and len(places):
            at, ok = np.searchsorted(index.prints[gram], g[places]), np.zeros(len(places), bool)
            of = [[t for t, _ in index.postings[gram][int(p)]] for p in index.prints[gram]]
            for t in {t for ts in of for t in ts}:
                mine = np.array([t in ts for ts in of])[at]
                if t in index.short:
                    # words of the texts before and after count too, which can only let more texts through
                    bits = np.array([index.short[t].get(w, 0) for w in cleaned], np.int64)[index_of]
                    mine[mine] = enough_near(bits, places[mine], len(index.words[t]), min(index.need[t], len(index.short[t])))
                ok |= mine
            places = places[ok]
        out.append(doc[places])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", id_col: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, coverage, start, end, matched_words, spans (characters, end exclusive)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen, coverage)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            ids = batch.column("doc_id").to_pylist()
            out = []
            for a, b in by_bytes(texts):
                for k in candidates(texts.slice(a, b - a), index).tolist():
                    out += [(ids[a + k], *f) for f in scan(texts[a + k].as_py(), index, coverage)]
            names = [c.strip().split()[0] for c in SCHEMA.split(",")]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return map_texts(rows, run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
