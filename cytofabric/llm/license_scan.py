"""Licence scan: matching statistics against a suffix automaton of licence texts, chained into covered spans."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, slices, table

#: Phrases and the labels they give wherever their words stand in a row.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Passages of well-known licences, and notices that name one; a text that covers enough of one gets its label, without -notice or -whole.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
}
#: Whole texts of short licences (fixed values); a fragment of one is caught by the passages above.
_WARRANTY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
TEMPLATES |= {
    "mit-whole": TEMPLATES["mit"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + _WARRANTY,
    "isc-whole": TEMPLATES["isc"] + ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-whole": TEMPLATES["bsd"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "unlicense-whole": TEMPLATES["unlicense"] + ". Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + _WARRANTY.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS"),
    "zlib-whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Words that a match needs to be chained, words that may be missing between two of a chain, share of a template covered.
MIN_WORDS, MAX_GAP, MIN_COVER = 4, 12, 0.6


class LicenceAutomaton:
    """Suffix automaton over the words of several texts: from any state, the words that continue it in some text."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.labels = [*phrases.values(), *templates]
        texts = [alnum_words(t) for t in (*phrases, *templates.values())]
        self.n_phrases, self.sizes = len(phrases), [len(t) for t in texts]
        self.word = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (text, position behind its last word), own ones of a state
        for t, words in enumerate(texts):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.word[w])
                self.ends[last].append((t, at + 1))
        # a state's places are those of all states that link to it
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]
        whole: list[list[int]] = [[] for _ in self.len]
        for t in range(self.n_phrases):
            v = 0
            for w in texts[t]:
                v = self.next[v][self.word[w]]
            whole[v].append(t)
        self.phrases: list[list[int]] = []  # phrases that are suffixes of what a state stands for
        for v in range(len(self.len)):
            found, u = [], v
            while u > 0:
                found += whole[u]
                u = self.link[u]
            self.phrases.append(found)

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A state for the longest suffix that p and w make, cut off from q."""
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier text has it
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w)
        now, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[now] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w)
        return now

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position behind, state, length) of the longest match that ends at each word, where there is one."""
        ids = list(map(self.word.get, words))
        v = n = 0
        before = -2
        for at in [i for i, w in enumerate(ids) if w is not None]:
            w = ids[at]
            if at != before + 1:
                v = n = 0
            before = at
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if w in self.next[v]:
                v, n = self.next[v][w], n + 1
                yield at + 1, v, n

    def scan(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """Spans (label, is it a phrase, first word, words, covered share): every phrase, and each template's best chain."""
        spans, pieces = [], {}
        ended = [*self.matches(words)]
        for i, (end, v, n) in enumerate(ended):
            for t in self.phrases[v]:
                if n >= self.sizes[t]:
                    spans.append((self.labels[t], True, end - self.sizes[t], self.sizes[t], 1.0))
            grows = i + 1 < len(ended) and ended[i + 1][0] == end + 1 and ended[i + 1][2] == n + 1
            if n >= MIN_WORDS and not grows:  # maximal to the right
                for t, at in self.ends[v]:
                    if t >= self.n_phrases and at >= n:
                        pieces.setdefault(t, []).append((end - n, at - n, n))
        for t, found in pieces.items():
            best = self._chain(sorted(set(found)))
            covered, first, last = best
            if covered >= MIN_COVER * self.sizes[t]:
                spans.append((self.labels[t].removesuffix("-notice").removesuffix("-whole"), False, first, last - first, min(1.0, covered / self.sizes[t])))
        return sorted(spans, key=lambda s: (s[2], s[0], not s[1]))

    @staticmethod
    def _chain(pieces: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """(covered words, first, behind the last) of the best chain that goes forward in text and template."""
        best: list[tuple[int, int, int]] = []
        low = 0
        for i, (d, t, n) in enumerate(pieces):
            while pieces[low][0] + pieces[low][2] + MAX_GAP + n < d:
                low += 1
            top = (n, d, d + n)
            for j in range(low, i):
                d0, t0, n0 = pieces[j]
                over = max(0, d0 + n0 - d, t0 + n0 - t)  # words that both cover
                if d0 < d and t0 < t and over < n and d - d0 - n0 <= MAX_GAP and t - t0 - n0 <= MAX_GAP and best[j][0] + n - over > top[0]:
                    top = (best[j][0] + n - over, best[j][1], d + n)
            best.append(top)
        return max(best)


@cache
def _automaton(phrases: tuple, templates: tuple) -> LicenceAutomaton:
    return LicenceAutomaton(dict(phrases), dict(templates))


SPANS = "struct<n_words:bigint,spans:array<struct<label:string,base:boolean,first:bigint,words:bigint,covered:double>>>"
_SPAN = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()), ("covered", pa.float64())])
_KEYS = ("label", "base", "first", "words", "covered")


def scan_licences(docs: DataFrame, phrases: Mapping[str, str] = BASE, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, spans.

    A span is a phrase's place (base, all of them) or the stretch over which a template is covered by a chain of matches
    of at least MIN_WORDS words, to MIN_COVER or more; first counts words from 0. Null texts are empty and have no words.
    Texts are streamed a batch at a time; nothing is shuffled. Repeated rows and null ids stay as they are.
    """
    key = (tuple(phrases.items()), tuple(templates.items()))

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        automaton, parts = _automaton(*key), []
        for part in slices(texts):
            words = [alnum_words(t) for t in part.to_pylist()]
            found = [[dict(zip(_KEYS, s, strict=True)) for s in automaton.scan(w)] for w in words]
            parts.append(pa.StructArray.from_arrays([pa.array(map(len, words), pa.int64()), pa.array(found, pa.list_(_SPAN))], names=["n_words", "spans"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN))]))

    return docs.select(F.col(id_col), spans(F.col(text_col)).alias("s")).select(id_col, "s.n_words", "s.spans")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    first = F.transform(base, lambda s: s.first)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.covered)), F.lit(0.0)).alias("score"),
    )
