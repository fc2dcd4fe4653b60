"""License scans: matching statistics of each file on a generalised suffix automaton of licence words.

Every template (licence notices and short base phrases) is a word sequence; all go into one
generalised suffix automaton. A file streams through it word by word, which gives for every place
the longest run of words that ends there and occurs in some template. Runs that cannot grow are the
matches; long ones are chained along both file and template into spans, and the share of a
template's words that its best chain covers decides on its label. Where chains of several labels cover
the same words of the file (licences share much of their wording), the one that covers most of its
template stands.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Phrases whose every occurrence counts, with their labels (fixed values).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and whole short licences by label (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-4.0", "this work is licensed under cc by 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law"),
]

#: Shortest match, in words, that a chain may use.
MIN_MATCH = 3
#: Most words, in the file or the template, between two matches of a chain.
MAX_GAP = 12
#: Least share of a template's words that must be covered for its label.
MIN_COVERED = 0.7

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


class LicenseAutomaton:
    """Generalised suffix automaton over the words of all templates."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str]]):
        self.base_labels = list(base.values())
        self.base = [words_of(p) for p in base]
        self.labels = self.base_labels + [label for label, _ in templates]
        self.sequences = self.base + [words_of(text) for _, text in templates]
        self.vocabulary = {w for s in self.sequences for w in s}
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(self.sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._add(last, word, ends)
                ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]
        self.base_at = self._base_states()

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes, ends: list) -> int:
        clone = self._new(self.length[p] + 1, ends)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, word: bytes, ends: list) -> int:
        if word in self.next[last]:  # a run that an earlier template has too
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word, ends)
        cur, p = self._new(self.length[last] + 1, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word, ends)
        return cur

    def _base_states(self) -> dict[int, list[tuple[int, int]]]:
        """By state: (phrase, least match length) of base phrases that end where the state's run ends."""
        own: dict[int, list[tuple[int, int]]] = {}
        for k, phrase in enumerate(self.base):
            v = 0
            for word in phrase:
                v = self.next[v][word]
            own.setdefault(v, []).append((k, len(phrase)))
        out = {}
        for v in range(len(self.length)):
            found, u = [], v
            while u > 0:
                found += own.get(u, [])
                u = self.link[u]
            if found:
                out[v] = found
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of base phrases (phrase, start) and the matches that cannot grow (end, length, state)."""
        base, matches = [], []
        nxt, link, length, vocabulary, base_at = self.next, self.link, self.length, self.vocabulary, self.base_at
        state, run, before = 0, 0, -1
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            w = words[i]
            if i != before + 1:
                if run >= MIN_MATCH:
                    matches.append((before + 1, run, state))
                state, run = 0, 0
            before = i
            if w not in nxt[state]:
                if run >= MIN_MATCH:
                    matches.append((i, run, state))
                while state and w not in nxt[state]:
                    state = link[state]
                run = length[state]
            state = nxt[state][w]
            run += 1
            if state in base_at:
                base += [(k, i + 1 - n) for k, n in base_at[state] if run >= n]
        if run >= MIN_MATCH:
            matches.append((before + 1, run, state))
        return base, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches along a template: (label, first word, last word, share of the template)."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for end, run, state in matches:
            for k, at in self.ends[state]:
                if k >= len(self.base) and at >= run:
                    anchors.setdefault(k, []).append((end - run, at - run, run))
        out = []
        for k, found in anchors.items():
            found.sort()
            best: list[list] = []  # per anchor: covered words, first word of the chain, its predecessor's use
            lo = 0
            for i, (d, t, run) in enumerate(found):
                while found[lo][0] + found[lo][2] + MAX_GAP < d and lo < i:
                    lo += 1
                top = [run, d]
                for j in range(lo, i):
                    e, u, r = found[j]
                    shared = max(0, e + r - d, u + r - t)  # words both would cover
                    if e < d and u < t and shared < run and d - e - r <= MAX_GAP and t - u - r <= MAX_GAP and best[j][0] + run - shared > top[0]:
                        top = [best[j][0] + run - shared, best[j][1]]
                best.append(top)
            ends: dict[int, tuple[int, int]] = {}  # by first word: the chain that covers most
            for (d, _, run), (covered, first) in zip(found, best, strict=True):
                ends[first] = max(ends.get(first, (0, 0)), (covered, d + run - 1))
            size = len(self.sequences[k])
            out += [(self.labels[k], first, last, min(1.0, covered / size)) for first, (covered, last) in ends.items()]
        return sorted(out)


def standing(chains: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Chains that reach ``MIN_COVERED``, less those most of whose words a chain of another label with a larger share covers.

    What covers most of a chain covers its middle word; a chain is no longer than templates and gaps
    allow, so only those that begin within that reach before the middle are looked at.
    """
    kept = sorted(c for c in chains if c[3] >= MIN_COVERED)
    by_start = sorted(kept, key=lambda c: c[1])
    starts = [c[1] for c in by_start]
    reach = max((c[2] - c[1] for c in kept), default=0)

    def beaten(c: tuple[str, int, int, float]) -> bool:
        middle = (c[1] + c[2]) // 2
        near = by_start[bisect_left(starts, middle - reach) : bisect_right(starts, middle)]
        return any(o[0] != c[0] and o[3] > c[3] and 2 * (min(c[2], o[2]) - max(c[1], o[1]) + 1) > c[2] - c[1] + 1 for o in near)

    return [c for c in kept if not beaten(c)]


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: places of base phrases, labels, and covered template spans.

    A null or empty text has no words, no labels, null ``first_word``/``last_word`` and score 0.
    Repeated rows give repeated results, other columns are ignored, an empty table gives no rows.
    ``score`` is the largest share of a template that a chain covers, 1 where a base phrase stands.
    ``spans`` holds the chains that reach ``MIN_COVERED`` and stand: label, first and last word, share; of
    several labels with equal shares on the same words all stand.
    """
    base = BASE_PHRASES if base is None else base
    templates = TEMPLATES if templates is None else templates
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LicenseAutomaton(base, templates)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                places, matches = automaton.scan(words)
                chains = automaton.spans(matches)
                kept = standing(chains)
                starts = [s for _, s in places]
                base_labels = {automaton.base_labels[k] for k, _ in places}
                rows.append((
                    len(words), len(places), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {c[0] for c in kept})),
                    1.0 if places else max((c[3] for c in chains), default=0.0),
                    [dict(zip(("label", "first_word", "last_word", "covered"), c, strict=True)) for c in kept],
                ))
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *[n for n, _ in kinds]])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,covered:double>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "cast(size(spans) as long) AS n_spans", "to_json(spans) AS spans")
