"""License scans by patience alignment against templates.

Anchors are words unique to both the text window and the template; the longest
increasing subsequence of their places is kept and the gaps between are aligned
in the same way. Coverage is the share of template words that are aligned.

A license is found where aligned words of a template lie within SPAN times its
length plus SLACK words of the text (so many may be inserted) and cover enough
of it. Windows twice as long follow at half their length, so every such stretch
lies whole in one of them, wherever it is and however far the words are apart.
Where notices repeat, such a window holds several and no word is unique in it:
each place where a template may begin, told by the words that are unique in the
template and by where they stand in it, gets a window of its own.

Exact tests spare most texts and windows the alignment. A text can only reach
the threshold if it holds one of any m + 1 template words, m being how many may
be missing; and a text or window only if the template words that it holds at
all are enough. The scan is narrow: one row in, a row out for every license
found, no shuffle.

Every occurrence of a license is a row. Occurrences of one license do not
overlap: one that spans several others stays only if it has more words than
they have together. Where templates resemble each other, a license whose words
lie for the larger part in the stretch of another goes if that has as many
words at least and covers more of its template; a template that is part of
another never outdoes it. What lies in the stretch of a license with more words
tells its name in within, null otherwise. Null and empty texts give no rows, nor do texts
without a match; empty tables none. Repeated rows are reported each. A null
doc_id stays null. Very long texts are scanned whole, one at a time. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces

#: Least share of a template's words.
COVERAGE = 0.8
#: Words of the text that an alignment may span: SPAN times the template's and SLACK more.
SPAN, SLACK = 2, 12
#: License notices as their publishers word them.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        back[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(p)
            at.append(i)
        else:
            ends[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a and b by patience alignment, increasing in both.

    A gap without anchors gives its common beginning and end; what is between
    is split at its rarest common word's first places.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place_b]
        if not anchors:
            both = [w for w in in_b if w in in_a]
            if not both:
                continue
            w = min(both, key=lambda w: (in_a[w] * in_b[w], -len(w), w))
            anchors = [(a.index(w, a0, a1), b.index(w, b0, b1))]
        anchors = [anchors[i] for i in increasing([j for _, j in anchors])]
        out += anchors
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            if i > i0 and j > j0:
                stack.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(t) for name, t in templates.items()}
        self.count = {name: Counter(t) for name, t in self.templates.items()}
        keys: set[str] = set()
        for t in self.templates.values():
            missing = len(t) - self.least(t)
            # any missing + 1 places do: the longest words are the rarest
            by_length = sorted(t, key=lambda w: (-len(w), w))
            keys.update(by_length[: missing + 1])
        # a substring test never misses a word
        self.keys = sorted(k for k in keys if not any(o != k and o in k for o in keys))

    def least(self, t: list[str]) -> int:
        return max(1, -(-int(self.coverage * 1000) * len(t) // 1000))

    def windows(self, words: list[str], t: list[str], own: Counter) -> list[tuple[int, int]]:
        """Windows of twice the span that hold enough of the template's words, every span of the text whole in one."""
        at = [i for i, w in enumerate(words) if w in own]
        span, least, out, i = self.span(t), self.least(t), [], 0
        while i < len(at):
            a = at[i]
            end = bisect_left(at, a + 2 * span, i)
            if end - i >= least and sum((Counter(words[p] for p in at[i:end]) & own).values()) >= least:
                out.append((a, at[end - 1] + 1))
            i = max(i + 1, bisect_left(at, a + span, i))
        return out

    def span(self, t: list[str]) -> int:
        return SPAN * len(t) + SLACK

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, int, str | None]]:
        """(license, coverage, matched, template words, first word, last word, within) of every occurrence found."""
        low = text.lower()
        if not any(k in low for k in self.keys):
            return []
        words, found = _WORD.findall(low), []
        have = set(words)
        for name, t in self.templates.items():
            least, own = self.least(t), self.count[name]
            if sum(n for w, n in own.items() if w in have) < least:
                continue
            close = self._apart([x for a, b in self.starts(words, t, own) if (x := self._found(words, a, b, t))], words, t)
            wide = [x for a, b in self.windows(words, t, own) if (x := self._found(words, a, b, t))]
            for x in sorted(wide, key=lambda x: (-x[0], x[1])):
                met = [y for y in close if y[1] <= x[2] and x[1] <= y[2]]
                if x[0] > sum(y[0] for y in met):
                    close = [y for y in close if y not in met] + [x]
            found += [(name, n / len(t), n, len(t), lo, hi) for n, lo, hi in sorted(close, key=lambda x: x[1])]
        kept = [x for x in found if not any(self._outdone(x, y) for y in found)]
        return [(*x, max((y for y in kept if y[2] > x[2] and self._inside(x, y)), key=lambda y: y[2], default=(None,))[0]) for x in kept]

    def starts(self, words: list[str], t: list[str], own: Counter) -> list[tuple[int, int]]:
        """Windows of about the template's length, one for each place where enough of its unique words say that it begins."""
        place = {w: i for i, w in enumerate(t) if own[w] == 1}
        missing = len(t) - self.least(t)
        votes = sorted(i - place[w] for i, w in enumerate(words) if w in place)
        enough, reach, out, i = max(1, len(place) - missing), max(3, missing), [], 0
        for j in range(1, len(votes) + 1):
            if j == len(votes) or votes[j] - votes[j - 1] > reach:
                if j - i >= enough:
                    out.append((max(0, votes[i] - 1), min(len(words), votes[j - 1] + len(t) + 1)))
                i = j
        return out

    def _found(self, words: list[str], a: int, b: int, t: list[str], low: int = 0, high: int | None = None) -> tuple[int, int, int] | None:
        """(matched, first word, last word) of the template in words[a:b], if it is covered enough; never outside of words[low:high]."""
        pairs = self._dense(align(words[a:b], t), self.span(t))
        if (rest := len(t) - len(pairs)) and pairs:  # words may have gone to chance places far off: once more, close by
            lo, hi = max(low, a + pairs[0][0] - rest), min(len(words) if high is None else high, a + pairs[-1][0] + 1 + rest)
            near = self._dense(align(words[lo:hi], t), self.span(t))
            if len(near) > len(pairs):
                a, pairs = lo, near
        return (len(pairs), a + pairs[0][0], a + pairs[-1][0]) if len(pairs) >= self.least(t) else None

    def _apart(self, found: list[tuple[int, int, int]], words: list[str], t: list[str]) -> list[tuple[int, int, int]]:
        """Those that do not overlap, the ones with most words and then the shortest first; of the others what they have beside these."""
        out: list[tuple[int, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            met = [y for y in out if y[1] <= x[2] and x[1] <= y[2]]
            if met:
                edges = sorted([(y[1], y[2]) for y in met])
                free = [(a, b) for a, b in zip([x[1], *(hi + 1 for _, hi in edges)], [*(lo for lo, _ in edges), x[2] + 1], strict=True) if b > a]
                x = max((z for a, b in free if (z := self._found(words, a, b, t, a, b))), default=None)
            if x:
                out.append(x)
        return out

    @staticmethod
    def _inside(x, y) -> bool:
        """Whether the larger part of x's stretch is y's too."""
        return 2 * (min(x[5], y[5]) - max(x[4], y[4]) + 1) > x[5] - x[4] + 1

    @classmethod
    def _outdone(cls, x, y) -> bool:
        """Whether y, with as many words at least, covers its template better over most of x's stretch."""
        return y[2] >= x[2] and y[1] > x[1] and cls._inside(x, y)

    @staticmethod
    def _dense(pairs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
        """The longest run of pairs whose places in the text lie within span words."""
        best, i = (0, 0), 0
        for j in range(len(pairs)):
            while pairs[j][0] - pairs[i][0] >= span:
                i += 1
            if j + 1 - i > best[1] - best[0]:
                best = (i, j + 1)
        return pairs[best[0] : best[1]]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_matched, n_template, first_word, last_word, within."""
    templates = templates or TEMPLATES

    def run(it):
        own = Scanner(templates, coverage)
        for b in pieces(it, 1):
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for x in own.scan(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "coverage", "n_matched", "n_template", "first_word", "last_word", "within"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, coverage double, n_matched long, n_template long, first_word long, last_word long, within string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
