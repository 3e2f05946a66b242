"""License scans by patience alignment of texts with notice templates.

Text and template are words (letters, digits and dots in versions, lower case). Words that occur exactly
once in both are anchors; the longest increasing subsequence of their places keeps those in the same order,
and the gaps between neighbours are aligned in the same way, ends that agree being matched first. The share of
template words that are matched inside one run of the text is the coverage; a run ends where more than
``MOST_GAP`` words of the text are unmatched.

A template names its licence only if its telling words (versions, and the words of ``NAMES``) are all matched in the run and no word
that restricts or changes a licence (``RESTRICTING``) stands in the run without being matched: "version 2" is not version 3, the
Lesser licence is not the plain one, and a notice with NC is not one without. Only a template of which so many distinct words
occur in the text that the coverage can be reached is aligned.

Defined cases: a null or empty text has no license and coverage 0; ties go to the longer template, then to the
name; repeated rows give a row each; very long texts are aligned whole and in stretches around a notice's rarest word;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices and texts of public licences, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Released under the BSD License.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
}
for _short, _name, _versions in (("GPL", "General", (2, 3)), ("LGPL", "Lesser General", (2.1, 3)), ("AGPL", "Affero General", (3,))):
    for _v in _versions:
        TEMPLATES[f"{_short}-{float(_v)}"] = f"Licensed under the GNU {_name} Public License, version {_v}."
        TEMPLATES[f"{_short}-{float(_v)}-header"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
for _short, _name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    TEMPLATES[f"CC-{_short}-4.0"] = f"Licensed under CC {_short} 4.0."
    TEMPLATES[f"CC-{_short}-4.0-long"] = f"Licensed under a Creative Commons {_name} 4.0 International License."

#: Words that tell one licence from another; with the words that hold a digit they must be matched.
NAMES = set("apache mit bsd gnu general lesser affero mozilla eclipse boost unencumbered cc by nc sa nd cc0 attribution sharealike noderivatives noncommercial neither endorse".split())
#: Words that make another licence of a notice in which they are not expected.
RESTRICTING = set("lesser library affero nc sa nd noncommercial sharealike noderivatives noderivs not".split())
LEAST_COVERAGE = 0.8
MOST_GAP = 10

_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def telling(template: list[str]) -> set[str]:
    """The words of a template that its run must hold."""
    return {w for w in template if w in NAMES or any(x.isdigit() for x in w)}


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by their first member) that increases in the second."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        tops[at : at + 1], piles[at : at + 1] = [b], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in text, in template), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        there = Counter(template[c:d])
        once = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1}
        found: dict[str, int] = {}
        for i in range(a, b):
            if (w := text[i]) in once:
                found[w] = -1 if w in found else i
        anchors = longest_increasing(sorted((i, once[w]) for w, i in found.items() if i >= 0))
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(x + 1, y, z + 1, w) for (x, z), (y, w) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def best_run(matches: list[tuple[int, int]], most_gap: int = MOST_GAP) -> tuple[int, int, int]:
    """(matched, first place in the text, place after the last) of the run with the most matches."""
    best, start = (0, 0, 0), 0
    for i in range(len(matches)):
        if i and matches[i][0] - matches[i - 1][0] > most_gap:
            start = i
        best = max(best, (i - start + 1, -matches[start][0], matches[i][0] + 1))
    return best[0], -best[1], best[2]


class Scanner:
    """Templates as words, the longest first."""

    def __init__(self, templates: dict[str, str]):
        self.templates = sorted(((words_of(t), name) for name, t in templates.items()), key=lambda x: (-len(x[0]), x[1]))
        self.every = {w for ws, _ in self.templates for w in ws}
        self.sets = [(ws, set(ws), telling(ws), name) for ws, name in self.templates if ws]

    def found(self, text: str | None, least: float) -> tuple[list[tuple[str, float, int, int]], float]:
        """(licence, coverage, first word, word after the last) of each template that names its licence, and the best coverage of all."""
        words = words_of(text)
        common = self.every.intersection(words)
        out, best = [], 0.0
        for template, distinct, must, name in self.sets:
            if len(distinct - common) > (1 - least) * len(template) + 1e-9:
                continue  # more words are missing than may be
            own: tuple = (name, 0.0, 0, 0)
            for matches in self.tries(words, template):
                n, start, end = best_run(matches)
                best = max(best, n / len(template))
                if n / len(template) > own[1] and self.names(words, template, matches, must, start, end):
                    own = (name, n / len(template), start, end)
            if own[1] >= least:
                out.append(own)
        return out, best

    @staticmethod
    def names(words: list[str], template: list[str], matches: list[tuple[int, int]], must: set[str], start: int, end: int) -> bool:
        run = {a: template[c] for a, c in matches if start <= a < end}
        return must.issubset(run.values()) and not any(words[i] in RESTRICTING for i in range(start, end) if i not in run)

    def scan(self, text: str | None, least: float) -> tuple[str | None, float, int | None, int | None, list[str]]:
        """The best covered licence, and the names of all that stand in stretches of their own, in order of the text."""
        found, best = self.found(text, least)
        if not found:
            return None, best, None, None, []
        chosen: list[tuple[str, float, int, int]] = []
        for one in sorted(found, key=lambda x: -x[1]):  # the longer template first, as the sort is stable
            if all(one[3] <= x[2] or x[3] <= one[2] for x in chosen):
                chosen.append(one)
        return *chosen[0], [x[0] for x in sorted(chosen, key=lambda x: x[2])]

    @staticmethod
    def tries(words: list[str], template: list[str]) -> Iterator[list[tuple[int, int]]]:
        """Alignments with the whole text and, as a notice's words may recur elsewhere, with the stretch around each place of its rarest word."""
        yield align(words, template)
        places = Counter(w for w in words if w in set(template))
        if not places:
            return
        rarest = min(places, key=lambda w: (places[w], w))
        at = template.index(rarest)
        for i, w in enumerate(words):
            if w == rarest:
                low = max(0, i - 2 * at - MOST_GAP)
                yield [(x + low, y) for x, y in align(words[low : i + 2 * (len(template) - at) + MOST_GAP], template)]


SCANNED = [("license", "string", pa.string()), ("coverage", "double", pa.float64()), ("start_word", "long", pa.int64()), ("end_word", "long", pa.int64()), ("licenses", "array<string>", pa.list_(pa.string()))]


def _scan(templates: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [scanner.scan(x.as_py(), least) for x in batch["text"]]
            columns = [pa.array([f[i] for f in found], t) for i, (_, _, t) in enumerate(SCANNED)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *(n for n, _, _ in SCANNED)])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word, licenses): the best covered licence of each document, null if none is
    covered by ``least``, and the names of all that are, each in a stretch of its own. Without a licence, coverage is the best of any template."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, least), "doc_id long, " + ", ".join(f"{n} {t}" for n, t, _ in SCANNED))
