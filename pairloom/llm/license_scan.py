r"""License scans by patience alignment.

Template and text are sequences of lower-cased words.  Words that occur once in
the template and once in a window of the text are anchors; the longest
increasing subsequence of their positions is kept, and the gaps between
anchors are aligned in the same way.  Gaps without anchors take their common
head and tail.  Coverage is the share of template words that are matched.

A match lies in a window of the text that begins with one of the template's
words and is ``STRETCH`` times as long as the template (and three words).
Windows that cannot reach the coverage are skipped: at most ``(1 - coverage)``
of the template's places may stay unmatched, so all but that many of its
distinct words must stand in the window.  That is a filter on position lists
that loses nothing, so most texts cost one set intersection.

Defined results: a null or empty text has no match; overlapping matches of a
template keep the better (then the earlier, then the shorter) one, and a
template whose span lies inside a better-covered longer match is dropped;
repeated rows match alike; an empty table gives an empty table; extra columns
of any name are passed by.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

#: Short public license notices, as texts carry them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "reserved": "All rights reserved.",
}
COVERAGE, STRETCH = 0.8, 1.25
_WORD = re.compile(r"[^\W_]+")


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back[i] = piles[at - 1] if at else -1
        tops[at : at + 1] = [v]
        piles[at : at + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(template: list[str], text: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Matched (template, text) positions of template[a:b] and text[c:d]."""
    out: list[tuple[int, int]] = []
    gaps = [(a, b, c, d)]
    while gaps:
        a, b, c, d = gaps.pop()
        head: list[tuple[int, int]] = []
        while a < b and c < d and template[a] == text[c]:
            head.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            head.append((b, d))
        out += head
        if a >= b or c >= d:
            continue
        here: dict[str, int] = {}
        for i in range(a, b):
            here[template[i]] = -1 if template[i] in here else i
        there: dict[str, int] = {}
        for j in range(c, d):
            if text[j] in here:
                there[text[j]] = -1 if text[j] in there else j
        anchors = sorted((i, there[w]) for w, i in here.items() if i >= 0 and there.get(w, -1) >= 0)
        chain = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not chain:
            continue
        out += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def windows(positions: list[int], words: list[str], size: int, distinct: int, total: int):
    """(start, end) word ranges that begin with a template word and hold ``distinct`` different ones."""
    hi = 0
    for lo, p in enumerate(positions):
        while hi < len(positions) and positions[hi] < p + size:
            hi += 1
        if hi - lo >= distinct and len({words[k] for k in positions[lo:hi]}) >= distinct:
            yield p, min(total, p + size)


def _needed(template: list[str], coverage: float) -> int:
    """Distinct words that a window must hold to reach the coverage."""
    return max(1, len(set(template)) - (len(template) - math.ceil(coverage * len(template))))


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = []
        for name, text in (TEMPLATES if templates is None else templates).items():
            words = _WORD.findall(text.lower())
            self.templates.append((name, words, frozenset(words)))

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(name, matched words, template words, start, end) of every match, by start."""
        if not text:
            return []
        lower = text.lower()
        plain = lower if len(lower) == len(text) else None
        words = _WORD.findall(lower)
        vocabulary = set(words)
        found = []
        for name, template, known in self.templates:
            need = _needed(template, self.coverage)
            if len(known & vocabulary) < need:
                continue
            positions = [i for i, w in enumerate(words) if w in known]
            best = []
            for lo, hi in windows(positions, words, int(STRETCH * len(template)) + 3, need, len(words)):
                pairs = align(template, words, 0, len(template), lo, hi)
                if len(pairs) >= self.coverage * len(template):
                    best.append((-len(pairs), pairs[-1][1] - pairs[0][1], pairs[0][1], pairs[-1][1]))
            taken: list[tuple[int, int]] = []
            for missed, _, first, last in sorted(best):
                if all(last < x or first > y for x, y in taken):
                    taken.append((first, last))
                    found.append((name, -missed, len(template), first, last))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text if plain is None else plain)]
        whole = [f for f in found if not any(g is not f and g[1] > f[1] and g[3] <= f[3] and f[4] <= g[4] for g in found)]
        return sorted(((n, m, k, spans[min(a, len(spans) - 1)][0], spans[min(b, len(spans) - 1)][1]) for n, m, k, a, b in whole), key=lambda x: (x[3], x[0]))


RESULT = "array<struct<license:string,matched:bigint,words:bigint,coverage:double,start:bigint,end:bigint>>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` plus ``licenses`` (or the first free ``licenses_N``), the matches with coverage and character offsets."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int64()), ("words", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        scanner = Scanner(templates)
        return pa.array([[
            {"license": n, "matched": m, "words": k, "coverage": m / k, "start": a, "end": b} for n, m, k, a, b in scanner.scan(t)
        ] for t in texts.to_pylist()], kind)

    return docs.withColumn(free_name(docs, "licenses"), scanned(F.col(text)))


def license_rows(docs: DataFrame) -> DataFrame:
    """One row a document: the licenses found, the best coverage, and the spans."""
    out = scan_licenses(docs.select("doc_id", "text"))
    spans = F.transform("licenses", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return out.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"), F.array_join(spans, ",").alias("spans"))
