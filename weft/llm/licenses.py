"""License scans by patience alignment.

Each template is aligned with a text: words that occur once in both are anchors, the longest increasing
subsequence of anchors is kept, and the gaps between kept anchors are aligned the same way, down to gaps
without anchors, where only equal words at either end are taken. Coverage is the share of the template's
words that are aligned; a template counts from ``COVERAGE`` on.

A text is aligned only with templates that could reach that share: the multiset overlap of words bounds
the aligned words from above, so the test drops nothing (long texts are cut into the stretches where
template words stand closer than a template's length, each aligned on its own, so several licenses, or
one repeated, are all found).

Edge cases: null and empty texts have no licenses; matching ignores case and punctuation; ties between
templates covering the same words go to the higher coverage, then the longer template; repeated rows give
repeated results; very long texts are scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from weft.llm.common import arrow_map, table, texts

COVERAGE = 0.8
SLACK = 8  # template words closer than this are looked at before those up to a template's length apart

# Short license notices and headers as their licenses print them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"\w+(?:[.\-]\w+)*")


def words_of(text: str):
    """The words of a text, lower-cased, and their places (start, end)."""
    found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    return [f[0] for f in found], [(f[1], f[2]) for f in found]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: matched index pairs, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in where]
        keep = [pairs[i] for i in longest_increasing([j for _, j in pairs])]
        if not keep:
            continue
        out += keep
        lo_a, lo_b = a0, b0
        for i, j in keep:
            todo.append((lo_a, i, lo_b, j))
            lo_a, lo_b = i + 1, j + 1
        todo.append((lo_a, a1, lo_b, b1))
    return sorted(out)


def stretches(hits: list[int], gap: int):
    """Runs (from, to) of ascending places of which neighbours stand at most ``gap`` apart."""
    start = 0
    for k in range(1, len(hits) + 1):
        if k == len(hits) or hits[k] - hits[k - 1] > gap:
            yield start, k
            start = k


def joined(pairs: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """The largest run of aligned pairs with at most ``gap`` foreign words in a row."""
    runs = list(stretches([j for _, j in pairs], max(SLACK, gap + 1)))
    lo, hi = max(runs, key=lambda r: r[1] - r[0], default=(0, 0))
    return pairs[lo:hi]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words_of(text)[0]) for name, text in sorted(templates.items())]
        self.counts = [Counter(w) for _, w in self.templates]
        self.sets = [frozenset(w) for _, w in self.templates]
        # a word of every template such that a text without any of them cannot cover enough of it
        seen = Counter(w for s in self.sets for w in s)
        self.rare = []
        for (_, ws), counts in zip(self.templates, self.counts):
            need, pick = len(ws) - -(-int(coverage * len(ws) * 1000) // 1000), set()
            for w in sorted(counts, key=lambda w: (-len(w), seen[w], w)):
                pick.add(w)
                if sum(counts[x] for x in pick) > need:
                    break
            self.rare.append(frozenset(pick))
        self.cues = sorted(set().union(*self.rare))

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of the licenses of a text, in reading order; offsets in code points."""
        low = text.lower()
        if not any(c in low for c in self.cues):
            return []
        ws, places = words_of(text)
        have, found = set(ws), []
        for (name, tw), counts, own, rare in zip(self.templates, self.counts, self.sets, self.rare):
            if rare.isdisjoint(have):
                continue
            hits = [i for i, w in enumerate(ws) if w in own]
            for lo, hi in stretches(hits, max(SLACK, len(tw) + 1)):
                # what stands close together first, so that a notice does not reach for words far from it
                close = list(stretches(hits[lo:hi], SLACK))
                took: list = []
                for a, b in close:
                    took += self._stretch(name, tw, counts, ws, places, hits[lo + a], hits[lo + b - 1] + 1, found)
                if len(close) > 1:
                    at = hits[lo]
                    for a, b in [*sorted(took), (hits[hi - 1] + 1, 0)]:
                        self._stretch(name, tw, counts, ws, places, at, a, found)
                        at = b
        found.sort(key=lambda f: (-f[3] * f[4], -f[3], -f[4], f[0], f[1]))
        kept: list = []  # disjoint, by (start, end)
        for f in found:
            k = bisect_left(kept, (f[1], f[2]))
            if (k == 0 or kept[k - 1][1] <= f[1]) and (k == len(kept) or f[2] <= kept[k][0]):
                kept.insert(k, (f[1], f[2], f[0], f[3]))
        return [(name, a, b, share) for a, b, name, share in kept]

    def _stretch(self, name, tw, counts, ws, places, lo, hi, found) -> list[tuple[int, int]]:
        """Align one stretch; what it covers is taken and the rest of the stretch looked at again. Gives what it took."""
        todo, took, need = [(lo, hi)], [], self.coverage * len(tw)
        while todo:
            lo, hi = todo.pop()
            pairs = []
            if hi - lo <= 4 * len(tw) + SLACK:
                part = ws[lo:hi]
                have = Counter(w for w in part if w in counts)
                if sum(min(n, have[w]) for w, n in counts.items()) < need:
                    continue
                first, pairs = lo, [(t, lo + j) for t, j in joined(align(tw, part), len(tw))]
            if len(pairs) < need:
                # repeated words hide the anchors: look at each place where the template can begin
                first, pairs = self._place(tw, counts, ws, lo, hi)
                if len(pairs) < need:
                    continue
            a, b = pairs[0][1], pairs[-1][1] + 1
            found.append((name, places[a][0], places[b - 1][1], round(len(pairs) / len(tw), 4), len(tw)))
            took.append((a, b))
            todo += [(first, a), (b, hi)]
        return took

    def _place(self, tw, counts, ws, lo, hi) -> tuple[int, list[tuple[int, int]]]:
        """The best alignment near the first start from ``lo`` on that covers enough, and that start. Two windows slide
        along, without and with a long insertion, and a start is passed over if their words cannot reach the coverage;
        no start before the first has to be looked at again, and nothing far behind it is, so a stretch of many copies
        costs one pass."""
        need, widths = self.coverage * len(tw), (len(tw) + SLACK, 2 * len(tw) + SLACK)
        have, bound, end = [Counter(), Counter()], [0, 0], [lo, lo]
        best, score, first = [], 0, None
        for i in range(lo, hi):
            if first is not None and i > first + widths[0]:
                break
            w = ws[i]
            for k, width in enumerate(widths):
                while end[k] < hi and end[k] < i + width:
                    x, end[k] = ws[end[k]], end[k] + 1
                    if x in counts:
                        have[k][x] += 1
                        bound[k] += have[k][x] <= counts[x]
            if w in counts:
                for k, width in enumerate(widths):
                    if bound[k] >= need and score < len(tw):
                        pairs = joined(align(tw, ws[i : min(i + width, hi)]), len(tw))
                        if len(pairs) >= need:
                            first = i if first is None else first
                            # foreign words inside count against it, so it takes no words of the next copy
                            if (tight := 2 * len(pairs) - (pairs[-1][1] + 1 - pairs[0][1])) > score or not best:
                                score, best = tight, [(t, j + i) for t, j in pairs]
                            break
                for k in range(2):
                    bound[k] -= have[k][w] <= counts[w]
                    have[k][w] -= 1
        return (lo if first is None else first), best


_SCANNER: list[Scanner] = []


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_licenses, license, coverage, spans): the best license of each text and all of them."""

    def work(batch):
        if not _SCANNER:
            _SCANNER.append(Scanner())
        found = [_SCANNER[0].scan(t) for t in texts(batch)]
        best = [max(f, key=lambda x: (x[3], x[2] - x[1], x[0])) if f else None for f in found]
        return {
            "doc_id": batch.column("doc_id"),
            "n_licenses": [len(f) for f in found],
            "license": [b[0] if b else None for b in best],
            "coverage": [b[3] if b else 0.0 for b in best],
            "spans": [",".join(f"{n}:{a}:{b}" for n, a, b, _ in f) for f in found],
        }

    return arrow_map(docs.select("doc_id", "text"), work, "doc_id long, n_licenses long, license string, coverage double, spans string")


def op1_license_patience(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
