"""License scans by patience alignment.

A document is searched for each license template. Words that occur once in both
the template and a region of the text are anchors; the longest increasing run of
them is kept, and the gaps between are aligned in the same way. A gap without
anchors is aligned by longest common subsequence, after equal words at its ends.
The coverage is the share of the template's words that are aligned.

Regions come from trigger words: a text that covers a template to ``COVERAGE`` holds
at least one of any of its words that make up more than the rest, and the longest
words of each template are taken for that. So each notice that spreads over no more than
``REACH`` lengths of its template lies in a region. Regions are bounded by the template, so
a text full of trigger words costs no more than its length; those that hold too few of the
template's words are counted out before the alignment.

Licenses of one family share most words. So the words of a license's own name that its
template holds must be aligned, and of notices that overlap, the one with the most aligned
words is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import pick

COVERAGE = 0.8
#: Words around a trigger that are searched, in lengths of the template.
REACH = 2
_WORD = re.compile(r"[^\W_]+")

#: Short notices of public licenses, as their texts give them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Licenses with the same short line or notice.
_GNU = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
_CC = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
TEMPLATES |= {name: f"This work is licensed under the GNU {title}, version {v}." for name, (title, v) in _GNU.items()}
TEMPLATES |= {f"{name}-notice": f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version." for name, (title, v) in _GNU.items()}
TEMPLATES |= {f"CC-{terms}-4.0": f"Licensed under CC {terms} 4.0." for terms in _CC}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs with rising first numbers, the longest run with rising second ones (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence by dynamic programming, as pairs of places."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both lists."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place_b = {w: j for j, w in enumerate(b[b0:b1], b0) if count_b[w] == 1}
        anchors = _increasing([(i, place_b[w]) for i, w in enumerate(a[a0:a1], a0) if count_a[w] == 1 and w in place_b])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        for i, j in [*anchors, (a1, b1)]:
            gaps.append((a0, i, b0, j))
            if i < a1:
                out.append((i, j))
            a0, b0 = i + 1, j + 1
    return sorted(out)


def _increments(words: list[str], wanted: Counter, windows: list[tuple[int, int]]) -> Iterator[int]:
    """For windows whose ends never fall: how many of the wanted words each holds, counted with their number."""
    held: Counter = Counter()
    low = high = total = 0
    for start, end in windows:
        for w in words[high:end]:
            if w in wanted:
                held[w] += 1
                total += held[w] <= wanted[w]
        for w in words[low:start]:
            if w in wanted:
                total -= held[w] <= wanted[w]
                held[w] -= 1
        low, high = start, end
        yield total


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, words) for name, text in templates.items() if (words := words_of(text))]
        self.counts = [Counter(words) for _, words in self.templates]
        self.named = [set(words_of(name.replace(".0", ""))) & set(words) for name, words in self.templates]
        self.triggers: list[set[str]] = []
        for (_, words), count in zip(self.templates, self.counts, strict=True):
            spare = int((1 - coverage) * len(words) + 1e-9)  # so many words may be missing
            chosen, n = set(), 0
            for w in sorted(count, key=lambda w: (-len(w), w)):
                if n > spare:
                    break
                chosen.add(w)
                n += count[w]
            self.triggers.append(chosen)
        self.any = re.compile("|".join(sorted(map(re.escape, set().union(*self.triggers)), key=len, reverse=True)) or r"(?!)")

    def covered(self, k: int, words: list[str], low: int, high: int) -> list[int]:
        """Places in ``words`` that are aligned to template ``k``, if they cover it and hold its name."""
        template = self.templates[k][1]
        pairs = align(template, words[low:high])
        if len(pairs) < self.coverage * len(template) - 1e-9 or self.named[k] - {template[i] for i, _ in pairs}:
            return []
        return [low + j for _, j in pairs]

    def settled(self, k: int, words: list[str], places: list[int], done: int) -> list[int]:
        """As many places as one length around these adds, then as close together as they can be."""
        size = len(self.templates[k][1])
        while len(wider := self.covered(k, words, max(done, places[0] - size), places[-1] + size + 1)) > len(places):
            places = wider
        for first, last in ((1, 0), (0, 1)):  # a word of another notice does not stand for one of this
            while len(closer := self.covered(k, words, places[0] + first, places[-1] + 1 - last)) >= len(places):
                places = closer
        return places

    def notices(self, k: int, words: list[str]) -> Iterator[list[int]]:
        """Aligned places of each notice of template ``k``, one after another: in one length around a trigger, else in ``REACH``."""
        size = len(self.templates[k][1])
        at = [i for i, w in enumerate(words) if w in self.triggers[k]]
        wide = [(max(0, i - REACH * size), min(len(words), i + REACH * size + 1)) for i in at]
        done = 0
        for i, (low, high), held in zip(at, wide, _increments(words, self.counts[k], wide), strict=True):
            if i < done or held < self.coverage * size - 1e-9:
                continue
            places = self.covered(k, words, max(done, i - size), min(len(words), i + size + 1)) or self.covered(k, words, max(done, low), high)
            if places:
                places = self.settled(k, words, places, done)
                done = places[-1] + 1
                yield places

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, int, int]]:
        """(license, words, words aligned, coverage, first word, last word) of each notice, in the text's order."""
        if not text or not self.any.search(text.lower()):
            return []
        words = words_of(text)
        have = set(words)
        found = []
        for k, (name, template) in enumerate(self.templates):
            if not have.isdisjoint(self.triggers[k]):
                found += [(name, len(template), len(p), len(p) / len(template), p[0], p[-1]) for p in self.notices(k, words)]
        kept: list[tuple] = []
        for x in sorted(found, key=lambda x: (-x[2], -x[3], x[4])):  # stable: ties go to the earlier template
            at = bisect_left(kept, x[4], key=lambda y: y[4])
            if (at == len(kept) or x[5] < kept[at][4]) and (at == 0 or kept[at - 1][5] < x[4]):
                kept.insert(at, x)
        return kept


_FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template_words", pa.int64()), ("aligned_words", pa.int64()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each license notice in a text of ``df``: doc_id, license, template_words, aligned_words, coverage, first_word, last_word.

    Words are numbered from 0 over the whole text. Notices don't overlap; of those that would, the one with more aligned words
    stays, then the one with more coverage, the earlier one, the earlier template. Null or empty texts hold none.
    Repeated rows give repeated results. Empty table: no rows. Other columns are not read.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, *found) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for found in scanner.scan(t.as_py())]
            columns = list(zip(*out, strict=True)) or [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    docs = pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, license string, template_words long, aligned_words long, coverage double, first_word long, last_word long")
