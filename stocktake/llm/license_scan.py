"""License scans: MinHash bands over overlapping windows, then exact shingle containment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from stocktake.llm import words as W
from stocktake.llm.common import text_array

WORDS = 5
# Short notices by which licenses are declared, as their texts or steward pages word them.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
     "option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
     "your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
     "the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
     "the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
     "to this software to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
     "2.0 which is available at"),
]

MATCH = StructType([StructField("doc_id", LongType()), StructField("license", StringType()), StructField("template", LongType()),
                    StructField("containment", DoubleType()), StructField("first_word", LongType()), StructField("last_word", LongType())])


def hashed(texts: pa.Array | Sequence[str]):
    """(first text, number of texts, word hashes, the words' texts) of each piece of texts."""
    for first, data, offsets in W.pieces(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
        data = W.lower(data)
        start, end, doc = W.spans(data, offsets)
        word = W.span_hash(data, start, end)
        yield first, len(offsets) - 1, word, doc


@dataclass
class Width:
    """Templates whose windows hold ``shingles`` shingles, taken every ``stride``."""

    shingles: int
    stride: int
    rows: int
    bands: int
    factors: np.ndarray
    offsets: np.ndarray
    templates: list[int]
    keys: list[np.ndarray]
    marks: list[np.ndarray]

    def minima(self, values: np.ndarray, i: int) -> np.ndarray:
        return values * self.factors[i] + self.offsets[i]


def band_plan(shingles: int, width: int, stride: int, threshold: float, miss: float) -> tuple[int, int]:
    """(rows, bands) under which a window over a match of ``threshold`` containment is retrieved with
    probability 1 - ``miss`` at least.

    The best aligned window loses half a stride at either end at most, so it shares c shingles with
    the template, and its similarity is at least c / (width + shingles - c). One row a band is
    enough: unrelated windows hardly ever share a five-word shingle, let alone the smallest.
    """
    c = math.ceil(threshold * shingles - 1e-9) - (0 if stride == 1 else stride / 2)
    similarity = c / (width + shingles - c)
    if similarity >= 1:
        return 1, 1
    return 1, math.ceil(math.log(miss) / math.log(1 - similarity))


class Library:
    """Templates cut into shingles of five words (all words, if fewer) and grouped by window width."""

    def __init__(self, notices: Sequence[tuple[str, str]] = NOTICES, threshold: float = 0.8, miss: float = 1e-3, seed: int = 3):
        self.names = [n for n, _ in notices]
        self.threshold = threshold
        self.sizes: list[int] = []
        self.sets: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        for _, text in notices:
            word = np.concatenate([w for _, _, w, _ in hashed([text])]) if text else np.zeros(0, np.uint64)
            n = min(WORDS, len(word))
            self.sizes.append(n)
            self.sets.append(np.unique(W.shingle_hash(word, np.zeros(len(word), np.int64), n)[0]) if n else np.zeros(0, np.uint64))
        self.widths: dict[int, list[Width]] = {}
        for n in sorted(set(self.sizes) - {0}):
            by: dict[int, list[int]] = {}
            for t, s in enumerate(self.sets):
                if self.sizes[t] == n and len(s):
                    by.setdefault(len(s) if len(s) < 16 else -(-len(s) // 8) * 8, []).append(t)
            self.widths[n] = [self._width(w, ts, miss, rng) for w, ts in sorted(by.items())]

    def _width(self, width: int, templates: list[int], miss: float, rng) -> Width:
        stride = 1 if width < 16 else width // 8
        plans = [band_plan(len(self.sets[t]), width, stride, self.threshold, miss) for t in templates]
        rows, bands = max(p[0] for p in plans), max(p[1] for p in plans)
        factors = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offsets = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
        out = Width(width, stride, rows, bands, factors, offsets, templates, [], [])
        for b in range(bands):
            keys = np.array([band_key([out.minima(self.sets[t], b * rows + r).min() for r in range(rows)]) for t in templates], np.uint64)
            mark = np.zeros(1 << 16, bool)
            mark[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            out.keys.append(keys)
            out.marks.append(mark)
        return out

    def matches(self, word: np.ndarray, doc: np.ndarray):
        """(text, template, containment, first word, last word) of every verified window region."""
        begin = np.searchsorted(doc, np.arange(doc[-1] + 2)) if len(doc) else np.zeros(1, np.int64)
        for n, widths in self.widths.items():
            shingle, at = W.shingle_hash(word, doc, n)
            if not len(shingle):
                continue
            for w in widths:
                for t, lo, hi in _retrieved(w, shingle, doc[at]):
                    yield from self._verified(t, n, shingle, at, doc, begin, lo, hi)

    def _verified(self, t, n, shingle, at, doc, begin, lo, hi):
        d = doc[at[lo]]
        hit = np.flatnonzero(np.isin(shingle[lo:hi], self.sets[t]))
        if len(hit):
            share = len(np.unique(shingle[lo:hi][hit])) / len(self.sets[t])
            if share >= self.threshold - 1e-12:
                yield int(d), t, share, int(at[lo + hit[0]] - begin[d]), int(at[lo + hit[-1]] + n - 1 - begin[d])


def band_key(parts) -> np.ndarray:
    key = parts[0]
    for p in parts[1:]:
        key = W.mix(np.asarray(key, dtype=np.uint64)) + np.asarray(p, dtype=np.uint64)
    return W.mix(np.asarray(key, dtype=np.uint64))


def _retrieved(w: Width, shingle: np.ndarray, doc: np.ndarray):
    """(template, first shingle, end) of the regions whose windows share a band with the template.

    Windows start every ``stride`` shingles of a text, the last ones reaching over its end. Minima of
    strides are combined to minima of windows; texts are kept apart by rows of the largest value.
    """
    count = w.shingles // w.stride
    firsts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    lengths = np.diff(np.concatenate((firsts, [len(doc)])))
    blocks = -(-lengths // w.stride)
    block_of = np.concatenate(([0], np.cumsum(blocks)))
    text = np.repeat(np.arange(len(firsts)), blocks)
    within = np.arange(block_of[-1]) - block_of[text]
    start = firsts[text] + within * w.stride
    place = np.arange(block_of[-1]) + text * (count - 1)
    size = block_of[-1] + len(firsts) * (count - 1)
    found: set[tuple[int, int]] = set()
    for b in range(w.bands):
        parts = []
        for r in range(w.rows):
            values = w.minima(shingle, b * w.rows + r)
            if w.stride > 1:
                values = np.minimum.reduceat(values, start)
            if count > 1:
                padded = np.full(size + count, np.iinfo(np.uint64).max)
                padded[place] = values
                reach = 1
                while reach < count:
                    step = min(reach, count - reach)
                    padded[:-step] = np.minimum(padded[:-step], padded[step:])
                    reach += step
                values = padded[place]
            parts.append(values)
        key = band_key(parts)
        near = np.flatnonzero(w.marks[b][(key & np.uint64(0xFFFF)).astype(np.int64)])
        for j in near:
            for t, k in zip(w.templates, w.keys[b], strict=True):
                if key[j] == k:
                    found.add((t, int(j)))
    spare = w.shingles // 2
    run: list[int] | None = None
    for t, j in sorted(found):
        s = firsts[text[j]]
        lo, hi = max(s, start[j] - spare), min(s + lengths[text[j]], start[j] + w.shingles + spare)
        if run and run[0] == t and run[3] == text[j] and lo <= run[2]:
            run[2] = max(run[2], hi)
            continue
        if run:
            yield run[0], run[1], run[2]
        run = [t, lo, hi, text[j]]
    if run:
        yield run[0], run[1], run[2]


def best_of(matches: list[tuple], sizes: list[int]) -> list[tuple]:
    """Of the matches (text, template, containment, first word, last word) that lie on one place, the one of highest
    containment (ties: the larger template, then its number): two lie on one place if they share more than half of
    the shorter one's words."""
    kept: list[tuple] = []
    for m in sorted(matches, key=lambda m: (-m[2], -sizes[m[1]], m[1], m[3])):
        shared = ((min(m[4], k[4]) - max(m[3], k[3]) + 1, min(m[4] - m[3], k[4] - k[3]) + 1) for k in kept if k[0] == m[0])
        if not any(2 * both > shorter for both, shorter in shared):
            kept.append(m)
    return kept


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, threshold: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text", best: bool = False) -> DataFrame:
    """One row for each license text found: doc_id, license, template (its number), containment (share of
    the template's five-word shingles), first_word and last_word (of the text's words, from 0).

    Words are runs of letters and digits in lower case. Overlapping windows as wide as the template
    are retrieved by MinHash bands whose number makes a miss less likely than 0.1 %, and every
    retrieved region is verified exactly; regions that touch are one. A text that repeats a license
    in several places has a row for each. ``best`` names each place by one template only (``best_of``), so that
    versions and variants of a license aren't taken for each other. Null and empty texts have no rows, nor do empty templates;
    null ids are carried. A narrow map: templates are a parameter, and nothing is shuffled.
    """
    library = docs.sparkSession.sparkContext.broadcast(Library(notices, threshold))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        lib = library.value
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, _, word, doc in hashed(text_array(batch, "text")):
                matches = list(lib.matches(word, doc))
                if best and len(matches) > 1:
                    by_text: dict[int, list[tuple]] = {}
                    for m in matches:
                        by_text.setdefault(m[0], []).append(m)
                    matches = [m for own in by_text.values() for m in best_of(own, [len(x) for x in lib.sets])]
                out += [(ids[first + d], lib.names[t], t, share, a, z) for d, t, share, a, z in matches]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), (
                    pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], MATCH.fieldNames())

    return rows.mapInArrow(run, MATCH)
