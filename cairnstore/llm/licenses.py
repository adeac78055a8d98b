"""License scans by MinHash bands over overlapping windows of text.

Texts and templates are folded into words and those into five-word shingles (a template of fewer words is left
out). Templates are looked up in windows of 1, 4 or 16 shingles; a text's windows of 16 begin at every eighth shingle,
the others at every one, a template's at every one. A template has windows of the largest size of which one stands whole
inside it wherever it begins (16 from 23 shingles on, 4 from 4 on). Two windows whose shingles are equal share all
bands, and of a similarity of 0.8 they share one of 16 bands of two rows with a probability of 0.9999999 (8 bands for
windows of four: 0.9997), so a template that stands whole in a text is always retrieved. A retrieved template is then
verified: the share of its distinct shingles that stand within one and a quarter of its length has to reach the threshold.

Defined results: null and empty texts have no match; matches of one template in a text don't overlap; rows that
repeat an id and a text repeat its matches; an empty table gives an empty result. Columns beside id and text are
left alone. Templates are a fixed list, broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, slices
from .words import mix, shingles, words

GRAM, THRESHOLD, REACH = 5, 0.8, 1.25
#: Window in shingles, its step in texts, bands and rows of a band.
CLASSES = ((1, 1, 1, 1), (4, 1, 8, 2), (16, 8, 16, 2))

#: Public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def window_bands(g: np.ndarray, size: int, step: int, bands: int, rows: int):
    """(band, hash of each window): minima over size shingles from every step-th on; g may run across texts."""
    n = len(g) - size + 1
    if n <= 0:
        return
    for band in range(bands):
        key = np.full(len(range(0, n, step)), band * 64 + size, np.uint64)
        for row in range(rows):
            v, have = mix(g ^ np.uint64((0x9E3779B97F4A7C15 * (band * rows + row + 1)) & 0xFFFFFFFFFFFFFFFF)), 1
            while have < size:
                v, have = np.minimum(v[: len(v) - have], v[have:]), have * 2
            key = mix(key ^ v[:n:step])
        yield band, key


class Templates:
    """Shingles of every template and, by window size, the bands of all their windows."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.sets, self.words = [], [], []
        found: dict[int, list[tuple[np.ndarray, int]]] = {c[0]: [] for c in CLASSES}
        for name, text in sorted(templates.items()):
            w = words(pa.array([text], pa.large_string()), fold=True)
            g = shingles(w.hashes(), GRAM)
            if not len(g):
                continue
            size, _, bands, rows = max(c for c in CLASSES if c[0] + c[1] - 1 <= len(g))
            found[size] += [(key, len(self.names)) for _, key in window_bands(g, size, 1, bands, rows)]
            self.names.append(name)
            self.sets.append(np.unique(g))
            self.words.append(len(w.start))
        self.index = {}
        for size, parts in found.items():
            keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
            owner = np.concatenate([np.full(len(k), o) for k, o in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(keys, kind="stable")
            near = np.zeros(1 << 16, bool)
            near[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.index[size] = keys[order], owner[order], near

    def retrieve(self, g: np.ndarray) -> set[tuple[int, int]]:
        """(shingle at which a window starts, template) that share a band."""
        out = set()
        for size, step, bands, rows in CLASSES:
            keys, owner, near = self.index[size]
            if not len(keys):
                continue
            for _, key in window_bands(g, size, step, bands, rows):
                at = np.flatnonzero(near[(key & np.uint64(0xFFFF)).astype(np.int64)])
                lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
                for i in np.flatnonzero(hi > lo).tolist():
                    out.update((int(at[i]) * step, int(o)) for o in owner[lo[i] : hi[i]])
        return out


def matches(g: np.ndarray, template: np.ndarray, size: int, threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, containment) in words of each disjoint stretch of one text that holds enough of a template's
    distinct shingles; a stretch is at most REACH times the template's `size` words."""
    reach = int(np.ceil(REACH * size)) - GRAM + 1
    at = np.flatnonzero(np.isin(g, template))
    need = threshold * len(template) - 1e-9
    out, begin = [], 0
    hi, held, distinct = 0, {}, 0
    places, values = at.tolist(), g[at].tolist()
    best = None
    for lo in range(len(places)):
        while hi < len(places) and places[hi] < places[lo] + reach:
            held[values[hi]] = held.get(values[hi], 0) + 1
            distinct += held[values[hi]] == 1
            hi += 1
        if places[lo] >= begin and distinct >= need:
            if best and places[lo] >= best[1]:
                out.append(best)
                best = None
            if not best or distinct / len(template) > best[2]:
                best = (places[lo], places[hi - 1] + GRAM, distinct / len(template))
        held[values[lo]] -= 1
        distinct -= held[values[lo]] == 0
    return [*out, best] if best else out


def _scan(templates, threshold: float):
    def run(batches):
        t = templates.value
        for batch in slices(batches):
            w = words(batch.column("text"), fold=True)
            g = shingles(w.hashes(), GRAM)
            first = w.first
            seen = {(int(np.searchsorted(first, at, "right")) - 1, o) for at, o in t.retrieve(g)}
            # a window may begin in the text before: look into the next one with words as well
            full = np.flatnonzero(np.diff(first))
            after = {(int(x), o) for i, o in seen for x in full[np.searchsorted(full, i + 1) : np.searchsorted(full, i + 1) + 1 + max(c[0] for c in CLASSES)]}
            ids, rows = batch.column("doc_id"), []
            for i, o in sorted(seen | after):
                mine = g[first[i] : max(first[i], first[i + 1] - GRAM + 1)]
                rows += [(i, t.names[o], *m) for m in matches(mine, t.sets[o], t.words[o], threshold)]
            yield pa.record_batch([ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[c] for r in rows], k) for c, k in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], ["doc_id", "template", "start", "end", "containment"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, start and end (in folded words), containment of every match."""
    known = Shared(docs.sparkSession, Templates(TEMPLATES if templates is None else templates))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(known, threshold), "doc_id long, template string, start long, end long, containment double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
