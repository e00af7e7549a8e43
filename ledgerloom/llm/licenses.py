"""License scans: winnowed template fingerprints, then banded alignment.

Templates are cut to words; of each window of WINNOW word grams the smallest
hash is kept, and an inverted index maps it to templates and places. All word
grams of a document are looked up in the index. Hits on a template that lie on
neighbouring diagonals make a candidate region. Regions that can't match (too few of their words are in the template,
or too few of the template's words lie within the band) are left out; for the
others a banded alignment of the region with the template (match 1, mismatch and gap -1, local) reports which
template words are matched, the share of them, and the words and characters
that the match spans.

The index holds the templates only; its bytes are checked against MAX_BYTES
before it is sent to the tasks. Documents are scanned where they lie, whole.

Cases: null and empty texts hold no license; templates without words match
nothing; short templates (fewer words than a gram) are one gram; repeated rows
get repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.runtime import documents, over_batches, table

GRAM, WINNOW, BAND = 3, 4, 8
#: Templates of fewer words have all their pairs of words in the index. An alignment of two matches or more begins with
#: two neighbouring ones (a gap after the first would end it), so it always has a hit.
SHORT = 32
#: A region is reported if at least this share of its template's words is matched.
LEAST_COVERAGE = 0.8
MAX_BYTES = 16 << 20

#: Licenses whose whole text, without the copyright line and appendices, lies in license_texts; each is the template `<name>-text`.
TEXTS = [
    *("Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-SA-4.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0"),
    *("GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense"),
]
_GNU = (
    "is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; "
    "either version {1} of the License, or (at your option) any later version."
)

#: The notices and licenses that the scan looks for; any other list can be given. A name without -text is a notice or one sentence of the license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
    ),
    ("Apache-2.0-header", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "Apache-2.0-file-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0-header", "This program " + _GNU.format("General Public License", 2)),
    ("GPL-3.0-header", "This program " + _GNU.format("General Public License", 3)),
    ("AGPL-3.0-header", "This program " + _GNU.format("Affero General Public License", 3)),
    ("LGPL-2.1-header", "This library " + _GNU.format("Lesser General Public License", 2.1)),
    ("LGPL-3.0-header", "This library " + _GNU.format("Lesser General Public License", 3)),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *((f"{name}-text", pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in TEXTS),
]

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
FOUND = "license string, coverage double, matched long, first_word long, end_word long, first_char long, end_char long"
RESULT = f"doc_id long, {FOUND}"


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    gram: np.ndarray
    template: np.ndarray
    place: np.ndarray
    vocabulary: np.ndarray
    #: For each template, which words of the vocabulary it holds, and False for all other words.
    member: list[np.ndarray]


def _words(texts: tk.Texts) -> tuple[np.ndarray, tk.Words]:
    lower = tk.Texts(tk.LOWER[texts.data], texts.offsets)
    words = tk.words_of(lower, _SEPARATOR)
    return tk.span_hash(tk.prefix_hash(lower.data), words.start, words.end), words


def winnow(gram: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the smallest hash of each window, the last one of equals."""
    if len(gram) <= window:
        return np.flatnonzero(gram == gram.min())[-1:] if len(gram) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(gram, window)
    return np.unique(np.arange(len(rows)) + window - 1 - np.argmin(rows[:, ::-1], 1))


def _gram_of(n_words: int) -> int:
    return GRAM if n_words >= SHORT else min(2, n_words)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    gram = tk.gram_hashes(hashes, n)
    return gram if n == GRAM else tk.mix(gram + np.uint64(n))


def index_of(templates: Sequence[tuple[str, str]]) -> Index:
    if sum(len(t.encode()) for _, t in templates) > MAX_BYTES:
        raise ValueError("the templates are larger than what may be sent to every task")
    out = Index([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [])
    for name, text in templates:
        hashes, _ = _words(tk.texts_of(pa.array([text], pa.large_string())))
        if not len(hashes):
            continue
        gram = _grams(hashes, _gram_of(len(hashes)))
        at = np.arange(len(gram)) if len(hashes) < SHORT else winnow(gram)
        out.gram, out.place = np.append(out.gram, gram[at]), np.append(out.place, at)
        out.template = np.append(out.template, np.full(len(at), len(out.names)))
        out.names.append(name)
        out.words.append(hashes)
    order = np.argsort(out.gram, kind="stable")
    out.gram, out.template, out.place = out.gram[order], out.template[order], out.place[order]
    out.vocabulary = np.unique(np.concatenate([out.vocabulary, *out.words]))
    out.member = [np.append(np.isin(out.vocabulary, w), False) for w in out.words]
    return out


def _able(doc: np.ndarray, template: np.ndarray, diagonal: np.ndarray, hashes: np.ndarray, words: tk.Words, index: Index) -> np.ndarray:
    """Which hits lie in a region with enough words of their template; only words that it holds can be matched."""
    code = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    code = np.where(index.vocabulary[code] == hashes, code, len(index.vocabulary))
    size = np.asarray([len(w) for w in index.words])
    low, high = np.maximum(words.first[doc], diagonal - BAND), np.minimum(words.first[doc + 1], diagonal + size[template] + BAND)
    able = high - low >= LEAST_COVERAGE * size[template]
    for t in np.unique(template[able]).tolist():
        own = np.flatnonzero(able & (template == t))
        known = np.append(0, np.cumsum(index.member[t][code]))
        able[own] = known[high[own]] - known[low[own]] >= LEAST_COVERAGE * size[t]
    return able


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Best local alignment whose diagonal (text place - template place) is within `band` of `shift`.

    Gives its score, the number of matched template words, and the first and
    end place in the text. Row by row over the template; a row is the band.
    """
    width = 2 * band + 1
    score, matched, first = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1)
    best = (0, 0, 0, 0)
    for i in range(len(template)):
        new_score, new_matched, new_first = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1)
        for d in range(width):
            j = i + shift - band + d
            if not 0 <= j < len(text):
                continue
            same = template[i] == text[j]
            options = [(score[d] + (1 if same else -1), matched[d] + same, first[d] if score[d] > 0 else j)]
            if d + 1 < width:
                options.append((score[d + 1] - 1, matched[d + 1], first[d + 1]))  # a template word left out
            if d:
                options.append((new_score[d - 1] - 1, new_matched[d - 1], new_first[d - 1]))  # a text word too many
            s, m, f = max(options, key=lambda o: (o[0], o[1]))
            if s > 0:
                new_score[d], new_matched[d], new_first[d] = s, m, f
                if (s, m) > best[:2]:
                    best = (int(s), int(m), int(f), j + 1)
        score, matched, first = new_score, new_matched, new_first
    return best


def _within(model: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> int:
    """Template words that some text word within the band equals: no alignment there matches more."""
    near = np.zeros(len(model), bool)
    for s in range(shift - band, shift + band + 1):
        i, end = max(0, -s), min(len(model), len(text) - s)
        if i < end:
            near[i:end] |= model[i:end] == text[i + s : end + s]
    return int(near.sum())


def scan(texts: tk.Texts, index: Index) -> list[tuple[int, int, float, int, int, int, int, int]]:
    """(document, template, coverage, matched words, first and end word, first and end character) of each match."""
    hashes, words = _words(texts)
    if not len(hashes) or not len(index.gram):
        return []
    found: set[tuple[int, int, int]] = set()
    for n in sorted({_gram_of(len(w)) for w in index.words}):
        gram = _grams(hashes, n)
        at = np.flatnonzero(words.doc[: len(gram)] == words.doc[n - 1 :]) if len(gram) else np.zeros(0, np.int64)
        low, high = np.searchsorted(index.gram, gram[at], "left"), np.searchsorted(index.gram, gram[at], "right")
        count = high - low
        hit, place = tk.ranges(low, count), np.repeat(at, count)
        doc, template, diagonal = words.doc[place], index.template[hit], place - index.place[hit]
        able = _able(doc, template, diagonal, hashes, words, index)
        found |= set(zip(doc[able].tolist(), template[able].tolist(), diagonal[able].tolist()))
    out = []
    point = None
    ends: dict[tuple[int, int], int] = {}
    for doc, template, diagonal in sorted(found):
        model = index.words[template]
        if diagonal + len(model) // 2 < ends.get((doc, template), -1):
            continue  # another hit on a match that is known
        a = max(int(words.first[doc]), diagonal - BAND, ends.get((doc, template), 0))
        b = min(int(words.first[doc + 1]), diagonal + len(model) + BAND)
        if _within(model, hashes[a:b], diagonal - a) < LEAST_COVERAGE * len(model):
            continue
        _, matched, first, end = align(model, hashes[a:b], diagonal - a)
        if matched < LEAST_COVERAGE * len(model):
            continue
        ends[doc, template] = a + end
        if point is None:
            point = np.append(0, np.cumsum((texts.data & 0xC0) != 0x80))
        zero = point[texts.offsets[doc]]
        own = int(words.first[doc])
        out.append((doc, template, matched / len(model), matched, a + first - own, a + end - own, int(point[words.start[a + first]] - zero), int(point[words.end[a + end - 1]] - zero)))
    return out


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each match: columns as in RESULT; places count from the document's start, ends are exclusive."""
    index = index_of(templates)
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, rows = batch.column("doc_id"), []
        for first, _, texts in tk.blocks(tk.texts_of(batch.column("text"))):
            rows += [(ids[first + d].as_py(), index.names[t], *rest) for d, t, *rest in scan(texts, index)]
        if not rows:
            return None
        kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5)
        return pa.record_batch({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})

    return over_batches(documents(docs), run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
