"""License texts in documents: winnowed fingerprints, then banded alignment.

The templates' winnowed word trigrams form a small inverted index (fingerprint to template and place). Every trigram of a document is
looked up in it; hits of one template on neighbouring diagonals make a candidate place. Winnowing keeps one of
any ``WINNOW`` consecutive trigrams, so a place that repeats ``WINNOW + GRAM - 1`` template words is always hit. A global-local alignment in a
band about the hit's diagonal then counts the template words matched in order and gives the span. The band grows with the template. A place is
only aligned if it holds enough of the template's words in any order. Whole texts of related licenses share most of their words: where they lie over each other,
the one with most words matched is the license. Notices and headers are reported beside the texts they stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxloom.llm.license_texts import TEXTS
from fluxloom.llm.words import PUNCTUATION, Words, sliced_words, window_keys

GRAM, WINNOW, BAND = 3, 2, 8
DRIFT = 8  # one word in so many may be left out or put in before a long template leaves its band
LEAST_COVERAGE = 0.7

# Notices by which works name their license, and the headers that files bear. Whole texts stand beside them.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    **{
        f"{name}-or-later-header": f"This {work} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        for name, work, colon, kind, version in (
            ("GPL-2.0", "program", ";", "General Public License", "2"),
            ("GPL-3.0", "program", ":", "General Public License", "3"),
            ("AGPL-3.0", "program", ":", "Affero General Public License", "3"),
            ("LGPL-2.1", "library", ";", "Lesser General Public License", "2.1"),
            ("LGPL-3.0", "program", ":", "Lesser General Public License", "3"),
        )
    },
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
TEMPLATES = NOTICES | TEXTS


class TemplateIndex:
    """Words of the templates and the winnowed fingerprints that lead to them."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = list(templates), []
        rows = []
        for t, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            words = Words(raw, np.array([len(raw)]), lower=True, gaps=PUNCTUATION)
            self.words.append(words.keys)
            keys, starts = window_keys(words.keys, words.first, GRAM)
            picked = {int(np.argmin(keys[i : i + WINNOW])) + i for i in range(max(1, len(keys) - WINNOW + 1))} if len(keys) else set()
            rows += [(int(keys[i]), t, int(starts[i])) for i in picked]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], dtype=np.uint64)
        self.template = np.array([r[1] for r in rows], dtype=np.int64)
        self.place = np.array([r[2] for r in rows], dtype=np.int64)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``keys``, index row) of all fingerprints found."""
        left, right = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = np.flatnonzero(right > left)
        count = right[found] - left[found]
        rows = np.repeat(left[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(found, count), rows


def band_of(n: int) -> int:
    return max(BAND, n // DRIFT)


def shared(template: np.ndarray, words: np.ndarray) -> int:
    """Number of template words that ``words`` hold in any order; no alignment matches more."""
    keys, count = np.unique(template, return_counts=True)
    place = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return int(np.minimum(np.bincount(place[keys[place] == words], minlength=len(keys)), count).sum())


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, start, end) of the best in-order match of template words with ``words``, template word i near words[i + shift].

    A match earns 1, a skipped word of the document inside the span costs a hundredth, so spans stay tight.
    """
    order = np.argsort(words, kind="stable")
    left, right = np.searchsorted(words[order], template, "left"), np.searchsorted(words[order], template, "right")
    # Best match that ends at a word, as 101 * matched + start (equal to its worth up to the word's place), with the start in the low bits.
    best = np.full(len(words), -1, dtype=np.int64)
    one = 101 << 32
    for i in range(len(template)):
        at = order[left[i] : right[i]]
        at = at[np.searchsorted(at, i + shift - band) : np.searchsorted(at, i + shift + band + 1)]
        if not len(at):
            continue
        before = np.full(len(at), best[: at[0]].max(initial=-1))
        if len(at) > 1:
            before[1:] = np.maximum(before[1:], np.maximum.accumulate(best[at[0] : at[-1]])[at[1:] - at[0] - 1])
        best[at] = np.maximum(best[at], np.maximum((at << 32) + at, before) + one)
    if not (best >= 0).any():
        return 0, 0, 0
    end = int(np.argmax((best >> 32) - np.where(best >= 0, np.arange(len(best)), 1 << 30)))
    start = int(best[end]) & 0xFFFFFFFF
    return ((int(best[end]) >> 32) - start) // 101, start, end + 1


def _over(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two spans share over half of the shorter one."""
    return 2 * (min(a[1], b[1]) - max(a[0], b[0])) > min(a[1] - a[0], b[1] - b[0])


def places(template: np.ndarray, own: np.ndarray, diagonals: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(matched, start, end) of every place of a text that covers ``least`` of the template, from its hits' diagonals; none lies over another."""
    n = len(template)
    if len(own) < least * n or shared(template, own) < least * n:
        return []
    band = band_of(n)
    step = max(BAND, band // 2)
    found = []
    values, count = np.unique(diagonals, return_counts=True)
    while len(values):
        d = int(values[np.argmax(count)])
        far = np.abs(values - d) > step
        values, count = values[far], count[far]
        base = max(0, d - 2 * band)
        near = own[base : d + n + 2 * band]
        if shared(template, near) >= least * n:
            matched, s, e = align(template, near, d - base, band)
            if matched >= least * n:
                found.append((matched, base + s, base + e))
    found.sort(key=lambda x: (-x[0], x[2] - x[1], x[1]))
    kept: list[tuple[int, int, int]] = []
    for place in found:
        if not any(_over(place[1:], k[1:]) for k in kept):
            kept.append(place)
    return sorted(kept, key=lambda x: x[1])


def _scan(index: TemplateIndex, least: float, whole: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in sliced_words(batch.column(1), lower=True, gaps=PUNCTUATION):
                keys, starts = window_keys(words.keys, words.first, GRAM)
                at, row = index.hits(keys)
                text = np.searchsorted(words.first, starts[at], side="right") - 1
                template = index.template[row]
                diagonal = starts[at] - words.first[text] - index.place[row]
                order = np.lexsort((diagonal, template, text))
                text, template, diagonal = text[order], template[order], diagonal[order]
                begins = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(template, prepend=-1) != 0))
                out: dict[int, list] = {}
                for lo, hi in zip(begins.tolist(), np.append(begins[1:], len(text)).tolist()):
                    t, name = int(text[lo]), index.names[template[lo]]
                    wanted = index.words[template[lo]]
                    for place in places(wanted, words.keys[words.first[t] : words.first[t + 1]], diagonal[lo:hi], least):
                        out.setdefault(t, []).append((t, name, place[0], len(wanted), *place[1:]))
                out = [o for t in out for o in _told_apart(out[t], whole)]
                rows = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(rows),
                        pa.array([o[1] for o in out], pa.string()),
                        *[pa.array([o[i] for o in out], pa.int64()) for i in (2, 3)],
                        pa.array([o[2] / o[3] for o in out], pa.float64()),
                        *[pa.array([o[i] for o in out], pa.int64()) for i in (4, 5)],
                    ],
                    ["doc_id", "license", "n_matched", "n_template", "coverage", "start_word", "end_word"],
                )

    return run


def _told_apart(found: list[tuple], whole: frozenset[str]) -> list[tuple]:
    """A text's places without those of whole texts that lie over another whole text with more words matched (or as many, of a shorter text)."""
    kept = []
    for one in sorted((o for o in found if o[1] in whole), key=lambda o: (-o[2], o[3], o[4])):
        if not any(_over(one[4:], k[4:]) for k in kept):
            kept.append(one)
    return [o for o in found if o[1] not in whole or o in kept]


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_matched, n_template, coverage, start_word, end_word): every place that covers ``least`` of a template.

    Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased A-Z and counted from 0 in the whole text; the end is
    exclusive. Of whole license texts over the same words only the one with most words matched is given. Null and empty texts have none; rows with null or repeated ids are scanned like others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(TemplateIndex(templates), least, frozenset(TEXTS)), "doc_id long, license string, n_matched long, n_template long, coverage double, start_word long, end_word long")
