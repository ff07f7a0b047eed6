"""License scans: winnowed fingerprints find candidates, banded alignment reports what matched (operator 1).

Templates are cut into runs of three words; of every two neighbouring runs the smaller hash is kept, and all of them
form an inverted index, whose size is that of the templates. Texts are winnowed alike, so a passage of four words or
more in common shares a fingerprint. Hits of a template that lie close together are a candidate; its words are aligned
with the template's in a band around their diagonals, which gives the matched words and the span in the text. Whole
license texts are matched by the longest common subsequence with a window of the text, on the bits of one number.
Notices must also say name, kind and version, and of licenses that claim the same span the best one is reported.

Null, empty and word-free texts have no match and no row. Repeated rows are reported as often as they occur. A null
doc_id stays null. Of matches of one worth, the first template by name and place wins. Very long texts are read whole,
in memory that follows the text and the width of a band. An empty table gives no rows. Only doc_id and text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import Memo, map_rows, shingle_hashes, table

#: Words of a fingerprint, and neighbouring fingerprints of which one is kept.
GRAM = 3
WINDOW = 2
#: Share of a template's words that must be matched in order, and words that may be inserted or left out: a quarter
#: of a template's, three at least and BAND at most.
COVERAGE = 0.8
BAND = 12
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Templates of more words are aligned as a whole, with up to an eighth of their words put in.
LONG = 64
#: Whole texts of public licenses, from the first word that all copies share; the files in ``license_texts``.
TEXTS = (
    "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES = {n: pkgutil.get_data(__package__, f"license_texts/{n}.txt").decode() for n in TEXTS}
#: First parts of licenses, which are often quoted alone; within the whole text they are not reported.
TEMPLATES |= {
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: What a passage must say to be a notice or header of its license and not of a neighbour: name, kind and version.
IDENTITY = {"GPL-3.0": "gnu general public license version 3"}  # the AGPL has nearly the same text


def _add(name: str, text: str, identity: str) -> None:
    TEMPLATES[name], IDENTITY[name] = text, identity


_add("MIT-notice", "Released under the MIT License.", "mit license")
_add("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "license 2")
for _v in ("1.1", "2.0"):
    _add(f"Apache-{_v}-notice", f"Licensed under the Apache License, Version {_v}.", f"apache license (version )?{_v.removesuffix('.0')}")
    _text = {"1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", "2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."}[_v]
    _add(f"MPL-{_v}-header", _text, f"mozilla public license v(ersion)? {_v.removesuffix('.0')}")
for _short, _kind, _versions in (("GPL", "", "123"), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", "3")):
    for _v in _versions:
        _full = _v if "." in _v else f"{_v}.0"
        _said = f"gnu {_kind.lower()}general public license"
        _add(f"{_short}-{_full}-notice", f"This work is licensed under the GNU {_kind}General Public License, version {_v}.", f"{_said} (version )?{_v}")
        _add(
            f"{_short}-{_full}-header",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version.",
            f"{_said} .*version {_v}",
        )
for _kind, _long in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _v, _where in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _end = _v.removesuffix(".0")
        _add(f"CC-{_kind}-{_v}-notice", f"Licensed under CC {_kind} {_v}.", f"cc {_kind.lower().replace('-', ' ')} {_end}")
        _add(f"CC-{_kind}-{_v}", f"This work is licensed under a Creative Commons {_long} {_v} {_where} License.", f"creative commons {_long.lower().replace('-', ' ')} {_end}")

_HASHES = Memo(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words], 400_000)


def lower(text: str) -> str:
    """The text in lower case; characters whose small form is longer stay, so that places are those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def words_of(low: str) -> list[str]:
    """The words of a lower-case text; 3.0 and 3 are one version."""
    return [w.removesuffix(".0") for w in WORD.findall(low)]


def winnowed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints of a sequence of words."""
    h = shingle_hashes(np.fromiter(_HASHES.look(words), np.uint64, len(words)), GRAM)
    if len(h) <= WINDOW:
        at = np.arange(len(h))[:1] if len(h) < 2 else np.array([int(h.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.unique(view.argmin(1) + np.arange(len(view)))
    return at, h[at]


class Index:
    """Inverted index from fingerprints to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [words_of(templates[n].lower()) for n in self.names]
        self.bags = [Counter(w) for w in self.words]
        self.identity = [re.compile(rf"\b{IDENTITY[n]}\b") if n in IDENTITY and templates[n] == TEMPLATES[n] else None for n in self.names]
        self.bits: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            h = shingle_hashes(np.fromiter(_HASHES.look(words), np.uint64, len(words)), GRAM)
            for p, x in enumerate(h.tolist()):  # all runs, so that a text's kept ones are found wherever it cuts in
                self.places[x].append((t, p))
        self.keys = np.array(sorted(self.places), np.uint64)
        self.band = [max(BAND, len(w) // 8) if len(w) > LONG else min(BAND, max(3, len(w) // 4)) for w in self.words]

    def candidates(self, words: list[str], coverage: float) -> list[tuple[int, int, int]]:
        """(template, lowest diagonal, highest diagonal) of hits that lie close together, of templates whose words the
        text can cover at all."""
        at, h = winnowed(words)
        near = self.keys[np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)] == h
        if not near.any():
            return []
        bag = Counter(words)
        able: dict[int, bool] = {}
        hits = []
        for p, x in zip(at[near].tolist(), h[near].tolist()):
            for t, q in self.places[x]:
                if t not in able:
                    able[t] = len(words) >= coverage * len(self.words[t]) and self.covers(t, bag, coverage)
                if able[t]:
                    hits.append((t, p - q))
        out: list[list[int]] = []
        for t, d in sorted(set(hits)):
            # texts and templates repeat themselves, so hits may lie on many diagonals; groups are of one band at most, and
            # an alignment, whose diagonals lie within a band, is found with the group of its lowest hit
            if out and out[-1][0] == t and d - out[-1][1] <= self.band[t]:
                out[-1][2] = d
            else:
                out.append([t, d, d])
        return [tuple(x) for x in out]

    def covers(self, t: int, bag: Counter, coverage: float) -> bool:
        """False when so many words of the template can't be matched, in whatever order."""
        return sum(min(n, bag[w]) for w, n in self.bags[t].items()) >= coverage * len(self.words[t])

    def match(self, t: int, words: list[str], lowest: int, highest: int, coverage: float) -> tuple[int, int, int]:
        """(matched words, first, behind the last) of the best alignment near these diagonals."""
        low, high = lowest - self.band[t], highest + self.band[t]
        template = self.words[t]
        if len(template) <= LONG:
            return align(template, words, low, high)
        start, stop = max(0, low), min(len(words), high + len(template))
        part = words[start:stop]
        if not self.covers(t, Counter(part), coverage):
            return 0, -1, -1
        if t not in self.bits:
            self.bits[t] = places(template), places(template[::-1])
        m, behind = subsequence(self.bits[t][0], len(template), part)
        if m < coverage * len(template):
            return m, -1, -1
        return m, stop - subsequence(self.bits[t][1], len(template), part[::-1])[1], start + behind


def places(template: list[str]) -> dict[str, int]:
    """For each word a number whose bits are its places."""
    out: dict[str, int] = {}
    for k, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << k
    return out


def subsequence(at: dict[str, int], size: int, words: list[str]) -> tuple[int, int]:
    """(length, behind the last word) of the longest common subsequence of a template and ``words``."""
    full = v = (1 << size) - 1
    m = behind = 0
    for k, w in enumerate(words):
        u = v & at.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
            if size - v.bit_count() > m:
                m, behind = m + 1, k + 1
    return m, behind


def best_of_each_span(found: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of matches (template, first, behind, matched) that share more than half of the shorter one, or any word if they are
    of one template, the one that explains most words with the fewest others."""
    def worth(x: tuple[int, int, int, int]) -> float:
        t, first, behind, m = x
        return m * (2 * m / (sizes[t] + behind - first)) ** 4

    out: list[tuple[int, int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (-worth(x), x)):
        t, first, behind, _ = x
        for u, a, b, _ in out:
            shared = min(b, behind) - max(a, first)
            if shared > 0 and (t == u or 2 * shared > min(b - a, behind - first)):
                break
        else:
            out.append(x)
    return sorted(out)


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, behind the last) of the longest common subsequence on diagonals from ``low`` to ``high``."""
    best: list[tuple[int, int, int]] = [(0, -1, -1)] * (high - low + 2)
    for i, word in enumerate(template):
        row = [(0, -1, -1)] * (high - low + 2)
        left = (0, -1, -1)
        for d in range(low, high + 1):
            j = i + d
            k = d - low
            x = max(left, best[k + 1], key=lambda c: (c[0], c[1] - c[2]))
            if 0 <= j < len(words) and words[j] == word:
                m, first, _ = best[k]
                y = (m + 1, first if m else j, j + 1)
                x = max(y, x, key=lambda c: (c[0], c[1] - c[2]))
            row[k] = left = x
        best = row
    return max(best, key=lambda c: (c[0], c[1] - c[2]))


_INDEXES: dict[int, Index] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, template_words, matched_words, coverage, start, end, passage) of every match in ``docs``.

    ``start`` and ``end`` are code points of the text; of matches that share a span the best one is reported.
    """
    templates = templates or TEMPLATES
    key = hash(tuple(sorted(templates.items())))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        if key not in _INDEXES:
            _INDEXES[key] = Index(templates)
        index = _INDEXES[key]
        names = ("doc_id", "license", "template_words", "matched_words", "coverage", "start", "end", "passage")
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                low = lower(text or "")
                words = words_of(low)
                found = []
                for t, lowest, highest in index.candidates(words, coverage) if words else []:
                    m, first, behind = index.match(t, words, lowest, highest, coverage)
                    named = index.identity[t]
                    if m >= coverage * len(index.words[t]) and (not named or named.search(" ".join(words[first:behind]))):
                        found.append((t, first, behind, m))
                if not found:
                    continue
                spans = [x.span() for x in WORD.finditer(low)]
                for t, first, behind, m in best_of_each_span(found, [len(w) for w in index.words]):
                    a, b = spans[first][0], spans[behind - 1][1]
                    rows.append((i, index.names[t], len(index.words[t]), m, m / len(index.words[t]), a, b, text[a:b]))
            yield dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    schema = "doc_id long, license string, template_words long, matched_words long, coverage double, start long, end long, passage string"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
