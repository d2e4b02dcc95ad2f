"""Operator 3: license scans.

Words are compared without the punctuation at their edges.  A template's text is cut into windows of
1, 2, 4 .. 32 word shingles (the largest size that it has room for), each document's text into windows of
the same sizes that overlap by seven eighths; the last one ends with the text, and a shorter text is one
window.  What matches in a text depends on that text alone.  Windows with a MinHash band in common with a
template's window retrieve the template.  With ``BANDS`` bands of ``ROWS`` hashes, windows that share 0.6 of their
shingles meet with a probability of 1 - (1 - 0.6**2)**16 > 0.999.  A retrieved template matches when the
document holds 0.75 or more of its distinct 5-word shingles, counted exactly.

Templates are the statements of ``TEMPLATES``, the notices of ``NOTICES`` and the whole texts in
``license_texts``.  Of two that match and are much alike (BSD of two and three clauses, GPL and AGPL), one
must show ``OWN`` of what sets it apart from the other, or the other stays alone.  Names of licenses
in short phrases of up to six words ("under the MIT License") and SPDX lines match word by word; they are
reported with one shingle, phrases only where no other match covers them.

Null or empty text: no match.  Null doc_id: reported as null.  Repeated rows: each is reported.  Ties:
of matches much alike that show the same of what sets them apart, the one with more shingles stays, then
the one that comes first.  Very long texts: windows are taken over the whole text.  Empty table: an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import text_slices
from .shingles import core_words, shingle

SHINGLE, CONTAINED = 5, 75
BANDS, ROWS, LONGEST = 16, 2, 32
#: Places of the filter before a table of keys; a power of two.
FILTER = 1 << 18
#: Most characters of a library of templates, which every worker holds.
MOST_TEMPLATE_CHARS = 1 << 26
MATCHES = "doc_id long, license string, containment double, n_shared long, n_template long, first_word long, last_word long"
#: The share, in percent, of the shingles that a match has and a better one much like it has not.
OWN = 50


def plain(text: str) -> str:
    """A text without the ASCII punctuation at the edges of its words, as it is compared."""
    return " ".join(w for w in (w.strip(string.punctuation) for w in text.split()) if w)


#: Statements and notices of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
}
TEMPLATES = {name: plain(text) for name, text in TEMPLATES.items()}

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {0} {1} License."
#: More notices, told from their like by ``OWN``.
NOTICES = {
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": "This program is free software; " + _GNU.format("General", "2"),
    "GPL-2.0-only-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-3.0-only-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "LGPL-2.0-notice": "This library is free software; " + _GNU.format("Library General", "2"),
    "LGPL-2.1-notice": "This library is free software; " + _GNU.format("Lesser General", "2.1"),
    "LGPL-3.0-notice": "This program is free software: " + _GNU.format("Lesser General", "3"),
    "AGPL-3.0-notice": "This program is free software: " + _GNU.format("Affero General", "3"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MPL-1.1-notice": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."
    ),
    "EPL-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-notice": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "GFDL-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "CC0-1.0-notice": "has waived all copyright and related or neighboring rights to this work",
    "PSF-notice": "made available subject to the terms and conditions in the Python Software License Agreement",
    **{
        f"CC-{code}-{version}-notice": _CC.format(name, version + place)
        for version, place in (("4.0", " International"), ("3.0", " Unported"))
        for code, name in {
            "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
        if f"CC-{code}-{version}-notice" not in TEMPLATES
    },
}

#: Names of licenses, and the words that make a name a notice.
NAMES = {
    "MIT": ("mit license", "mit licence", "expat license", "mit"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache 2.0 license", "apache 2.0", "apache-2.0", "apache-2.0 license", "apache software license 2.0"),
    "GPL": ("gnu general public license", "gnu gpl", "gpl"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2.0", "gnu general public license v2", "gnu gpl version 2", "gnu gplv2", "gnu gpl v2", "gplv2", "gpl v2", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl version 2", "gplv2+"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3.0", "gnu general public license v3", "gnu gpl version 3", "gnu gplv3", "gnu gpl v3", "gplv3", "gpl v3", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl version 3", "gplv3+"),
    "LGPL": ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "gnu lgpl v2.1", "lgpl v2.1", "lgplv2.1", "lgpl-2.1", "lgpl 2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl v3", "lgplv3", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"),
    "AGPL-3.0": ("gnu affero general public license", "gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl", "agpl", "agplv3", "agpl v3", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v2.0", "mozilla public license v 2.0", "mpl 2.0", "mpl-2.0", "mpl v2.0"),
    "MPL": ("mozilla public license", "mpl"),
    "EPL-2.0": ("eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license version 2.0", "epl 2.0", "epl-2.0"),
    "BSD": ("bsd license", "bsd-style license", "bsd"),
    "BSD-2-Clause": ("bsd 2-clause license", "2-clause bsd license", "bsd-2-clause license", "bsd-2-clause", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3-clause license", "3-clause bsd license", "bsd-3-clause license", "bsd-3-clause", "new bsd license", "modified bsd license"),
    "ISC": ("isc license", "isc"),
    "Unlicense": ("unlicense",),
    "Zlib": ("zlib license", "zlib"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license", "bsl-1.0"),
    "CC0-1.0": ("cc0 1.0", "cc0 1.0 universal", "cc0", "cc0-1.0"),
    **{
        f"CC-{code}-{version}": tuple(f"{x} {version}" for x in (f"cc {code.lower()}", f"cc-{code.lower()}")) + (f"cc-{code.lower()}-{version}",)
        for code in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
        for version in ("4.0", "3.0", "2.0")
    },
}
FRAMES = ("under {}", "under the {}", "under a {}", "under an {}", "terms of the {}", "license {}", "licence {}", "licensed {}", "osi approved {}")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_SPDX_TERM = re.compile(r"[\s(]*([A-Za-z0-9][A-Za-z0-9.+:-]*)(?:\s+WITH\s+[A-Za-z0-9.+-]+)?[\s)]*(?:\b(?:AND|OR)\b)?")


def whole_texts() -> dict[str, str]:
    """The texts of ``license_texts``, by name."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return {f.name[:-4] + "-full": f.read_text("utf-8") for f in files}


def spdx_lines(text: str):
    """(license, first word, last word) of the identifiers in the SPDX lines of a text."""
    for m in _SPDX.finditer(text):
        first = len(text[: m.start()].split())
        rest, at = m[1], 0
        while True:
            t = _SPDX_TERM.match(rest, at)
            if not t:
                break
            yield t[1].rstrip("."), first, len(text[: m.start(1) + t.end(1)].split()) - 1
            at = t.end()
            if not t[0].rstrip().endswith(("AND", "OR")):
                break


_rng = np.random.default_rng(0x11CE)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Phrases:
    """Short phrases, matched word by word."""

    def __init__(self, names: dict[str, tuple[str, ...]]):
        by_size: dict[int, list] = {}
        for name, all_names in names.items():
            for phrase in {f.format(n) for n in all_names for f in FRAMES}:
                words, _, _ = core_words([phrase])
                by_size.setdefault(len(words), []).append((int(shingle(words, len(words))[0]), f"{name}-named"))
        self.tables = []
        for size in sorted(by_size, reverse=True):
            keys, owners = zip(*sorted(by_size[size]), strict=True)
            seen = np.zeros(FILTER, bool)
            keys = np.array(keys, np.uint64)
            seen[(keys & np.uint64(FILTER - 1)).astype(np.int64)] = True
            self.tables.append((size, keys, owners, seen))

    def find(self, words: np.ndarray):
        """(place, size, name), longest phrases first."""
        for size, keys, owners, seen in self.tables:
            got = shingle(words, size)
            here = np.flatnonzero(seen[(got & np.uint64(FILTER - 1)).astype(np.int64)])
            at = np.searchsorted(keys, got[here])
            at[at == len(keys)] = 0
            for p, k in zip(here[keys[at] == got[here]].tolist(), at[keys[at] == got[here]].tolist(), strict=True):
                yield p, size, owners[k]


class Windows:
    """The windows of ``size`` shingles in each of several texts, whose words begin at ``at``.

    Each text has its own: they begin ``stride`` apart, the last one ends with the text, and a text of
    fewer shingles is one window.  ``levels`` has, for each power of two, the windows that are as long as
    that but not twice as long, and the first place of the first and of the last run of that length."""

    def __init__(self, at: np.ndarray, size: int, stride: int):
        held = np.maximum(np.diff(at) - SHINGLE + 1, 0)
        spare = np.maximum(held - size, 0)
        counts = np.where(held > 0, -(-spare // stride) + 1, 0)
        self.text = np.repeat(np.arange(len(held)), counts)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = at[:-1][self.text] + np.minimum(nth * stride, spare[self.text])
        length = np.minimum(held, size)[self.text]
        self.levels = []
        step = 1
        while step <= size:
            some = np.flatnonzero((length >= step) & ((length < 2 * step) | (step == size)))
            self.levels.append((some, first[some], first[some] + length[some] - step))
            step *= 2


class Scanner:
    def __init__(self, templates: dict[str, str], names: dict[str, tuple[str, ...]] | None = None):
        self.names = list(templates)
        self.phrases = Phrases(names) if names else None
        words, at, _ = core_words([templates[n] for n in self.names])
        ordered = [shingle(words[a:b], SHINGLE) for a, b in zip(at[:-1], at[1:], strict=True)]
        if not all(len(s) for s in ordered):
            raise ValueError(f"a template has {SHINGLE} words at least")
        self.sets = [np.unique(s) for s in ordered]
        # templates that share half of the shingles of either are alike
        self.alike: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            for j in range(k):
                if 2 * len(np.intersect1d(s, self.sets[j], True)) >= min(len(s), len(self.sets[j])):
                    self.alike.setdefault(k, []).append(j)
                    self.alike.setdefault(j, []).append(k)
        sizes = [1 << min(len(s).bit_length() - 1, LONGEST.bit_length() - 1) for s in ordered]
        self.sizes = sorted(set(sizes))
        self.index: dict[tuple[int, int], tuple] = {}
        for size in self.sizes:
            held = [(k, s) for k, (s, z) in enumerate(zip(ordered, sizes, strict=True)) if z == size]
            for band in range(self._bands(size)):
                keys, owners = [], []
                for k, s in held:
                    got = self._band(s, band, Windows(np.array([0, len(s) + SHINGLE - 1]), size, 1))
                    keys.append(got)
                    owners.append(np.full(len(got), k))
                keys, owners = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(FILTER, bool)
                seen[(keys & np.uint64(FILTER - 1)).astype(np.int64)] = True
                self.index[size, band] = keys[order], owners[order], seen

    @staticmethod
    def _bands(size: int) -> int:
        return BANDS if size > 1 else 1

    @staticmethod
    def _minima(shingles: np.ndarray, k: int, windows: Windows) -> np.ndarray:
        """The minimum of hash k over each window: over its first and its last power of two, by doubling."""
        m = (shingles ^ _XOR[k]) * _MUL[k]
        out = np.empty(len(windows.text), np.uint64)
        step = 1
        for some, first, last in windows.levels:
            if len(some):
                out[some] = np.minimum(m[first], m[last])
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        return out

    def _band(self, shingles: np.ndarray, band: int, windows: Windows) -> np.ndarray:
        out = self._minima(shingles, band * ROWS, windows)
        for k in range(band * ROWS + 1, (band + 1) * ROWS):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self._minima(shingles, k, windows)
        return out ^ (out >> np.uint64(32))

    def _retrieve(self, every: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(text, template) that have a band in common."""
        found = [np.zeros(0, np.int64)]
        for size in self.sizes:
            windows = Windows(at, size, max(1, size // 8))
            if not len(windows.text):
                continue
            for band in range(self._bands(size)):
                keys, owners, seen = self.index[size, band]
                got = self._band(every, band, windows)
                here = np.flatnonzero(seen[(got & np.uint64(FILTER - 1)).astype(np.int64)])
                low, high = np.searchsorted(keys, got[here], "left"), np.searchsorted(keys, got[here], "right")
                n = high - low
                if n.any():
                    some = owners[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    found.append(np.unique(np.repeat(windows.text[here], n) * len(self.names) + some))
        return [divmod(x, len(self.names)) for x in np.unique(np.concatenate(found)).tolist()]

    def _tell_apart(self, held: dict[int, np.ndarray]) -> None:
        """Drop matches that show less than a match much like them of what sets the two apart."""
        for k in sorted(held, key=lambda k: (len(held[k]), -k)):
            for j in self.alike.get(k, ()):
                if j in held:
                    own, other = np.setdiff1d(self.sets[k], self.sets[j], True), np.setdiff1d(self.sets[j], self.sets[k], True)
                    if not len(own):
                        continue
                    mine, theirs = (int(np.isin(x, held[y]).sum()) for x, y in ((own, k), (other, j)))
                    if 100 * mine < OWN * len(own) and (not len(other) or mine * len(other) <= theirs * len(own)):
                        del held[k]
                        break

    def scan(self, texts: list[str]):
        """(text, license, shared, of, first word, last word) of all matches."""
        words, at, number = core_words(texts)
        every = shingle(words, SHINGLE)
        covered = np.zeros(len(words), bool)
        by_text: dict[int, list[int]] = {}
        for text, k in self._retrieve(every, at):
            by_text.setdefault(text, []).append(k)
        for text, some in by_text.items():
            a, b = int(at[text]), int(at[text + 1])
            mine = every[a : max(a, b - SHINGLE + 1)]
            held, places = {}, {}
            for k in some:
                p = np.flatnonzero(np.isin(mine, self.sets[k]))
                shared = np.unique(mine[p])
                if len(shared) and 100 * len(shared) >= CONTAINED * len(self.sets[k]):
                    held[k], places[k] = shared, p
            self._tell_apart(held)
            for k, shared in held.items():
                p = places[k]
                for word in range(SHINGLE):
                    covered[a + p + word] = True
                yield text, self.names[k], len(shared), len(self.sets[k]), int(number[a + p[0]]), int(number[a + p[-1] + SHINGLE - 1])
        if self.phrases is None:
            return
        for text, t in enumerate(texts):
            if "SPDX-License-Identifier" in t:
                firsts: dict[str, tuple[int, int]] = {}
                for name, first, last in spdx_lines(t):
                    firsts.setdefault(name, (first, last))
                    inside = (number[at[text] : at[text + 1]] >= first) & (number[at[text] : at[text + 1]] <= last)
                    covered[at[text] : at[text + 1]][inside] = True
                for name, (first, last) in firsts.items():
                    yield text, f"{name}-SPDX", 1, 1, first, last
        named: dict[tuple[int, str], list[int]] = {}
        for p, size, name in self.phrases.find(words):
            text = int(np.searchsorted(at, p, "right")) - 1
            if p + size <= at[text + 1] and not covered[p : p + size].all():
                covered[p : p + size] = True
                ends = int(number[p]), int(number[p + size - 1])
                span = named.setdefault((text, name), [*ends])
                span[:] = min(span[0], ends[0]), max(span[1], ends[1])
        for (text, name), (first, last) in named.items():
            yield text, name, 1, 1, first, last


@lru_cache(1)
def _default() -> Scanner:
    return Scanner(TEMPLATES | NOTICES | whole_texts(), NAMES)


def template_table(spark: SparkSession) -> DataFrame:
    """The library of templates as a table: license, text."""
    rows = list((TEMPLATES | NOTICES | whole_texts()).items())
    return spark.createDataFrame(rows, "license string, text string")


def templates_of(table: DataFrame) -> dict[str, str]:
    """A table of license and text on the driver; one of more than ``MOST_TEMPLATE_CHARS`` is refused."""
    held = table.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL")
    if (held.agg(F.sum(F.char_length("text"))).first()[0] or 0) > MOST_TEMPLATE_CHARS:
        raise ValueError(f"a library of templates has {MOST_TEMPLATE_CHARS} characters at most")
    return {r["license"]: r["text"] for r in held.orderBy("license").collect()}


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row for each document and license text, notice, phrase or SPDX identifier that it holds;
    with ``templates`` (a dictionary, or a table of license and text), for each of these alone."""
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)

    def run(batches):
        scanner = Scanner(templates) if templates else _default()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            rows = []
            for a, b in text_slices(texts):
                for t, name, shared, n, first, last in scanner.scan(texts[a:b]):
                    rows.append((ids[a + t], name, shared / n, shared, n, first, last))
            names = [x.split()[0] for x in MATCHES.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, MATCHES)
