"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Words are runs of letters, digits, apostrophes and non-ASCII bytes, lower-cased A-Z. Every template's
``GRAM``-word hashes are winnowed (the least hash of each ``WINDOW`` consecutive ones) into an inverted
index (hash -> template, place), whose size depends on the templates alone. A document's
winnowed hashes are looked up in it: a run of GRAM + WINDOW - 1 words shared with a template always gives a hit.
A match may share no such run, so each template also has key words: its rarest ones, one more than a match
may miss. Every match has one of them at its place, so every document word is looked up among the key words,
and no match depends on which grams were winnowed. A hit counts if the words around it that occur in the
template are as many as a match needs.
Hits of one template whose diagonals (document place - template place) lie within the band of each other
and that are no farther apart than the template is long form a candidate region, and the template's
words are aligned to it within the band around these diagonals, document ends free. The band is a third of
the template's words, at most ``BAND``. A match
is reported if at least ``LEAST_COVERAGE`` of the template's words are equal in the alignment; of matches
that overlap by half, the one with more matched words (then higher coverage, then name) stays.
The words that tell licenses apart (``NAMES``, and the numbers of a template) must all be equal in the alignment,
and the matched words may hold no other name and no longer version number; else nothing is reported, so
a license without a template gets no other license's name.

The scan is map only: no shuffle, one text's candidates at a time.

Defined results: null and empty texts match nothing; a template repeated in a text is reported each
time; repeated rows are reported alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm import textops as T

GRAM, WINDOW = 3, 3
BAND = 8
LEAST_COVERAGE = 0.8
#: Words of everyday texts, commonest first: the last choice for a template's key words. ("mit" is German.)
COMMON = (
    "the of and to in a is that it for was on as with be by this are at an from or not any no all may if mit work must have copy following "
    "you use can provided other under more free see public general 0 1 2 3 4 version file without including"
).split()

#: Names and versions: a license is reported only if those of its template and of the matched words are the same.
#: (Numbers of a template count too, and a number that goes on from another one, as in 2.1.)
NAMES = frozenset(
    "mit apache gpl lgpl agpl gnu lesser affero mozilla mpl bsd isc cc cc0 sa nc nd sharealike noncommercial noderivatives noderivs attribution "
    "boost eclipse epl unlicense zlib artistic wtfpl beerware cddl eupl either later".split()
)
#: A name as well, but only as the first of these two words ("GNU Library General Public License").
NAME_BEFORE = ["library", "general"]

_GNU_HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {license}General Public License as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
_GNU_ONLY = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {license}General Public License as published by the "
    "Free Software Foundation, version {version} of the License."
)


def _gnu(name: str, versions: list[str], what: str, license: str) -> dict[str, list[str]]:
    """Notices of one GNU license by SPDX identifier: the standard header, and one-line notes."""
    found = {}
    for version in versions:
        full, short = (version, version.removesuffix(".0"))
        line = f"licensed under the GNU {license}General Public License, version {short}"
        found[f"{name}-{full}-only"] = [_GNU_ONLY.format(what=what, license=license, version=short), f"This work is {line}."]
        found[f"{name}-{full}-or-later"] = [_GNU_HEADER.format(what=what, license=license, version=short), f"This work is {line} or later."]
    return found


def _creative(name: str, parts: str) -> dict[str, list[str]]:
    """Notices of one Creative Commons license in its versions."""
    found = {}
    for version, kind in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        found[f"CC-{name}-{version}"] = [
            f"Licensed under CC {name} {version}.",
            f"This work is licensed under a Creative Commons {parts} {version} {kind} License.",
        ]
    return found


_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    f"{_BSD}: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_CLAUSE_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)

# Short and standard notices, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
    ],
    **_gnu("GPL", ["2.0", "3.0"], "program", ""),
    **_gnu("LGPL", ["2.1", "3.0"], "library", "Lesser "),
    **_gnu("LGPL", ["2.0"], "library", "Library "),
    **_gnu("AGPL", ["3.0"], "program", "Affero "),
    # The first lines of both BSD licenses are the same, so by themselves they are not evidence of either.
    "BSD-2-Clause OR BSD-3-Clause": [_BSD],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD_2],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", f"{_BSD_2} {_BSD_CLAUSE_3}"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    **_creative("BY", "Attribution"),
    **_creative("BY-SA", "Attribution-ShareAlike"),
    **_creative("BY-NC", "Attribution-NonCommercial"),
    **_creative("BY-ND", "Attribution-NoDerivatives"),
    **_creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    **_creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
}

_CODES = T.fold_table(lower=True)
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Cost of an edit of a name or version: more than all other edits of a template.
_NEVER = 1 << 20


def winnowed(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places (first word) of the winnowed grams of consecutive texts; ``of``: each word's text."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = T.mix(grams * _STEP + words[k : k + n])
    whole = of[:n] == of[GRAM - 1 :]
    place = np.flatnonzero(whole)
    grams, of = grams[place], of[place]
    chosen = np.zeros(len(place), bool)
    # The least gram of every window inside one text; texts with fewer grams are one window.
    size = np.bincount(np.unique(of, return_inverse=True)[1])
    last = np.repeat(np.cumsum(size), size)
    start = last - np.repeat(size, size)
    index = np.arange(len(place))
    first = np.minimum(index, np.maximum(last - WINDOW, start))
    best = first.copy()
    for k in range(1, WINDOW):
        other = np.minimum(first + k, last - 1)
        best = np.where(grams[other] <= grams[best], other, best)
    chosen[best] = True
    return place[chosen]


def gram_hashes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    grams = np.zeros(len(places), np.uint64)
    for k in range(GRAM):
        grams = T.mix(grams * _STEP + words[places + k])
    return grams


@dataclass(frozen=True)
class Index:
    """Templates as word hashes, the inverted index over their winnowed grams, and that over their key
    words. ``least`` is the smallest coverage for which the key words suffice."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray  # sorted
    template: np.ndarray
    place: np.ndarray
    key_hashes: np.ndarray  # sorted
    key_template: np.ndarray
    key_place: np.ndarray
    vocabulary: np.ndarray  # sorted hashes of all template words
    member: np.ndarray  # (templates, vocabulary): which words a template holds
    distinct: list[np.ndarray]  # per template: which of its words are names or numbers
    names_hashed: np.ndarray  # sorted hashes of NAMES
    least: float

    @staticmethod
    def of(templates: dict[str, list[str]], least: float = LEAST_COVERAGE) -> Index:
        names, words, hashes, numbers, places = [], [], [], [], []
        keys: list[tuple[int, int, int]] = []
        distinct: list[np.ndarray] = []
        named = np.sort(_word_hashes(pa.array(sorted(NAMES)))[0])
        common = {h: i for i, h in enumerate(reversed(_word_hashes(pa.array(COMMON))[0].tolist()), 1)}
        for name, texts in templates.items():
            for text in texts:
                found, _, (starts, ends, _) = _word_hashes(pa.array([text]))
                distinct.append(_named(found, named) | _numbers(T.string_buffers(pa.array([text]))[0], starts, ends))
                at = winnowed(found, np.zeros(len(found), np.int64))
                if not len(at):
                    raise ValueError(f"a template of {name} has under {GRAM} words")
                hashes.append(gram_hashes(found, at))
                numbers.append(np.full(len(at), len(names)))
                places.append(at)
                rare = sorted(range(len(found)), key=lambda i: (common.get(int(found[i]), 0), starts[i] - ends[i], i))
                keys += [(int(found[i]), len(names), i) for i in rare[: len(found) - needed(len(found), least) + 1]]
                names.append(name)
                words.append(found)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        keys.sort()
        key_hashes = np.array([k[0] for k in keys], np.uint64)
        vocabulary = np.unique(np.concatenate(words))
        member = np.stack([np.isin(vocabulary, w) for w in words])
        return Index(
            names, words, every[order], np.concatenate(numbers)[order], np.concatenate(places)[order],
            key_hashes, np.array([k[1] for k in keys]), np.array([k[2] for k in keys]), vocabulary, member, distinct, named, least,
        )


def needed(length: int, least: float) -> int:
    """Equal words that a match of a template of ``length`` words needs."""
    return max(1, int(np.ceil(least * length - 1e-9)))


def _named(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which words tell licenses apart by name."""
    first, second = _word_hashes(pa.array(NAME_BEFORE))[0]
    found = np.isin(words, names)
    found[:-1] |= (words[:-1] == first) & (words[1:] == second)
    return found


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are numbers of at most two digits."""
    first, last = data[starts], data[np.maximum(ends, 1) - 1]
    return (ends - starts <= 2) & (first >= 48) & (first <= 57) & (last >= 48) & (last <= 57)


def _others(index: Index, words: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words lo to hi: which no other license may hold (names, and numbers that go on from
    another one, but for .0), and which of them are such numbers."""
    names = _named(words[lo : hi + 1], index.names_hashed)[: hi - lo]
    numbers = _numbers(data, starts[lo:hi], ends[lo:hi])
    goes_on = np.zeros(hi - lo, bool)
    goes_on[1:] = numbers[1:] & numbers[:-1] & (starts[lo + 1 : hi] == ends[lo : hi - 1] + 1) & (data[ends[lo : hi - 1]] == 46)
    goes_on &= ~((ends[lo:hi] - starts[lo:hi] == 1) & (data[starts[lo:hi]] == 48))
    return names | goes_on, goes_on


def band_of(length: int) -> int:
    return min(BAND, length // 3)


def _looked_up(places: np.ndarray, hashes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document place, index entry) of all entries of the sorted ``index`` that equal a hash."""
    low, high = np.searchsorted(index, hashes, "left"), np.searchsorted(index, hashes, "right")
    hit = high > low
    which, inner = T.runs(high[hit] - low[hit])
    return places[hit][which], low[hit][which] + inner


def _hits(index: Index, words: np.ndarray, of: np.ndarray, bounds: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, template, diagonal) of the hits around which enough words of the template occur."""
    at = winnowed(words, of)
    grams, gram_entry = _looked_up(at, gram_hashes(words, at), index.hashes)
    keys, key_entry = _looked_up(np.arange(len(words)), words, index.key_hashes)
    place = np.concatenate([grams, keys])
    template = np.concatenate([index.template[gram_entry], index.key_template[key_entry]])
    diagonal = place - np.concatenate([index.place[gram_entry], index.key_place[key_entry]])
    if not len(place):
        return place, template, diagonal
    word = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    known = index.vocabulary[word] == words
    enough = np.zeros(len(place), bool)
    for t in np.unique(template):
        mine = np.flatnonzero(template == t)
        length, seen = len(index.words[t]), np.concatenate([[0], np.cumsum(known & index.member[t][word])])
        band, row = band_of(length), of[place[mine]]
        first = np.maximum(bounds[row], diagonal[mine] - band)
        last = np.minimum(bounds[row + 1], diagonal[mine] + length + band)
        enough[mine] = seen[last] - seen[first] >= needed(length, least)
    return place[enough], template[enough], diagonal[enough]


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    data, offsets = T.string_buffers(texts)
    starts, ends, bounds = T.word_spans(data, offsets, _SEPARATORS)
    return T.span_hashes(data, starts, ends, _CODES), bounds, (starts, ends, offsets)


def align(template: np.ndarray, region: np.ndarray, centre: int, band: int, distinct: np.ndarray | None = None, other: np.ndarray | None = None) -> tuple[int, int, int]:
    """(equal words, first, last + 1 in ``region``) of the best alignment whose diagonals stay within
    ``band`` of ``centre``: fewest edits, document words before and behind free. Words of the template in
    ``distinct`` must be equal, and those of the region in ``other`` may not be left over; no equal words
    if that cannot be."""
    m, width = len(template), 2 * band + 1
    lose = [1] * m if distinct is None else np.where(distinct, _NEVER, 1).tolist()
    extra = [1] * len(region) if other is None else np.where(other, _NEVER, 1).tolist()
    template, region = template.tolist(), region.tolist()
    far = 1 << 30
    # Row i, column c: i template words and i + centre - band + c region words used.
    cost = [far] * width
    for c in range(width):
        if 0 <= centre - band + c <= len(region):
            cost[c] = 0
    equal = [0] * width
    start = [centre - band + c for c in range(width)]
    for i in range(1, m + 1):
        new_cost, new_equal, new_start = [far] * width, [0] * width, [0] * width
        for c in range(width):
            j = i + centre - band + c
            if not 0 <= j <= len(region):
                continue
            best = (far, 0, 0)
            if j >= 1 and cost[c] < far:  # template word on region word
                hit = int(template[i - 1] == region[j - 1])
                best = min(best, (cost[c] + (0 if hit else max(lose[i - 1], extra[j - 1])), -equal[c] - hit, start[c]))
            if c + 1 < width and cost[c + 1] < far:  # template word missing in the region
                best = min(best, (cost[c + 1] + lose[i - 1], -equal[c + 1], start[c + 1]))
            if c >= 1 and new_cost[c - 1] < far:  # region word more
                best = min(best, (new_cost[c - 1] + extra[j - 1], -new_equal[c - 1], new_start[c - 1]))
            new_cost[c], new_equal[c], new_start[c] = best[0], -best[1], best[2]
        cost, equal, start = new_cost, new_equal, new_start
    c = min(range(width), key=lambda c: (cost[c], -equal[c], c))
    if cost[c] >= _NEVER:
        return 0, 0, 0
    return equal[c], start[c], m + centre - band + c


def regions(places: np.ndarray, diagonals: np.ndarray, length: int, band: int) -> list[tuple[int, int]]:
    """(low, high) diagonals of groups of hits of one template in one text: near in place, within the band."""
    order = np.lexsort((places, diagonals))
    out: list[list[int]] = []  # low diagonal, high diagonal, last place
    for p, d in zip(places[order].tolist(), diagonals[order].tolist(), strict=True):
        if out and d - out[-1][0] <= band and abs(p - out[-1][2]) <= length + band:
            out[-1][1], out[-1][2] = d, p
        else:
            out.append([d, d, p])
    return [(a, b) for a, b, _ in out]


def scan_texts(index: Index, texts: pa.Array, least: float) -> list[tuple[int, str, int, int, float, int, int]]:
    """(row, license, matched words, template words, coverage, start, end) of all matches; start and end are
    character places in the text."""
    words, bounds, (starts, ends, offsets) = _word_hashes(texts)
    data, _ = T.string_buffers(texts)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if least < index.least:
        raise ValueError(f"the index is for a coverage of {index.least} or more")
    place, template, diagonal = _hits(index, words, of, bounds, least)
    if not len(place):
        return []
    order = np.lexsort((template, of[place]))
    place, template, diagonal = place[order], template[order], diagonal[order]
    cuts = np.flatnonzero(np.diff(of[place], prepend=-1) | np.diff(template, prepend=-1))
    found: dict[int, list[tuple]] = {}
    for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
        row, t = int(of[place[a]]), int(template[a])
        own = index.words[t]
        first, last = int(bounds[row]), int(bounds[row + 1])
        band = band_of(len(own))
        for low_d, high_d in regions(place[a:b], diagonal[a:b], len(own), band):
            lo, hi = max(first, low_d - band), min(last, high_d + len(own) + band)
            end = min(last, hi + 1)  # a number may go on behind
            other, goes_on = _others(index, words, data, starts, ends, lo, end)
            matched, s, e = align(own, words[lo:hi], (low_d + high_d) // 2 - lo, band + (high_d - low_d + 1) // 2, index.distinct[t], other[: hi - lo])
            if e > s and lo + e < end and goes_on[e]:
                continue
            if e > s and matched >= needed(len(own), least):
                found.setdefault(row, []).append((matched, matched / len(own), index.names[t], len(own), lo + s, lo + e))
    out = []
    for row, matches in sorted(found.items()):
        kept: list[tuple] = []
        for m in sorted(matches, key=lambda m: (-m[0], -m[1], m[2], m[4])):
            if all(2 * (min(m[5], k[5]) - max(m[4], k[4])) < min(m[5] - m[4], k[5] - k[4]) for k in kept):
                kept.append(m)
        text = texts[row].as_py().encode("utf-8", "surrogatepass")
        for matched, coverage, name, length, s, e in sorted(kept, key=lambda m: m[4]):
            start, end = int(starts[s] - offsets[row]), int(ends[e - 1] - offsets[row])
            before = len(text[:start].decode("utf-8", "replace"))
            out.append((row, name, matched, length, coverage, before, before + len(text[start:end].decode("utf-8", "replace"))))
    return out


def scan_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, least: float = LEAST_COVERAGE) -> DataFrame:
    """A row per match: doc_id, license, matched_words, template_words, coverage, start, end."""
    index = Index.of(TEMPLATES if templates is None else templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            _, offsets = T.string_buffers(texts)
            for i, j in T.chunks(offsets):
                found = scan_texts(index, texts.slice(i, j - i), least)
                if found:
                    rows, names, matched, lengths, coverage, starts, ends = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, j - i).take(pa.array(rows)), pa.array(names), pa.array(matched, pa.int64()), pa.array(lengths, pa.int64()),
                         pa.array(coverage), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                        ["doc_id", "license", "matched_words", "template_words", "coverage", "start", "end"],
                    )

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, license string, matched_words long, template_words long, coverage double, start long, end long")
