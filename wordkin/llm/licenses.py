"""Licence scans with a generalised suffix automaton.

All licence texts and phrases are read, word by word, into one automaton that knows every run of words in
them. Tasks stream the words of a document through it: at every word the automaton gives the longest run
that ends there and also stands in some template (the matching statistic), with the places where it
stands. Runs of at least LONG words are matches; matches on one diagonal are one. Matches of one template
that follow each other in both texts, with gaps of at most GAP words, are chained so that the covered
words of the template are most; a chain that covers SHARE of its template is a span and gives the
template's label. Of spans that overlap, the one that covers more stays (ties: smaller label), so of two
licences that differ in one word only the better one is reported. Phrases are counted at every place
where the automaton's run ends with them.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lowered.

Defined results: a null text counts as empty: no words, no spans, no labels (empty string), score 0; a
document with a phrase has score 1, another the largest covered share of any template; equal texts get
equal results; rows are never dropped, extra columns pass through, input columns of the result's names are
replaced. A document is one task's row; its matches are kept only where words follow a template.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordkin.llm.common import with_fields

LONG = 4
GAP = 8
SHARE = 0.9

# The phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Fixed values: (label, public licence text or notice).
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at"""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at"""),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version."""),
    ("lgpl-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version."""),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", """To the extent possible under law, the person who associated CC0 with this work has waived all
        copyright and related or neighboring rights to this work."""),
]

# ASCII capitals become small, every other ASCII character that is no letter or digit becomes a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_PLAIN).split()


class LicenseAutomaton:
    """Generalised suffix automaton of word sequences, with the places of every state."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, long: int = LONG):
        self.long = long
        self.labels = [label for label, _ in templates]
        self.phrase_labels = list(phrases.values())
        texts = [split_words(t) for _, t in templates]
        wanted = [split_words(p) for p in phrases]
        if any(len(w) < 2 for w in texts + wanted):
            raise ValueError("templates and phrases need two words at least")
        self.sizes, self.phrase_sizes = [len(w) for w in texts], [len(w) for w in wanted]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        held: list[list[tuple[int, int]]] = [[]]
        pairs = []
        ends_of_phrase = {}
        for number, words in enumerate(texts + wanted):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            pairs += zip(ids, ids[1:])
            last = 0
            for place, w in enumerate(ids):
                last = self._grow(last, w, held)
                if number < len(texts):
                    held[last].append((number, place))
            if number >= len(texts):
                ends_of_phrase[number - len(texts)] = ids
        v = len(self.vocabulary)
        self.follows = np.zeros((v + 1, v + 1), bool)
        self.follows[tuple(np.array(pairs).T)] = True
        # Places of a state stand also in all states that its suffixes lead to; each is listed with the deepest one.
        places: list[set[tuple[int, int]]] = [set(p) for p in held]
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            places[self.link[s]] |= places[s]
        self.places: list[list[tuple[int, int, int]]] = [[] for _ in self.next]
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        locus = {}
        for p, ids in ends_of_phrase.items():
            s = 0
            for w in ids:
                s = self.next[s][w]
            locus.setdefault(s, []).append(p)
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            up = self.link[s]
            if self.length[s] >= long:
                deepest = [(t, e, self.length[s]) for t, e in sorted(places[s])]
                self.places[s] = deepest + [x for x in self.places[up] if x[:2] not in places[s]]
            self.ends[s] = self.ends[up] + [(p, self.phrase_sizes[p]) for p in locus.get(s, [])]

    def _grow(self, last: int, w: int, held: list) -> int:
        """Read one more word after state last; the state of the longer run."""

        def new(length: int, follow: dict[int, int], link: int) -> int:
            self.next.append(follow)
            self.length.append(length)
            self.link.append(link)
            held.append([])
            return len(self.next) - 1

        def divide(p: int, q: int) -> int:
            """The state of the run of p and w alone, split off q where q also holds longer runs."""
            if self.length[q] == self.length[p] + 1:
                return q
            short = new(self.length[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = short
            while p >= 0 and self.next[p].get(w) == q:
                self.next[p][w] = short
                p = self.link[p]
            return short

        if w in self.next[last]:
            return divide(last, self.next[last][w])
        state, p = new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = divide(p, self.next[p][w])
        return state

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest template run that ends there) wherever that is two words or more."""
        none = len(self.vocabulary)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        if len(ids) < 2:
            return
        # Only where two neighbouring words stand together in a template can a run of two end.
        hits = np.flatnonzero(self.follows[ids[:-1], ids[1:]])
        state = length = 0
        before = -2
        for i in hits.tolist():
            if i != before + 1:
                state, length = self.next[0][int(ids[i])], 1
            before = i
            w = int(ids[i + 1])
            while w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state][w]
            length += 1
            yield i + 1, state, length

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int, int]]]]:
        """(phrase, first word) of all places of phrases, and for every template (first word, last word, shift) of all
        its longest common runs of enough words; a word at i stands at i + shift in the template."""
        found: list[tuple[int, int]] = []
        open_runs: dict[tuple[int, int], list[int]] = {}
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for i, state, length in self.stream(words):
            found += [(phrase, i - size + 1) for phrase, size in self.ends[state] if size <= length]
            if length < self.long:
                continue
            for template, place, most in self.places[state]:
                key = template, place - i
                run = open_runs.get(key)
                if run and run[1] == i - 1:
                    run[1] = i
                    continue
                if run:
                    runs.setdefault(template, []).append((*run, place - i))
                open_runs[key] = [i - min(length, most) + 1, i]
        for (template, shift), run in open_runs.items():
            runs.setdefault(template, []).append((*run, shift))
        return found, runs

    def scan(self, text: str | None) -> dict:
        """Counts, labels, score and spans of one text."""
        words = split_words(text)
        found, runs = self.matches(words)
        best, spans = 0.0, []
        for template, own in runs.items():
            size = self.sizes[template]
            for first, last, covered in chains(own):
                best = max(best, covered / size)
                if covered >= SHARE * size:
                    spans.append((covered, self.labels[template], first, last, covered / size))
        spans = apart(spans)
        base = {self.phrase_labels[p] for p, _ in found}
        places = [at for _, at in found]
        return {
            "n_words": len(words),
            "n_base": len(found),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s["label"] for s in spans})),
            "score": 1.0 if found else best,
            "spans": spans,
        }


def chains(runs: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(first word, last word, covered template words) of the best chain that ends with each run.

    A run may follow another if it begins and ends behind it in both texts, at most gap words after its end; what
    overlaps counts once."""
    out: list[tuple[int, int, int]] = []
    near: list[tuple[int, int, int, int, int]] = []
    for first, last, shift in sorted(runs):
        start, covered = first, last - first + 1
        near = [n for n in near if n[1] + gap >= first - 1]
        for a, b, s, begin, before in near:
            begins, ends = min(first - a, first + shift - a - s), min(last - b, last + shift - b - s)
            if begins <= 0 or ends <= 0 or first + shift - b - s - 1 > gap:
                continue
            more = before + last - first + 1 - max(0, b - first + 1, b + s - first - shift + 1)
            if more > covered:
                start, covered = begin, more
        near.append((first, last, shift, start, covered))
        out.append((start, last, covered))
    return out


def apart(spans: list[tuple[int, str, int, int, float]]) -> list[dict]:
    """Spans without overlaps, those that cover more first; in text order."""
    kept: list[tuple[int, int, str, float]] = []
    for _, label, first, last, share in sorted(spans, key=lambda s: (-s[0], *s[1:])):
        at = bisect.bisect(kept, (first,))
        if (at == 0 or kept[at - 1][1] < first) and (at == len(kept) or kept[at][0] > last):
            kept.insert(at, (first, last, label, share))
    return [{"label": label, "first": first, "last": last, "share": share} for first, last, label, share in kept]


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, share: double>>"
)


def scan_licenses(df: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Add the columns of FIELDS to every row. The automaton is as large as the given templates, not as the table."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kept = [c for c in df.columns if c.lower() not in names]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(LicenseAutomaton(templates, phrases))
    # The text travels under a reserved name, so a text column with a result's name may be replaced too.
    given = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("_scanned"))
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scan(t) for t in batch.column(len(kept)).to_pylist()]
            columns = [pa.array([f[n] for f in found], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *names])

    return given.mapInArrow(run, with_fields(given.drop("_scanned"), FIELDS))
