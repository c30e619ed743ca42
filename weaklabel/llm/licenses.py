"""Licence scan with a generalised suffix automaton of licence texts.

The templates' words become one suffix automaton. A document's words stream
through it once and give the matching statistics: for each place the longest
run of words ending there that occurs in some template. Maximal runs of at
least ``MIN_RUN`` words are chained, template by template, when their places
follow each other in the document and in the template; a chain that covers
enough of its template is a span and gives the template's label. Besides,
every place where a base phrase stands gives the base label.

Templates are a fixed, bounded set that goes to every task; documents are
scanned where they lie, without a shuffle, in time linear in their words.

Defined cases: a null text counts as empty, a text without words has no
labels, no places and score zero; repeated rows get a row each; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

# The base phrases and the openings of well-known licence texts.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring "
     "rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
MIN_RUN = 3
COVERED = 0.75
#: Words that a chain may skip in the document and in the template.
GAP = 8

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences. Each state keeps, by
    sequence, one end position of its words."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for n, seq in enumerate(sequences):
            at = 0
            for pos, w in enumerate(seq):
                at = self._add(at, w)
                self.ends[at].setdefault(n, pos)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.ends[self.link[s]]
            for n, pos in self.ends[s].items():
                up[n] = min(pos, up.get(n, pos))
        self.ends[0] = {}

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of exactly ``length[p] + 1`` words that ``p`` reaches by
        ``w``, split off from ``q`` if ``q`` holds longer words as well."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def runs(self, words: Iterable[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches ``(first word, words, state)`` of at least ``least``
        words: those that the next word does not lengthen."""
        out = []
        state = size = 0
        i = -1
        for i, w in enumerate(words):
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
                continue
            if size >= least:
                out.append((i - size, size, state))
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                state = size = 0
        if size >= least:
            out.append((i + 1 - size, size, state))
        return out


class Scanner:
    """Templates and base phrases, ready to scan texts."""

    def __init__(self, templates=TEMPLATES, base=BASE, least: int = MIN_RUN, covered: float = COVERED):
        self.labels = [label for label, _ in templates]
        seqs = [words_of(t) for _, t in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for s in seqs for w in s}))}
        self.sizes = [len(s) for s in seqs]
        self.automaton = Automaton([[self.vocabulary[w] for w in s] for s in seqs])
        self.base = [(words_of(p), label) for p, label in base.items()]
        self.first = {}
        for phrase, label in self.base:
            self.first.setdefault(phrase[0], []).append((phrase, label))
        self.least, self.covered = least, covered

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """``(first word, end word, template, covered share)``."""
        get = self.vocabulary.get
        ids = [get(w, -1) for w in words]
        known = np.flatnonzero(np.array(ids, np.int64) >= 0) if ids else np.empty(0, int)
        if len(known) < self.least:
            return []
        # Only stretches of template words can match; each is streamed on its own.
        edge = np.flatnonzero(np.r_[True, np.diff(known) > 1])
        begin, end = known[edge], known[np.r_[edge[1:] - 1, len(known) - 1]] + 1
        chains: dict[int, list[list[int]]] = {}
        done: list[tuple[int, int, int, float]] = []
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            if e - b < self.least:
                continue
            for at, size, state in self.automaton.runs(ids[b:e], self.least):
                for n, pos in self.automaton.ends[state].items():
                    self._chain(chains.setdefault(n, []), b + at, size, pos - size + 1, n, done)
        for n, open_ in chains.items():
            for c in open_:
                self._close(c, n, done)
        return sorted(done)

    def _chain(self, open_: list[list[int]], at: int, size: int, pos: int, n: int, done: list) -> None:
        """Add a match at word ``at`` and template word ``pos`` to the chain
        of template ``n`` that it continues, or open one. A chain is [first
        word, end word, end in the template, words covered]."""
        while open_ and at - open_[0][1] > GAP:
            self._close(open_.pop(0), n, done)
        for c in reversed(open_):
            over = max(0, c[1] - at, c[2] - pos)             # words that both matches cover
            if size > over and pos + over - c[2] <= GAP and pos + size > c[2]:
                c[3] += size - over
                c[1], c[2] = at + size, pos + size
                return
        open_.append([at, at + size, pos + size, size])

    def _close(self, c: list[int], n: int, done: list) -> None:
        share = min(1.0, c[3] / self.sizes[n])
        if share >= self.covered:
            done.append((c[0], c[1], n, share))

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        n_base, first, last, base = 0, None, None, set()
        for w, phrases in self.first.items():
            at = -1
            while True:
                try:
                    at = words.index(w, at + 1)
                except ValueError:
                    break
                for phrase, label in phrases:
                    if words[at:at + len(phrase)] == phrase:
                        n_base += 1
                        base.add(label)
                        first = at if first is None else min(first, at)
                        last = at if last is None else max(last, at)
        spans = self.spans(words)
        labels = base | {self.labels[n] for _, _, n, _ in spans}
        best = max([share for *_, share in spans], default=0.0)
        return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
                "score": max(best, 1.0 if base else 0.0),
                "spans": [f"{self.labels[n]}:{a}:{b}" for a, b, n, _ in spans]}


RESULT = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<string>")


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Rows of ``RESULT``, one a document; spans are label:first word:end word
    of the covered template parts."""
    scanner = scanner or Scanner()
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scanner.scan(t) for t in texts_of(batch)]
        return pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True))],
                               names=["doc_id", *names])
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, RESULT)
