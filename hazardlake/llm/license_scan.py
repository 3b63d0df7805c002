"""Licence scan by a generalised suffix automaton of licence words.

The automaton holds every run of words of every licence text. Streaming a document through it gives
the matching statistics: at each word, how many words that end there stand in some licence in the
same order. Long matches that cannot grow are chained, per licence, into spans in which both the
document's and the licence's words run on; how much of a licence its best chain covers decides the
label. Short phrases are in the automaton too, and every place of theirs is found on the way.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence notices as published, by label.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0."],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details."""],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""],
    "mit": [
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software."""],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""],
}

#: Words of a match that may join a chain, words that may be missing between two of them, and the
#: share of a licence that a chain must cover. A licence shorter than a match is a match as a whole.
MATCH, GAP, COVER = 4, 8, 0.8
#: Bytes of a text that are split into words at a time.
PART = 1 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes):
    """The words of a text, in lists of about PART bytes; a word is never cut."""
    start = 0
    while start < len(text):
        stop = min(start + PART, len(text))
        if stop < len(text):
            while stop > start and _WORD.match(text[stop - 1:stop].lower()):
                stop -= 1
            if stop == start:  # one word that fills the part: go on to its end
                stop = start + PART
                while stop < len(text) and _WORD.match(text[stop:stop + 1].lower()):
                    stop += 1
        yield _WORD.findall(text[start:stop].lower())
        start = stop


class Automaton:
    """Generalised suffix automaton of phrases and licence notices, over word ids."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.labels, self.sizes = [], []          # of each notice
        self.places: list[list[tuple[int, int]]] = [[]]  # (notice, end) that the state's runs end at
        self.found: list[list[tuple[int, str]]] = [[]]   # (words, label) of the phrase that is the state's longest run
        for label, texts in notices.items():
            for t in texts:
                self._add(self._numbers(t), notice=len(self.labels))
                self.labels.append(label)
                self.sizes.append(len(self._numbers(t)))
        for phrase, label in phrases.items():
            self._add(self._numbers(phrase), notice=-1)
        for phrase, label in phrases.items():
            numbers, state = self._numbers(phrase), 0
            for w in numbers:
                state = self.next[state][w]
            self.found[state].append((len(numbers), label))
        # A state's runs end wherever those of the states linking to it do.
        order = sorted(range(1, len(self.next)), key=lambda s: -self.longest[s])
        for s in order:
            if self.link[s] > 0:
                self.places[self.link[s]].extend(self.places[s])
        self.places = [sorted(set(p)) for p in self.places]
        # Phrases that end where a state's runs end are on its way along the links.
        for s in reversed(order):
            if self.link[s] > 0:
                self.found[s] = self.found[s] + self.found[self.link[s]]
        self.short = [i for i, n in enumerate(self.sizes) if n < MATCH]

    def _numbers(self, text: str) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids)) for part in words_of(text.encode()) for w in part]

    def _state(self, longest: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else -1)
        self.longest.append(longest)
        self.places.append([])
        self.found.append([])
        return len(self.next) - 1

    def _add(self, numbers: list[int], notice: int) -> None:
        last = 0
        for end, w in enumerate(numbers, 1):
            last = self._extend(last, w)
            if notice >= 0:
                self.places[last].append((notice, end))

    def _split(self, p: int, w: int, q: int) -> int:
        """A state of its own for the runs of q that are p's longest and w; q keeps the longer ones."""
        clone = self._state(self.longest[p] + 1, like=q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # known from another text
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.longest[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, w, q)
        return new

    def stream(self, text: bytes):
        """(n_words, places, matches) of a document.

        ``places`` are (start, label) of all phrases. ``matches`` are (start, end, state) of runs that
        stand in a notice and can grow on neither side, of MATCH words or of a whole shorter notice.
        """
        state = length = done = 0
        places, matches = [], []
        link, longest, found, following = self.link, self.longest, self.found, self.next

        def close(end):
            if length >= MATCH or any((n, length) in self.places[state] and self.sizes[n] == length for n in self.short):
                matches.append((end - length, end, state))

        for words in words_of(text):
            ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int32, len(words))
            known = np.flatnonzero(ids >= 0)
            expected = 0 if length else None
            for k, w in zip(known.tolist(), ids[known].tolist()):
                at = done + k
                if k != expected and length:
                    close(done + expected)
                    state = length = 0
                expected = k + 1
                if w not in following[state]:
                    close(at)
                    while state >= 0 and w not in following[state]:
                        state = link[state]
                        length = longest[state] if state >= 0 else 0
                    if state < 0:
                        state = 0
                        continue
                state, length = following[state][w], length + 1
                while longest[link[state]] >= length:
                    state = link[state]
                for n, label in found[state]:
                    if n <= length:
                        places.append((at + 1 - n, label))
            if length and expected != len(words):
                close(done + expected)
                state = length = 0
            done += len(words)
        if length:
            close(done)
        return done, places, matches

    def spans(self, matches) -> list[tuple[int, int, int, float]]:
        """(notice, start, end, share covered) of chains through the matches.

        A chain goes on in document and notice alike, each with at most GAP words in between; where
        two matches overlap, the later one counts without its overlap. Of every notice the chain that
        covers most is returned, of equal ones that which ends first, and all others that cover COVER
        or more and share no word with a better one.
        """
        by_notice: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, end, state in matches:
            for notice, stop in self.places[state]:
                by_notice.setdefault(notice, []).append((end, stop, start, stop - end + start))
        out = []
        for notice, runs in by_notice.items():
            runs.sort()
            ended: list[tuple[int, int, int]] = []       # (-covered, end, first) of the best chain to each match
            chains: list[tuple[int, int, int, int]] = []  # (end, stop, first, covered) that may still go on
            for end, stop, start, begin in runs:
                covered, first = end - start, start
                chains = [c for c in chains if c[0] >= start - GAP]
                for c_end, c_stop, c_first, c_covered in chains:
                    over = max(c_end - start, c_stop - begin, 0)
                    if c_end < end and c_stop < stop and c_stop >= begin - GAP and over < end - start and c_covered + end - start - over > covered:
                        covered, first = c_covered + end - start - over, c_first
                chains.append((end, stop, first, covered))
                ended.append((-covered, end, first))
            taken: list[tuple[int, int]] = []  # (start, end), in order
            for covered, end, first in sorted(ended):
                if taken and -covered < COVER * self.sizes[notice]:
                    break
                k = bisect_left(taken, (first, end))
                if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= end):
                    taken.insert(k, (first, end))
                    out.append((notice, first, end, -covered / self.sizes[notice]))
        return out

    def scan(self, text: bytes) -> tuple:
        """What ``scan_licenses`` returns of one text."""
        n, places, matches = self.stream(text)
        chains = self.spans(matches)
        spans = sorted((self.labels[i], first, end, share) for i, first, end, share in chains if share >= COVER)
        base, starts = {label for _, label in places}, [at for at, _ in places]
        score = 1.0 if places else max((c[3] for c in chains), default=0.0)
        return (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base.union(s[0] for s in spans))), score, spans)


_ADDED = [("n_words", pa.int64(), T.LongType()), ("n_base", pa.int64(), T.LongType()), ("first_word", pa.int64(), T.LongType()),
          ("last_word", pa.int64(), T.LongType()), ("base_labels", pa.string(), T.StringType()), ("labels", pa.string(), T.StringType()),
          ("score", pa.float64(), T.DoubleType())]
_SPAN = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()),
                                  T.StructField("after", T.LongType()), T.StructField("covered", T.DoubleType())]))
_SPAN_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("covered", pa.float64())]))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """Add licence labels of the text; columns of the added names are replaced, all others pass through.

    A-Z count as a-z; words are runs of other characters than ASCII ones that are neither letters
    nor digits. n_words: words of the text. n_base: places of phrases, overlapping ones too;
    first_word and last_word: their smallest and largest first word, from 0, or NULL. base_labels:
    labels of phrases found. labels: these and those of notices of which a chain of matches covers
    COVER or more; distinct, sorted, comma-joined. score: 1 if a phrase is found, else the largest
    share of a notice that a chain covers, else 0. license_spans: (label, first, after, covered) of
    the covered notices, ``after`` being the word behind the span. NULL counts as the empty text: no
    words, no labels, score 0. Whole texts are read, split a part at a time; nothing is shuffled, and
    every row has a result of its own, repeated or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(phrases, notices))
    added = [a[0] for a in _ADDED] + ["license_spans"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, _, t in _ADDED), T.StructField("license_spans", _SPAN)])

    def run(batches):
        automaton = shared.value
        for b in batches:
            column = b.column(b.schema.names.index("text"))
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for i, j in slices(sizes):
                rows = [automaton.scan(t.encode("utf-8", "replace") if t else b"") for t in column.slice(i, j - i).to_pylist()]
                columns = list(zip(*rows))
                spans = [[dict(zip(("label", "first", "after", "covered"), s)) for s in r] for r in columns[7]]
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), *(pa.array(c, a) for c, (_, a, _) in zip(columns, _ADDED)), pa.array(spans, _SPAN_ARROW)],
                    names=[*names, *added])

    return docs.mapInArrow(run, schema)


def op12_license_scan(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan_licenses(docs).select("doc_id", *(a[0] for a in _ADDED))
