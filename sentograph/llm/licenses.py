"""License scans by a positional index of rare words.

Licence templates are split into words, and an index lists for each word the places it has in each template. How rare a
licence word is comes from all documents. A template is a finding in a file if at some place enough of its words stand near
their places, and one of its mandatory key phrases stands in that stretch. Both lead to the places that are tried, and leave out
none: a key phrase's places in the file bound where the template can begin; and of each template's own words the rarest are
looked up, so many that a finding can't do without NEED of them, each of whose places says where the template would begin.
Base phrases are found beside that, as consecutive words.

Defined results: a null or empty text has no words and no places, and empty labels; overlapping places all count;
repeated rows each get a result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import slices

#: Phrases and the label of each.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, text, key phrases of which one is mandatory)
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind", ("apache license version 2 0",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Distinct ones of a template's rarest words that have to agree before all its words are compared.
NEED = 3
#: Half of the words that may be missing or added before a word of the template.
SLACK = 4
#: Share of a template's words that have to stand in the matched stretch.
ENOUGH = 0.75


def _class_table() -> bytes:
    """Bytes of words in lower case, all others as a space."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            out[b] = b
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


TABLE = _class_table()


def words_of(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(TABLE).split(b" ") if w]


def coded(texts: pa.Array):
    """(distinct words, number of each word of all texts in order, bounds of the texts in that)."""
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = bytes(texts.buffers()[2][lo:hi]).translate(TABLE) if hi > lo else b""
    classed = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - lo)), pa.py_buffer(data)])
    split = pc.split_pattern(classed, " ")
    bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten().dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [w.encode() for w in flat.dictionary.to_pylist()]
    bounds = bounds - bounds[0]
    if b"" in words:  # between two separators
        real = index != words.index(b"")
        bounds = np.append(0, np.cumsum(real))[bounds]
        index = index[real]
    return words, index, bounds


def _within(own, lo: int, hi: int) -> bool:
    """Whether one of the ordered places is from lo to hi."""
    k = bisect_left(own, lo)
    return k < len(own) and own[k] <= hi


class Index:
    """The positional index of the templates, with the rarity of its words."""

    def __init__(self, frequency: dict[bytes, int], documents: int, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(self.templates):
            for place, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, place))
        self.rarity = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in self.postings}
        rarest = lambda words: sorted(words, key=lambda w: (-self.rarity[w], w))
        #: For each template: words that may be missing, its rarest words, how many of them agree at least, and all its (word, place), rarest first.
        self.plans = []
        for t, (_, words, _) in enumerate(self.templates):
            spare = len(words) - math.ceil(ENOUGH * len(words))
            some = rarest(set(words))[: spare + NEED]
            self.plans.append((spare, some, max(1, len(some) - spare), [(w, q) for w in rarest(set(words)) for u, q in self.postings[w] if u == t]))

    def vocabulary(self) -> list[bytes]:
        return sorted({*self.postings, *(w for p, _ in self.phrases for w in p), *(w for _, _, keys in self.templates for k in keys for w in k)})

    def findings(self, places: dict[bytes, list[int]]) -> dict[str, float]:
        """Labels and scores for a file, by the places of its licence words.

        Of neighbouring begins the one with the most words right at their places gives the score, and the best score counts.
        """
        out: dict[str, float] = {}
        for t, (label, words, keys) in enumerate(self.templates):
            spare, some, need, every = self.plans[t]
            if not words or out.get(label) == 1.0 or sum(w in places for w in some) < need:
                continue
            last, most = None, -1
            runs: list[float] = []  # the score of each run of begins
            for lo, hi in self.stretches(len(words), keys, places):
                for begin in self.begins(t, some, need, places, lo, hi):
                    missing = 0
                    for w, q in every:
                        if not _within(places.get(w, ()), begin + q - 2 * SLACK, begin + q + 2 * SLACK):
                            missing += 1
                            if missing > spare:
                                break
                    else:
                        right = sum(_within(places.get(w, ()), begin + q, begin + q) for w, q in every)
                        score = (len(words) - missing) / len(words)
                        if last is None or begin > last + 1:
                            runs.append(score)
                            most = right
                        elif right > most:
                            runs[-1], most = score, right
                        last = begin
            if runs:
                out[label] = max(out.get(label, 0.0), max(runs))
        return out

    def stretches(self, n: int, keys, places) -> list[list[int]]:
        """First and last begins of a template of n words with a key phrase in its stretch, in order and apart."""
        starts = set()
        for key in keys:
            if all(w in places for w in key):
                i, rare = min(enumerate(key), key=lambda x: len(places[x[1]]))
                starts.update(p - i for p in places[rare] if all(_within(places[w], p - i + j, p - i + j) for j, w in enumerate(key)))
        out: list[list[int]] = []
        for p in sorted(starts):
            lo, hi = p - n - 2 * SLACK, p + 2 * SLACK
            if out and lo <= out[-1][1] + 1:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
        return out

    def begins(self, t: int, some: list[bytes], need: int, places, first: int, last: int) -> Iterator[int]:
        """Begins from first to last near which so many of a template's rarest words agree."""
        events = []
        for w in some:
            own = places.get(w, ())
            for u, q in self.postings[w]:
                if u == t:
                    for p in own[bisect_left(own, first + q - 2 * SLACK) : bisect_right(own, last + q + 2 * SLACK)]:
                        events += [(p - q - 2 * SLACK, 1, w), (p - q + 2 * SLACK + 1, -1, w)]
        events.sort()
        count: dict[bytes, int] = {}
        at = first
        for place, step, w in events:
            if place > at:
                if len(count) >= need:
                    yield from range(at, min(place, last + 1))
                at = place
            count[w] = count.get(w, 0) + step
            if not count[w]:
                del count[w]


def frequencies(documents: DataFrame, text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all documents, and their count."""
    wanted = Index({}, 0).vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, rows = np.zeros(len(wanted), np.int64), 0
        number = {w: k for k, w in enumerate(wanted)}
        for whole in batches:
            for batch in slices(whole, "text"):
                words, index, bounds = coded(batch.column("text"))
                rows += batch.num_rows
                known = np.array([number.get(w, -1) for w in words] or [-1], np.int64)
                at = np.flatnonzero(known[index] >= 0) if len(index) else np.zeros(0, np.int64)
                doc = np.searchsorted(bounds, at, "right") - 1
                pairs = np.unique(doc * len(wanted) + known[index[at]]) if len(at) else at
                total += np.bincount(pairs % len(wanted), minlength=len(wanted))
        yield pa.RecordBatch.from_pydict({"word": [*[w.decode() for w in wanted], ""], "n": pa.array([*total.tolist(), rows], pa.int64())})

    rows = documents.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document.

    score: the best finding's share of matched words; of base phrases alone 0.5, of nothing 0.
    """
    index = Index(*frequencies(documents, text))
    wanted = index.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number = {w: k for k, w in enumerate(wanted)}
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for whole in batches:
            for batch in slices(whole, "text"):
                words, coded_words, bounds = coded(batch.column("text"))
                known = np.array([number.get(w, -1) for w in words] or [-1], np.int64)
                own = known[coded_words] if len(coded_words) else np.zeros(0, np.int64)
                at = np.flatnonzero(own >= 0)
                kept = own[at]
                cuts = np.searchsorted(at, bounds)
                out = []
                for d in range(batch.num_rows):
                    n = int(bounds[d + 1] - bounds[d])
                    lo, hi = int(cuts[d]), int(cuts[d + 1])
                    if lo == hi:
                        out.append((n, 0, None, None, "", "", 0.0))
                        continue
                    places: dict[bytes, list[int]] = {}
                    for k, p in zip(kept[lo:hi].tolist(), (at[lo:hi] - bounds[d]).tolist()):
                        places.setdefault(wanted[k], []).append(p)
                    starts, base = [], set()
                    for phrase, label in index.phrases:
                        if all(w in places for w in phrase):
                            rest = [set(places[w]) for w in phrase[1:]]
                            hits = [p for p in places[phrase[0]] if all(p + i in s for i, s in enumerate(rest, 1))]
                            if hits:
                                starts += hits
                                base.add(label)
                    found = index.findings(places)
                    score = max([*found.values(), 0.5 if base else 0.0])
                    out.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *found})), score))
                columns = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["key", *names])

    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
