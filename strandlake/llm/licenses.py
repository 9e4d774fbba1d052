"""License scans: matching statistics against a generalised suffix automaton of license templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import batch_pieces, mixed, span_hashes, spans

#: Phrases that name a license by themselves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Sentences of well-known license notices, by label. What stands between asterisks tells a license from others
#: with like notices: it must be matched as consecutive words. `bsd` is what the two- and three-clause licenses share.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "this project is released under the *mit license*",
    ],
    "apache-2": [
        "licensed under the *apache license version 2* 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-3": ["neither the name of the copyright holder nor the names of its contributors may be used to *endorse or promote products derived from this software* without specific prior written permission"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl-2": [
        "licensed under the *gnu general public license version 2*",
        "*gnu general public license either version 2*",
        "*gnu gpl version 2* or later",
        "this program is free software you can redistribute it and or modify it under the terms of the *gnu general public license* as published by the free software foundation either *version 2* of the license or at your option any later version",
    ],
    "gpl-3": [
        "licensed under the *gnu general public license version 3*",
        "*gnu general public license either version 3*",
        "*gnu gpl version 3* or later",
        "this program is free software you can redistribute it and or modify it under the terms of the *gnu general public license* as published by the free software foundation either *version 3* of the license or at your option any later version",
    ],
    "lgpl-2": ["this library is free software you can redistribute it and or modify it under the terms of the *gnu library general public license* as published by the free software foundation either *version 2* of the license or at your option any later version"],
    "lgpl-2.1": ["this library is free software you can redistribute it and or modify it under the terms of the *gnu lesser general public license* as published by the free software foundation either *version 2 1* of the license or at your option any later version"],
    "lgpl-3": ["this program is free software you can redistribute it and or modify it under the terms of the *gnu lesser general public license* as published by the free software foundation either *version 3* of the license or at your option any later version"],
    "agpl-3": ["this program is free software you can redistribute it and or modify it under the terms of the *gnu affero general public license* as published by the free software foundation either *version 3* of the license or at your option any later version"],
    "mpl-2": ["this source code form is subject to the terms of the *mozilla public license* v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the *eclipse public license 2 0* which is available at"],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "cc0": ["to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the *public domain worldwide*"],
    "cc-by-nc": ["licensed under *cc by nc* 4 0", "this work is licensed under a creative commons *attribution noncommercial* 4 0 international license"],
    "cc-by-nc-sa": ["licensed under *cc by nc sa* 4 0", "this work is licensed under a creative commons *attribution noncommercial sharealike* 4 0 international license"],
    "cc-by-nc-nd": ["licensed under *cc by nc nd* 4 0", "this work is licensed under a creative commons *attribution noncommercial noderivatives* 4 0 international license"],
    "cc-by-nd": ["licensed under *cc by nd* 4 0", "this work is licensed under a creative commons *attribution noderivatives* 4 0 international license"],
    "cc-by-sa": ["licensed under *cc by sa* 4 0", "this work is licensed under a creative commons *attribution sharealike* 4 0 international license"],
    "cc-by": ["licensed under *cc by 4* 0", "this work is licensed under a creative commons *attribution 4* 0 international license"],
}

#: Identifiers of the public license list, as words, which follow "SPDX-License-Identifier:".
IDENTIFIERS = {
    "mit": "mit",
    "apache-2": "apache 2 0",
    "bsd": "bsd 2 clause",
    "bsd-3": "bsd 3 clause",
    "isc": "isc",
    "gpl-2": "gpl 2 0",
    "gpl-3": "gpl 3 0",
    "lgpl-2": "lgpl 2 0",
    "lgpl-2.1": "lgpl 2 1",
    "lgpl-3": "lgpl 3 0",
    "agpl-3": "agpl 3 0",
    "mpl-2": "mpl 2 0",
    "epl-2": "epl 2 0",
    "unlicense": "unlicense",
    "zlib": "zlib",
    "cc0": "cc0 1 0",
    "cc-by": "cc by 4 0",
    "cc-by-sa": "cc by sa 4 0",
    "cc-by-nc": "cc by nc 4 0",
    "cc-by-nd": "cc by nd 4 0",
    "cc-by-nc-sa": "cc by nc sa 4 0",
    "cc-by-nc-nd": "cc by nc nd 4 0",
}

#: The templates of all labels, with their identifiers.
NOTICES = {label: [*texts, f"*spdx license identifier {IDENTIFIERS[label]}*"] for label, texts in TEMPLATES.items()}

#: Words before a notice that turn it into its opposite ("is not licensed under", "isn't").
NEGATIONS = {b"not", b"never", b"isn", b"t"}

#: Lower-cased bytes, and which of those are of words: 0-9, a-z and all bytes of multi-byte characters.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class LicenseAutomaton:
    """A suffix automaton of the word sequences of all templates and phrases."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.phrase_labels = list(phrases.values())
        self.names: list[str] = []
        self.sizes: list[int] = []
        #: By template, the places (first word, end) of what must be matched as consecutive words.
        self.keys: list[list[tuple[int, int]]] = []
        self.key_words: list[list[tuple[str, ...]]] = []
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: list[set[tuple[int, int]]] = [set()]
        texts = [(label, t) for label, ts in templates.items() for t in ts] + [(label, p) for p, label in phrases.items()]
        for number, (label, text) in enumerate(texts):
            parts = [x.split() for x in text.split("*")]
            at = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
            self.keys.append([(at[i], at[i + 1]) for i in range(1, len(parts), 2)])
            ids = self.ids(text.replace("*", " "))
            self.key_words.append([tuple(parts[i]) for i in range(1, len(parts), 2)])
            self.names.append(label)
            self.sizes.append(len(ids))
            last = 0
            for at, word in enumerate(ids):
                last = self.extend(last, word)
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[last].add((number, at + 1))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            ends[self.link[s]] |= ends[s]
        #: (template, words of it read) of every place where a state's words end.
        self.ends = [sorted(x) for x in ends]
        #: (words, phrase) of the phrases that end where a state's words end.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.next]
        first = len(texts) - len(phrases)
        for k, phrase in enumerate(phrases):
            state, n = 0, len(phrase.split())
            for word in self.ids(phrase):
                state = self.next[state][word]
            for s in range(1, len(self.next)):
                up = s
                while up > 0:
                    if up == state:
                        self.phrases[s].append((n, k))
                    up = self.link[up]
        #: Phrases aren't templates to cover.
        self.ends = [[x for x in e if x[0] < first] for e in self.ends]
        #: By template, those of other labels with a key that goes on where one of its keys ends.
        self.longer = [{j for j, other in enumerate(self.key_words) if self.names[j] != self.names[i] and any(len(b) > len(a) and b[: len(a)] == a for a in keys for b in other)} for i, keys in enumerate(self.key_words)]
        self.least_phrase = min((len(p.split()) for p in phrases), default=1 << 30)

    def ids(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in text.split()]

    def extend(self, last: int, word: int) -> int:
        """The state of (what last stands for) + word, which may be there already from another template."""
        if word in self.next[last]:
            to = self.next[last][word]
            return to if self.length[to] == self.length[last] + 1 else self.split(last, word, to)
        new = self.add(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self.split(at, word, to)
        return new

    def split(self, at: int, word: int, to: int) -> int:
        """Parts from state `to` the words no longer than those that come through at."""
        twin = self.add(self.length[at] + 1, dict(self.next[to]))
        self.link[twin], self.link[to] = self.link[to], twin
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def add(self, length: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.next.append(following)
        return len(self.next) - 1

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the length of the longest match that ends there, and its state."""
        state, n = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            yield n, state

    def best_chain(self, found: list[tuple[int, int, int]], most_gap: int) -> tuple[int, list[int]]:
        """The words of a template that the best chain of its matches covers, and those matches in order.

        found: sorted (end in the text, words of the template read, length). A chain goes forward in text and template alike
        and leaps at most most_gap words of the text at once; a match that overlaps its forerunner adds only what is new.
        """
        best: list[tuple[int, int]] = []  # covered words, forerunner
        for i, (end, read, n) in enumerate(found):
            cover, before = n, -1
            for j in range(i - 1, -1, -1):
                e, r, _ = found[j]
                if end - n - e > most_gap:
                    break
                new = min(n, end - e, read - r)
                if new > 0 and best[j][0] + new > cover:
                    cover, before = best[j][0] + new, j
            best.append((cover, before))
        i = max(range(len(best)), key=lambda i: best[i][0])
        cover, links = best[i][0], []
        while i >= 0:
            links.append(i)
            i = best[i][1]
        return cover, links[::-1]

    def chain(self, matches: list[tuple[int, int, int]], most_gap: int, coverage: float = 0.7) -> list[tuple[int, int, int, int, bool]]:
        """(template, covered words, first word, last word, whether it counts) of the best chain of each template that is
        matched, and of the best ones that are left, in words on either side of those taken, as long as they reach the
        coverage. A chain counts if it reaches the coverage and each of the template's keys lies in one of its matches.

        matches: (end in the text, length, state), by end.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in matches:
            for template, read in self.ends[state]:
                by.setdefault(template, []).append((end, read, n))
        out = []
        for template, found in sorted(by.items()):
            found.sort()
            todo, taken = [found], False
            while todo:
                found = todo.pop()
                if not found:
                    continue
                cover, links = self.best_chain(found, most_gap)
                first, last = found[links[0]][0] - found[links[0]][2], found[links[-1]][0] - 1
                enough = cover >= coverage * self.sizes[template]
                if not taken or enough:
                    named = all(any(found[i][1] - found[i][2] <= a and b <= found[i][1] for i in links) for a, b in self.keys[template])
                    out.append((template, cover, first, last, enough and named))
                taken = True
                if enough:
                    todo += [[x for x in found if x[0] <= first], [x for x in found if x[0] - x[2] > last]]
        return out


def scan_licenses(docs: DataFrame, *, templates: dict[str, list[str]] = NOTICES, phrases: dict[str, str] = PHRASES, least_match: int = 4, coverage: float = 0.7, most_gap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licenses that each text of docs names or quotes.

    Columns: doc_id, n_words, n_base (places of phrases), first_word and last_word (least and greatest start of one,
    else null), base_labels, labels (with the method's own; both distinct, sorted, comma-joined, empty if none), score
    (1 with a phrase, else the largest share of a template that is covered in a span, 0 without any), spans (label, first
    and last word, covered share of every place where a template is covered to at least `coverage` and what tells it from
    others, between asterisks, stands as consecutive words; not if a negation stands before it, nor where the longer name of
    another license stands there).

    Texts are streamed: words outside the templates' vocabulary end every match, so only runs of known words are led
    through the automaton. The matching statistics at a word give the phrases that end there and, where a match of
    least_match words or more can't be prolonged, a match to be chained into a template's span.
    A null or empty text has no words, no labels and score 0. Null ids and repeated rows give one row each, an empty table
    none; other columns are ignored.
    """
    automaton = LicenseAutomaton(templates, phrases)
    known = np.array([span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in automaton.vocabulary], np.uint64)
    filter_ = np.zeros(1 << 16, bool)
    filter_[mixed(known) & np.uint64(0xFFFF)] = True
    shortest = min(automaton.least_phrase, least_match)
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))

    def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, list]], Callable[[int, int], list[bytes]]]:
        """The number of words of each text, by text its phrase places and matches, and a look at two words before a place."""
        data = LOWER[data]
        starts, ends = spans(WORD[data], offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        n_words = np.bincount(row, minlength=len(offsets) - 1)
        first = np.concatenate([[0], np.cumsum(n_words)])
        maybe = filter_[mixed(span_hashes(data, starts, ends)) & np.uint64(0xFFFF)]
        found: dict[int, tuple[list, list]] = {}
        lo, hi = spans(maybe, first)
        for a, b in zip(lo[hi - lo >= shortest].tolist(), hi[hi - lo >= shortest].tolist(), strict=True):
            raw = data[starts[a] : ends[b - 1]].tobytes()
            at = int(starts[a])
            words = [automaton.vocabulary.get(raw[s - at : e - at], -1) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            r = int(row[a])
            place = a - int(first[r])
            before = (0, 0)
            for i, (n, state) in enumerate([*automaton.statistics(words), (0, 0)]):
                if before[0] >= least_match and n <= before[0]:
                    found.setdefault(r, ([], []))[1].append((place + i, *before))
                if n >= automaton.least_phrase:
                    for size, phrase in automaton.phrases[state]:
                        if size <= n:
                            found.setdefault(r, ([], []))[0].append((place + i + 1 - size, phrase))
                before = (n, state)

        def before_place(r: int, place: int) -> list[bytes]:
            g = int(first[r]) + place
            return [data[starts[i] : ends[i]].tobytes() for i in range(max(int(first[r]), g - 2), g)]

        return n_words, found, before_place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batch_pieces(batches, 1, 1 << 20):
            n_words, found, before_place = scan(data, offsets)
            out = []
            for r, n in enumerate(n_words.tolist()):
                places, matches = found.get(r, ([], []))
                counted = [(t, words / automaton.sizes[t], a, b) for t, words, a, b, counts in automaton.chain(matches, most_gap, coverage) if counts and not NEGATIONS & set(before_place(r, a))]
                # Where a longer name stands (BY-NC-SA), the shorter one in it (BY-NC) isn't meant.
                lost = {x for x in counted for y in counted if y[0] in automaton.longer[x[0]] and x[2] <= y[3] and y[2] <= x[3]}
                covered = [(automaton.names[t], a, b, share) for t, share, a, b in counted if (t, share, a, b) not in lost]
                most = max((c[3] for c in covered), default=0.0)
                base = {automaton.phrase_labels[p] for _, p in places}
                at = [s for s, _ in places]
                spans_ = [{"label": k, "first_word": a, "last_word": b, "covered": c} for k, a, b, c in sorted(covered)]
                out.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {c[0] for c in covered})), 1.0 if at else most, spans_))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.dtypes[0][1]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, covered: double>>")
