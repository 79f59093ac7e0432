"""License scans by template-markup matching (operator 7).

A template is a license's wording with markup: ``[[ ... ]]`` may be left out,
``<<a-b>>`` stands for a to b words of any kind.  All templates are compiled
into one automaton over words: mandatory words are edges that only they take,
optional regions can be passed by, replaceable ones take any word.  States are
made deterministic as they are met.  A text is accepted for a template where
its words, from some place on, lead to the template's end, so all mandatory
wording stands there exactly; the longest such place counts.

Words are runs of a-z (A-Z lower-cased), 0-9 and everything beyond ASCII.  The
base labels need less: only the words of a short phrase, one after the other.

Null texts count as empty.  Repeated rows each get a row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare

#: FIXED VALUES of the query's contract.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this
list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""

#: FIXED VALUES: wording of well-known licenses and notices, in their words.
TEMPLATES = (
    ("mit-notice", "[[this <<1-2>> is]] released under the [[terms of the]] mit license"),
    ("mit-notice", "[[this <<1-2>> is]] licensed under the [[terms of the]] mit license"),
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
     documentation files the software to deal in the software without restriction including without limitation the rights to use
     copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
     is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including
     the next paragraph]] shall be included in all copies or substantial portions of the software"""),
    ("apache-2.0-notice", "[[this <<1-2>> is]] licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-notice", "[[this <<1-2>> is]] licensed under the [[terms of the]] gnu general public license [[version <<1-1>>]]"),
    ("gpl-notice", """this <<1-3>> is free software you can redistribute it and or modify it under the terms of the gnu general public
     license as published by the free software foundation either version <<1-1>> of the license or [[at your option]] any later
     version"""),
    ("cc-by-notice", "[[this <<1-2>> is]] licensed under [[a]] [[the]] [[creative commons]] cc by [[nc]] [[sa]] [[nd]] [[<<1-1>> 0]]"),
    ("bsd-2-clause", _BSD_HEAD),
    ("bsd-3-clause", _BSD_HEAD + """ [[3]] neither the name of <<1-12>> nor the names of its contributors may be used to endorse or
     promote products derived from this software without specific prior written permission"""),
    ("isc-text", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
     provided that the above copyright notice and this permission notice appear in all copies"""),
    ("mpl-2.0-notice", """this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was
     not distributed with this file you can obtain one at]]"""),
)

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ANY = None


def spaced(text: bytes | None) -> tuple[bytes, int]:
    """(the words with one space before and after each, their number)."""
    words = (text or b"").translate(_WORD).split()
    return b" " + b" ".join(words) + b" ", len(words)


class Automaton:
    """Templates as one automaton; ``matches`` runs it from the places where some template can begin."""

    def __init__(self, templates=TEMPLATES):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.final: dict[int, str] = {}
        for label, markup in templates:
            at = self._new()
            self.free[0].append(at)
            self.final[self._add(markup, at)] = label
        self.known: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        self.literals = {w for row in self.edges for w, _ in row if w is not _ANY}
        self.start = self._closed({0})
        self.begin = re.compile(b" (?=(?:" + b"|".join(sorted(self._openings())) + b") )")

    def _new(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _add(self, markup: str, at: int) -> int:
        """Add the markup's states after ``at``; the state at its end."""
        opened = []
        for bit in re.findall(r"\[\[|\]\]|<<\d+-\d+>>|[^\s\[\]<>]+", markup):
            if bit == "[[":
                opened.append(at)
            elif bit == "]]":
                end = self._new()
                self.free[at].append(end)
                self.free[opened.pop()].append(end)
                at = end
            elif bit.startswith("<<"):
                least, most = map(int, bit[2:-2].split("-"))
                end = self._new()
                for k in range(most):
                    nxt = self._new()
                    self.edges[at].append((_ANY, nxt))
                    at = nxt
                    if k + 1 >= least:
                        self.free[at].append(end)
                at = end
            else:
                nxt = self._new()
                self.edges[at].append((bit.encode(), nxt))
                at = nxt
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in out:
                    out.add(nxt)
                    todo.append(nxt)
        return frozenset(out)

    def _openings(self) -> set[bytes]:
        """Patterns of the first two words of all templates."""
        out = set()
        for s in self.start:
            for w, nxt in self.edges[s]:
                for t in self._closed({nxt}):
                    if t in self.final:
                        out.add(re.escape(w))
                    for w2, _ in self.edges[t]:
                        out.add(re.escape(w) + (b" [^ ]+" if w2 is _ANY else b" " + re.escape(w2)))
        return out

    def step(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        key = (state, word if word in self.literals else b"")
        got = self.known.get(key)
        if got is None:
            got = self._closed({n for s in state for w, n in self.edges[s] if w is _ANY or w == word})
            self.known[key] = got
        return got

    def matches(self, words: bytes) -> list[tuple[str, int, int]]:
        """(label, first word, word after the last) of each accepted place, the longest per label and place."""
        out, first, counted = [], -1, 0
        for m in self.begin.finditer(words):
            at, first, counted = m.end(), first + words.count(b" ", counted, m.end()), m.end()
            state, n, found = self.start, 0, {}
            while state and at < len(words):
                end = words.index(b" ", at)
                state = self.step(state, words[at:end])
                at, n = end + 1, n + 1
                found.update({self.final[s]: n for s in state if s in self.final})
            out += [(label, first, first + k) for label, k in sorted(found.items())]
        return out


@lru_cache(maxsize=1)
def _automaton() -> Automaton:
    return Automaton()


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at, k, counted = words.find(needle), 0, 0
        while at >= 0:
            k, counted = k + words.count(b" ", counted, at), at
            out.append((k, label))
            at = words.find(needle, at + 1)
    return sorted(out)


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = _automaton()
    for batch in batches:
        n, base, found = [], [], []
        for text in batch.column(1).to_pylist():
            words, count = spaced(text)
            n.append(count)
            base.append([{"label": x, "start": k, "end": None} for k, x in base_places(words)])
            found.append([{"label": x, "start": a, "end": b} for x, a, b in auto.matches(words)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, _MATCH), pa.array(found, _MATCH)],
                                         names=["doc_id", "n_words", "base", "matches"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, matches): places of base phrases and of accepted templates, in words."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    m = "array<struct<label:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(_scan, f"doc_id long, n_words long, base {m}, matches {m}")


def licenses(docs: DataFrame) -> DataFrame:
    """The registered query.  ``score``: 1 with an accepted template, 0.5 with a base phrase alone, else 0."""
    rows = scan(docs)
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.label") for c in cols]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), labels("base").alias("base_labels"), labels("base", "matches").alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"), "matches")
