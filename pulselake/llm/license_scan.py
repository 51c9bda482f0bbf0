"""Licence scan: matching statistics of a generalised suffix automaton of licence templates.

The automaton holds every substring of the templates' word sequences; each state knows which
templates contain it. A file's words are streamed through it once, which gives at every word the
longest suffix that some template contains. Maximal matches of at least MIN_MATCH words are
placed in their template (at the state's first end position after the chain so far) and chained in file order with
bounded gaps; the covered share of the template decides. Runs of words outside the templates'
vocabulary are skipped without touching the automaton.

Base labels come from phrases whose words stand consecutively; the method's labels are added.

Cases: null or empty text has no words, no labels and score 0; repeated rows are scanned each for
itself; ties between templates keep all of them; an empty table gives no rows; other columns are
ignored; texts are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import alnum_words, map_batches, utf8
from pulselake.session import read_table

#: Phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public licence notices, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Released under the MIT License.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
}
MIN_MATCH = 3
MAX_GAP = 3
MIN_COVER = 0.8


class SuffixAutomaton:
    """Online construction over several word sequences; a state keeps all its end positions by sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].setdefault(number, set()).add(at)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for number, at in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, set()).update(at)
        self.ends = [{number: sorted(at) for number, at in of.items()} for of in self.ends]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new

    def statistics(self, symbols: list[int]):
        """(position, length, state) wherever the longest matching suffix cannot be extended."""
        state = length = 0
        for at, symbol in enumerate(symbols):
            if symbol not in self.next[state] and length:
                yield at - 1, length, state
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            else:
                state = length = 0
        if length:
            yield len(symbols) - 1, length, state


class Scanner:
    """Templates and phrases compiled for one pass over a file's words."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.sequences, self.labels, self.number = [], [], {}
        for label, texts in templates.items():
            for text in texts:
                self.sequences.append([self.number.setdefault(w, len(self.number)) for w in alnum_words(text.encode())])
                self.labels.append(label)
        self.automaton = SuffixAutomaton(self.sequences)
        self.phrases = [(alnum_words(p.encode()), label) for p, label in phrases.items()]
        self.by_last = {}
        for words, label in self.phrases:
            self.by_last.setdefault(words[-1], []).append((words, label))

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Starts of all places of the phrases, and their labels."""
        starts, labels = [], set()
        for last, of in self.by_last.items():
            at = -1
            while True:
                try:
                    at = words.index(last, at + 1)
                except ValueError:
                    break
                for phrase, label in of:
                    if (start := at - len(phrase) + 1) >= 0 and words[start : at + 1] == phrase:
                        starts.append(start)
                        labels.add(label)
        return starts, labels

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """Chained matches as (first word, last word, label, covered share of the template)."""
        number, out = self.number.get, []
        ids = [number(w, -1) for w in words]
        known = [k for k, i in enumerate(ids) if i >= 0]
        lo = 0
        chains: dict[int, list] = {}

        def close(t: int) -> None:
            first, last, _, cover = chains.pop(t)
            if (share := cover / len(self.sequences[t])) >= MIN_COVER:
                out.append((first, last, self.labels[t], min(1.0, share)))

        while lo < len(known):
            hi = lo
            while hi + 1 < len(known) and known[hi + 1] == known[hi] + 1:
                hi += 1
            if hi - lo + 1 >= MIN_MATCH:
                at = known[lo]
                for end, length, state in self.automaton.statistics(ids[at : known[hi] + 1]):
                    if length < MIN_MATCH:
                        continue
                    last, first = at + end, at + end - length + 1
                    for t, places in self.automaton.ends[state].items():
                        t_last = places[0]
                        if t in chains:
                            c = chains[t]
                            after = bisect_right(places, c[2])
                            if first - c[1] - 1 > MAX_GAP or after == len(places):
                                close(t)
                            else:
                                t_last = places[after]
                        t_first = t_last - length + 1
                        if t not in chains:
                            chains[t] = [first, last, t_last, length]
                        else:
                            c = chains[t]
                            c[1], c[3], c[2] = last, c[3] + t_last - max(t_first - 1, c[2]), t_last
            lo = hi + 1
        for t in list(chains):
            close(t)
        return sorted(out)

    def scan(self, text: bytes | None) -> tuple:
        words = alnum_words(text)
        starts, base = self.base(words)
        spans = self.spans(words)
        score = max([1.0 if base else 0.0, *(s[3] for s in spans)])
        labels = base | {s[2] for s in spans}
        ends = (min(starts), max(starts)) if starts else (None, None)
        return (len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, the digest columns and the chained spans of each row of docs."""
    scanner = Scanner(templates, phrases)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scanner.scan(t) for t in utf8(batch, "text")]
        spans = [[dict(zip(("first", "last", "label", "cover"), s)) for s in r[-1]] for r in rows]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_FIELDS)), pa.array(spans, _SPAN)], ["doc_id", *(n for n, _ in _FIELDS), "spans"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,last:long,label:string,cover:double>>"
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every document."""
    return scan(read_table(spark, sf_dir, "documents")).drop("spans")
