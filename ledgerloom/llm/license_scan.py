"""Licence scan with a generalised suffix automaton of template words.

Words are runs of digits, letters and characters beyond ASCII; A-Z are lower-cased. One suffix automaton
holds all templates. A text is streamed through it word by word; at each word the automaton gives the
longest stretch of words ending there that occurs in a template (the matching statistics). Then

* a *base* phrase stands wherever it is a suffix of that stretch, which the automaton's suffix links tell;
* stretches of at least ``MIN_WORDS`` words that cannot be made longer are chained per template, in
  order of text and template and with gaps of at most ``MAX_GAP`` words, and a chain that covers
  ``COVERED`` of the template's words labels the document with the template's licence.

The score is the largest covered share of any template, 1 where a base phrase stands.

Defined results: null, empty and word-less texts have no words, no labels (empty strings), score 0 and
null positions. Repeated rows are scanned alike. Texts of any length are read in one pass, holding their
words and the chains that are open. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import table, values

#: Base phrases: fixed values.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Templates of the method: usual wordings of licence notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

MIN_WORDS, MAX_GAP, COVERED = 3, 4, 0.8

#: Bytes that are no part of a word become spaces; A-Z become a-z.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


@dataclass
class Automaton:
    """States of a generalised suffix automaton; ``next``, ``link`` and ``length`` by state.

    ``ends`` has the places (template, words up to there) at which the state's strings end, ``phrases``
    the base phrases (label, words) that are suffixes of them.
    """

    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    phrases: list[list[tuple[str, int]]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)

    def _state(self, length: int, like: int | None = None) -> int:
        self.length.append(length)
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state of p's longest string followed by ``word``, made its own if it is part of a longer one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, like=q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:  # the string is known from another template
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = self._split(p, word) if p >= 0 else 0
        return new


def build(templates: Sequence[tuple[str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> Automaton:
    auto = Automaton()
    accepted: dict[int, list[tuple[str, int]]] = {}
    for label, phrase in [*templates, *base]:
        tokens, state = phrase.encode().split(), 0
        for at, word in enumerate(tokens, 1):
            state = auto._extend(state, word)
            auto.ends[state].add((len(auto.sizes), at))
        auto.sizes.append(len(tokens))
        auto.labels.append(label)
    for label, phrase in base:
        state = 0
        for word in phrase.split():
            state = auto.next[state][word.encode()]
        accepted.setdefault(state, []).append((label, len(phrase.split())))
    by_length = sorted(range(1, len(auto.length)), key=lambda s: -auto.length[s])
    for s in by_length:  # what ends in a state ends in its suffixes too
        auto.ends[auto.link[s]] |= auto.ends[s]
    auto.phrases = [[] for _ in auto.length]
    for s in reversed(by_length):
        auto.phrases[s] = accepted.get(s, []) + auto.phrases[auto.link[s]]
    return auto


@functools.cache
def automaton() -> Automaton:
    return build()


@dataclass
class Scan:
    words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[int, int, str, float]] = field(default_factory=list)


def scan(text: str | None, auto: Automaton, min_words: int = MIN_WORDS, max_gap: int = MAX_GAP) -> Scan:
    """Base places (first word, label) and, per template, the best span (first word, word behind, label, share)."""
    out = Scan()
    following, link, length, phrases = auto.next, auto.link, auto.length, auto.phrases
    start = following[0]
    chains: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}  # template -> (text end, template end) -> (text start, covered words)
    best: dict[int, tuple[float, int, int]] = {}
    at, state, matched = -1, 0, 0

    def close(end: int) -> None:
        """The longest stretch that ends before word ``end`` cannot be made longer there."""
        if matched < min_words:
            return
        for template, behind in auto.ends[state]:
            begin, first = end - matched, behind - matched
            start_, share_ = begin, matched
            open_ = {ends: c for ends, c in chains.get(template, {}).items() if begin - ends[0] <= max_gap}
            for (text_end, template_end), (chain_start, chain_words) in open_.items():
                overlap = max(0, text_end - begin, template_end - first)
                if end > text_end and behind > template_end and first - template_end <= max_gap and chain_words + matched - overlap > share_:
                    start_, share_ = chain_start, chain_words + matched - overlap
            if share_ > open_.get((end, behind), (0, 0))[1]:
                open_[end, behind] = (start_, share_)
            chains[template] = open_
            share = min(1.0, share_ / auto.sizes[template])
            if share > best.get(template, (0.0,))[0]:
                best[template] = (share, start_, end)

    for word in words(text):
        at += 1
        if matched == 0 and word not in start:
            continue
        while True:
            step = following[state].get(word)
            if step is not None:
                state, matched = step, matched + 1
                break
            if state == 0:
                matched = 0
                break
            if length[state] >= min_words:
                close(at)
            state = link[state]
            matched = length[state]
        for label, size in phrases[state]:
            if matched >= size:
                out.base.append((at - size + 1, label))
    close(at + 1)
    out.words = at + 1
    out.spans = [(begin, end, auto.labels[t], share) for t, (share, begin, end) in best.items() if share > 0]
    return out


_FIELDS = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())]
)
_KINDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def licenses(docs: DataFrame, covered: float = COVERED) -> DataFrame:
    """One row per document; ``spans`` lists the covered spans as first-behind:label, in order of text."""

    def one(text: str | None) -> tuple:
        found = scan(text, automaton())
        places = [p for p, _ in found.base]
        base = {label for _, label in found.base}
        full = sorted(s for s in found.spans if s[3] >= covered)
        labels = base | {s[2] for s in full}
        score = 1.0 if base else max((s[3] for s in found.spans), default=0.0)
        spans = " ".join(f"{b}-{e}:{label}" for b, e, label, _ in full)
        return found.words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(text) for text in values(batch.column("text"))]
            columns = [pa.array([r[k] for r in found], f.type) for k, f in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_FIELDS.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_KINDS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
