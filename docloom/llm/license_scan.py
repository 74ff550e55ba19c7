"""License scans by template-markup matching.

A template is plain wording with markup: ``<<opt>> ... <</opt>>`` may be absent, ``<<var:N>>`` stands for up to N words of
any wording. Templates are compiled into automata over word tokens; a text matches where its mandatory wording stands
exactly, in order, with nothing else in between. Phrases are templates without markup.

Defined results: null text counts as empty; repeated rows each get a row; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordhash import SPLIT_TABLE, words_of

#: base phrases and their labels, fixed by the contract
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Creative Commons in full words, hyphens or not
_CC = "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> creative commons"
_CC_TAIL = "<<opt>>sharealike<</opt>> <<opt>>share alike<</opt>> <<opt>>noderivatives<</opt>> <<opt>>noderivs<</opt>> <<opt>>no derivatives<</opt>> <<opt>>4 0<</opt>> <<opt>>3 0<</opt>> <<opt>>2 5<</opt>> <<opt>>2 0<</opt>> <<opt>>1 0<</opt>> <<opt>>international<</opt>> <<opt>>unported<</opt>> <<opt>>public<</opt>> <<opt>>license<</opt>>"
#: notices and grants; label, markup
TEMPLATES = (
    ("mit-notice", "<<opt>>this <<opt>>work<</opt>><<opt>>software<</opt>> is<</opt>> <<opt>>released<</opt>><<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> MIT license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-notice", "licensed under the apache license version <<var:3>>"),
    ("gpl-notice", "<<opt>>this <<var:2>> is<</opt>> licensed under the <<opt>>terms of the<</opt>> <<opt>>gnu<</opt>> <<opt>>lesser<</opt>> general public license <<opt>>version <<var:2>><</opt>>"),
    ("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under <<opt>>a<</opt>> <<opt>>creative commons<</opt>> <<opt>>cc<</opt>> by nc <<opt>>sa<</opt>> <<var:2>>"),
    ("cc-by", "licensed under <<opt>>a<</opt>> <<opt>>creative commons<</opt>> cc by <<opt>>sa<</opt>> <<var:2>>"),
    ("cc-by-nc", f"{_CC} attribution noncommercial {_CC_TAIL}"),
    ("cc-by-nc", f"{_CC} attribution non commercial {_CC_TAIL}"),
    ("cc-by", f"{_CC} attribution {_CC_TAIL}"),
)
MARK = re.compile(r"<<opt>>|<</opt>>|<<var:(\d+)>>")


@dataclass
class Automaton:
    """States with transitions by token, by any token (``wild``), and without one (``skip``)."""

    label: str
    steps: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    wild: list[list[int]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0
    anchor: bytes = b""

    def _state(self) -> int:
        self.steps.append({})
        self.wild.append([])
        self.skip.append([])
        return len(self.steps) - 1

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        a = cls(label)
        at, opened, done = 0, [], 0
        fixed: list[bytes] = []

        def wording(text: str, at: int) -> int:
            for w in words_of(text):
                to = a._state()
                a.steps[at].setdefault(w, []).append(to)
                if not opened:
                    fixed.append(w)
                at = to
            return at

        for m in MARK.finditer(template):
            at = wording(template[done : m.start()], at)
            done = m.end()
            if m[0] == "<<opt>>":
                opened.append(at)
                to = a._state()  # an own first state, so that loops of inner parts stay inside
                a.skip[at].append(to)
                at = to
            elif m[0] == "<</opt>>":
                if not opened:
                    raise ValueError(f"{label}: <</opt>> without <<opt>>")
                to = a._state()
                a.skip[at].append(to)
                a.skip[opened.pop()].append(to)
                at = to
            else:
                end = a._state()
                for _ in range(int(m[1])):
                    to = a._state()
                    a.skip[at].append(end)
                    a.wild[at].append(to)
                    at = to
                a.skip[at].append(end)
                at = end
        a.final = wording(template[done:], at)
        if opened or not fixed:
            raise ValueError(f"{label}: an open <<opt>>, or no mandatory wording")
        a.anchor = max(fixed, key=len)
        return a

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.steps[s]}

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match that begins at ``at``, or -1."""
        now, end, i = self.closure({0}), -1, at
        while now:
            if self.final in now and i > at:
                end = i
            if i >= len(words):
                break
            w = words[i]
            now = self.closure({t for s in now for t in (*self.steps[s].get(w, ()), *self.wild[s])})
            i += 1
        return end


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.automata = [Automaton.compile(label, phrase) for phrase, label in phrases] + [Automaton.compile(label, text) for label, text in templates]
        self.n_base = len(phrases)
        self.anchors = {a.anchor for a in self.automata}
        self.first: dict[bytes, list[int]] = {}
        for k, a in enumerate(self.automata):
            for w in a.first_words():
                self.first.setdefault(w, []).append(k)

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        raw = text.encode("utf-8", "surrogatepass").translate(SPLIT_TABLE) if text else b""
        words = raw.split()
        base: list[int] = []
        base_labels, more = set(), set()
        covered = 0
        if any(a in raw for a in self.anchors):
            first, automata = self.first, self.automata
            held = {k for k, a in enumerate(automata) if a.anchor in raw}
            for i in [i for i, w in enumerate(words) if w in first]:
                best, label = i, None  # of the templates that match here the one that takes most words counts
                for k in first[words[i]]:
                    if k in held and (end := automata[k].match(words, i)) >= 0:
                        if k < self.n_base:
                            base.append(i)
                            base_labels.add(automata[k].label)
                        elif end > best:
                            best, label = end, automata[k].label
                if label:
                    more.add(label)
                    covered = max(covered, best - i)
        score = 0.0 if not (base or more) else min(1.0, 0.5 * bool(base_labels) + 0.4 * bool(more) + 0.1 * (covered >= 12))
        return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | more)), score)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TYPES = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document with the places of license wording and its labels."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanner = Scanner(phrases, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[] for _ in TYPES], TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *NAMES])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
