"""License scan by template markup.

A template is license wording with `<<optional>> ... <</optional>>` regions and `<<var n>>` places, where a text may have
0 to n words of its own. It is compiled to an automaton over words: a state is a place in the template, a text word moves
along a literal word, stays in a replaceable region, or an optional region is passed by. A text is accepted from a word on
if some run reaches the end, which needs every mandatory word in order. An automaton starts only around places of
two of its mandatory words that stand side by side.

Words are lower-cased in A-Z only and hold digits, letters and every character beyond ASCII. Plain phrases are counted at
all their places besides. The score is the share of words inside accepted templates and phrases.

Defined results: null and empty texts have no words and score 0; overlapping places count each; repeated rows are rows of
their own; an empty table gives an empty one.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import arrow, steps

#: Phrases of the base scan and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license notices and grants as templates: fixed wording of the licenses.
TEMPLATES = {
    "copyright-notice": "copyright <<optional>> c <</optional>> <<var 12>> all rights reserved",
    "GPL-notice": "licensed under the <<optional>> terms of the <</optional>> <<optional>> gnu <</optional>> general public license"
    " <<optional>> as published by the free software foundation <</optional>> <<optional>> either <</optional>> version <<var 1>>",
    "GPL-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " <<optional>> lesser <</optional>> <<optional>> affero <</optional>> general public license as published by the free software foundation"
    " either version <<var 3>> of the license or at your option any later version",
    "CC-BY-notice": "licensed under <<optional>> a <</optional>> <<optional>> the <</optional>> <<optional>> creative commons <</optional>> <<var 2>> cc by"
    " <<optional>> sa <</optional>> <<optional>> nc <</optional>> <<optional>> nd <</optional>> <<var 2>>",
    "CC-license": "licensed under <<optional>> a <</optional>> <<optional>> the <</optional>> creative commons attribution"
    " <<optional>> sharealike <</optional>> <<optional>> noncommercial <</optional>> <<optional>> noderivatives <</optional>> <<var 3>> license",
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    " the software to deal in the software without restriction",
    "MIT-notice": "<<optional>> licensed <</optional>> <<optional>> released <</optional>> under the mit license",
    "Apache-2.0": "licensed under the apache license version 2 0 <<optional>> the license you may not use this file except in compliance with"
    " the license <</optional>>",
    "BSD": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "<<optional>> this work <</optional>> is <<optional>> released <</optional>> in the public domain",
}

_SPACED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
MARKUP = re.compile(r"<<(/?optional|var \d+)>>|(\S+)")


def words_of(text):
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


class Automaton:
    """States 0..n; `arcs[s]` maps a word to the next states, `skips[s]` lists states reached without a word."""

    def __init__(self, template):
        self.arcs, self.skips, self.free = [{}], [[]], [False]
        opened, mandatory = [], []
        for mark, word in MARKUP.findall(template):
            if word:
                self._step(word.encode())
                if not opened:
                    mandatory.append((len(self.arcs) - 2, word.encode()))
            elif mark == "optional":
                opened.append(len(self.arcs) - 1)
            elif mark == "/optional":
                self.skips[opened.pop()].append(len(self.arcs) - 1)
            else:
                for _ in range(int(mark[4:])):
                    self.free[-1] = True
                    self._state()
                    self.skips[-2].append(len(self.arcs) - 1)
        self.end = len(self.arcs) - 1
        #: two mandatory words that stand side by side, the longest such pair, and how many words may precede it
        pairs = [(a[1] + b" " + b[1], a[0]) for a, b in zip(mandatory, mandatory[1:]) if b[0] == a[0] + 1]
        self.anchor, self.lead = max(pairs, key=lambda p: len(p[0]))

    def _state(self):
        self.arcs.append({})
        self.skips.append([])
        self.free.append(False)

    def _step(self, word):
        self._state()
        self.arcs[-2].setdefault(word, []).append(len(self.arcs) - 1)

    def _closed(self, states):
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def match(self, words, at):
        """Index behind the longest accepted run of words from `at`, or None."""
        states, found = self._closed([0]), None
        for i in range(at, len(words) + 1):
            if self.end in states:
                found = i
            if i == len(words) or not states:
                break
            after = set()
            for s in states:
                after.update(self.arcs[s].get(words[i], ()))
                if self.free[s]:
                    after.add(s + 1)
            states = self._closed(after)
        return found

    def places(self, words, joined):
        """(start, end) of accepted runs; a run starts at most `lead` words before its anchor."""
        out = {}
        for at in positions(joined, self.anchor):
            for start in range(max(0, at - self.lead), at + 1):
                end = self.match(words, start)
                if end is not None and end > at:
                    out.setdefault(end, start)
        return [(start, end) for end, start in out.items()]


def positions(joined, phrase):
    """Word indexes at which a phrase stands in words joined, led and ended by blanks."""
    out, at, seen, i = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        i += joined.count(b" ", seen, at)
        seen = at
        out.append(i)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


@lru_cache(maxsize=8)
def compiled(templates):
    return [(label, Automaton(t)) for label, t in templates]


def scan(text, phrases, automata):
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base, spans, base_labels, labels = [], [], set(), set()
    for phrase, label in phrases:
        if at := positions(joined, phrase):
            base += at
            spans += [(i, i + phrase.count(b" ") + 1) for i in at]
            base_labels.add(label)
    for label, automaton in automata:
        if automaton.anchor in joined and (found := automaton.places(words, joined)):
            spans += found
            labels.add(label)
    covered = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        covered[a] += 1
        covered[b] -= 1
    score = float((np.cumsum(covered) > 0).sum()) / len(words) if spans else 0.0
    join = lambda found: ",".join(sorted(found))
    return len(words), len(base), min(base, default=None), max(base, default=None), join(base_labels), join(base_labels | labels), score


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs, templates=None, phrases=None):
    """docs(doc_id, text) -> one row per document, see SCANNED."""
    templates = tuple((templates or TEMPLATES).items())
    phrases = [(p.encode(), label) for p, label in (phrases or PHRASES).items()]
    names = [c.split()[0] for c in SCANNED.split(", ")]
    kinds = dict(zip(names, [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]))

    def run(batches):
        automata = compiled(templates)
        for batch in steps(batches, "text"):
            rows = [scan(t or "", phrases, automata) for t in batch.column("text").to_pylist()]
            yield arrow({"doc_id": batch.column("doc_id")} | dict(zip(names[1:], map(list, zip(*rows)))), kinds)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCANNED)
