"""License scans by template-markup matching.

A template is the wording of a license with two kinds of regions marked: [[ ... ]] may be left out, and
<<name:n>> stands for any one to n words. It is compiled into an automaton over words; a text matches
where the automaton accepts, so every mandatory word must stand there in its order. Case, punctuation
and line breaks play no part, as words are lower-cased runs of letters and digits.

Before an automaton runs, the text must hold the template's anchor, the longest run of words that every
match contains; matches start near it, so texts without license wording cost one substring search each.

Base phrases are counted apart from templates, by exact runs of words, overlapping ones included.

Rows: one for each input row, in place. A null or empty text has no words: no places, no labels, score 0.
A null id stays null, repeated rows stay repeated, other columns are not read, an empty table gives no rows.
Texts of any length are scanned whole. The score is the share of
the text's words inside base phrases or matched templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm.common import map_texts, slim, table
from vigilake.llm.words import plain_words

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label -> templates. Wordings of public licenses and the notices that refer to them.
TEMPLATES = {
    "mit": [
        """[[permission notice]] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.""",
        "[[this <<work:3>> is]] released under the MIT License",
        "[[<<work:3>> is]] licensed under the MIT License",
    ],
    "isc": [
        """Permission to use, copy, modify, [[and]] [[/ or]] distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        "licensed under the ISC License",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "licensed under the BSD [[<<clauses:2>> clause]] license",
    ],
    "apache-2": [
        """Licensed under the Apache License, Version 2.0 [[(the "License")]] [[; you may not use this file except in compliance with the
        License]]""",
    ],
    "gpl-3": [
        "[[this]] [[<<work:3>> is]] licensed under the [[terms of the]] GNU General Public License, version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or [[(at your option)]] any later version.""",
    ],
    "gpl-2": [
        "[[this]] [[<<work:3>> is]] licensed under the [[terms of the]] GNU General Public License, version 2",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "licensed under the Mozilla Public License [[,]] [[version]] 2.0",
    ],
    "cc-by-nc": ["licensed under [[a]] [[the]] CC BY-NC [[4.0]] [[license]]", "licensed under [[a]] [[the]] Creative Commons Attribution NonCommercial [[4.0]] [[International]] License"],
    "cc-by": ["licensed under [[a]] [[the]] Creative Commons Attribution [[4.0]] [[International]] License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


@dataclass
class State:
    word: bytes | None = None  # None: any word
    to: int = -1
    free: list[int] = field(default_factory=list)  # moves that read nothing


class Automaton:
    """A template as a nondeterministic automaton over words. State 0 starts, the last state accepts."""

    def __init__(self, template: str):
        self.states = [State()]
        self.anchor, self.least = b"", 0
        opened: list[int] = []
        run: list[bytes] = []
        for token in re.findall(r"\[\[|\]\]|<<\w+:\d+>>|(?:(?!\[\[|\]\]|<<).)+", template, re.S):
            mandatory = False
            if token == "[[":
                opened.append(len(self.states) - 1)
            elif token == "]]":
                self.states[opened.pop()].free.append(len(self.states) - 1)
            elif token.startswith("<<"):
                most = int(token[2:-2].partition(":")[2])
                steps = [self._step(None) for _ in range(most)]
                for state in steps[:-1]:
                    self.states[state].free.append(steps[-1])
            else:
                words = plain_words(token.encode())
                for word in words:
                    self._step(word)
                mandatory = not opened
                if mandatory:
                    run += words
                    self.least += len(words)
                    self.anchor = max(self.anchor, b" ".join(run), key=len)
            if not mandatory:
                run = []
        self.final = len(self.states) - 1

    def _step(self, word: bytes | None) -> int:
        last = self.states[-1]
        last.word, last.to = word, len(self.states)
        self.states.append(State())
        return len(self.states) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.states[todo.pop()].free:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the longest match that starts here, or -1."""
        now, end = self._closed({0}), -1
        for k in range(start, len(words) + 1):
            if self.final in now:
                end = k
            if k == len(words):
                break
            now = self._closed({state.to for i in now if (state := self.states[i]).to >= 0 and (state.word is None or state.word == words[k])})
            if not now:
                break
        return end


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = [(b" " + b" ".join(plain_words(phrase.encode())) + b" ", len(phrase.split()), label) for phrase, label in phrases.items()]
        self.automata = [(label, Automaton(template)) for label, some in templates.items() for template in some]

    @staticmethod
    def places(text: bytes, wanted: bytes) -> list[int]:
        """The numbers of the words where a run of words, spaces around it, starts in a text of the same form."""
        found, at, words, counted = [], text.find(wanted), 0, 0
        while at >= 0:
            words += text.count(b" ", counted, at)
            counted = at
            found.append(words)
            at = text.find(wanted, at + 1)
        return found

    def scan(self, data: bytes) -> tuple:
        words = plain_words(data)
        text = b" " + b" ".join(words) + b" "
        starts, base, spans = [], set(), []
        for phrase, length, label in self.phrases:
            for at in self.places(text, phrase):
                starts.append(at)
                base.add(label)
                spans.append((at, at + length))
        labels = set(base)
        for label, automaton in self.automata:
            anchor = b" " + automaton.anchor + b" "
            if anchor not in text:
                continue
            reach, tried = len(automaton.states), -1
            for at in self.places(text, anchor):
                for start in range(max(tried + 1, at - reach), at + 1):
                    if (end := automaton.match(words, start)) >= 0:
                        labels.add(label)
                        spans.append((start, end))
                tried = max(tried, at)
        covered, last = 0, 0
        for start, end in sorted(spans):
            covered += max(0, end - max(start, last))
            last = max(last, end)
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), covered / len(words) if words else 0.0,
        )


def scan_licenses(df: DataFrame, *, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    phrases, templates = phrases or BASE_PHRASES, TEMPLATES if templates is None else templates

    def make():
        return Scanner(phrases, templates).scan

    schema = "id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double"
    return map_texts(slim(df, id_col, text_col), schema, make).withColumnRenamed("id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
