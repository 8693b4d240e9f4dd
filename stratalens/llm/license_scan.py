"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates expressions.

Phrases are sought among the words of a text, so that line breaks, punctuation and case do not matter: one
automaton reads the words, joined by single spaces, and reports all phrases with all overlaps. A
second one finds tags such as ``SPDX-License-Identifier:`` in the lower-cased text. The tokens that follow
a tag on its line are read as far as they form an expression of licences, ``and``, ``or``, ``with`` and
parentheses; operators are ordered by two stacks (``with`` binds before ``and``, ``and`` before
``or``), and the same pass evaluates what is left open to a user: the freest choice of
``or``, the strictest part of ``and``, and a step towards freedom for the exception of ``with``.

Tags that any text may hold (``license:``) are read as far as the licences are known ones;
an SPDX tag names whatever it says. ``score`` is the evidence that a text states its licence: one minus the
product of the doubts that different phrases and expressions leave.

Defined cases: a null text is empty; a text without words has no phrase, and a tag may still stand in it
only as words, so it has none; repeated rows are scanned one by one; an empty table gives an empty
result; other columns are not looked at. Texts of any length and nesting are read whole, in time that grows with
their length.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import whole_text

# The phrases that are counted place by place.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further notice phrases, and how much doubt one leaves.
NOTICES = {
    "the mit license": ("mit", 0.2), "mit licensed": ("mit", 0.2), "permission is hereby granted free of charge to any person": ("mit", 0.2),
    "gnu general public license version 2": ("gpl-2", 0.1), "gnu general public license version 3": ("gpl-3", 0.1), "gnu general public license": ("gpl", 0.4),
    "gnu lesser general public license": ("lgpl", 0.2), "gnu affero general public license": ("agpl", 0.2),
    "redistribution and use in source and binary forms": ("bsd", 0.2), "bsd 2 clause": ("bsd-2", 0.2), "bsd 3 clause": ("bsd-3", 0.2),
    "mozilla public license": ("mpl", 0.2), "eclipse public license": ("epl", 0.2), "boost software license": ("bsl-1", 0.2), "isc license": ("isc", 0.2),
    "released into the public domain": ("public-domain", 0.2), "this is free and unencumbered software": ("unlicense", 0.1), "creative commons zero": ("cc0", 0.2), "cc0 1 0": ("cc0", 0.2),
    "creative commons attribution": ("cc-by", 0.2), "cc by 4 0": ("cc-by", 0.2), "cc by 3 0": ("cc-by", 0.2), "cc by sa": ("cc-by-sa", 0.2), "cc by nd": ("cc-by-nd", 0.2),
    "cc by nc sa": ("cc-by-nc-sa", 0.1), "cc by nc nd": ("cc-by-nc-nd", 0.1), "creative commons attribution noncommercial": ("cc-by-nc", 0.2), "all rights reserved": ("reserved", 0.5),
}
BASE_DOUBT = 0.1

# Tags before an expression; whether any identifier counts, and the doubt left.
TAGS = {"spdx-license-identifier:": (True, 0.05), "license-expression:": (False, 0.1), "license:": (False, 0.2), "licence:": (False, 0.2), '"license":': (False, 0.2), "license =": (False, 0.2)}

# Identifiers of expressions and their labels.
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit", "apache-2.0": "apache-2", "apache-2": "apache-2", "isc": "isc", "0bsd": "bsd", "bsd": "bsd", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3",
    "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3",
    "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl",
    "agpl-3.0": "agpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl", "mpl-2.0": "mpl", "epl-2.0": "epl", "bsl-1.0": "bsl-1", "unlicense": "unlicense",
    "cc0-1.0": "cc0", "cc-by-3.0": "cc-by", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
}

# How free a licence leaves its users, from 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "unlicense": 1.0, "cc0": 1.0, "mit": 0.9, "apache-2": 0.9, "isc": 0.9, "bsd": 0.9, "bsd-2": 0.9, "bsd-3": 0.9, "bsl-1": 0.9, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.0, "reserved": 0.0,
}
UNKNOWN_FREEDOM = 0.0

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t\"'\[,]*([()]|[a-z0-9][a-z0-9.+-]*)")
_TAG_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, freedom double"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()]

#: Of the bytes: A to Z lowered; those between words become spaces. Others belong to words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(_LOWER[b] if b >= 128 or chr(_LOWER[b]).isalnum() else 32 for b in range(256))


def _base_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, tag)
    found.make_automaton()
    return found


class Expression:
    """An evaluated expression: the licences that it names, its text in pieces, and what it leaves open."""

    def __init__(self, identifier: str):
        label = label_of(identifier)
        self.licences = {label}
        self.pieces = deque([label])
        self.freedom = FREEDOM.get(label, UNKNOWN_FREEDOM)
        self.binds = max(PRECEDENCE.values()) + 1

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def apply(self, operator: str, right: Expression) -> Expression:
        """``self operator right``; the smaller side moves, so that no chain or nest costs a square."""
        for side in (self, right):
            if side.binds < PRECEDENCE[operator]:
                side.pieces.appendleft("(")
                side.pieces.append(")")
        free = {"or": max(self.freedom, right.freedom), "and": min(self.freedom, right.freedom), "with": (self.freedom + 1) / 2}[operator]
        small, large = (right, self) if len(right.pieces) <= len(self.pieces) else (self, right)
        if small is right:
            large.pieces.append(f" {operator} ")
            large.pieces.extend(small.pieces)
        else:
            large.pieces.appendleft(f" {operator} ")
            large.pieces.extendleft(reversed(small.pieces))
        # The name of an exception stays in the text, but is no licence.
        parts = [self.licences] if operator == "with" else sorted((self.licences, right.licences), key=len, reverse=True)
        large.licences = parts[0]
        for more in parts[1:]:
            large.licences |= more
        large.freedom, large.binds = free, PRECEDENCE[operator]
        return large


def label_of(identifier: str) -> str:
    plain = identifier.rstrip("+")
    return IDENTIFIERS.get(plain, plain)


def complete(tokens: list[str], any_name: bool = True) -> int:
    """How many first tokens form an expression, of known licences unless ``any_name``; 0 where none do."""
    depth, wants, done = 0, True, 0
    for i, token in enumerate(tokens):
        if wants and token == "(":
            depth += 1
        elif wants and token not in PRECEDENCE and token != ")":
            if not any_name and label_of(token) not in FREEDOM and (not i or tokens[i - 1] != "with"):
                break
            wants = False
        elif not wants and token == ")" and depth:
            depth -= 1
        elif not wants and token in PRECEDENCE:
            # The right side of a ``with`` is the name of an exception, and neither side is a group.
            if token == "with" and (tokens[i - 1] == ")" or i + 1 < len(tokens) and tokens[i + 1] == "("):
                break
            wants = True
        else:
            break
        if not wants and not depth:
            done = i + 1
    return done


def evaluated(tokens: list[str]) -> Expression | None:
    """The value of a whole expression by two stacks, or None where ``tokens`` are none."""
    if not tokens or complete(tokens) != len(tokens):
        return None
    values: list[Expression] = []
    waiting: list[str] = []

    def settle() -> None:
        b, a = values.pop(), values.pop()
        values.append(a.apply(waiting.pop(), b))

    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                settle()
            waiting.pop()
        elif token in PRECEDENCE:
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                settle()
            waiting.append(token)
        else:
            values.append(Expression(token))
    while waiting:
        settle()
    return values[0]


def expression_at(text: str, at: int, any_name: bool = True) -> tuple[list[str], int]:
    """The tokens of the expression that starts at ``at`` of a lower-cased text, and where they end."""
    tokens, ends, pattern = [], [at], _TOKEN
    while (m := pattern.match(text, ends[-1])) is not None:
        tokens.append(m.group(1))
        ends.append(m.end())
        pattern = _TAG_TOKEN
    n = complete(tokens, any_name)
    return tokens[:n], ends[n]


@dataclass
class Found:
    """What a text says of its licence."""

    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    doubts: dict[str, float] = field(default_factory=dict)
    expressions: dict[str, float] = field(default_factory=dict)

    def notice(self, label: str, doubt: float) -> None:
        self.labels.add(label)
        self.doubts[label] = min(doubt, self.doubts.get(label, 1.0))

    def base_place(self, phrase: str, index: int) -> None:
        self.n_base += 1
        self.base.add(BASE[phrase])
        self.first_word = index if self.first_word is None else min(self.first_word, index)
        self.last_word = index if self.last_word is None else max(self.last_word, index)
        self.notice(BASE[phrase], BASE_DOUBT)

    def row(self) -> tuple:
        left = 1.0
        for doubt in self.doubts.values():
            left *= doubt
        joined = lambda names: ",".join(sorted(names))
        free = min(self.expressions.values(), default=min((FREEDOM.get(x, UNKNOWN_FREEDOM) for x in self.labels), default=None))
        return self.n_words, self.n_base, self.first_word, self.last_word, joined(self.base), joined(self.labels), 1 - left, "; ".join(sorted(self.expressions)) or None, free


class Scanner:
    """The two automata of a task."""

    def __init__(self) -> None:
        self.phrases, self.tags = _base_automaton(), _tag_automaton()

    def scan(self, raw: bytes) -> Found:
        out = Found()
        words = raw.translate(_WORDS).split()
        out.n_words = len(words)
        if words:
            line = f" {b' '.join(words).decode()} "
            at = index = 0
            notices: list[tuple[int, int, str]] = []
            for end, phrase in self.phrases.iter(line):
                start = end - len(phrase) - 1
                # Phrases are reported by their ends, so starts may step back a little.
                index += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                at = start
                if phrase in BASE:
                    out.base_place(phrase, index)
                else:
                    notices.append((start, -end, phrase))
            reach = -1
            for _, end, phrase in sorted(notices):
                # A notice inside a longer one says nothing of its own.
                if -end > reach:
                    reach = -end
                    out.notice(*NOTICES[phrase])
        lowered = raw.translate(_LOWER).decode()
        read = 0
        for end, tag in self.tags.iter(lowered):
            if end < read:
                continue
            any_name, doubt = TAGS[tag]
            tokens, read = expression_at(lowered, end + 1, any_name)
            value = evaluated(tokens)
            if value is None:
                continue
            text = value.text
            out.labels |= value.licences
            out.expressions[text] = value.freedom
            out.doubts[text] = min(doubt, out.doubts.get(text, 1.0))
        return out


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """SCHEMA: one row per row of ``docs``; places count words from 0."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [scanner.scan(t.as_buffer().to_pybytes()).row() for t in batch.column(1)]
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 9, _KINDS[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text).alias("text")).mapInArrow(scanned, SCHEMA)
