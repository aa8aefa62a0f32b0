"""License scans: an Aho-Corasick automaton finds notice phrases and identifier
tags, a shunting-yard parser evaluates the expressions that follow tags.

A text is lower-cased (A-Z), cut into words of ``[a-z0-9]`` and non-ASCII
characters, and its words are joined by single spaces; a phrase occurs where its
words stand consecutively.  A tag (``SPDX-License-Identifier:`` and the like) is
found by the same automaton; the expression after it is read from the raw line,
parsed into postfix order (``WITH`` binds tightest, then ``AND``, then ``OR``) and
evaluated to its licenses and to whether they permit commercial use.

The scan is one map over the rows, with nothing shuffled.  Defined results: null
and empty texts have no words and no labels; a malformed expression gives the
identifiers before the fault; ties and repeated rows are scanned alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Phrase and label of the base scan.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notice phrases of the method and their labels.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}

#: Words of the tags that announce an expression.
TAGS = ("spdx license identifier", "license identifier")

#: Identifiers (a prefix up to a version) and labels.
IDENTIFIERS = {
    "mit": "mit",
    "apache": "apache-2",
    "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa",
    "cc-by": "cc-by",
    "cc0": "cc0",
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "mpl": "mpl",
    "bsd": "bsd",
    "isc": "isc",
}

#: Labels that forbid commercial use.
RESTRICTED = {"cc-by-nc", "proprietary"}

_WORD_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
_TAG_LINE = re.compile(r"licen[sc]e-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_RANK = {"or": 1, "and": 2, "with": 3}


@dataclass
class Expression:
    """Postfix form and value of a license expression."""

    postfix: list[str] = field(default_factory=list)
    labels: frozenset[str] = frozenset()
    commercial: bool = False
    valid: bool = False


def label_of(identifier: str) -> str:
    """Label of a license identifier; an unknown one is its own label."""
    name = identifier.lower().rstrip("+")
    for known in sorted(IDENTIFIERS, key=len, reverse=True):
        if name == known or name.startswith(known + "-"):
            return IDENTIFIERS[known]
    return name


def parse(text: str) -> Expression:
    """Shunting yard over operands, ``and``/``or``/``with`` and brackets; stops at the first token that doesn't fit."""
    output: list[str] = []
    held: list[str] = []
    operand = True  # an operand is due
    ok = True
    for token in _TOKEN.findall(text):
        word = token.lower()
        if word in _RANK:
            if operand:
                ok = False
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                output.append(held.pop())
            held.append(word)
            operand = True
        elif token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            if operand or "(" not in held:
                ok = False
                break
            while held[-1] != "(":
                output.append(held.pop())
            held.pop()
        else:
            if not operand:
                break  # prose after the expression
            output.append(token)
            operand = False
    ok = ok and bool(output) and not operand and "(" not in held
    while held:
        top = held.pop()
        if top != "(":
            output.append(top)
    return _evaluate(output, ok)


def _evaluate(postfix: list[str], ok: bool) -> Expression:
    """A stack of (labels, commercial): OR allows what either side allows, AND what both do, WITH keeps its left side."""
    stack: list[tuple[frozenset[str], bool]] = []
    for token in postfix:
        if token in _RANK and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else (left[0] | right[0], left[1] or right[1] if token == "or" else left[1] and right[1]))
        elif token not in _RANK:
            label = label_of(token)
            stack.append((frozenset([label]), label not in RESTRICTED))
    labels = frozenset().union(*(x[0] for x in stack))
    return Expression(postfix, labels, bool(stack) and all(x[1] for x in stack), ok)


class Scanner:
    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, str] | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        # one entry a phrase: base phrases count places, the others add labels
        for kind, phrases in (("tag", dict.fromkeys(TAGS, "")), ("notice", NOTICE_PHRASES if notices is None else notices), ("base", BASE_PHRASES if base is None else base)):
            for phrase, label in phrases.items():
                self.automaton.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> dict:
        words = raw.translate(_WORD_TABLE).split()
        line = (b" " + b" ".join(words) + b" ").decode()
        places, base, other, tagged = [], set(), set(), False
        for end, (kind, label, size) in self.automaton.iter(line):
            if kind == "tag":
                tagged = True
            elif kind == "base":
                base.add(label)
                places.append(line.count(" ", 0, end - size + 1))
            else:
                other.add(label)
        found = [parse(m[1]) for m in _TAG_LINE.finditer(raw.decode())] if tagged else []
        for x in found:
            other |= x.labels
        labels = base | other
        # each place or tag of its own halves the doubt
        evidence = len(places) + len(other - base) + sum(x.valid for x in found)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 - 0.5**evidence,
            "expressions": [" ".join(x.postfix) for x in found], "commercial": not (labels & RESTRICTED) or any(x.commercial for x in found),
        }


_FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
    "score": pa.float64(), "expressions": pa.list_(pa.string()), "commercial": pa.bool_(),
}


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id with the places, labels, expressions (postfix) and score of each text."""

    def run(batches):
        scanner = Scanner(base, notices)
        for batch in tokens.pieces(batches):
            rows = [scanner.scan(t or b"") for t in tokens.as_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in _FIELDS.items())], ["doc_id", *_FIELDS])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, commercial boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
