"""License scans: Aho-Corasick for tags and phrases, a shunting-yard parser for expressions.

One automaton over the lower-cased text finds identifier tags, another one over the
text's words (joined by single blanks) finds notice phrases. What follows a tag is
parsed as a licence expression (``and``, ``or``, ``with``, parentheses) and evaluated to
the labels of its licences and to a score.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_columns

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases that the method adds.
NOTICES = {
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Label of a licence identifier by the family that it begins with, if its version, a mark such as ``+`` or ``-only``, or nothing follows.
FAMILIES = {
    "mit": "mit", "x11": "mit", "isc": "isc", "apache": "apache", "bsd": "bsd", "0bsd": "public-domain", "unlicense": "public-domain", "wtfpl": "public-domain", "cc0": "public-domain", "pddl": "public-domain", "cc": "cc",
    "bsl": "bsl", "zlib": "zlib", "psf": "psf", "python": "psf", "artistic": "artistic", "ofl": "ofl", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "mpl": "mpl", "epl": "epl", "cpl": "epl", "cddl": "cddl", "eupl": "eupl", "cecill": "cecill",
    "osl": "osl", "afl": "afl", "lgpl": "lgpl", "gpl": "gpl", "agpl": "agpl", "sspl": "sspl", "busl": "busl",
}
#: What may follow a family's name.
FOLLOWS = "($|[-+.0-9]|v[0-9])"
#: What a licence asks for, from 0 (nothing) to 1 (all rights reserved); with an exception, less by a quarter.
WEIGHT = {
    "public-domain": 0.05, "mit": 0.1, "isc": 0.1, "bsl": 0.1, "zlib": 0.1, "bsd": 0.15, "psf": 0.15, "apache": 0.2, "afl": 0.2, "artistic": 0.3, "ofl": 0.3, "ms-pl": 0.3, "cc": 0.4, "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "ms-rl": 0.5,
    "lgpl": 0.6, "eupl": 0.7, "cecill": 0.8, "osl": 0.8, "gpl": 0.8, "agpl": 0.9, "busl": 0.9, "sspl": 0.95, "proprietary": 1.0,
}
UNKNOWN = 0.7

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in _LOWER)


@dataclass
class Parsed:
    """An expression's licences (labels) and what it asks for at least."""

    labels: set[str] = field(default_factory=set)
    weight: float = 0.0


_POWER = {"or": 1, "and": 2, "with": 3}
#: A line's end and the end of a comment also end an expression.
_TOKEN = re.compile(r"\n|\*/|\(|\)|[a-z0-9][a-z0-9.+:-]*")


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order (shunting-yard); ValueError if it isn't one."""
    out, stack, operand = [], [], False
    for token in expression:
        if token in _POWER:
            if not operand:
                raise ValueError("an operator without an operand before it")
            while stack and stack[-1] != "(" and _POWER[stack[-1]] >= _POWER[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError("no operator before a parenthesis")
            stack.append(token)
        elif token == ")":
            if not operand:
                raise ValueError("an empty parenthesis")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("a parenthesis too many")
            stack.pop()
        else:
            if operand:
                raise ValueError("no operator between licences")
            out.append(token)
            operand = True
    while stack:
        if stack[-1] == "(":
            raise ValueError("an open parenthesis")
        out.append(stack.pop())
    if not operand:
        raise ValueError("an expression ends in a licence")
    return out


_FAMILY = re.compile(f"({'|'.join(FAMILIES)}){FOLLOWS}")


def label_of(identifier: str) -> str:
    """The label of a lower-cased licence identifier; ``other`` for one of no known family."""
    m = _FAMILY.match(identifier)
    return FAMILIES[m[1]] if m else "other"


def evaluate(tokens: list[str]) -> Parsed:
    """``or`` leaves the choice (the lesser weight), ``and`` asks for both, ``with`` grants an exception."""
    stack: list[Parsed] = []
    for token in postfix(tokens):
        if token in _POWER:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(Parsed(left.labels, left.weight * 0.75))
            else:
                stack.append(Parsed(left.labels | right.labels, (min if token == "or" else max)(left.weight, right.weight)))
        else:
            label = label_of(token)
            stack.append(Parsed({label}, WEIGHT.get(label, UNKNOWN)))
    return stack[0]


def parse_tag(low: str, start: int = 0) -> Parsed:
    """The expression that the line begins with at ``start`` (of a lower-cased text, after a tag), however long.

    Of a line that goes on with other words, the longest beginning that is an expression
    counts; without any, nothing is found. Reading stops at the first token that can't go on.
    """
    tokens: list[str] = []
    end, operand, depth = 0, False, 0
    for k, token in enumerate(m[0] for m in _TOKEN.finditer(low, start)):
        if token in ("\n", "*/"):
            break
        tokens.append(token)
        if token in _POWER or token == ")":
            if not operand or token == ")" and not depth:
                break
            depth -= token == ")"
            operand = token == ")"
        elif operand:
            break
        else:
            depth += token == "("
            operand = token != "("
        if operand and not depth:
            end = k + 1
    return evaluate(tokens[:end]) if end else Parsed()


@functools.cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        phrases.add_word(f" {phrase} ", (phrase, label))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None) -> tuple[int, list[int], set[str], set[str], float]:
    """Number of words, places of base phrases, base labels, all labels, score.

    The score is the largest weight of what is found, 0 without anything.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(_WORD).split()
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    phrases, tags = _automata()
    places, base, labels, score = [], set(), set(), 0.0
    counted = at = 0
    for end, (phrase, label) in phrases.iter(flat):
        labels.add(label)
        score = max(score, WEIGHT[label])
        if phrase in BASE:
            start = end - len(phrase) - 1
            if start < at:
                counted = at = 0
            counted += flat.count(" ", at, start)
            at = start
            places.append(counted)
            base.add(label)
    low = data.translate(_LOWER).decode("latin-1")
    for end, _ in tags.iter(low):
        found = parse_tag(low, end + 1)
        labels |= found.labels
        score = max(score, found.weight)
    return len(words), places, base, labels, score


def license_report(docs: DataFrame) -> DataFrame:
    """What each text of ``docs`` says about licences.

    Null and empty texts have no words and a score of 0; repeated rows have equal
    results; only doc_id and text are read.
    """

    def report(ids, texts):
        out = [scan(t) for t in texts]
        text = lambda labels: ",".join(sorted(labels))
        return (
            ids, [n for n, *_ in out], [len(p) for _, p, *_ in out], [min(p, default=None) for _, p, *_ in out], [max(p, default=None) for _, p, *_ in out],
            [text(b) for _, _, b, *_ in out], [text(x) for *_, x, _ in out], [s for *_, s in out],
        )

    return map_columns(docs.select("doc_id", "text"), report, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
