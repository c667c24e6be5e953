"""Secret scans by one deterministic automaton for all rules.

Rules are regular expressions over bytes. They are compiled together: parsed to a
nondeterministic automaton, made deterministic by subset construction over classes of
bytes, minimised by partition refinement, and laid out as one transition array whose
accepting states come last. The automaton is that of the reversed rules and reads a text's
bytes once, from the last to the first: so it accepts exactly where a match of a rule
begins. Of a rule's places the leftmost counts; only from there its end is sought, over the
match's own bytes, with the rule's anchored automaton (longest), and the next place that
counts is at or after that end. Far from where matches begin, no byte is read twice.
"""

from __future__ import annotations

import functools
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_columns, with_columns


@dataclass(frozen=True)
class Rule:
    """``pattern`` as in Python, with ``(?i:...)``, classes, groups, ``| ? * + {m,n}``.

    The part of a match after the longest ``prefix`` (the whole match, if there is none)
    must have ``least`` characters, else the match is dropped; it still takes up its
    place. Lengths belong there where patterns can share characters: counters of several
    patterns multiply the states of the common automaton.
    """

    kind: str
    pattern: str
    prefix: str = ""
    least: int = 0


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: A run of hex digits is maximal, so its least length can be part of the pattern; nearly every text has shorter runs.
BASE = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _ASSIGN, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Bytes that are scanned before places are looked for.
CHUNK = 1024

_EVERY = {"d": frozenset(range(48, 58)), "w": frozenset([*range(48, 58), *range(65, 91), 95, *range(97, 123)]), "s": frozenset([32, *range(9, 14)])}
_ESCAPED = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """A pattern to a tree: bytes sets, ("cat", ...), ("or", ...), ("rep", x, least, most)."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        ways = [self.sequence()]
        while self.peek() == "|":
            self.take()
            ways.append(self.sequence())
        return ways[0] if len(ways) == 1 else ("or", *ways)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", *parts)

    def repeated(self):
        x = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                least, comma, most = self.s[self.i : end].partition(",")
                self.i = end + 1
                x = ("rep", x, int(least), (int(most) if most else None) if comma else int(least))
            else:
                x = ("rep", x, int(c == "+"), 1 if c == "?" else None)
        return x

    def atom(self):
        c = self.take()
        if c == "(":
            fold = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            x = self.alternatives()
            if self.i >= len(self.s) or self.take() != ")":
                raise ValueError(f"no closing parenthesis in {self.s!r}")
            self.fold = fold
            return x
        if c == "[":
            return self.byte_class()
        if c == ".":
            return frozenset(range(256)) - {10}
        return self.folded(self.escape() if c == "\\" else frozenset(c.encode()) if ord(c) < 128 else self.refuse(c))

    def refuse(self, c: str):
        raise ValueError(f"{c!r} is not ASCII")

    def folded(self, own: frozenset) -> frozenset:
        return own | {b ^ 32 for b in own if chr(b).isalpha() and b < 128} if self.fold else own

    def escape(self) -> frozenset:
        c = self.take()
        if c == "x":
            self.i += 2
            return frozenset([int(self.s[self.i - 2 : self.i], 16)])
        if c.lower() in _EVERY:
            return _EVERY[c.lower()] if c.islower() else frozenset(range(256)) - _EVERY[c.lower()]
        return frozenset([_ESCAPED.get(c, ord(c))])

    def byte_class(self) -> frozenset:
        other = self.peek() == "^" and bool(self.take())
        own: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else frozenset([ord(c)])
            if self.peek() == "-" and self.s[self.i + 1] != "]" and len(low) == 1:
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else frozenset([ord(c)])
                low = frozenset(range(min(low), min(high) + 1))
            own |= low
        self.take()
        own = self.folded(frozenset(own))
        return frozenset(range(256)) - own if other else own


def reverse(tree):
    """The tree of the reversed texts."""
    if isinstance(tree, frozenset):
        return tree
    if tree[0] == "cat":
        return ("cat", *map(reverse, tree[:0:-1]))
    if tree[0] == "or":
        return ("or", *map(reverse, tree[1:]))
    return ("rep", reverse(tree[1]), *tree[2:])


class _Nfa:
    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, x, start: int) -> int:
        """Builds ``x`` from ``start``; returns the state after it."""
        if isinstance(x, frozenset):
            end = self.state()
            self.steps[start].append((x, end))
            return end
        if x[0] == "cat":
            for part in x[1:]:
                start = self.add(part, start)
            return start
        if x[0] == "or":
            end = self.state()
            for way in x[1:]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(way, own)].append(end)
            return end
        _, part, least, most = x
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start] += [loop]
            self.free[loop].append(end)
            self.free[self.add(part, loop)].append(loop)
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end


class Automaton:
    """The minimal deterministic automaton of some patterns.

    ``anywhere``: a match may begin at any byte, else at the first only. ``backward``: the
    patterns are reversed, for bytes that come from the last to the first. ``table`` has
    ``width`` next states for each state, all multiplied by ``width``; ``start`` is where a
    text begins, states from ``accepting`` on accept (``accepts``: which patterns), ``dead``
    is the state that nothing leads out of (or -1).
    """

    def __init__(self, patterns: list[str], anywhere: bool, backward: bool = False):
        nfa = _Nfa()
        origin = nfa.state()
        finals = {}
        for k, pattern in enumerate(patterns):
            parser = _Parser(pattern)
            tree = parser.alternatives()
            if parser.i < len(pattern):
                raise ValueError(f"unexpected {pattern[parser.i]!r} in {pattern!r}")
            tree = reverse(tree) if backward else tree
            start = nfa.state()
            nfa.free[origin].append(start)
            finals[nfa.add(tree, start)] = k
        sets = list({s for steps in nfa.steps for s, _ in steps})
        kinds: dict[tuple, int] = {}
        self.classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        self.width = len(kinds)
        among = {s: sorted({self.classes[b] for b in s}) for s in sets}

        @functools.cache
        def closure(state: int) -> frozenset:
            seen, todo = {state}, [state]
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(t for t in seen if nfa.steps[t] or t in finals)

        first = closure(origin)
        if first & finals.keys():
            raise ValueError("a pattern that matches the empty text")
        number, rows, todo = {first: 0}, [], [first]
        while len(rows) < len(todo):
            own = todo[len(rows)]
            reach: list[set] = [set(first) if anywhere else set() for _ in range(self.width)]
            for state in own:
                for s, t in nfa.steps[state]:
                    for c in among[s]:
                        reach[c] |= closure(t)
            row = []
            for r in map(frozenset, reach):
                if r not in number:
                    number[r] = len(number)
                    todo.append(r)
                row.append(number[r])
            rows.append(row)
        accepts = [frozenset(finals[t] for t in own if t in finals) for own in todo]
        self._minimise(np.array(rows), accepts)

    def _minimise(self, rows: np.ndarray, accepts: list[frozenset]) -> None:
        names: dict[frozenset, int] = {}
        block = np.array([names.setdefault(a, len(names)) for a in accepts])
        while True:
            _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        n = block.max() + 1
        one = np.zeros(n, int)
        one[block[::-1]] = np.arange(len(block))[::-1]
        order = sorted(range(n), key=lambda b: (bool(accepts[one[b]]), one[b]))
        place = np.empty(n, int)
        place[order] = np.arange(n)
        self.start = int(place[block[0]]) * self.width
        self.table = (place[block[rows[one[order]]]] * self.width).reshape(-1).tolist()
        self.accepts = {int(place[b]) * self.width: accepts[one[b]] for b in range(n) if accepts[one[b]]}
        self.accepting = min(self.accepts, default=n * self.width)
        stuck = [b for b in range(n) if not accepts[one[b]] and (block[rows[one[b]]] == b).all()]
        self.dead = int(place[stuck[0]]) * self.width if stuck else -1
        self.states = n

    def begins(self, data: bytes) -> dict[int, list[int]]:
        """Where a match of each pattern begins, from the last place to the first."""
        return {k: [p for i in range(0, len(own), 2) for p in range(own[i], own[i + 1] - 1, -1)] for k, own in self.runs(data).items()}

    def runs(self, data: bytes) -> dict[int, array]:
        """Where a match of each pattern begins: one pass of a backward automaton.

        Places are given as runs, the last one first: its last place, its first place. Only a chunk in which the automaton accepts is gone
        through once more, with places.
        """
        state, table, accepting, found = self.start, self.table, self.accepting, {}
        classes = data.translate(self.classes)[::-1]
        for at in range(0, len(classes), CHUNK):
            some, before, hit = classes[at : at + CHUNK], state, False
            for c in some:
                state = table[state + c]
                if state >= accepting:
                    hit = True
            if hit:
                for place, c in zip(range(len(data) - at - 1, -1, -1), some, strict=False):
                    before = table[before + c]
                    if before >= accepting:
                        for k in self.accepts[before]:
                            runs = found.setdefault(k, array("q"))
                            if runs and runs[-1] == place + 1:
                                runs[-1] = place
                            else:
                                runs.extend((place, place))
        return found

    def longest(self, classes: bytes, start: int) -> int:
        """End of the longest match at ``start``, or -1."""
        state, table, accepting, dead, end = self.start, self.table, self.accepting, self.dead, -1
        for i in range(start, len(classes)):
            state = table[state + classes[i]]
            if state == dead:
                break
            if state >= accepting:
                end = i + 1
        return end


class Scanner:
    """All rules in one backward automaton, and each rule's own for the ends."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Automaton([r.pattern for r in rules], anywhere=True, backward=True)
        self.own = [(Automaton([r.pattern], False), Automaton([r.prefix], False) if r.prefix else None) for r in rules]

    def bounds(self, k: int, data: bytes, begins: array) -> list[tuple[int, int]]:
        """Leftmost, longest, non-overlapping matches, from all runs of places where one begins (the last first)."""
        rule, (anchored, prefix) = self.rules[k], self.own[k]
        whole = data.translate(anchored.classes)
        found, at = [], 0
        for i in range(len(begins) - 2, -1, -2):
            start = max(begins[i + 1], at)
            while start <= begins[i]:
                at = anchored.longest(whole, start)
                lead = prefix.longest(data[start:at].translate(prefix.classes), 0) if prefix else 0
                if at - start - lead >= rule.least:
                    found.append((start, at))
                start = at
        return found

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by the rules' order."""
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        spans = sorted((s, k, e) for k, places in self.all.runs(data).items() for s, e in self.bounds(k, data, places))
        if len(data) == len(text):
            return [(self.rules[k].kind, s, e) for s, k, e in spans]
        points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        point = lambda at: int(points[at - 1]) if at else 0
        return [(self.rules[k].kind, point(s), point(e)) for s, k, e in spans]


@functools.lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _struct(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end; code points, end exclusive) of every row.

    Null and empty texts give no spans. Repeated rows give repeated results. Only doc_id
    and text are read. Whole texts are scanned, and each kind's spans don't overlap.
    """
    return map_columns(docs.select("doc_id", "text"), lambda ids, texts: (ids, [_struct(scanner(rules).scan(t)) for t in texts]), f"doc_id long, spans {SPANS}")


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch that spans cover replaced by the first one's kind in brackets."""
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i < len(spans) and spans[i][1] < end or i < len(spans) and spans[i][1] == start:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by their kind in brackets; n_chars, if there, follows.

    Null texts stay null; all other columns stay as they are.
    """
    reads = ["text", "n_chars"] if "n_chars" in docs.columns else ["text"]

    def clean(old, sizes=None):
        texts = [redacted(t, scanner(rules).scan(t)) for t in old]
        if sizes is None:
            return (texts,)
        return texts, [n if t is o or t == o else len(t) for n, t, o in zip(sizes, texts, old, strict=True)]

    return with_columns(docs, reads, clean, StructType([docs.schema[c] for c in reads]))


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for every row of ``docs``.

    Null and empty texts have none (the digest of the empty text); spans that begin
    together come in the rules' order; repeated rows have equal results; an empty table
    gives no rows. Only doc_id and text are read.
    """
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
