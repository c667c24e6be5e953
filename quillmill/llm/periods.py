"""Periodic runs of words, such as a generator caught in a loop leaves behind, and texts without the repetitions.

A run is a stretch of words with smallest period q, at least ``REPEATS`` times as long as q and at
least ``LEAST`` words long, that can't be made longer on either side.

A suffix automaton of the words has a state for each set of end positions that some words share;
its suffix links are a tree. From the longest state to the shortest, ordered sets of end positions
are merged into those of the link's target, the smaller into the larger. Two positions that become neighbours
in a state no farther apart than the state is long are the seed of a square: the words up to the first position recur at
the second, as far to the left as the state is long and no farther. Where the word after the one position isn't that
after the other, the seed can't be extended to the right either: it is a run, and its period is the distance. Others are
extended by the seed one to the right of them. Neighbours while a merge is under way may lie farther apart than a
period; as the period's own seed gives the same stretch, the smallest distance counts.

Most texts have no runs, so words are sieved first, which loses none: in a run of the given lengths every
``GRAM`` words recur within it. The automaton gets the stretches whose every ``GRAM`` words
occur more than once in the text; no run reaches over the end of such a stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns

LEAST, REPEATS = 24, 3
#: Words that recur within every run: 2q + GRAM - 1 is at most its length, whatever its period q, for LEAST and REPEATS or more.
GRAM = 8
#: Places that a block of an ordered set holds at most.
BLOCK = 2048


class Places:
    """An ordered set of places, in blocks, so that an insertion moves a block's places only."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, at: int):
        self.blocks, self.firsts, self.size = [[at]], [at], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, at: int) -> tuple[int, int]:
        """Insert a place that isn't there; its neighbours, -1 where there is none."""
        blocks = self.blocks
        k = max(bisect_left(self.firsts, at) - 1, 0) if len(blocks) > 1 else 0
        block = blocks[k]
        i = bisect_left(block, at)
        before = block[i - 1] if i else -1  # only the very first block can have none before it
        after = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
        block.insert(i, at)
        if not i:
            self.firsts[k] = at
        self.size += 1
        if len(block) > BLOCK:
            blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.firsts.insert(k + 1, block[BLOCK // 2])
        return before, after


def automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position (-1: a clone) of every state of the suffix automaton of ``words``; 0 is the root.

    Most states have one way on, which is kept without a table.
    """
    length, link, end = [0], [-1], [-1]
    word, to, more = [-1], [-1], [None]  # the first way on, and a table of all from the second on
    last = 0
    for at, w in enumerate(words):
        new = len(length)
        length.append(at + 1), link.append(0), end.append(at), word.append(-1), to.append(-1), more.append(None)
        p = last
        while p >= 0:
            table = more[p]
            if table is None:
                if word[p] == w:
                    q = to[p]
                    break
                if word[p] < 0:
                    word[p], to[p] = w, new
                else:
                    more[p] = {word[p]: to[p], w: new}
            else:
                q = table.get(w, -1)
                if q >= 0:
                    break
                table[w] = new
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1), link.append(link[q]), end.append(-1)
                word.append(word[q]), to.append(to[q]), more.append(None if more[q] is None else dict(more[q]))
                while p >= 0:
                    table = more[p]
                    if table is None:
                        if word[p] != w or to[p] != q:
                            break
                        to[p] = clone
                    else:
                        if table.get(w) != q:
                            break
                        table[w] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def squares(words: Sequence[int]) -> dict[tuple[int, int], int]:
    """First and last word of every stretch at least twice as long as its smallest period that can't be made longer, with that period."""
    n, found = len(words), {}
    length, link, end = automaton(words)
    sets: list[Places | None] = [Places(e) if e >= 0 else None for e in end]
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        at = link[state]
        if at <= 0:  # neighbours in the root have nothing in common
            sets[state] = None
            continue
        own, other, sets[state] = sets[state], sets[at], None
        if other is None:
            sets[at] = own
            continue
        if own.size > other.size:
            own, other = other, own
        sets[at], most, met = other, length[at], -1
        for place in own:
            before, after = other.add(place)
            if before == met:  # both are of the smaller set and met before, in a longer state
                before = -1
            met = place
            for a, b in ((before, place), (place, after)):
                if 0 <= a and 0 < b - a <= most and (b + 1 == n or words[a + 1] != words[b + 1]):
                    stretch = (a - most + 1, b)
                    found[stretch] = min(found.get(stretch, n), b - a)
    return found


def sieved(words: list[bytes]) -> list[tuple[int, int]]:
    """Stretches (first word, end) of at least ``LEAST`` words whose every ``GRAM`` words occur more than once in ``words``.

    Occurrences are told by hashes, so that chance can only make stretches longer.
    """
    n = len(words) - GRAM + 1
    if len(words) < LEAST:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    gram = h[:n].copy()
    for k in range(1, GRAM):
        gram *= np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
        gram += h[k : k + n]
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n + 2, np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    change = np.diff(again)
    start, stop = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + GRAM - 1
    return [(a, z) for a, z in zip(start.tolist(), stop.tolist(), strict=True) if z - a >= LEAST]


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, in this order."""
    out, todo = [], [(0, words)]
    while todo:
        first, own = todo.pop()
        for a, z in sieved(own):
            if 2 * (z - a) <= len(own):  # what recurs only outside of a stretch is sieved out of it
                todo.append((first + a, own[a:z]))
                continue
            number: dict[bytes, int] = {}
            found = squares([number.setdefault(w, len(number)) for w in own[a:z]])
            out += [(first + a + i, j - i + 1, q) for (i, j), q in found.items() if j - i + 1 >= max(LEAST, REPEATS * q)]
    return sorted(out)


def split(text: str | None) -> list[bytes]:
    """The words of a text: runs without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run contains after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(found).T
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent; ties go to the smallest start, then period."""
    best = None
    for start, length, period in found:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period) and the collapsed text of every row of ``docs``.

    In the collapsed text words that repeat a run's first period are left out and the others joined by one blank; it is null
    if the text is. Empty texts have no runs; repeated rows have equal results. Only doc_id and the text are read.
    """

    def rows(ids, texts):
        own = [split(t) for t in texts]
        found = [runs(w) for w in own]
        short = [None if t is None else b" ".join(collapsed(w, r)).decode("utf-8", "replace") for t, w, r in zip(texts, own, found, strict=True)]
        return ids, [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], short

    return map_columns(docs.select("doc_id", text), rows, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string", rows=256)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """``words``, for one id in ten with a period from some word on; null ids count as the empty text."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[: a + p] + words[a : a + p] * ((n - a) // p))[:n]


def period_report(docs: DataFrame) -> DataFrame:
    """Runs of every text of ``docs``, one in ten of them made periodic (``planted``): their number, the one with the greatest exponent, and digests.

    doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256. Null and empty texts
    have no runs and the digests of nothing; texts without a run have four nulls; repeated rows have equal results; an empty
    table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """

    def rows(ids, texts):
        out = []
        for i, t in zip(ids, texts, strict=True):
            words = planted(split(t), i)
            found = runs(words)
            best = longest(found)
            top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            out.append((i, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
        return tuple(list(c) for c in zip(*out, strict=True))

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_columns(docs.select("doc_id", "text"), rows, schema, rows=256)
