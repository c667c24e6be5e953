"""Periodic runs against a search by every period."""

import hashlib
import random
import zlib

import pytest

from quillmill.llm import periods
from quillmill.llm.queries import op11_periods


def by_every_period(words):
    """Runs by comparing each word with the one a period later; of periods that give the same stretch the smallest counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                found.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng, n):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p = rng.randrange(n), rng.randint(1, 12)
        for i in range(a + p, min(n, a + rng.randint(0, 80))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("block", [2, 5, periods.BLOCK])
def test_runs(monkeypatch, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(600):
        words = some_words(rng, rng.randint(0, 160))
        assert periods.runs(words) == by_every_period(words), words


def test_squares_without_a_sieve():
    rng = random.Random(6)
    for _ in range(300):
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 60))]
        want = {}
        for q in range(1, len(words) // 2 + 1):
            for s in range(len(words)):
                e = s
                while e + q < len(words) and words[e] == words[e + q]:
                    e += 1
                if e - s >= q and (s == 0 or words[s - 1] != words[s - 1 + q]):
                    want.setdefault((s, e + q - 1), q)
        assert periods.squares(words) == want


def test_automaton_knows_every_factor():
    rng = random.Random(7)
    for _ in range(100):
        words = [rng.randrange(2) for _ in range(rng.randint(1, 25))]
        length, link, end = periods.automaton(words)
        factors = {tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        assert sum(length[s] - length[link[s]] for s in range(1, len(length))) == len(factors)
        assert sorted(e for e in end if e >= 0) == list(range(len(words)))


def test_long_repetitions_are_linear():
    for words in ([b"a"] * 60_000, [b"a", b"b"] * 30_000, [b"%d" % k for k in range(20_000)] * 3):
        found = periods.runs(words)
        assert len(found) == 1 and found[0][:2] == (0, 60_000)
    assert periods.runs([b"%d" % k for k in range(60_000)]) == []


def test_planted_and_longest():
    words = [b"%d" % k for k in range(100)]
    chosen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in range(400):
        g = zlib.crc32(str(i).encode()) // 10
        a, n = g % 100, 100
        p = 1 + (n - a) // (3 + g % 8)
        want = [words[k] if k < a or i not in chosen else words[a + (k - a) % p] for k in range(n)]
        assert periods.planted(words, i) == want
    assert periods.planted([], chosen[0]) == []
    assert periods.longest([(0, 30, 10), (5, 24, 8), (9, 60, 20)]) == (0, 30, 10)
    assert periods.longest([(4, 60, 20), (4, 30, 10), (9, 31, 10)]) == (9, 31, 10)
    assert periods.longest([]) is None


def test_report_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(w.decode() for w in some_words(rng, rng.randint(0, 200)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (203, "é ü " * 40), (3, rows[3][1]), (None, rows[4][1]), (204, "A a " * 30), (205, "x" * 100_000)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, period int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_periods(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        words = periods.planted((t or "").encode().split(), i)
        found = by_every_period(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 50
    assert op11_periods(spark, str(tmp_path)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_find_runs(spark):
    rows = [(1, "one " + "two three " * 20 + "four", 7), (2, None, 8), (3, "", 9)]
    found = {r[0]: (r[1], r[2]) for r in periods.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()}
    assert [tuple(x) for x in found[1][0]] == [(1, 40, 2)] and found[1][1] == "one two three four"
    assert found[2] == ([], None) and found[3] == ([], "")
    assert periods.period_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
