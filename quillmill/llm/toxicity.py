"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and the beginnings of its words, hashed, each with the
logarithm of its count. Besides a weight each term has a vector, and the product of two
terms' vectors weighs the two together: an insult next to a group's name counts for more
than both do by themselves, and a word's beginning that is common in one language counts
only together with others.

Which terms the machine knows is found in all of the training rows, by counts that are
aggregated before they are gathered; its weights are then fitted on the driver. Training
takes at most ``MOST`` labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_columns, remove, train_texts, written

MODULUS, HELD = 3, 1
#: Labelled rows that training takes at most.
MOST = 20_000
#: Hashed terms, and how many of them the machine knows.
HASHED, TERMS, FACTORS = 1 << 20, 1024, 8
BEGINNINGS = (5, 6, 7)
CUT = 0.7
#: Words whose terms a worker remembers at most; then it starts anew.
REMEMBERED = 300_000

_WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[int]:
    """Hashed terms of a word: itself and its beginnings that are shorter than it."""
    own = [f"={word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % HASHED for t in own]


def words_of(text: str | None) -> Counter:
    return Counter(_WORDS((text or "").lower()))


def screen(rows: DataFrame, terms: int = TERMS) -> list[int]:
    """The hashed terms whose presence differs most between the labels (chi-square of documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, HASHED), np.int64)
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {t for w in words_of(text) for t in terms_of(w)}
                n[int(label > 0), list(own)] += 1
        some = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]), pa.array(n[1, some])], names=["term", "clean", "toxic"])

    size = rows.agg(F.sum((F.col("label") > 0).cast("double")).alias("t"), F.count("label").alias("n")).first()
    toxic, total = size["t"] or 0.0, float(size["n"])
    if not toxic or toxic == total:
        return []
    clean = total - toxic
    summed = rows.mapInArrow(count, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    gap = F.col("b") / toxic - F.col("a") / clean
    share = (F.col("a") + F.col("b")) / total
    chosen = summed.where("a + b >= 3").select("term", (F.abs(gap) / F.sqrt(share * (1 - share) + 1 / total)).alias("chi")).orderBy(F.desc("chi"), "term").limit(terms)
    return sorted(r["term"] for r in chosen.collect())


class Terms:
    """Texts to counts of the known terms; the last place stands for the text's length."""

    def __init__(self, known: list[int]):
        self.place = {t: k for k, t in enumerate(known)}
        self.of: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> tuple[list[int], list[float]]:
        words = words_of(text)
        if len(self.of) > REMEMBERED:
            self.of = {}
        of, found = self.of, Counter()
        for w, n in words.items():
            own = of.get(w)
            if own is None:
                own = of[w] = tuple(self.place[t] for t in terms_of(w) if t in self.place)
            for k in own:
                found[k] += n
        places = sorted(found)
        return [*places, len(self.place)], [*(float(np.log1p(found[k])) for k in places), float(np.log1p(sum(words.values()))) / 8]


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + half the sum of (v.x)^2 - v^2.x^2), over known terms."""

    known: list[int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        at, x, start = packed(rows)
        return 1 / (1 + np.exp(-np.clip(self.raw(at, x, start)[0], -30, 30)))

    def raw(self, at: np.ndarray, x: np.ndarray, start: np.ndarray):
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, start)
        squares = np.add.reduceat(vx * vx, start)
        return self.bias + np.add.reduceat(self.w[at] * x, start) + 0.5 * (sums * sums - squares).sum(axis=1), sums


def packed(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, none of them empty, as places, values and starts."""
    size = np.array([len(a) for a, _ in rows])
    return np.concatenate([np.array(a) for a, _ in rows]), np.concatenate([np.array(x) for _, x in rows]), np.concatenate(([0], np.cumsum(size)[:-1]))


def fit(known: list[int], rows: list[tuple[list[int], list[float]]], labels: np.ndarray, *, epochs: int = 60, batch: int = 256, rate: float = 0.2, ridge: float = 1e-4, seed: int = 7) -> Machine:
    """Minimises log loss by AdaGrad over shuffled batches."""
    rng = np.random.default_rng(seed)
    base = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    n = len(known) + 1
    machine = Machine(known, float(np.log(base / (1 - base))), np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)))
    if not len(rows) or labels.min() == labels.max():
        return machine
    gw, gv, gb = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            some = order[s : s + batch]
            at, x, start = packed([rows[k] for k in some])
            raw, sums = machine.raw(at, x, start)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            of = np.repeat(np.arange(len(some)), np.diff(np.append(start, len(at))))
            e = (error[of] * x)[:, None]
            dv = e * (sums[of] - machine.v[at] * x[:, None])
            uniq, back = np.unique(at, return_inverse=True)
            w = np.bincount(back, e[:, 0], len(uniq)) + ridge * machine.w[uniq]
            v = np.stack([np.bincount(back, dv[:, f], len(uniq)) for f in range(FACTORS)], axis=1) + ridge * machine.v[uniq]
            gw[uniq] += w * w
            gv[uniq] += v * v
            gb += error.sum() ** 2
            machine.w[uniq] -= rate * w / np.sqrt(gw[uniq])
            machine.v[uniq] -= rate * v / np.sqrt(gv[uniq])
            machine.bias -= rate * error.sum() / np.sqrt(gb)
    return machine


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST) -> Machine:
    """A machine from the labelled rows outside the held-out fold.

    Without any such rows, or with one label only, it scores every text alike: by the
    smoothed share of label 1 (0.001 without rows). The rows that teach are written once,
    so ``docs`` is read once, and ``most`` bounds what comes to the driver.
    """
    rows, path = written(train_texts(docs, labels, label, MODULUS, HELD, most).select("text", "label"))
    known = screen(rows)

    def counts(texts, own):
        terms = Terms(known)
        got = [terms.counts(t) for t in texts]
        return [a for a, _ in got], [x for _, x in got], own

    found = map_columns(rows, counts, "at array<int>, x array<double>, label int").collect() if known else []
    found.sort()  # the order in which rows arrive must not matter
    remove(docs.sparkSession, path)
    return fit(known, [(r["at"], r["x"]) for r in found], np.array([float(r["label"] > 0) for r in found]))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of ``docs``; null counts as empty. Scores depend on the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def score(ids, texts):
        own = shipped.value
        if not hasattr(own, "terms"):
            own.terms = Terms(own.known)
        return ids, own.score([own.terms.counts(t) for t in texts])

    return map_columns(docs.select("doc_id", "text"), score, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every document, and whether its label was held out of training.

    Null and empty texts are scored like others (without terms); repeated rows have equal
    results; a null id counts as empty text for the fold. Empty ``docs`` give no rows, empty
    ``labels`` one score for all. Only doc_id, text and the label are read.
    """
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
