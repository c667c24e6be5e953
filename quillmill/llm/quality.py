"""Quality by a sparse ensemble of rules.

Statistics of a text are Spark columns. From a bounded sample of labelled rows small
boosted trees are grown; every path from a root is a rule, a conjunction of comparisons
of statistics. A logistic regression with an L1 penalty (lasso) over the rules leaves a
few of them with weights, and these are compiled back into one Spark column. So scoring
runs in the JVM and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, train_texts

MODULUS, HELD = 5, 0
#: Labelled rows that training takes at most.
MOST = 20_000
CUT = 0.3
TREES, DEPTH, BINS, LEAF = 40, 3, 32, 20
PENALTY = 2e-3
NEUTRAL = 0.5


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; null counts as empty. Shares of nothing are 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.split(t, "\n")
    chars, n, m = F.length(t), F.size(words), F.size(lines)
    share = lambda a, b: a / F.greatest(b, F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "words": n.cast("double"),
        "word_length": share(chars, n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "repeated_words": share(count(r"(?<!\S)(\S++)\s(?=\1(?!\S))"), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), m),
        "words_per_line": share(n, m),
        "upper": share(count(r"\p{Lu}"), chars),
        "marks": share(count(r"[#$%&*!|<>{}\[\]\\^~=+_]"), chars),
        "bars": share(count(r"\|"), n),
        "bangs": share(count(r"!"), n),
        "digits": share(count(r"[0-9]"), chars),
        "sentence_ends": share(count(r"[.?](?!\S)"), n),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold) hold: the statistic is above the threshold, or not above it."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        held = np.ones(len(x), bool)
        for k, above, t in self.terms:
            held &= (x[:, k] > t) == above
        return held

    def column(self, names: list[str]) -> Column:
        held = F.lit(True)
        for k, above, t in self.terms:
            held = held & ((F.col(names[k]) > t) if above else (F.col(names[k]) <= t))
        return held


@dataclass
class Ensemble:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.bias)
        for rule, w in self.rules:
            raw += w * rule.holds(x)
        return 1 / (1 + np.exp(-raw))

    def column(self) -> Column:
        """The score over columns named as the statistics."""
        raw = F.lit(self.bias)
        for rule, w in self.rules:
            raw = raw + F.when(rule.column(self.names), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-raw))


def _simple(terms: list[tuple[int, bool, float]]) -> Rule:
    """One comparison for each statistic and direction: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, t in terms:
        old = tight.get((k, above))
        tight[k, above] = t if old is None else max(old, t) if above else min(old, t)
    return Rule(tuple((k, above, t) for (k, above), t in sorted(tight.items())))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, rate: float = 0.3, seed: int = 5) -> list[Rule]:
    """The rules of boosted trees (log loss, second order) on random halves of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    raw, found = np.zeros(len(x)), {}

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, terms: list, left: int) -> None:
        if left and len(rows) >= 2 * leaf:
            best, at = 1e-6, None
            whole_g, whole_h = g[rows].sum(), h[rows].sum()
            for k in range(x.shape[1]):
                b, size = binned[rows, k], len(cuts[k]) + 1
                n = np.cumsum(np.bincount(b, minlength=size))[:-1]
                a, c = (np.cumsum(np.bincount(b, v[rows], size))[:-1] for v in (g, h))
                gain = a * a / (c + 1) + (whole_g - a) ** 2 / (whole_h - c + 1) - whole_g**2 / (whole_h + 1)
                gain[(n < leaf) | (len(rows) - n < leaf)] = 0
                if len(gain) and gain.max() > best:
                    best, at = gain.max(), (k, int(gain.argmax()))
            if at:
                k, cut = at
                for above in (False, True):
                    own = [*terms, (k, above, float(cuts[k][cut]))]
                    found.setdefault(_simple(own), None)
                    split(rows[(binned[rows, k] > cut) == above], g, h, own, left - 1)
                return
        value[rows] = -g[rows].sum() / (h[rows].sum() + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        chosen = np.flatnonzero(rng.random(len(x)) < 0.5)
        value = np.zeros(len(x))
        split(chosen, p - y, p * (1 - p), [], depth)
        raw += rate * value
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty on all but the bias, by accelerated proximal gradient."""
    n, m = z.shape
    centre = z.mean(axis=0)
    scale = np.maximum(z.std(axis=0), 1e-3)
    s = (z - centre) / scale
    v = np.full(m, 1 / np.sqrt(m))
    for _ in range(20):  # largest eigenvalue, for the step
        v = s.T @ (s @ v) / n
        v /= np.linalg.norm(v) + 1e-12
    step = 4 / (1.1 * float(v @ (s.T @ (s @ v))) / n + 1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b, w = np.log(share / (1 - share)), np.zeros(m)
    pb, pw, t = b, w, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(pb + s @ pw))) - y
        nb = pb - step * e.mean()
        nw = pw - step * (s.T @ e) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pb, pw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b - (w / scale) @ centre), w / scale


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> Ensemble:
    """An ensemble from statistics and labels; with one label only, a constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else NEUTRAL
        return Ensemble(names, float(np.log(share / (1 - share))), [])
    rules = grow(x, y)
    if not rules:
        return Ensemble(names, float(np.log(y.mean() / (1 - y.mean()))), [])
    bias, w = lasso(np.column_stack([r.holds(x) for r in rules]).astype(np.float32), y)
    return Ensemble(names, bias, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and a column ``s`` with the statistics of the text."""
    return docs.select("doc_id", F.struct(*(c.alias(n) for n, c in statistics(F.col("text")).items())).alias("s"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> Ensemble:
    """An ensemble from the labelled rows outside the held-out fold, ``most`` rows at most.

    Only the rows that teach have their statistics computed, once each, and only these
    come to the driver. Without any rows every text scores ``NEUTRAL``.
    """
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = train_texts(docs, labels, label, MODULUS, HELD, most).select(*(c.alias(n) for n, c in stats.items()), F.col("label").alias("label"))
    got = sorted(rows.collect())  # the order in which rows arrive must not matter
    return fit(names, np.array([r[:-1] for r in got], float).reshape(len(got), len(names)), np.array([float(r[-1] > 0) for r in got]))


def score_documents(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id and score of every row of ``docs``; null counts as empty. Scores depend on the text alone."""
    return with_statistics(docs).select("doc_id", "s.*").select("doc_id", ensemble.column().alias("score"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision for every document, and whether its label was held out of training.

    Null and empty texts are scored like others (their statistics are 0); repeated rows
    have equal results; a null id counts as empty text for the fold. Empty ``docs`` give no
    rows, empty ``labels`` one score for all. Only doc_id, text and the label are read.
    """
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, with their columns.

    Labels teach by the ids in ``docs``. Names of columns don't matter, as statistics
    are in one struct, whose name is free in ``docs``.
    """
    ensemble = train(docs, labels)
    own = next(f"s{k}" for k in range(len(docs.columns) + 1) if f"s{k}" not in docs.columns)
    stats = F.struct(*(c.alias(n) for n, c in statistics(F.col("text")).items()))
    inner = Ensemble([f"{own}.{n}" for n in ensemble.names], ensemble.bias, ensemble.rules)
    return docs.withColumn(own, stats).where(inner.column() >= cut).select(*docs.columns)
