"""Toxicity and quality: held-out accuracy, folds, edges."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import quality, toxicity

DOCS, LABELS = "doc_id long, text string, lang string, label int, s string", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts that are toxic if an insult meets a group's name, and bad if made of repeats or marks."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        for there, name in ((insult, "idiots"), (group, "neighbours")):
            if there:
                own[rng.randrange(len(own))] = name
        bad = rng.random() < 0.25
        if bad:
            own = [w for w in own for _ in range(4)] if rng.random() < 0.5 else [w + "$$$" for w in own]
        rows.append((k, " ".join(own), "xx", 1, "s"))
        labels.append((k, int(not bad), int(insult and group)))
    return spark.createDataFrame(rows, DOCS).cache(), spark.createDataFrame(labels, LABELS).cache()


def held_out(spark, report, labels, label):
    got = report.where("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
    return got.score.to_numpy(), got.predicted.to_numpy(), got[label].to_numpy()


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_learns_pairs(spark, corpus):
    docs, labels = corpus
    score, predicted, y = held_out(spark, toxicity.toxicity_report(docs, labels), labels, "toxic")
    assert auc(score, y) > 0.97
    assert predicted[y == 1].mean() > 0.7 and y[predicted == 1].mean() > 0.9


def test_quality(spark, corpus):
    docs, labels = corpus
    score, predicted, y = held_out(spark, quality.quality_report(docs, labels), labels, "quality")
    assert auc(score, y) > 0.98 and predicted[y == 1].mean() > 0.98 and predicted[y == 0].mean() < 0.1


def test_compiled_rules_score_alike(spark, corpus):
    """The Spark column gives what the ensemble gives."""
    docs, labels = corpus
    ensemble = quality.train(docs, labels)
    assert 0 < len(ensemble.rules) < 200
    rows = quality.with_statistics(docs).select("doc_id", "s.*").orderBy("doc_id").toPandas()
    want = ensemble.score(rows[ensemble.names].to_numpy())
    got = quality.score_documents(docs, ensemble).orderBy("doc_id").toPandas().score.to_numpy()
    assert np.allclose(got, want)


@pytest.mark.parametrize("report, modulus, held, label", [(toxicity.toxicity_report, 3, 1, "toxic"), (quality.quality_report, 5, 0, "quality")])
def test_contract(spark, corpus, report, modulus, held, label):
    """Folds, odd rows, and that held-out labels, order and other columns don't matter."""
    docs, labels = corpus
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "", 0, ""), (None, "no id", "x", 1, "x"), (3, "again", "x", 1, "x"), (5002, "w1 " * 50_000, "", 1, "")], DOCS)
    mixed = docs.unionByName(odd).orderBy(F.desc("doc_id"))
    got = report(mixed, labels).toPandas()
    assert len(got) == 905 and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    want = [zlib.crc32(("" if np.isnan(i) else str(int(i))).encode()) % modulus == held for i in got.doc_id]
    assert got.held_out.tolist() == want
    hidden = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, 1 - F.col(label)).otherwise(F.col(label))
    other = labels.withColumn(label, hidden).orderBy(F.rand(1))
    changed = docs.unionByName(odd).withColumn("lang", F.lit("zz")).withColumn("label", F.lit(0))
    again = report(changed, other).toPandas()
    key = ["doc_id", "score"]
    assert np.allclose(got.sort_values(key).score.to_numpy(), again.sort_values(key).score.to_numpy())


@pytest.mark.parametrize("report", [toxicity.toxicity_report, quality.quality_report])
def test_without_labels(spark, corpus, report):
    docs, labels = corpus
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (999_999, 1, 1)], LABELS)
    one_sided = labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))
    for table in (labels.limit(0), nulls, one_sided):
        scores = {r.score for r in report(docs.limit(20), table).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert report(docs.limit(0), labels).count() == 0


def test_keep_good(spark, corpus):
    docs, labels = corpus
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.quality_report(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("train, size", [(toxicity.train_texts, 2), (quality.train_texts, 2)])
def test_bounded_training(spark, train, size):
    """Ids that repeat don't break the bound; the smallest text counts."""
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(1200)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 3, 1, 1) for k in range(30)], LABELS)
    rows = train(docs, labels, "toxic", 1000, -1, size).collect()
    assert len(rows) == size and len({r.doc_id for r in rows}) == size
    assert all(r.text == ("" if r.doc_id == 1 else f"text {r.doc_id}") for r in rows)


def test_machine_by_pairs():
    """The machine's raw score is the sum over terms and over all pairs of terms."""
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(list(range(6)), 0.3, rng.normal(size=7), rng.normal(size=(7, toxicity.FACTORS)))
    rows = []
    for _ in range(50):
        at = sorted(rng.choice(7, rng.integers(1, 8), replace=False).tolist())
        rows.append((at, rng.normal(size=len(at)).tolist()))
    want = []
    for at, x in rows:
        raw = machine.bias + sum(machine.w[k] * v for k, v in zip(at, x, strict=True))
        for i in range(len(at)):
            for j in range(i):
                raw += sum(machine.v[at[i], f] * machine.v[at[j], f] for f in range(toxicity.FACTORS)) * x[i] * x[j]
        want.append(1 / (1 + np.exp(-raw)))
    assert np.allclose(machine.score(rows), want)


def plain_statistics(text):
    """The statistics of a text, counted one by one."""
    t = text or ""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    lines = t.split("\n")
    share = lambda a, b: a / max(b, 1)
    n, chars = len(words), len(t)
    gaps = [m.end() - m.start() for m in re.finditer(r"[ \t\n\x0b\f\r]+", t.strip(" \t\n\x0b\f\r"))]
    repeated = sum(a == b and g == 1 for a, b, g in zip(words, words[1:], gaps, strict=False))
    return {
        "words": n, "word_length": share(chars, n), "distinct_words": share(len(set(words)), n), "repeated_words": share(repeated, n),
        "distinct_lines": share(len(set(lines)), len(lines)), "words_per_line": share(n, len(lines)),
        "upper": share(sum(unicodedata.category(c) == "Lu" for c in t), chars), "marks": share(sum(c in "#$%&*!|<>{}[]\\^~=+_" for c in t), chars),
        "bars": share(t.count("|"), n), "bangs": share(t.count("!"), n), "digits": share(sum(c in "0123456789" for c in t), chars),
        "sentence_ends": share(sum(c in ".?" and (k + 1 == chars or t[k + 1] in " \t\n\x0b\f\r") for k, c in enumerate(t)), n),
    }


def test_statistics(spark):
    rng = random.Random(6)
    pieces = ["one", "two", "Two", " ", " ", " ", "\n", "\n\n", ".", "?", "!", "|", "$", "É", "ß", "42", "one one", "\t", "😀", "_"]
    texts = [None, "", " ", "\n", "a", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 80))) for _ in range(300))]
    got = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "s.*").collect()
    for r in got:
        own = r.asDict()
        assert own == {"doc_id": r.doc_id} | {k: pytest.approx(v) for k, v in plain_statistics(texts[r.doc_id]).items()}, texts[r.doc_id]


def test_lasso_is_sparse():
    rng = np.random.default_rng(1)
    z = (rng.random((2000, 40)) < 0.5).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * z[:, 3] - 3 * z[:, 7])))).astype(float)
    _, w = quality.lasso(z, y, 0.02)
    assert set(np.flatnonzero(np.abs(w) > 0.3)) == {3, 7} and w[3] > 0 > w[7] and (w == 0).sum() > 20


def test_machine_without_linear_signal():
    """An exclusive or of two terms, which no additive weights can tell."""
    rows = [([a, 2 + b, 4], [1.0, 1.0, 1.0]) for _ in range(200) for a in (0, 1) for b in (0, 1)]
    y = np.array([float(a == b) for _ in range(200) for a in (0, 1) for b in (0, 1)])
    machine = toxicity.fit([10, 11, 12, 13], rows, y, epochs=200)
    assert ((machine.score(rows) > 0.5) == (y == 1)).all()
