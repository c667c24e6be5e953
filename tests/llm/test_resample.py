"""Resampling against plain loops, and its SQL over odd texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillmill.llm import resample
from quillmill.llm.queries import ORACLE_SQL, op13_resample

from .test_oracles import duck, plain

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def some_texts(rng, n):
    return ["".join(rng.choice("abZé09 ,\n") for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize("grams", [1, 2, 3])
@pytest.mark.parametrize("piece", [2, 64])
def test_crcs_of_all_features(monkeypatch, grams, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    texts = ["", "Hello, World 12", "é" * 50 + " x", "a" * 1000 + "-" + "b" * 63 + " " + "c" * 64 + " " + "d" * 65, "end", "start", " ", "x" * 129, "", "İK ı"]
    texts += some_texts(random.Random(grams), 60)
    coded = [t.encode() for t in texts]
    data, offset = np.frombuffer(b"".join(coded), np.uint8), np.concatenate(([0], np.cumsum([len(c) for c in coded])))
    crc, of, words = resample.features(data, offset, grams)
    for k, t in enumerate(texts):
        own = words_of(t)
        assert words[k] == len(own)
        assert sorted(crc[of == k].tolist()) == sorted(zlib.crc32(" ".join(own[i : i + g]).encode()) for g in range(1, grams + 1) for i in range(len(own) - g + 1))


def test_a_very_long_word():
    data = np.frombuffer(b"q" * 3_000_001, np.uint8)
    crc, _, _ = resample.features(data, np.array([0, len(data)]))
    assert crc.tolist() == [zlib.crc32(b"q" * 3_000_001)]


def by_loops(docs, target, buckets=10_000, grams=1, seed=2024, least=20, percent=10):
    def found(text):
        own = words_of(text)
        return [zlib.crc32(" ".join(own[i : i + g]).encode()) % buckets for g in range(1, grams + 1) for i in range(len(own) - g + 1)], len(own)

    s, t = [0] * buckets, [0] * buckets
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for b in found(x)[0]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        own, n = found(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    top = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = top[: len(top) * percent // 100]
    return [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in rows if not r[4]] + [(*r[:4], None) for r in top[len(drawn) :]]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    docs = list(enumerate(some_texts(rng, 400)))
    docs += [(500, None), (501, ""), (502, "word"), (3, docs[3][1]), (None, docs[4][1]), (None, docs[5][1]), (7, docs[8][1])]
    docs += [(600, "same words again " * 10)] * 60  # equal rows tie in all
    return docs, some_texts(rng, 30) + [None, "", "same words"]


def tables(spark, path, docs, target):
    spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, rank string, score double").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_query_by_loops_and_sql(spark, tmp_path, odd):
    tables(spark, tmp_path, *odd)
    out = op13_resample(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(by_loops(*odd), key=str)
    want = duck(documents=("doc_id bigint, text varchar", odd[0]), benchmark=("item_id bigint, text varchar", list(enumerate(odd[1])))).sql(ORACLE_SQL["op13_resample"]).df()
    assert plain(out.toPandas(), sorted(out.columns)) == plain(want, sorted(out.columns))


@pytest.mark.parametrize("percent", [0, 37, 100])
def test_other_parameters(spark, odd, percent):
    docs, target = odd
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    out = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), buckets=97, grams=3, seed=5, least_words=2, percent=percent)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(by_loops(docs, target, 97, 3, 5, 2, percent), key=str)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(k, "one two three " * 10) for k in range(30)], "doc_id long, text string")
    assert resample.resample(empty, docs).count() == 0
    uniform = resample.resample(docs, empty)
    assert uniform.where("rank is not null").count() == 3 and uniform.count() == 30


def test_the_draw_leans_to_the_target(spark):
    rng = random.Random(9)
    kinds = [[f"{k}{j}" for j in range(200)] for k in "ab"]
    docs = [(k, " ".join(rng.choices(kinds[k % 2], k=60))) for k in range(600)]
    target = [(" ".join(rng.choices(kinds[0], k=60)),) for _ in range(50)]
    drawn = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "text string")).where("rank is not null").collect()
    assert len(drawn) == 60 and sum(r.doc_id % 2 == 0 for r in drawn) > 45
