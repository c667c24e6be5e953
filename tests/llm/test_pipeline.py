"""Near copies against likeness by shingles, and the pipeline's rows against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import bpe, near_copies, quality, secrets, simhash
from quillmill.llm.queries import PATTERN, VOCABULARY

from .test_scans import base_spans, contained

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(rng, base, n, edits):
    words = base.split()
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        yield " ".join(own)


def corpus(rng):
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = " ".join(rng.choice(words) for _ in range(rng.choice([80, 200, 600])))
        texts += copies(rng, base, rng.randint(1, 6), max(1, len(base.split()) // 100))
    rng.shuffle(texts)
    return texts


def test_near_copies(spark):
    rng = random.Random(9)
    texts = [*corpus(rng), None, "", " \n", "one", "One", "long " * 20_000, *corpus(random.Random(10))]
    rows = [(k * 2, t, "x") for k, t in enumerate(texts)] + [(4, texts[2], "x"), (None, texts[5], "x"), (None, "alone and without an id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, f0 string")
    got = near_copies.near_copies(df).collect()
    assert len(got) == len(rows)
    for hot in (2,):  # crowded shingles and blocks, in parts
        assert sorted(map(str, near_copies.near_copies(df, hot=hot).collect())) == sorted(map(str, got))
    group = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    found = wrong = want = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(texts[a] or "") and len(texts[b] or ""):
                alike, same = likeness(texts[a], texts[b]), group[2 * a] == group[2 * b]
                found, want, wrong = found + (alike >= 0.85 and same), want + (alike >= 0.85), wrong + (alike < 0.4 and same)
    assert want > 150 and found >= 0.97 * want and wrong == 0
    blank = [2 * k for k, t in enumerate(texts) if not (t or "").strip()]
    assert {group[k] for k in blank} == {min(blank)} and group[2 * texts.index("one")] == group[2 * texts.index("One")] == 2 * texts.index("one")
    assert [r.component_id for r in got if r.doc_id is None].count(None) == 1
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_near_copies_at_the_bound(spark):
    """Groups are those that comparing each with each at likeness 0.8 gives, around the bound and in chains."""
    rng = random.Random(12)
    texts = []
    for k in range(60):
        own = [f"v{k}x{i}" for i in range(rng.choice([9, 40, 120, 300]))]
        for _ in range(6):
            texts.append(" ".join(own) + " the same last line of every text here")
            at = rng.randrange(len(own))
            own = own[:at] + [f"n{rng.randrange(10**6)}" for _ in range(max(1, len(own) // rng.choice([8, 10, 14])))] + own[at:]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and likeness(texts[a], texts[b]) >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (near_copies.HOT, 4):
        assert sorted(tuple(r) for r in near_copies.near_copies(df, hot=hot).collect()) == list(enumerate(label))
    assert 60 < len(set(label)) < 300


def test_near_copies_meet_by_signatures(spark):
    """Without a shingle to meet by, signatures find all up to 31 bits, and 0.9 of the pairs of likeness 0.8 at least."""
    rng = random.Random(14)
    rows = []
    for _ in range(150):
        sketch = rng.getrandbits(255) << 1
        for bits in (0, 1, 17, 31):
            rows.append(sketch ^ sum(1 << b for b in rng.sample(range(1, 256), bits)))
    for _ in range(200):  # sets of shingles of likeness 0.8
        own = rng.sample(range(1 << 62), 220)
        for h in (own[:200], own[20:] + own[:2]):
            words = near_copies.sketch(np.unique(np.array(h, np.uint64)))
            rows.append(sum((w & (1 << 64) - 1) << 64 * k for k, w in enumerate(words)))
    signed = lambda w: w - (w >> 63 << 64)
    made = [(d, 50, *(signed(s >> 64 * k & (1 << 64) - 1) for k in range(4)), []) for d, s in enumerate(rows)]
    df = spark.createDataFrame(made, f"d long, n long, {', '.join(f'{f} long' for f in near_copies.WORDS)}, p array<long>")
    roots, _ = near_copies.candidates(df)
    root = {r.node: r.root for r in roots.collect()}
    assert all(root.get(k, k) == root.get(k // 4 * 4, k // 4 * 4) for k in range(600))
    met = sum(root.get(k + 1) == k for k in range(600, 1000, 2))
    assert met >= 180
    assert len({root.get(k, k) for k in range(len(rows))}) == 150 + 400 - met
    tiny = df.where("d < 600").withColumn("f0", F.expr("f0 | 1"))  # flagged as tiny, by signatures 31 bits link
    assert {tuple(r) for r in near_copies.candidates(tiny, hot=2)[0].collect()} == {(k, k // 4 * 4) for k in range(600) if k % 4}


def test_copies_are_linked_by_few_edges(spark, monkeypatch):
    """Copies meet under most of their keys, but the edges that are joined grow with the sets, whatever the crowd."""
    rng, seen, connected = random.Random(15), [], near_copies.connected

    def counted(edges):
        seen.append(edges.distinct().count())
        return connected(edges)

    monkeypatch.setattr(near_copies, "connected", counted)
    signed = lambda w: w - (w >> 63 << 64)
    for many in (300, 1200):
        rows = []
        for crowd in range(2):
            sketch = rng.getrandbits(255) << 1
            for d in range(many // 2):
                own = sketch ^ sum(1 << b for b in rng.sample(range(1, 256), 20))
                rows.append((2 * d + crowd, 50, *(signed(own >> 64 * k & (1 << 64) - 1) for k in range(4)), []))
        df = spark.createDataFrame(rows, f"d long, n long, {', '.join(f'{f} long' for f in near_copies.WORDS)}, p array<long>")
        for hot in (near_copies.HOT, 64):
            seen.clear()
            roots, _ = near_copies.candidates(df, hot)
            assert sorted(tuple(r) for r in roots.collect()) == [(d, d % 2) for d in range(2, many)]
            assert max(seen) <= 3 * many


def sketched(rng, center, flips):
    own = center ^ sum(1 << b for b in rng.sample(range(1, 256), flips))
    return [w - (w >> 63 << 64) for w in (own >> 64 * k & (1 << 64) - 1 for k in range(4))]


@pytest.mark.parametrize("held, work", [(1 << 18, 1 << 26), (10, 1 << 26), (1 << 18, 0), (200, 3000)])
def test_crowds_are_linked_or_marked(monkeypatch, held, work):
    """Edges of a large key connect what comparing each with each does, or else the key is marked; however its rows come."""
    monkeypatch.setattr(near_copies, "HELD", held), monkeypatch.setattr(near_copies, "WORK", work), monkeypatch.setattr(near_copies, "EACH", 0 if work < 10_000 else 64)
    rng, names, marked = random.Random(17), ["key", "d", *near_copies.WORDS], []
    for signed in (True, False):
        for flips in (5, 20, 36, 60):
            centers = [rng.getrandbits(255) << 1 for _ in range(3)]
            centers.append(centers[0] ^ sum(1 << b for b in rng.sample(range(1, 256), 75)))  # a crowd that touches another one, or not
            own = [sketched(rng, rng.choice(centers), flips) for _ in range(150)] + [sketched(rng, rng.getrandbits(255) << 1, 0) for _ in range(30)]
            own = [[w[0] | (k % 40 == 7), *w[1:]] for k, w in enumerate(own)]  # some are tiny
            rng.shuffle(own)
            keys = sorted([3 if signed else -3] * len(own) + [9 if signed else -1] * 2)
            own += own[:2]
            if not signed:
                own = own[-2:] + own[:-2] if keys[0] == -1 else own
            rows = np.array([[k, d, *w] for d, (k, w) in enumerate(zip(keys, own, strict=True))], np.int64)
            group = rows[rows[:, 0] == (3 if signed else -3), 1:].view(np.uint64)
            near = near_copies.near(group[:, None], group[None], signed)
            i, j = np.nonzero(near)
            want = simhash.components(len(group), i, j)
            for cut in (1, 7, 1000):
                batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[at : at + cut].T], names=names) for at in range(0, len(rows), cut)]
                got = pa.Table.from_batches(list(near_copies._linked(iter(batches), 50)))
                edges = got.filter(pc.is_null(got["key"]))
                ids = group[:, 0].astype(np.int64).tolist()
                place = {d: k for k, d in enumerate(ids)}
                pairs = [(place[a], place[b]) for a, b in zip(edges["d"].to_pylist(), edges["b"].to_pylist(), strict=True) if a in place and b in place]
                assert all(near[a, b] for a, b in pairs) and len(pairs) < len(group)
                marks = got.filter(pc.is_valid(got["key"]))["key"].to_pylist()
                marked.append(bool(marks))
                if not marks:
                    label = simhash.components(len(group), *(np.array(x, np.int64) for x in zip(*pairs, strict=True))) if pairs else np.arange(len(group))
                    assert np.array_equal(label, want)
    assert any(marked) == ((held, work) != (1 << 18, 1 << 26))


def test_rows_of_crowds_grow_with_their_sets(spark, monkeypatch):
    """What tasks write about crowds of near copies among other sets: a few rows a set, below and above what makes a key large."""
    rng, counts, written = random.Random(18), [], near_copies.written

    def counted(df):
        out = written(df)
        if df.columns == ["key", "d", "b"]:
            counts.append(out[0].count())
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    for many, flips, hot in ((1500, 10, 1024), (1500, 20, 1024), (3000, 10, 1024), (3000, 20, 1024), (3000, 10, 5000), (6000, 20, 1024)):
        center = rng.getrandbits(255) << 1
        rows = [(d, 50, *sketched(rng, center, flips), []) for d in range(many)] + [(many + d, 50, *sketched(rng, rng.getrandbits(255) << 1, 0), []) for d in range(1500)]
        df = spark.createDataFrame(rows, f"d long, n long, {', '.join(f'{f} long' for f in near_copies.WORDS)}, p array<long>")
        counts.clear()
        roots, _ = near_copies.candidates(df, hot)
        assert sorted(tuple(r) for r in roots.collect()) == [(d, 0) for d in range(1, many)]
        assert sum(counts) <= 6 * many, (many, flips, hot, counts)


def test_keys_that_are_not_settled_meet_again(spark, monkeypatch):
    """With next to no work for a large key, whole groups are dealt again; the components are the same."""
    rng = random.Random(19)
    rows = [(d, 50, *sketched(rng, c, 20), []) for d, c in enumerate([rng.getrandbits(255) << 1 for _ in range(3)] * 60)]
    rows = [(*r[:6], [7, -9]) for r in rows]  # all of them share two shingles
    df = spark.createDataFrame(rows, f"d long, n long, {', '.join(f'{f} long' for f in near_copies.WORDS)}, p array<long>")
    want = sorted((d, d % 3) for d in range(3, 180))
    for work, marks in ((1 << 26, 1 << 17), (0, 1 << 17), (0, 0)):
        monkeypatch.setattr(near_copies, "WORK", work), monkeypatch.setattr(near_copies, "EACH", 0 if not work else 64), monkeypatch.setattr(near_copies, "MARKS", marks)
        assert sorted(tuple(r) for r in near_copies.candidates(df, 16)[0].collect()) == want


def test_spanned(spark):
    """A forest connects what its edges connect, however few are held at once; marked keys pass on as they are."""
    rng, names = np.random.default_rng(16), ["key", "d", "b"]
    for nodes, edges in ((40, 30), (300, 900), (50, 2000)):
        d, b = rng.integers(-nodes, nodes, edges), rng.integers(-nodes, nodes, edges)
        none = pa.nulls(edges, pa.int64())
        whole = pa.RecordBatch.from_arrays([none, pa.array(d), pa.array(b)], names=names)
        marks = pa.RecordBatch.from_arrays([pa.array([5, None, 6]), pa.array([None, int(d[0]), None]), pa.array([None, int(b[0]), None])], names=names)
        want = simhash.components(2 * nodes, d + nodes, b + nodes)
        for most in (1, 64, 1 << 18):
            got = list(near_copies._spanned(iter([whole.slice(0, 0), *(whole.slice(k, 7) for k in range(0, edges, 7)), marks]), most))
            assert [x.column("key").to_pylist() for x in got if not x.column("key").null_count] == [[5, 6]]
            x, y = (np.concatenate([g.column(c).to_numpy() for g in got if g.column("key").null_count]) for c in "db")
            assert np.array_equal(simhash.components(2 * nodes, x + nodes, y + nodes), want)
        assert len(x) == 2 * nodes - len(np.unique(want))
    assert list(near_copies._spanned(iter([]))) == []


def test_signatures(spark):
    """Each bit but the first is left out of its segment once, whatever the width; shingles are keys as well."""
    one, words = 0x0123_4567_89AB_CDEF, near_copies.WORDS
    df = spark.createDataFrame([(1, 9, one, -1, -one, 0, [5, -6]), (2, 0, 0, 0, 0, 0, [])], f"d long, n long, {', '.join(f'{f} long' for f in words)}, p array<long>")
    for wide in near_copies.SEGMENTS:
        per, want = 64 // wide, []
        for v in range(1, 4 * per * wide):
            segment, bit = divmod(v, wide)
            word = [one & ~1, -1, -one, 0][segment // per] & (1 << 64) - 1
            want.append(v << 32 | (word >> wide * (segment % per)) & ((1 << wide) - 1) & ~(1 << bit))
        got = near_copies.indexed(df, wide).collect()
        assert sorted(r.key for r in got) == sorted([*want, 5 - (1 << 63), -6]) and {r.d for r in got} == {1}
        parts = [near_copies.indexed(df, wide, early).collect() for early in (True, False)]
        assert near_copies.EARLY <= len(parts[0]) <= near_copies.EARLY + 1 and sorted(r.key for p in parts for r in p) == sorted(r.key for r in got)
    assert [near_copies.segment_bits(k) for k in (0, 10**6, 10**8, 10**12)] == [16, 16, 21, 32]


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, " ".join(f"q{rng.randrange(400)}" for _ in range(rng.randint(12, 40)))) for k in range(10)]
    texts = corpus(rng)
    for k in range(0, len(texts), 9):
        texts[k] += " " + items[k % 10][1]
    for k in range(0, len(texts), 7):
        texts[k] += " password=abcdefgh12345 " + "0af1" * 9
    bad = [" ".join(w for w in f"junk{k} trash{k} b{k} c{k} d{k}".split() for _ in range(30)) for k in range(80)]
    every = [*texts, *bad, *texts[:10], texts[3]]
    order = rng.sample(range(len(every)), len(every))
    rows = [(order[k], t, "xx", "s", len(t)) for k, t in enumerate(every)] + [(10_000, None, None, None, None), (10_001, "", "", "", 0), (None, texts[0], None, None, 1), (order[1], every[1], "xx", "s", 1)]
    labels = [(order[k], int(t not in bad), 0) for k, t in enumerate(every)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen.append((name, before.collect(), docs.collect()))
        assert name == "bpe" or docs.columns == before.columns
    stages = {name: (old, new) for name, old, new in seen}
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "secrets", "bpe"]

    old, new = stages["quality"]
    good = {r.doc_id for r in quality.quality_report(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).where(F.col("predicted") == 1).collect()}
    assert sorted(map(str, new)) == sorted(str(r) for r in old if r.doc_id in good)
    kept = {r.text for r in new}
    assert set(texts) <= kept and len(set(bad) & kept) < 8

    old, new = stages["near_dedup"]
    assert {str(r) for r in new} <= {str(r) for r in old} and len({(r.doc_id, r.text) for r in new}) == len(new)
    for r in old:  # each row has a kept one of its group; exact copies of one text have one
        assert any(likeness(r.text, k.text) >= 0.6 for k in new)
    by_text = {}
    for r in new:
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    assert all(len(ids) == 1 for ids in by_text.values())
    pairs = [(a, b) for a in new for b in new if str(a) < str(b) and likeness(a.text, b.text) >= 0.85]
    assert len(pairs) <= 2 < len(old) - len(new)

    old, new = stages["decontaminate"]
    held = {d for d, _ in contained([(str(r), r.text) for r in old], items)}
    assert sorted(map(str, new)) == sorted(str(r) for r in old if str(r) not in held) and held

    old, new = stages["secrets"]
    want = sorted((str(r.doc_id), secrets.redacted(r.text, base_spans(r.text or ""))) for r in old)
    assert sorted((str(r.doc_id), r.text) for r in new) == want and all(r.text is None or r.n_chars == len(r.text) or r.doc_id is None for r in new)
    assert any("[assign]" in (r.text or "") for r in new)

    old, new = stages["bpe"]
    with open(VOCABULARY, "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Vocabulary.parse(f.read()).ranks, special_tokens={})
    want = sorted((str(r.doc_id), reference.encode_ordinary(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in old)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded_sha256) for r in new) == want and all(r.n_tokens == len(r.ids) for r in new)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, new))


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
