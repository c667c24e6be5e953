"""SimHash groups, fingerprints and shards against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from quillmill.llm import fingerprint as fp
from quillmill.llm import shards, simhash

DOCS = "doc_id long, text string"


def frame(spark, rows, ddl=DOCS):
    return spark.createDataFrame(rows, ddl)


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(rows):
    """component_id by comparing each with each."""
    f = [simhash_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                label[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(rows[i][0], f"{f[i]:016x}", least.get(top(i))) for i in range(len(rows))]


TEXTS = [None, "", "  \n", "One", "one", "one two", "ÉCOLE école", "a b c", "A B C", "a b c a b c a b c", "x " * 3000]


@given(st.text(max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == simhash_of(text.encode("utf-8", "ignore").decode())


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 + rng.randrange(10**6), " ".join(own)))
    rows += [rows[20], (None, "a b c"), (None, "nothing like it at all")]
    want = sorted(groups_of(rows), key=str)
    wide = frame(spark, [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    for hot in (simhash.HOT, 1):  # 1: every shared signature goes the second way
        got = sorted((tuple(r) for r in simhash.near_duplicates(wide, hot=hot).collect()), key=str)
        assert got == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_in_a_dense_ball():
    """The look-up of flips finds the components that comparing each with each finds."""
    rng = np.random.default_rng(2)
    base = np.uint64(0x123456789ABCDEF)
    fps = np.unique(base ^ (rng.integers(0, 1 << 16, 600).astype(np.uint64) << np.uint64(20)))
    of = lambda edges: simhash.components(len(fps), np.searchsorted(fps, edges[0]), np.searchsorted(fps, edges[1])).tolist()
    assert of(simhash.look_up(fps)) == of(simhash.compare(fps))


def test_hot_groups_that_meet_in_a_batch():
    """All rows of a hot group wait, also those at the head of a batch that ends in another hot group."""
    for tail in (1, 2, 3, 5):
        keys = [1] * 3 + [2] * (6 + tail) + [3] * 9 + [4] * 3 + [5] * 7
        fps = list(range(100, 100 + len(keys)))
        ends = [0, 9, 9 + tail + 7, 9 + tail + 9, len(keys)]
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(fps[a:b])], names=["key", "fp"]) for a, b in zip(ends, ends[1:], strict=False)]
        got = [r for b in simhash._linked(iter(batches), 1, 4) for r in b.to_pylist()]
        hot = sorted((k, f) for k, f in zip(keys, fps, strict=True) if k in (2, 3, 5))
        assert sorted((r["a"], r["b"]) for r in got if r["pending"]) == hot
        assert {keys[fps.index(r["a"])] for r in got if not r["pending"]} == {1, 4}


def test_connected_chain(spark):
    """A long chain and a star become one component each."""
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    got, _ = simhash.connected(frame(spark, edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 61)} | {(1000 + i, 1000) for i in range(1, 200)}


@given(st.lists(st.text(min_size=1, max_size=12).filter(lambda t: "\n" not in t), max_size=8), st.randoms())
def test_fingerprints_are_homomorphic(paragraphs, rng):
    whole = fp.Fingerprint.of("\n".join(paragraphs))
    mixed = list(paragraphs)
    rng.shuffle(mixed)
    assert fp.Fingerprint.of("\n".join(mixed)) == whole
    if paragraphs:
        less = fp.Fingerprint.of("\n".join(mixed[1:]))
        assert less != whole
        less.insert(mixed[0])
        assert less == whole
        less.delete(mixed[0])
        assert less == fp.Fingerprint.of("\n".join(mixed[1:])) and less + fp.Fingerprint.of(mixed[0]) == whole
    assert fp.Fingerprint(bytes(whole)) == whole and whole.likeness(whole) == 1.0


def test_edit_report(spark):
    rng = random.Random(3)
    words = "the of and to in a is that for it".split()
    rows = [(rng.randrange(10**9), "\n".join(" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30)) for _ in range(4))) for _ in range(120)]
    rows += [(-5, None), (7, ""), (8, "é😀x"), (9, "y" * 300_000)]
    ordered = sorted(rows)
    got = {r.doc_id: r for r in fp.edit_report(frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, bucket int")).collect()}
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp.Fingerprint.of(text).hex(), fp.Fingerprint.of(changed).hex())
        assert 0 <= r.near_next <= 1 and abs(r.near_edited - fp.Fingerprint.of(text).likeness(fp.Fingerprint.of(changed))) < 1e-12
        if len(text) > 500 and after not in ("", text):
            assert r.near_edited > 0.6 > 0.3 > r.near_next
    alone = fp.edit_report(frame(spark, [(1, "abcdefgh")])).first()
    assert (alone.edited_sha256, alone.near_next) == (hashlib.sha256(b"abcdefab").hexdigest(), 1.0)
    assert fp.edit_report(frame(spark, [])).count() == 0
    ties = [(1, "bbbb"), (1, "aaaa"), (None, "cccc"), (1, "aaaa")]
    got = sorted((r.doc_id or 0, r.edited_sha256) for r in fp.edit_report(frame(spark, ties)).collect())
    ties.sort(key=in_order)
    assert got == sorted((i or 0, hashlib.sha256(fp.edited(t, ties[(k + 1) % 4][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ties))


def plain_vector(text):
    """The fingerprint's vector by sums over lines, one run of eight bytes after the other."""
    exact, sketch = [0] * fp.EXACT, [0] * fp.SKETCH
    for line in (text or "").split("\n"):
        data = line.encode()
        if not data:
            continue
        digest = hashlib.shake_128(data).digest(fp.EXACT * 8)
        exact = [(x + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % 2**64 for k, x in enumerate(exact)]
        data = data.ljust(8, b"\0")
        for at in range(len(data) - 7):
            lane = int.from_bytes(data[at : at + 8], "little") * 0x9E3779B97F4A7C15 % 2**64 >> 54
            sketch[lane // 2] += 1 - 2 * (lane % 2)
    return b"".join(x.to_bytes(8, "little") for x in exact) + b"".join((x % 2**32).to_bytes(4, "little") for x in sketch)


@given(st.text(max_size=80))
def test_vectors_by_plain_sums(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bytes(fp.Fingerprint.of(text)) == plain_vector(text)


def test_a_long_paragraph_in_chunks(monkeypatch):
    text = "".join(random.Random(4).choices("abcdef é", k=5000))
    for chunk in (7, 8, 1000):
        monkeypatch.setattr(fp, "CHUNK", chunk)
        assert bytes(fp.Fingerprint.of(text)) == plain_vector(text)


def in_order(row):
    """By id, null first, then by the hash of the text."""
    return (row[0] is not None, row[0] or 0, xxhash.xxh64_intdigest((row[1] or "").encode(), 42) >> 1, row[1] or "")


def test_next_row_in_many_ranges(spark):
    """More ranges than ids, and an id with most of the rows, which is split: every row still meets the next one."""
    few = [(k * 7 % 101, f"text {k}") for k in range(60)]
    crowd = [*few, *((50, f"crowd {k}") for k in range(400)), *((None, f"none {k}") for k in range(200)), ((1 << 63) - 1, "last"), ((1 << 63) - 1, "again")]
    for rows in (few, crowd):
        after = sorted(rows, key=in_order)
        for parts in (1, 2, 16, 64):
            got = fp.with_next(frame(spark, rows), parts).collect()
            assert sorted(((r.doc_id, r.text) for r in got if not r.ahead), key=in_order) == after
            ahead, own = {}, {}
            for r in got:
                if r.ahead:
                    ahead.setdefault(r.bucket, (r.doc_id, r.text))  # the first one counts
                else:
                    own.setdefault(r.bucket, []).append((r.doc_id, r.text))
            assert set(ahead) == set(own)
            for bucket, first in ahead.items():
                assert first == after[(after.index(max(own[bucket], key=in_order)) + 1) % len(after)]
            if rows is crowd and parts == 16:
                assert max(map(len, own.values())) < 150 and sum((50, "crowd 0")[0] in {i for i, _ in x} for x in own.values()) > 5


def test_document_vectors(spark):
    got = fp.fingerprint_documents(frame(spark, [(1, "a\nb"), (2, "b\n\na"), (3, None)])).collect()
    assert {r.doc_id: bytes(r.vector) for r in got} == {1: bytes(fp.Fingerprint.of("a\nb")), 2: bytes(fp.Fingerprint.of("a\nb")), 3: bytes(fp.WIDTH)}


def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(None, None), (5, "text 5"), (5, "other"), (-1, ""), (10**12, "é")]
    got = shards.shard_documents(frame(spark, [(*r, 0) for r in rows], "doc_id long, text string, shard int")).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.5 * len(rows) / 24
    want = sorted((i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    moved = sum(r["grown_shard"] == 24 for r in got) / len(got)
    assert 0.02 < moved < 0.07
    assert shards.shard_documents(frame(spark, [])).count() == 0


def test_weighted_shards(spark):
    rows = frame(spark, [(i, "") for i in range(4000)])
    got = [r["shard"] for r in shards.shard_documents(rows, 3, [1.0, 2.0, 5.0]).collect()]
    assert all(abs(got.count(k) / 4000 - w / 8) < 0.03 for k, w in enumerate((1, 2, 5)))
    with pytest.raises(ValueError, match="positive weight"):
        shards.shard_documents(rows, 2, [1.0, 0.0])
