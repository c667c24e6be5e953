"""The backtracking encoder against the tokenizers library."""

import hashlib
import json
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmill.llm import backtrack
from quillmill.llm.queries import TOKENIZER, op12_backtrack


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def known():
    with open(TOKENIZER, "rb") as f:
        return backtrack._vocabulary("test", f.read())


def letter(rng):
    while True:
        c = rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0x110000), rng.choice(rng.choice(backtrack.LATER))])
        if not 0xD800 <= c < 0xE000:
            return chr(c)


def some_texts(rng):
    fixed = ["", " ", "  ", "\n", " x", "x ", "a\n b", "a \nb", "a  b", "a  b", "'s 's's ''s", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n<|endoftext", "aaaa" * 500, "ab" * 3000, "0" * 5000, " " * 3000 + "x", "the" * 3000]
    odd = ["".join(letter(rng) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    plain = ["".join(rng.choice("abcdet hhe  '\n1.") for _ in range(rng.randint(0, 200))) for _ in range(800)]
    blank = ["".join(rng.choice("ab  \n\t' .s") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    return fixed + odd + plain + blank + ["".join(rng.choice(a) for _ in range(20_000)) for a in ("acgt", "etaoin", "ab")]


def test_ids_and_texts_are_those_of_the_library(library, known):
    texts = some_texts(random.Random(1))
    encoder = backtrack.BacktrackingEncoder(*known)
    for at in (0, 3000):  # the second time over what is known
        ids, offset = encoder.texts(texts[at:])
        back = known[0].decode(ids, offset)
        for k, t in enumerate(texts[at:]):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[offset[k] : offset[k + 1]].tolist() == want, t
            assert back[k].decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_forgetting_changes_nothing(library, known, monkeypatch):
    monkeypatch.setattr(backtrack, "STRETCHES", 50)
    monkeypatch.setattr(backtrack, "REMEMBERED", 50)
    encoder = backtrack.BacktrackingEncoder(*known)
    for t in some_texts(random.Random(2))[:300]:
        assert encoder.texts([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_compatible_pairs_by_merging(known):
    """What two tokens' bytes merge to, by carrying the merges out."""
    vocabulary, rng = known[0], random.Random(3)
    of = lambda i: vocabulary.bytes[vocabulary.offset[i] : vocabulary.offset[i + 1]].tobytes()
    byte = {of(i): i for i in range(len(vocabulary.length)) if vocabulary.length[i] == 1}
    seen = set()
    joins = {(a, b): i for i, (a, b) in enumerate(zip(vocabulary.left, vocabulary.right, strict=True)) if a >= 0}
    near = [i for i in range(len(vocabulary.rank)) if -1 < vocabulary.rank[i] < 3000]
    for _ in range(3000):
        a, b = rng.choice(near), rng.choice(near)
        own = [byte[bytes([x])] for x in of(a) + of(b)]
        while True:
            best = min(((vocabulary.pair[x << 32 | y], k) for k, (x, y) in enumerate(zip(own, own[1:], strict=False)) if x << 32 | y in vocabulary.pair), default=None)
            if best is None:
                break
            k = best[1]
            own[k : k + 2] = [joins[own[k], own[k + 1]]]
        seen.add(own == [a, b])
        assert vocabulary.compatible(a, b) == (own == [a, b]), (of(a), of(b))
    assert seen == {True, False}


def test_very_long_pre_tokens_take_linear_time(known):
    rng = random.Random(4)
    for alphabet in (b"ab", b"acgt", b"etaoinshrdlu"):
        took = []
        for n in (100_000, 800_000):
            piece = bytes(rng.choices(alphabet, k=n))
            began = time.process_time()
            known[0].encode([piece])
            took.append(time.process_time() - began)
        assert took[1] < 16 * took[0] + 2


def test_other_files_are_refused():
    with open(TOKENIZER, "rb") as f:
        file = json.loads(f.read())
    for change in ({"dropout": 0.1}, {"unk_token": "x"}, {"merges": file["model"]["merges"][::-1]}, {"type": "WordPiece"}):
        with pytest.raises(ValueError):
            backtrack.Vocabulary(json.dumps(file | {"model": file["model"] | change}).encode())
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        backtrack.Vocabulary(f.read())


def test_small_vocabularies_by_the_library():
    """Random vocabularies in the order of training."""
    rng = random.Random(5)
    letters = {b: c for c, b in backtrack.byte_letters().items()}
    for _ in range(60):
        tokens, merges = [letters[b] for b in range(256)], []
        some = [letters[b] for b in b"abc"]
        for _ in range(rng.randint(0, 25)):
            a, b = rng.choice(some), rng.choice(some)
            if a + b not in tokens and len(a + b) < 9:
                tokens.append(a + b), some.append(a + b), merges.append([a, b])
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        file = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model | {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}}
        own, library = backtrack.Vocabulary(json.dumps(file).encode()), Tokenizer.from_str(json.dumps(file))
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(60)]
        ids, end = own.encode([p.encode() for p in pieces])
        for p, a, b in zip(pieces, [0, *end[:-1].tolist()], end.tolist(), strict=True):
            assert ids[a:b].tolist() == library.encode(p).ids, (p, merges)


def test_report(spark, tmp_path, library):
    rows = [(1, "One two  three\n<|endoftext|> four"), (2, None), (3, ""), (1, "One two  three\n<|endoftext|> four"), (None, "é" * 3000), (4, "word " * 20_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_backtrack(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert backtrack.token_report(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_columns_and_decoding(spark, library, known):
    docs = spark.createDataFrame([("a", 1, "Hello there", 5)], "ids string, doc_id long, text string, text0 int")
    coded = backtrack.encode(docs, TOKENIZER, back="text")
    assert coded.columns == ["ids0", "doc_id", "text0", "ids", "text"]
    assert coded.first()["text"] == "Hello there" and coded.first()["ids"] == library.encode("Hello there").ids
    rng = random.Random(6)
    lists = [None, [], [None, 15496, 999_999, -1], *([rng.randrange(50_300) for _ in range(rng.randint(0, 6))] for _ in range(300))]
    rows = spark.createDataFrame([(k, x, "x") for k, x in enumerate(lists)], "k int, ids array<int>, text string")
    got = {r["k"]: (r["text0"], r["text"]) for r in backtrack.decode(rows, TOKENIZER).collect()}
    for k, x in enumerate(lists):
        own = [i for i in x or [] if i is not None and 0 <= i < 50_257]
        assert got[k] == ("x", library.decode(own, skip_special_tokens=False))
    assert known[0].decode(np.empty(0, np.int64), np.zeros(1, np.int64)) == []
