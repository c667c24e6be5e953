"""The substring join and the catalogue index against comparing each with each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import catalog, substring_join
from quillmill.operators.catalog_index import CatalogIndex


def test_classes():
    for n in range(1, 5000):
        size = substring_join.size_of(n)
        assert size + max(1, size // 2) - 1 <= n <= substring_join.longest(size) and size * 9 >= n * 4


@pytest.mark.parametrize("chunk", [3, 40, substring_join.CHUNK])
def test_marks_are_shared_by_all_that_holds_them(monkeypatch, chunk):
    monkeypatch.setattr(substring_join, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        texts = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(1, 120))) for _ in range(4)]
        k = rng.randrange(4)
        a = rng.randrange(len(texts[k]))
        value = texts[k][a : a + rng.randint(1, 50)]
        size = substring_join.size_of(len(value))
        whole = substring_join.Texts([(0, 0, value)])
        places, hashes = whole.marks(size)
        own = set(zip(hashes.tolist(), places.tolist(), strict=True))
        every = set()
        for part in substring_join.together(texts, substring_join.longest(size)):
            at, h = part.marks(size)
            piece = part.piece(at)
            assert (at + size <= part.end[piece]).all()
            every |= {(x, p) for x, p, r in zip(h.tolist(), (at - part.begin[piece] + part.at[piece]).tolist(), part.row[piece].tolist(), strict=True) if r == k}
        assert own and all((h, o + a) in every for h, o in own)
        assert whole.hashes(np.array([0]), len(value)) == substring_join.Texts([(0, 0, "xyz"), (1, 0, texts[k])]).hashes(np.array([3 + a]), len(value))


def pairs(spark, values, sources):
    got = substring_join.contained(spark.createDataFrame([(v, 1) for v in values], "value string, text int"), spark.createDataFrame([(*s, "x") for s in sources], "source_id long, text string, value string"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_contained_as_contains(spark, monkeypatch):
    rng = random.Random(1)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    sources = [(k, some("ab é", 200) if k % 2 else some("abcdefghij é中", 300)) for k in range(80)]
    sources += [(100, None), (101, ""), (None, "null id"), (3, "another text of three"), (102, sources[5][1]), (103, "x" * 5000), (104, "\n\t😀" * 10)]
    values = [None, "", "a", "ab", " ", "null", "text of three", "nowhere at all", "x" * 4999, "x" * 5001, "x", "xx", "😀\n", "中", "é"]
    values += [t[a : a + rng.randint(1, 60)] for _, t in sources if t for a in [rng.randrange(len(t))] for _ in range(3)] + values[2:5]
    values += [some("ab é", 12) for _ in range(100)]
    want = sorted({(v, i) for v in values if v for i, t in sources if t and v in t}, key=str)
    assert pairs(spark, values, sources) == want and len(want) > 1500
    counts = lambda which: sorted((tuple(r) for r in substring_join.counted(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(which, "source_id long, text string")).collect()), key=str)
    tallied = lambda found: sorted(((v, len(own), min((i for i in own if i is not None), default=None)) for v in {v for v, _ in found} for own in [[i for w, i in found if w == v]]), key=str)
    assert counts(sources) == tallied(want)  # ids repeat
    once = list({i: (i, t) for i, t in sources}.values())
    assert counts(once) == tallied({(v, i) for v in values if v for i, t in once if t and v in t})
    monkeypatch.setattr(substring_join, "BITS", 64)  # a full bitmap keeps nothing back
    assert counts(once) == tallied({(v, i) for v in values if v for i, t in once if t and v in t}) and counts([]) == []
    assert pairs(spark, values[:40], sources) == [p for p in want if p[0] in values[:40]]
    assert pairs(spark, [], sources) == pairs(spark, values, []) == pairs(spark, ["", None], sources) == []


def test_catalogue_index(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abÀé中 ") for _ in range(rng.randint(1, 9)))
    records = [("s", str(k), word() + " " + word(), rng.choice([None, word()]), rng.choice([None, str(9780000000000 + k)])) for k in range(150)]
    records += [("s", None, None, None, None), ("s", "7", "the same", "the same", None), ("s", "7", "the same", "the same", None), ("s", "city", "İstanbul ẞ", None, None)]
    df = spark.createDataFrame(records, catalog.CATALOG_RECORD)
    index = CatalogIndex.build(df, str(tmp_path / "index"))
    queries = [None, "", "  ", "a", " b ", "ÀÉ", "é中", "the same", "THE SAME ", "the sameness", "978000000000", "0000000001", "zzz", "e  s", "i̇stan", "ß"] + [word() for _ in range(80)] + [r[2][2:9] for r in records[:40]]
    rows = spark.createDataFrame([(q, 1) for q in [*queries, "a", "the same"]], "query string, _row int")
    got = sorted(((r.query, *tuple(r)[1:]) for r in index.search(rows).collect()), key=str)
    asked = spark.createDataFrame([(q,) for q in set(queries)], "query string")
    want = asked.join(df, catalog.matches(asked["query"])).collect()
    assert got == sorted((tuple(r) for r in want), key=str) and len(got) > 1500
    c = catalog.Catalog("own", own=index.adapter())
    assert sorted(tuple(r) for r in c.search(" The SAME ").records.collect()) == [records[151]] * 2
    assert c.lookup("city").records.first().title == "İstanbul ẞ"
    empty = CatalogIndex.build(df.limit(0))
    assert empty.search(rows).count() == 0 and index.search(rows.limit(0)).count() == 0


def test_long_texts_tell_a_value_once(spark, monkeypatch):
    """Also where they come in several pieces; and no more rows are exchanged than values."""
    monkeypatch.setattr(substring_join, "CHUNK", 50)
    texts = [(k, "ab cd ef gh " * 40) for k in range(30)]
    held = spark.createDataFrame(texts, "source_id long, text string").select("text", "source_id")
    values = spark.createDataFrame([("ab cd",), ("h",), (" ef gh ab ",)], "value string")
    chosen, offsets = substring_join._chosen(values, held)
    bitmaps = [substring_join._bitmap(chosen, c) for c in ("h", "head", "whole")]
    # the task's own closure runs here, on one batch
    monkeypatch.setattr(type(held), "mapInArrow", lambda self, run, schema: run)
    run = substring_join._told(held, offsets, substring_join._by_size(chosen, substring_join.F.length("value")), *bitmaps)
    rows = [tuple(r.values()) for b in run(iter(held.toArrow().to_batches())) for r in b.to_pylist()]
    assert sorted(rows) == sorted((k, v) for k, _ in texts for v in ("ab cd", "h", " ef gh ab "))


def test_records_are_dealt_before_they_are_indexed(spark, monkeypatch):
    """However few files they come from; and few queries don't move the index."""
    from quillmill.operators import catalog_index

    monkeypatch.setattr(catalog_index, "RECORDS", 100)
    df = spark.range(1000).coalesce(1).selectExpr("'s' as source", "cast(id as string) as record_id", "concat('title ', id) as title", "'by' as creator", "'' as isbn")
    index = CatalogIndex.build(df)
    assert len(index._table("records").inputFiles()) == 10
    asked = spark.createDataFrame([("title 99",), ("7",), ("none",)], "query string")
    found = index.search(asked)
    assert "BroadcastExchange" in found._jdf.queryExecution().executedPlan().toString().split("records", 1)[-1]
    few = sorted((r.query, r.record_id) for r in found.collect())
    monkeypatch.setattr(catalog_index, "QUERIES", 0)
    assert sorted((r.query, r.record_id) for r in index.search(asked).collect()) == few
    assert [i for q, i in few if q == "title 99"] == sorted(["99", *(str(k) for k in range(990, 1000))]) and len(few) == 11 + sum("7" in str(k) for k in range(1000))


def test_long_queries_meet_few_records(spark):
    """A number meets the records that have eight of its digits, not those that have three."""
    from quillmill.operators import catalog_index

    df = spark.range(3000).selectExpr("'s' as source", "cast(id as string) as record_id", "'title' as title", "'by' as creator", "concat('978', lpad(cast(id * 7919 % 1000003 as string), 9, '0')) as isbn")
    index = CatalogIndex.build(df)
    asked = df.where("record_id % 50 = 0").selectExpr("substr(isbn, 4, 9) as query")
    grams = index._table("rows").where(F.length("gram") == catalog_index.LONG)
    assert grams.join(asked.select(F.explode(catalog_index.stretches(F.col("query"), 8)).alias("gram")), "gram").count() < 300
    assert sorted(r.record_id for r in index.search(asked).select("record_id").collect()) == sorted(str(k) for k in range(0, 3000, 50))
