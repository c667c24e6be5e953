"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

The index holds the test items, the queries are the passages of the training documents.
A passage's score for an item is BM25 over the words that both have, as a share of the
score that the item gets for its own words. An item that keeps ``SIMILAR`` of its word
shingles lacks no more words than it lacks shingles, so its share is at least one less the
shares of its so many heaviest words: that is the item's threshold, and every item that
reaches its own is retrieved. (Where that leaves no threshold, as for an item of few
different words, one word is enough.) A retrieved pair is then verified on word shingles of
the whole document: what share of the item's question and of its answer the document holds.

Items are ordered by length and lie in blocks of ``BLOCK``; for each word and block the
index has the largest part that the word can add there, relative to the threshold. A
passage's words give a bound for each block; only blocks whose bound reaches one are
opened, and in them WAND pivots over the posting lists.

Passages are windows at steps of the longest item's length, wide enough that an item's
copy, with a quarter more words put into it, lies within one of them, and the whole
document. So an item whose parts lie far apart is retrieved as well, and what is found
depends neither on the windows nor on the other items; a pair's score is that of its
best window, or of the document if no window reaches the threshold.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import make_room, remove, with_columns, written

K1, B = 1.2, 0.75
SHINGLE, SIMILAR, PART = 5, 0.8, 0.5
WIDE, LEAST = 2.25, 0.05
BLOCK = 2
#: What one index holds at most: items, and bytes of their texts. So many indexes are searched in one pass over the documents.
INDEX_ITEMS, INDEX_BYTES = 2048, 2 << 20
INDEXES = 8
#: Texts that hold items and were found by several passes are broadcast up to this number.
FOUND = 1 << 16

_WORDS = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


class Index:
    """BM25 over items (id, text); ``n`` items in all have the document frequencies ``df``, and lengths of ``mean`` on average and ``longest`` at most."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, longest: int, block: int = BLOCK):
        split = sorted((len(own), item_id, own) for item_id, own in ((i, words(t)) for i, t in items) if own)
        self.ids, self.question, self.answer, self.theta = [], [], [], []
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        self.longest, self.block = max(1, longest), block
        for at, (length, item_id, own) in enumerate(split):
            part = {
                w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                for w, tf in Counter(own).items()
            }
            whole = sum(part.values())
            cut = max(1, length - max(1, length // 4))
            self.question.append(shingles(own[: cut + SHINGLE - 1]))
            self.answer.append(shingles(own[cut:] if length - cut >= SHINGLE else own[-SHINGLE:]))
            lost = int((1 - SIMILAR) * len(self.question[-1] | self.answer[-1]) + 1e-9)
            theta = 1 - sum(sorted(part.values(), reverse=True)[:lost]) / whole
            self.theta.append(theta if theta > LEAST else min(part.values()) / whole)
            self.ids.append(item_id)
            for w, p in part.items():
                at_, parts = self.postings.setdefault(w, ([], []))
                at_.append(at)
                parts.append(p / whole / self.theta[-1])
        self.row = {w: k for k, w in enumerate(self.postings)}
        self.terms = list(self.postings)
        # the last row is that of all words without postings
        self.tops = np.zeros((len(self.row) + 1, -(-len(self.ids) // block)), np.float32)
        for k, (at_, parts) in enumerate(self.postings.values()):
            np.maximum.at(self.tops[k], np.array(at_) // block, np.array(parts, np.float32))

    def search(self, rows: set[int]) -> list[tuple[int, float]]:
        """(place, share) of all items that reach their threshold for a passage's words."""
        bound = self.tops[list(rows)].sum(axis=0)
        found = []
        for k in np.flatnonzero(bound >= 1 - 1e-4).tolist():
            found += self._wand([(self.terms[r], self.tops[r, k]) for r in rows if r >= 0 and self.tops[r, k] > 0], k * self.block, (k + 1) * self.block)
        return found

    def _wand(self, terms: list[tuple[str, float]], start: int, end: int) -> list[tuple[int, float]]:
        """The same within one block: the pivot is the first item that the lists up to it could lift over the threshold."""
        lists = []  # items, parts, place, largest part in the block
        for w, top in terms:
            items, parts = self.postings[w]
            lists.append([items, parts, bisect_left(items, start), float(top)])
        found = []
        while True:
            lists = sorted((x for x in lists if x[2] < len(x[0]) and x[0][x[2]] < end), key=lambda x: x[0][x[2]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= 1 - 1e-4:
                    pivot = x[0][x[2]]
                    break
            if pivot is None:
                return found
            if lists[0][0][lists[0][2]] == pivot:
                score = 0.0
                for x in lists:
                    if x[0][x[2]] != pivot:
                        break
                    score += x[1][x[2]]
                    x[2] += 1
                if score >= 1 - 1e-6:
                    found.append((pivot, score * self.theta[pivot]))
            else:
                for x in lists:
                    if x[0][x[2]] >= pivot:
                        break
                    x[2] = bisect_left(x[0], pivot, x[2])

    def matches(self, own: list[str], have: set[tuple[str, ...]] | None = None) -> list[tuple[int, float, float, float, float]]:
        """(item id, best score, overlap, question's, answer's) of the items that a text of these words (and shingles) holds."""
        get, step, width = self.row.get, self.longest, int(WIDE * self.longest)
        rows = [get(w, -1) for w in own]
        score: dict[int, float] = {}
        for at in range(0, max(1, len(own) - width + step), step):
            for item, s in self.search({*rows[at : at + width], -1}):
                score[item] = max(s, score.get(item, 0.0))
        if len(own) > width:
            for item, s in self.search({*rows, -1}):
                score.setdefault(item, s)
        if not score:
            return []
        have, out = have or shingles(own), []
        for item, s in sorted(score.items(), key=lambda x: (self.ids[x[0]], x[0])):
            question, answer = self.question[item], self.answer[item]
            whole = question | answer
            o, q, a = (len(x & have) / len(x) for x in (whole, question, answer))
            short = next(iter(whole))
            if len(short) < SHINGLE:  # an item of fewer words than a shingle: its words in a row
                o = q = a = float(any(tuple(own[k : k + len(short)]) == short for k in range(len(own))))
            if o >= SIMILAR and q >= PART and a >= PART:
                out.append((self.ids[item], s, o, q, a))
        return out


def shingles(own: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; fewer words are one run."""
    return {tuple(own[k : k + SHINGLE]) for k in range(max(1, len(own) - SHINGLE + 1))}


@functools.lru_cache(2)
def _indexes(shipped) -> list[Index]:
    """The indexes of one pass; their blocks grow with their number, so that the bounds of all take as much room as those of one."""
    blocks, whole = shipped.value
    return [Index(items, df, *whole, block=BLOCK * len(blocks)) for items, df in blocks]


def _found(indexes: list[Index], text: str | None) -> list[dict]:
    own = words(text)
    have = shingles(own) if len(indexes) > 1 else None
    return [dict(zip(_MATCH, m, strict=True)) for index in indexes for m in index.matches(own, have)]


_MATCH = ("item_id", "score", "overlap", "question", "answer")
_MATCHES = ArrayType(StructType([StructField(n, DoubleType() if k else LongType()) for k, n in enumerate(_MATCH)]))


def contamination(docs: DataFrame, items: DataFrame, out: str = "matches") -> DataFrame:
    """``docs`` and, in ``out``, the test items that each row's text holds.

    Null and empty texts hold none; items without id, text or words are never found;
    items that share an id or a text are each looked for, rows that repeat both once. Of
    ``items`` only item_id and text are read; the columns of ``docs`` pass unchanged, and one
    named as ``out`` gets a number after its name. Empty tables find nothing.

    Indexes go to every worker by broadcast, so their size is checked: items beyond
    ``INDEX_ITEMS`` or ``INDEX_BYTES`` are split by a hash into several, and the documents are
    searched for ``INDEXES`` of them in one pass. Where that takes several passes, each writes the texts that it has found
    something in, by their digest, and these are joined to ``docs``. Document frequencies are counted in Spark, and
    with the lengths they are those of all items: neither rows nor scores depend on the blocks.
    """
    spark = docs.sparkSession
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()

    def own_words(texts):
        own = [words(t) for t in texts]
        return [len(w) for w in own], [sorted(set(w)) for w in own]

    rows, path = written(with_columns(rows, ["text"], own_words, "n int, words array<string>"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    blocks = max(1, -(-size["rows"] // INDEX_ITEMS), -(-(size["bytes"] or 0) // INDEX_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    df, to = written(rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    whole = (size["n"], (size["words"] or 0) / max(1, size["n"]), size["longest"] or 1)
    docs = make_room(docs, {out})
    passes = [range(k, min(k + INDEXES, blocks)) for k in range(0, blocks, INDEXES)]

    def shipped(part: range):
        held = []
        for k in part:
            own = rows.where(F.col("block") == k)
            items = sorted((r["item_id"], r["text"]) for r in own.select("item_id", "text").collect())
            held.append((items, {r["word"]: r["df"] for r in own.select(F.explode("words").alias("word")).distinct().join(df, "word").collect()}))
        return spark.sparkContext.broadcast((held, whole))

    if len(passes) == 1:
        one = shipped(passes[0])
        found = with_columns(docs.withColumn(out, F.lit(None).cast(_MATCHES)), ["text"], lambda texts: ([_found(_indexes(one), t) for t in texts],), StructType([StructField(out, _MATCHES)]))
        remove(spark, path, to)
        return found
    tables, key = [], next(f"digest{k}" for k in range(len(docs.columns) + 2) if f"digest{k}" not in (*docs.columns, out))
    digest = F.sha2("text", 256)
    for part in passes:
        some = shipped(part)
        hit = with_columns(docs.select("text"), ["text"], lambda texts, some=some: ([_found(_indexes(some), t) for t in texts],), StructType([StructField(out, _MATCHES)]))
        tables.append(written(hit.where(F.size(out) > 0).select(digest.alias(key), out).groupBy(key).agg(F.first(out).alias(out)))[0])
        some.destroy()
    remove(spark, path, to)
    every = functools.reduce(DataFrame.unionByName, tables).groupBy(key).agg(F.flatten(F.collect_list(out)).alias(out))
    every = F.broadcast(every) if every.count() <= FOUND else every
    joined = docs.withColumn(key, digest).join(every, key, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(_MATCHES))).select(*docs.columns, out)


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and each test item that it holds: ids, BM25 share and overlaps.

    Documents without items (null and empty texts among them) have no row; repeated
    documents have equal rows; a null doc_id stays null.
    """
    return contamination(docs.select("doc_id", "text"), items).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, with their columns. Null and empty texts stay."""
    out = next(f"matches{k}" for k in range(len(docs.columns) + 1) if f"matches{k}" not in docs.columns)
    return contamination(docs, items, out).where(F.size(out) == 0).drop(out)
