"""SimHash near-duplicate groups by deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints link if at most three bits differ. Cut
into two segments of 32 bits, one of the segments then differs by one bit at most:
so every fingerprint is indexed under each segment as it is and under each segment
with one bit taken out (66 signatures), rows are brought together by equal
signature, and the whole fingerprints are verified.

Pairs are never listed. A signature's rows become the edges of a spanning star for
each group that they form, so that edges stay linear in rows. A signature with more
than ``HOT`` fingerprints is indexed once more in the same manner on its other half
(segments of 16 bits): a group of that second index has 18 free bits at most, hence a
bounded number of fingerprints, which is linked by looking up every flip of up to
three bits in a bitmap. Both ways are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, remove, written

SEED = 42
DISTANCE = 3
#: Up to so many fingerprints of a signature are compared with each other.
HOT = 1024
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer.

    A-Z is lower-cased, words are runs without ASCII white space, repeated shingles
    count each time. A text with fewer words is one shingle; without words (empty,
    blank or null) the fingerprint is zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (long) of every row of ``docs`` (doc_id, text)."""
    return map_columns(docs.select("doc_id", "text"), lambda ids, texts: (ids, [fingerprint(t, shingle) for t in texts]), "doc_id long, fp long")


def hex16(column):
    """The long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each node's component, given edges i-j among n nodes."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def star(values: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each value to its component's first."""
    leaf = np.flatnonzero(label != np.arange(len(values)))
    return values[leaf], values[label[leaf]]


def compare(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges among a few fingerprints, each compared with each."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE
    i, j = np.nonzero(np.triu(near, 1))
    return star(fps, components(len(fps), i, j))


_FLIPS = {n: np.array([sum(1 << b for b in bits) for k in range(1, DISTANCE + 1) for bits in itertools.combinations(range(n), k)]) for n in (16, 17, 18)}


def look_up(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges among fingerprints that agree but for 18 bits, in time linear in their number."""
    fps = np.unique(fps)
    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if free >> b & 1]
    width = max(16, len(bits))
    code = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        code |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << width, -1, np.int64)
    place[code] = np.arange(len(fps))
    label = np.arange(len(fps))
    for flip in _FLIPS[width]:
        other = place[code ^ flip]
        i = np.flatnonzero(other >= 0)
        label = components(len(fps), i, other[i], label)
    return star(fps, label)


def _linked(batches: Iterator[pa.RecordBatch], keys: int, hot: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys`` key columns, then fp -> rows (pending, a, b).

    pending false: an edge between fingerprints a and b. pending true: the group is
    hot; a is its key and b one of its fingerprints. At most ``hot`` fingerprints of a
    group are held (None: groups are bounded by their key).
    """
    names = ["pending", "a", "b"]

    def rows(pending: bool, a: list, b: list) -> pa.RecordBatch:
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), pending)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    held: tuple | None = None  # key and fingerprints of the group that the last batch ended in
    flowing = None  # key of a hot group whose rows pass through
    for batch in itertools.chain(batches, [None]):
        edges_a, edges_b, wait_a, wait_b = [], [], [], []
        if batch is None:
            key = np.empty((0, keys), np.int64)
            fps = np.empty(0, np.uint64)
        else:
            key = np.column_stack([batch.column(k).to_numpy() for k in range(keys)]).astype(np.int64)
            fps = batch.column(keys).to_numpy().view(np.uint64)
        if held is not None:
            key, fps = np.vstack([np.tile(held[0], (len(held[1]), 1)), key]), np.concatenate([held[1], fps])
            held = None
        if len(fps):
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(fps)]))
            size = end - start
            waiting = size > hot if hot is not None else np.zeros(len(start), bool)
            if flowing is not None:  # as it was before this batch: its tail may begin the batch
                waiting |= (key[start] == flowing).all(axis=1)
            if batch is not None:
                if waiting[-1]:
                    flowing = key[-1].copy()
                else:
                    held = (key[-1].copy(), fps[start[-1] :].copy())
                    start, end, size, waiting = start[:-1], end[:-1], size[:-1], waiting[:-1]
            two = start[(size == 2) & ~waiting]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE]
            edges_a.append(fps[near + 1]), edges_b.append(fps[near])
            many = (size > 2) & ~waiting
            for s, e in zip(start[many].tolist(), end[many].tolist(), strict=True):
                a, b = (compare if e - s <= HOT else look_up)(fps[s:e])
                edges_a.append(a), edges_b.append(b)
            for s, e in zip(start[waiting].tolist(), end[waiting].tolist(), strict=True):
                wait_a.append(key[s:e, 0].view(np.uint64)), wait_b.append(fps[s:e])
        if any(map(len, edges_a)):
            yield rows(False, edges_a, edges_b)
        if any(map(len, wait_a)):
            yield rows(True, wait_a, wait_b)


#: Signature v of a fingerprint: v // 33 is the segment, v % 33 the bit taken out (32: none).
_SIGNATURE = """
    shiftleft(cast(v as bigint), 32)
    | (shiftrightunsigned(fp, 32 * (v div 33)) & 4294967295L
       & ~(case when v % 33 < 32 then shiftleft(1L, cast(v % 33 as int)) else 0L end))
"""
#: Of the half that signature ``key`` leaves free: segment w // 17, bit taken out w % 17 (16: none).
_SECOND = """
    shiftleft(cast(w as bigint), 32)
    | (shiftrightunsigned(fp, (32 - 32 * cast(shiftright(key, 32) div 33 as int)) + 16 * (w div 17)) & 65535L
       & ~(case when w % 17 < 16 then shiftleft(1L, cast(w % 17 as int)) else 0L end))
"""


def links(fps: DataFrame, hot: int = HOT) -> tuple[DataFrame, list[str]]:
    """Edges (a, b) that connect what distance three connects among distinct ``fps`` (fp); scratch paths."""
    signed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("v")).selectExpr(f"{_SIGNATURE} as key", "fp")
    dealt = signed.repartition("key").sortWithinPartitions("key", "fp")
    found, path = written(dealt.mapInArrow(lambda it: _linked(it, 1, hot), "pending boolean, a long, b long"))
    second = (
        found.where("pending").selectExpr("a as key", "b as fp")
        .withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(33))))
        .selectExpr("key", f"{_SECOND} as sub", "fp")
        .repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
        .mapInArrow(lambda it: _linked(it, 2, None), "pending boolean, a long, b long")
    )
    return found.where("not pending").unionByName(second).select("a", "b").distinct(), [path]


def connected(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every node that has an edge; root is the component's smallest node.

    Large-star and small-star steps until the edges stay the same. Every step is a
    written table; per-node minima are combined before they are shuffled. The centre of a
    large component is a hot key of the joins: its rows are pairs of integers, and AQE
    (on by default) splits the partition that they fall into.
    """
    spark = edges.sparkSession
    now, path = written(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").where("a <> b").distinct())
    marks = [F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")]
    seen = now.agg(*marks).first()
    while True:
        both = now.unionByName(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.where("b > a").join(least, "a").selectExpr("b as a", "m as b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.expr("array(struct(a as a, m as b), struct(b as a, m as b))")).alias("e")).select("e.*")
        after, to = written(small.where("a <> b").distinct())
        mark = after.agg(*marks).first()
        remove(spark, path)
        now, path = after, to
        if mark == seen:
            return now.selectExpr("a as node", "b as root"), path
        seen = mark


def near_duplicates(docs: DataFrame, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id that links reach, itself included. Null or
    empty texts have fingerprint zero and link like others. A null doc_id never is a
    component's smallest unless all are null (then null). Repeated rows stay, with
    equal results. An empty table gives an empty result. Only doc_id and text are
    read, so other columns may have any name.
    """
    spark = docs.sparkSession
    fps, at = written(fingerprints(docs, shingle))
    first, to = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    edges, scratch = links(first.select("fp"), hot)
    roots, last = connected(edges)
    group = F.coalesce("root", "fp")
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "least_id", group.alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    out, _ = written(fps.join(named, "fp").select("doc_id", hex16("fp").alias("fingerprint"), "component_id"))
    remove(spark, *scratch, at, to, last)
    return out
