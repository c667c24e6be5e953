"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two. So the order of paragraphs
doesn't matter, and a paragraph is put in or taken out by adding or subtracting its
vector, without the rest of the text.

The vector has two parts. ``EXACT`` lanes of 64 bits (modulo 2**64) come from an
extendable hash of the whole paragraph and decide equality. ``SKETCH`` lanes of 32 bits
(modulo 2**32) are signed counts of hashed runs of eight bytes; their differences
estimate how much two multisets of such runs differ, hence a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

EXACT, SKETCH, RUN, CHUNK = 32, 512, 8, 1 << 20
WIDTH = EXACT * 8 + SKETCH * 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Fingerprint:
    """A multiset of paragraphs, as its vector. Empty at first."""

    __slots__ = ("exact", "sketch")

    def __init__(self, data: bytes | None = None):
        data = data or bytes(WIDTH)
        self.exact = np.frombuffer(data, "<u8", EXACT).copy()
        self.sketch = np.frombuffer(data, "<u4", SKETCH, EXACT * 8).copy()

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        """Of a text's paragraphs: its non-empty lines. Null and empty texts have none."""
        own = cls()
        for paragraph in (text or "").split("\n"):
            if paragraph:
                own.insert(paragraph)
        return own

    def insert(self, paragraph: str) -> None:
        exact, sketch = vector(paragraph)
        self.exact += exact
        self.sketch += sketch

    def delete(self, paragraph: str) -> None:
        exact, sketch = vector(paragraph)
        self.exact -= exact
        self.sketch -= sketch

    def __add__(self, other: Fingerprint) -> Fingerprint:
        both = Fingerprint(bytes(self))
        both.exact += other.exact
        both.sketch += other.sketch
        return both

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bytes(self) == bytes(other)

    def __hash__(self) -> int:
        return hash(bytes(self))

    def __bytes__(self) -> bytes:
        return self.exact.tobytes() + self.sketch.tobytes()

    def hex(self) -> str:
        """A digest of the vector: 64 hex digits."""
        return hashlib.sha256(bytes(self)).hexdigest()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints (two empty ones too), near 0 for texts without common runs of bytes."""
        if self == other:
            return 1.0
        a, b = self.sketch.view(np.int32).astype(float), other.sketch.view(np.int32).astype(float)
        whole = a @ a + b @ b
        return float(min(1.0, max(0.0, 2 * (a @ b) / whole))) if whole else 0.0


def vector(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    """The lanes that one paragraph adds. Its runs are counted by ``CHUNK``, so a long one needs little more than its bytes."""
    data = paragraph.encode("utf-8", "surrogatepass")
    exact = np.frombuffer(hashlib.shake_128(data).digest(EXACT * 8), "<u8")
    padded = data.ljust(RUN, b"\0")
    n, lanes = len(padded) - RUN + 1, np.zeros(2 * SKETCH, np.int64)
    for at in range(0, n, CHUNK):
        runs = np.ndarray(min(CHUNK, n - at), "<u8", padded, at, (1,)) * _MIX
        lanes += np.bincount((runs >> np.uint64(54)).astype(np.int64), minlength=2 * SKETCH)
    return exact, (lanes[::2] - lanes[1::2]).astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the beginning of the next one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _RESULT.split(", ")]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint's vector (binary) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bytes(Fingerprint.of(t)) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "vector"])

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, vector binary")


def _longs(values: list[int]):
    """A constant array: one literal, which Catalyst folds, however many values it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _place(key, splits: list[int]):
    """How many of the sorted ``splits`` are at most ``key``, by a search in two steps."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = upto(_longs(splits[::step]))
    fine = upto(F.slice(_longs(splits), (coarse - 1) * step + 1, step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def _ranges(ranks: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Split points of ids, and the first bucket and the number of buckets of each range between them.

    An id that several of the equally spaced ``ranks`` fall on is a range by itself, and has as many buckets.
    """
    # ranks come as doubles: beyond 2**53 an id is within a unit in their last place
    slack = lambda v: int(math.ulp(float(v))) if abs(v) >= 1 << 53 else 0
    count = Counter(ranks)
    heavy = {max(v - slack(v), -(1 << 63)): n for v, n in count.items() if n > 1}
    ends = (v + slack(v) + 1 for v, n in count.items() if n > 1)
    splits = sorted({*heavy, *(v for v in ends if v < 1 << 63), *(v for v, n in count.items() if n == 1)})
    width = [1, *(heavy.get(v, 1) for v in splits)]
    return splits, list(itertools.accumulate(width[:-1], initial=0)), width


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (bucket, ahead, k, doc_id, text, t) from which each row's next one is at hand.

    Rows are dealt out by ranges of doc_id and sorted in them; the first row of each
    range is sent to the range before it as well (``ahead``), that of the first range to
    the last. So one shuffle of the texts is enough, no task holds more than a range,
    and only ``parts`` split points (a tenth of a range from where they should be, at most)
    and minima come to the driver; finding them reads doc_id alone, unless an id has more
    rows than a range and is split. Null ids come first; rows with equal ids follow each
    other in the order of a hash of their texts (t), by which such an id is split.
    """
    low = -(1 << 63) + 1
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(low)).alias("k"))
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = rows.select("k").agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] if parts > 1 else []
    splits, start, width = _ranges(ranks or [])
    place = _place(F.col("k"), splits)
    part = hashed if max(width) > 1 else F.lit(0).cast("long")
    rows = rows.withColumn("part", part)
    within = F.shiftright(F.shiftright("part", 31) * F.get(_longs(width), F.col("place")), 32)  # as a share of all values
    rows = rows.withColumn("place", place).withColumn("bucket", (F.get(_longs(start), F.col("place")) + within).cast("int")).drop("place")
    first = {r["bucket"]: r["row"] for r in rows.groupBy("bucket").agg(F.min(F.struct("k", "part")).alias("row")).collect()}
    full = sorted(first)
    if not full:
        return rows.selectExpr("0 as bucket", "false as ahead", "k", "doc_id", "text", "part as t")
    before = dict(zip(full, [full[-1], *full[:-1]], strict=True))
    at = lambda known: F.get(_longs([known.get(b, 0) for b in range(full[-1] + 1)]), F.col("bucket"))
    row = lambda bucket, ahead: F.struct(bucket.cast("int").alias("bucket"), F.lit(ahead).alias("ahead"))
    own = row(F.col("bucket"), False)
    is_first = (F.col("k") == at({b: r["k"] for b, r in first.items()})) & (F.col("part") == at({b: r["part"] for b, r in first.items()}))
    places = F.when(is_first, F.array(own, row(at(before), True))).otherwise(F.array(own))
    dealt = rows.withColumn("to", F.explode(places)).select("to.bucket", "to.ahead", "k", "doc_id", "text", hashed.alias("t"))
    return dealt.repartitionById(full[-1] + 1, "bucket").sortWithinPartitions("bucket", "ahead", "k", "t", "text")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs``, of its edited text and their likeness.

    The edited text has its last floor(n/4) code points replaced by the first as many
    (or all) of the next document's, by ascending doc_id; after the last comes the first
    (a single document follows itself). Rows with equal ids follow each other as
    ``with_next`` orders them. Null texts count as empty. An empty table gives
    no rows. Only doc_id and text are read.
    """

    schema = pa.schema([(n, pa.int64() if n in _NAMES[:2] else pa.float64() if n.startswith("near") else pa.string()) for n in _NAMES])

    def compared(some: list[tuple[int, str, str]]) -> pa.RecordBatch:
        out: list[tuple] = []
        known, of_known = None, None  # a row's next is mostly the row that follows
        for doc_id, text, following in some:
            own = of_known if known == text else Fingerprint.of(text)
            known, of_known = following, Fingerprint.of(following)
            changed = edited(text, following)
            other = own if changed == text else Fingerprint.of(changed)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), digest, own.hex(), other.hex(), own.likeness(other), own.likeness(of_known)))
        return pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in out], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is still to come
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, some = batch.slice(start, 512), []
                for bucket, ahead, doc_id, text in zip(*(part.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                    if held and held[0] == bucket:
                        some.append((held[1], held[2], text or ""))
                    held = None if ahead else (bucket, doc_id, text or "")
                if some:
                    yield compared(some)

    bound_batches(docs.sparkSession)
    return with_next(docs).mapInArrow(run, _RESULT)
