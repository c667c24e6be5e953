"""Which texts of one table lie within which texts of another, without comparing each with each.

Stretches of g characters have rolling hashes; of any g / 2 neighbouring stretches the one with the least hash (the first
such) is marked. A value belongs to the class of the largest g for which it has such a window. Its windows are windows of every
text that it lies in, so it shares all of its marks with them. Each value is looked for under that of its marks which the fewest
places have, as a sample of the texts tells (what is found doesn't depend on it). Where a text has one of these marks, the
value could begin a few places before it: places at which the value's first characters, as many as all values of the class
have, don't stand are passed over. Both questions are answered in the task that has the text, by bitmaps of a bounded size; what is left
is joined by equality of the first characters' hash, and verified in the stretch of text that comes with it.

Pairs grow with the product of both tables, as short values lie in most texts. ``counted`` makes none: where a value's first characters stand, the
task looks for whole values, by a third bitmap; it tells each stretch that may be one once a text, and they are counted before anything is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import bound_batches, written

#: Bits of a bitmap; characters that are looked at together; rows of a batch.
BITS, CHUNK, ROWS = 1 << 27, 1 << 20, 1 << 16
#: About so many texts tell which marks are rare.
SAMPLE = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xFFFFFFFF)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: Lengths of stretches: powers of two and three halves of them.
SIZES = sorted({1, *(m << k for k in range(26) for m in (2, 3))})


def _window(size: int) -> int:
    return max(1, size // 2)


def size_of(length: int) -> int:
    """The class of a value of this length."""
    return next(b for b in reversed(SIZES) if b + _window(b) - 1 <= length)


def longest(size: int) -> int:
    """The length of the longest value of a class."""
    more = SIZES[SIZES.index(size) + 1]
    return more + _window(more) - 2


def least_length(size: int) -> int:
    """The length that all values of a class have at least."""
    return size + _window(size) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _ODD
    return h ^ h >> np.uint64(29)


class Texts:
    """Some texts one after the other, as hashes of stretches see them; a long text comes in pieces that overlap.

    ``row`` and ``start`` tell of each piece which text it is of, and where in it and in the whole it begins.
    """

    def __init__(self, pieces: list[tuple[int, int, str]]):
        self.text = "".join(p for _, _, p in pieces)
        length = np.array([len(p) for _, _, p in pieces])
        self.row, self.at = np.array([r for r, _, _ in pieces]), np.array([b for _, b, _ in pieces])
        self.end = np.cumsum(length)
        self.begin = self.end - length
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(codes)
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _ODD))))
        self.back = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BACK))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(codes + np.uint64(1)) * powers[:n], dtype=np.uint64)))
        self.room = np.repeat(self.end, length) - np.arange(n)  # characters up to the piece's end

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the stretches of a length that begin at these places."""
        return _mixed((self.sums[at + length] - self.sums[at]) * self.back[at])

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, "right")

    def marks(self, size: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the marks of all windows within one piece (of the pieces ``among``)."""
        window, n = _window(size), len(self.room) - size + 1
        starts = n - window + 1
        if starts < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = _mixed((self.sums[size:] - self.sums[:n]) * self.back[:n])
        own = self.room[:starts] >= least_length(size)
        if among is not None:
            own &= np.repeat(among, self.end - self.begin)[:starts]
        if window == 1:
            at = np.flatnonzero(own)
            return at, h[at]
        least, span = h & ~_PLACE | np.arange(n, dtype=np.uint64), 1  # a half of the hash decides, then the place
        while span * 2 <= window:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[:starts], least[window - span : window - span + starts])
        least = least[:starts][own]  # in order, as a window's mark never lies before that of an earlier one
        least = least[np.append(True, least[1:] != least[:-1])] if len(least) else least
        at = (least & _PLACE).astype(np.int64)
        return at, h[at]


def together(texts: list[str], most: int) -> Iterator[Texts]:
    """``texts`` in parts of about ``CHUNK`` characters; pieces of long ones overlap by ``most``."""
    some, size = [], 0
    for row, text in enumerate(texts):
        for begin in range(0, max(len(text) - most, 1), CHUNK):
            piece = text[begin : begin + CHUNK + most]
            some.append((row, begin, piece))
            size += len(piece)
            if size >= CHUNK:
                yield Texts(some)
                some, size = [], 0
    if size:
        yield Texts(some)


def _has(bitmap, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    last, out = np.uint64(64 * len(bitmap.value) - 1), np.zeros(len(h), bool)
    bit = h & last
    some = np.flatnonzero(bitmap.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
    bit = h[some] >> np.uint64(32) & last
    out[some] = (bitmap.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _bitmap(keys: DataFrame, column: str):
    """Two bits of every hash, as a broadcast array of ``BITS`` bits whatever their number."""
    bits = keys.select(F.explode(F.array(F.col(column).bitwiseAND(BITS - 1), F.shiftrightunsigned(column, 32).bitwiseAND(BITS - 1))).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def _keys(own: DataFrame) -> DataFrame:
    """Every mark of every value (value): size, h, its place o, and the hashes of the value's first characters (head) and of all (whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            size_of_row = np.array([size_of(len(t)) for t in texts])
            for part in together(texts, max(map(len, texts), default=0)):  # values aren't cut
                sizes = size_of_row[part.row]
                for size in np.unique(sizes).tolist():
                    at, h = part.marks(size, sizes == size)
                    piece = part.piece(at)
                    head = part.hashes(part.begin[piece], least_length(size))
                    whole = part.hashes(part.begin[piece], part.end[piece] - part.begin[piece])
                    columns = [batch.column(0).take(pa.array(part.row[piece])), pa.array(np.full(len(at), size, np.int32)), pa.array(h.view(np.int64)), pa.array(at - part.begin[piece]), pa.array(head.view(np.int64)), pa.array(whole.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["value", "size", "h", "o", "head", "whole"])

    return own.mapInArrow(run, "value string, size int, h long, o long, head long, whole long")


def _counts(texts: DataFrame, sizes: list[int], marks) -> DataFrame:
    """How often the marks that values have occur in ``texts`` (text): size, h, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in together(batch.column(0).to_pylist(), longest(sizes[-1])):
                for size in sizes:
                    _, h = part.marks(size)
                    h, places = np.unique(h[_has(marks, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(places)], names=["size", "h", "places"])

    return texts.mapInArrow(run, "size int, h long, places long").groupBy("size", "h").agg(F.sum("places").alias("places"))


def _places(part: Texts, size: int, offsets: list[int], marks, heads) -> np.ndarray:
    """Where first characters of values of a class stand, before a mark of theirs."""
    at, h = part.marks(size)
    at = at[_has(marks, h)]
    piece, need = part.piece(at), least_length(size)
    places = []
    for o in offsets:
        begin = at - o
        begin = begin[(begin >= part.begin[piece]) & (begin + need <= part.end[piece])]
        places.append(begin[_has(heads, part.hashes(begin, need))])
    return np.unique(np.concatenate(places))


def _begun(held: DataFrame, offsets: dict[int, list[int]], marks, heads) -> DataFrame:
    """Where values may begin in texts (text, source_id): source_id, size, head, and as much text as a value may have (piece)."""
    schema = StructType().add("source_id", held.schema["source_id"].dataType).add("size", "integer").add("head", "long").add("piece", "string")
    sizes = sorted(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in together(batch.column(0).to_pylist(), longest(sizes[-1])):
                for size in sizes:
                    begin = _places(part, size, offsets[size], marks, heads)
                    piece = part.piece(begin)
                    row, head, end = part.row[piece], part.hashes(begin, least_length(size)).view(np.int64), np.minimum(begin + longest(size), part.end[piece])
                    for k in range(0, len(begin), ROWS):
                        some = slice(k, k + ROWS)
                        texts = [part.text[a:z] for a, z in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
                        once = np.array(list(dict(zip(zip(row[some].tolist(), texts, strict=True), range(len(texts)), strict=True)).values()))  # what a text repeats is told once
                        columns = [batch.column(1).take(pa.array(row[some][once])), pa.array(np.full(len(once), size, np.int32)), pa.array(head[some][once]), pa.array([texts[i] for i in once.tolist()], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return held.mapInArrow(run, schema)


def _told(held: DataFrame, offsets: dict[int, list[int]], lengths: dict[int, list[int]], marks, heads, wholes) -> DataFrame:
    """Stretches of texts (text, source_id) that are values, but for hashes that are equal by chance: source_id, value, each once a row."""
    schema = StructType().add("source_id", held.schema["source_id"].dataType).add("value", "string")
    sizes = sorted(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last: set[tuple[int, str]] = set()  # what the text that ended the part before has told, as it may go on
            for part in together(batch.column(0).to_pylist(), longest(sizes[-1])):
                told: dict[tuple[int, str], None] = {}
                for size in sizes:
                    begin = _places(part, size, offsets[size], marks, heads)
                    piece = part.piece(begin)
                    for n in lengths[size]:
                        some = np.flatnonzero(begin + n <= part.end[piece])
                        some = some[_has(wholes, part.hashes(begin[some], n))]
                        told.update(dict.fromkeys(zip(part.row[piece[some]].tolist(), (part.text[a : a + n] for a in begin[some].tolist()), strict=True)))
                new = [x for x in told if x not in last] if last else list(told)
                end = int(part.row[-1])
                last = {x for x in (*last, *new) if x[0] == end}
                for k in range(0, len(new), ROWS):
                    rows, texts = zip(*new[k : k + ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), pa.array(texts, pa.string())], names=schema.names)

    return held.mapInArrow(run, schema)


def _chosen(values: DataFrame, held: DataFrame) -> tuple[DataFrame, dict[int, list[int]]]:
    """Each value with its class, the mark under which it is looked for and its hashes; places of these marks by class."""
    bound_batches(values.sparkSession)
    keys = written(_keys(values.where("value <> ''").select("value").distinct()))
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())  # a few lengths
    if not sizes:
        return keys, {}
    some = held.where(F.pmod(F.xxhash64("text"), F.lit(max(1, held.count() // SAMPLE))) == 0).select("text")
    counts = _counts(some, sizes, _bitmap(keys, "h"))
    rarest = keys.join(counts, ["size", "h"], "left").groupBy("value").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "size", "h", "o", "head", "whole")).alias("m"))
    chosen = written(rarest.select("value", "m.size", "m.h", "m.o", "m.head", "m.whole"))
    return chosen, _by_size(chosen, F.col("o"))


def _by_size(chosen: DataFrame, number: Column) -> dict[int, list[int]]:
    """The numbers that values of a class have: at most as many as the longest values have characters."""
    found: dict[int, list[int]] = {}
    for size, n in chosen.select("size", number).distinct().collect():
        found.setdefault(size, []).append(n)
    return found


def contained(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(value, source_id), each pair once: a text of ``values`` (value) lies within a text of ``sources`` (source_id, text).

    Texts are compared as they are. Null and empty values lie nowhere, null texts hold nothing. A repeated source_id holds
    what any of its texts holds. Empty tables give an empty result; other columns aren't read.
    """
    held = sources.where("text is not null").select("text", "source_id")
    chosen, offsets = _chosen(values, held)
    if not offsets:
        return values.sparkSession.createDataFrame([], StructType().add("value", "string").add("source_id", held.schema["source_id"].dataType))
    begun = _begun(held, offsets, _bitmap(chosen, "h"), _bitmap(chosen, "head"))
    met = chosen.select("value", "size", "head").join(begun, ["size", "head"])
    return met.where(F.startswith("piece", "value")).select("value", "source_id").distinct()


def counted(values: DataFrame, sources: DataFrame) -> DataFrame:
    """value, records, first: the number of pairs that ``contained`` has of a value, and their least source_id, without the pairs.

    Values that lie nowhere have no row. Only ids that repeat go by pairs: one may hold a value in several of its texts.
    """
    held = sources.where("text is not null").select("text", "source_id")
    again = written(held.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("source_id").alias("again")))
    repeated, some = F.col("source_id").eqNullSafe(F.col("again")), not again.isEmpty()
    single = held.join(again, repeated, "left_anti") if some else held
    chosen, offsets = _chosen(values, single)
    if offsets:
        lengths = _by_size(chosen, F.length("value"))
        told = _told(single, offsets, lengths, _bitmap(chosen, "h"), _bitmap(chosen, "head"), _bitmap(chosen, "whole"))
    else:
        told = values.sparkSession.createDataFrame([], StructType().add("source_id", held.schema["source_id"].dataType).add("value", "string"))
    sums = told.groupBy("value").agg(F.count(F.lit(1)).alias("records"), F.min("source_id").alias("first")).join(chosen.select("value"), "value", "left_semi")
    if not some:
        return sums
    pairs = contained(values, held.join(again, repeated, "left_semi")).groupBy("value").agg(F.count(F.lit(1)).alias("records"), F.min("source_id").alias("first"))
    return sums.unionByName(pairs).groupBy("value").agg(F.sum("records").alias("records"), F.min("first").alias("first"))
