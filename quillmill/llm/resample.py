"""Importance resampling: documents are drawn as if from a target's distribution of hashed word features.

Words and the CRC-32 of every feature come from a byte automaton that runs over a whole Arrow
buffer of texts at once. A look-up table tells which bytes belong to words, differences of its
answers tell where words begin and end, and a table-driven CRC takes one step in all words
together. Words longer than ``PIECE`` bytes are cut into pieces that take their steps like words;
CRCs are linear, so pieces are joined by four tables that stand for ``PIECE`` zero bytes,
again in all long words together. The work is linear in bytes, however long a text or word is.

What the corpus and the target hold is counted by bucket: every task gives one row for each
bucket that it has met, so counts have a size that doesn't depend on the corpus. A document's
weight is the floored mean of its buckets' gains; Gumbel noise, drawn from its id, makes taking
the highest scores a draw without replacement in proportion to the weights. The draw is
made and numbered without a task that sees all rows: scores are integers within a bounded range, so
their histogram is small and gives the threshold; what lies at or above it is sorted by ranges,
and ranges are numbered from the counts of those before them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, remove, written

BUCKETS, GRAMS, SEED = 10_000, 1, 2024
#: Documents with fewer words aren't drawn; percentage of the others that is.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of a piece of a word, a power of two.
PIECE = 64
#: Bytes of text that a worker looks at together, but for a longer single text.
TOGETHER = 1 << 21

#: Lower-case ASCII letters of all bytes, and which bytes belong to words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _crc_table() -> np.ndarray:
    """The table of the reversed CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


TABLE = _crc_table()
FULL = np.uint32(0xFFFFFFFF)


def step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """Registers after one more byte each."""
    return TABLE[(crc ^ byte) & 255] ^ crc >> np.uint32(8)


def _zeros(tables: np.ndarray | None) -> np.ndarray:
    """Tables (by byte of the register) of twice as many zero bytes as ``tables``; of one zero byte for None."""
    at = np.arange(256, dtype=np.uint32)
    registers = np.stack([at << np.uint32(8 * k) for k in range(4)])
    return step(registers, 0) if tables is None else skip(tables, tables)


def skip(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that ``tables`` stand for."""
    return tables[0][crc & 255] ^ tables[1][crc >> np.uint32(8) & 255] ^ tables[2][crc >> np.uint32(16) & 255] ^ tables[3][crc >> np.uint32(24)]


#: Zero bytes by powers of two.
ZEROS = [_zeros(None)]
while len(ZEROS) < 31:
    ZEROS.append(_zeros(ZEROS[-1]))


def advance(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers, begun with zero, of stretches of ``data`` of at most ``PIECE`` bytes, all at once."""
    order = np.argsort(-length, kind="stable")
    at, crc = start[order], np.zeros(len(start), np.uint32)
    open_ = len(start) - np.searchsorted(length[order][::-1], np.arange(int(length.max(initial=0))), "right")
    for k, n in enumerate(open_.tolist()):  # the n longest stretches have a byte k
        crc[:n] = step(crc[:n], data[at[:n] + k])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def registers(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers, begun with zero, of stretches of any length."""
    pieces = np.maximum(-(-length // PIECE), 1)
    crc = advance(data, start, length - (pieces - 1) * PIECE)  # the first piece is the short one
    long = np.flatnonzero(pieces > 1)
    if len(long):
        more = pieces[long] - 1
        long, more = long[order := np.argsort(-more, kind="stable")], more[order]
        first = start[long] + length[long] - more * PIECE
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        own = advance(data, np.repeat(first, more) + nth * PIECE, np.full(len(nth), PIECE))
        begin = np.cumsum(more) - more
        open_ = len(more) - np.searchsorted(more[::-1], np.arange(int(more[0])), "right")
        for k, n in enumerate(open_.tolist()):
            crc[long[:n]] = skip(ZEROS[PIECE.bit_length() - 1], crc[long[:n]]) ^ own[begin[:n] + k]
    return crc


def extend(crc: np.ndarray, own: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``crc`` after the bytes of a stretch whose register, begun with zero, is ``own``."""
    crc = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        on = (length >> k & 1).astype(bool)
        crc[on] = skip(ZEROS[k], crc[on])
    return crc ^ own


def features(data: np.ndarray, offset: np.ndarray, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in ``data`` between offsets: CRC-32 and text number of every feature, and each text's number of words.

    Features are all runs of 1 to ``grams`` words, lower-cased in ASCII and joined by one space.
    """
    texts = len(offset) - 1
    data = LOWER[data[offset[0] : offset[-1]]]
    bounds = offset - offset[0]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = WORD[data]
    change = inside[1:] - inside[:-1]
    begins, ends = change[:-1] == 1, change[1:] == -1  # by byte: the first of a word, the last of one
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    both = edge[(inside[edge] & inside[edge + 1]).astype(bool)]  # a text ends and the next begins within a run of word bytes
    begins[both], ends[both - 1] = True, True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    of = np.searchsorted(bounds, start, "right") - 1
    length = end - start
    own = registers(data, start, length)
    crc = extend(np.full(len(start), FULL), own, length)
    found, texts_of = [crc ^ FULL], [of]
    for n in range(1, grams):
        crc = extend(step(crc[: max(len(start) - n, 0)], 32), own[n:], length[n:])
        whole = of[n:] == of[: max(len(start) - n, 0)]
        found.append((crc ^ FULL)[whole]), texts_of.append(of[: max(len(start) - n, 0)][whole])
    return np.concatenate(found), np.concatenate(texts_of), np.bincount(of, minlength=texts)


def _buffers(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and offsets of stretches of a column of strings; null texts have no bytes."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, values = column.buffers()
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    offset = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if column.null_count:  # a null's bytes, if it has any, would be read as a text
        column = column.fill_null("")
        yield from _buffers(column)
        return
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offset, offset[first] + TOGETHER, "right")) - 1)
        yield first, last, data, offset[first : last + 1]
        first = last


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, text: str = "text") -> DataFrame:
    """bucket and count (long) of the features of all texts; buckets without any have no row."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offset in _buffers(batch.column(0)):
                crc, _, _ = features(data, offset, grams)
                counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(counts[has])], names=["bucket", "count"])

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def _held(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for bucket, count in counts.collect():  # one row a bucket at most
        out[bucket] = count
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """A bucket's gain: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), counts of source s, S in all, and target t, T."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_words, n_features and weight (the floored mean gain, 0 without features) of every row of ``docs``."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    names = [*keep, "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for batch in batches:
            for first, last, data, offset in _buffers(batch.column(0)):
                crc, of, words = features(data, offset, grams)
                n = np.bincount(of, minlength=last - first)
                total = np.zeros(last - first, np.int64)
                np.add.at(total, of, gain[crc % np.uint32(len(gain))])
                rows = [*(c.slice(first, last - first) for c in batch.columns[1:]), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(rows, names=names)

    schema = docs.select(*keep).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return docs.select("text", *keep).mapInArrow(run, schema)


def noise(seed: int = SEED):
    """Gumbel noise in thousandths of the row's doc_id: floor(-1000 ln(-ln((h + 0.5) / 2^32))), h of a digest of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, list[str]]:
    """Written ``rows`` (doc_id, score, eligible, ...) with rank: 1, 2, ... for the drawn ones, else null; scratch paths.

    Of all eligible rows the ``percent`` with the highest scores are drawn; ties go to smaller
    ids (null ids last), then to smaller other columns.
    """
    levels = sorted(rows.where("eligible").groupBy("score").count().collect(), reverse=True)  # integers of a bounded range
    left = draw = sum(n for _, n in levels) * percent // 100
    least = None
    for score, n in levels:
        if left <= 0:
            break
        least, left = score, left - n
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long")), []
    among = F.col("eligible") & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), *(F.col(c) for c in rows.columns if c not in ("score", "doc_id", "eligible"))]
    salt = F.monotonically_increasing_id()  # equal rows can be dealt to several ranges
    top = rows.where(among).withColumn("_salt", salt).repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    placed, path = written(top.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts = dict(placed.groupBy(part).count().collect())  # one row for each range
    begins = itertools.accumulate((counts.get(k, 0) for k in range(max(counts, default=0))), initial=1)
    rank = F.get(F.expr(f"array({', '.join(f'{b}L' for b in begins)})"), part) + F.col("_at").bitwiseAND((1 << 33) - 1)
    drawn = placed.withColumn("rank", F.when(rank <= draw, rank).cast("long")).drop("_at")
    return rows.where(~among | among.isNull()).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn), [path]


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn), all long, of every row of ``docs``.

    The more a document's features are those of ``target`` rather than of all ``docs``, the higher its
    weight. Null and empty texts have no features, weight 0, and aren't drawn as they have
    no words; their scores are noise alone. A null doc_id's noise is that of the empty text. Repeated rows
    are drawn each by itself, next to each other. Without documents there are no rows; an empty
    target is a uniform one. Only doc_id and text are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    gain = gains(_held(bucket_counts(docs, buckets, grams), buckets), _held(bucket_counts(target, buckets, grams), buckets))
    rows = weighed(docs, gain, grams).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", (F.col("weight") + noise(seed)).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("eligible")
    )
    scored, _ = written(rows)
    out, _ = ranked(scored, percent)
    return out.drop("eligible")
