"""Byte-level BPE: encoding by a rank queue under a hierarchical bitmap, and decoding.

A batch of distinct pre-tokens is one linked list of bytes with a border after each
pre-token. Every merge rank has a bucket of the positions whose pair would merge at
that rank, and a bitmap of three levels of 64-bit words says which buckets hold
anything; find-first-set gives the lowest. A position that has changed since it was
put into a bucket is stale and skipped. Merging a bucket changes only neighbours, so
the work is linear in bytes (times a bitmap look-up), however long a pre-token is.

Pre-tokens don't affect each other, so a bucket's positions merge together. Within a
pre-token that is right as long as no pair with the merged token has a lower rank;
ranks for which the vocabulary has such a pair (``Vocabulary.inverts``) merge the
leftmost position of each pre-token only, and the rest go back into the bucket.
A pre-token of more than ``LONG`` bytes is merged by itself, a position at a time: its
buckets are sorted positions with a cursor, and a heap for those that come later.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .common import bound_batches, make_room

NONE = 1 << 30
#: Pre-tokens that a worker remembers at most; then it starts anew.
REMEMBERED = 400_000
#: Bytes from which on a pre-token is merged by itself.
LONG = 1024
#: Characters of the texts that are encoded together, but for a longer single text.
TOGETHER = 1_500_000


class RankQueue:
    """Buckets of positions by rank; ``first`` is the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.bucket: dict[int, list[np.ndarray]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: np.ndarray) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            held.append(at)
            return
        self.bucket[rank] = [at]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def first(self) -> int:
        """The lowest rank with a bucket, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) + (self.mid[b] & -self.mid[b]).bit_length() - 1
        return (a << 6) + (self.low[a] & -self.low[a]).bit_length() - 1

    def drop(self, rank: int) -> list:
        """What the bucket holds; the bucket is gone."""
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return self.bucket.pop(rank)

    def take(self, rank: int) -> np.ndarray:
        """The bucket's positions, sorted, each once; the bucket is gone."""
        held = self.drop(rank)
        return np.unique(np.concatenate(held)) if len(held) > 1 else held[0]


class Ordered(RankQueue):
    """Buckets that give their leftmost position: sorted ones that were there first, with a cursor, and a heap."""

    def begin(self, rank: int, at: np.ndarray) -> None:
        self.push(rank, at)
        self.bucket[rank] += [0, []]

    def add(self, rank: int, at: int) -> None:
        held = self.bucket.get(rank)
        if held is None:
            self.begin(rank, _NOTHING)
            held = self.bucket[rank]
        heapq.heappush(held[2], at)

    def leftmost(self, rank: int) -> int:
        """The bucket's leftmost position, which is taken out."""
        held = self.bucket[rank]
        sorted_, cursor, heap = held
        if cursor < len(sorted_) and (not heap or sorted_[cursor] <= heap[0]):
            at = int(sorted_[cursor])
            held[1] = cursor + 1
        else:
            at = heapq.heappop(heap)
        if not heap and held[1] == len(sorted_):
            self.drop(rank)
        return at


_NOTHING = np.empty(0, np.int32)


class Vocabulary:
    """Ranks of byte strings, as tiktoken files list them (base64, blank, rank); ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.joins = pairs
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        self.inverts = np.zeros(self.size, bool)
        for side in (self.pair >> 32, self.pair & 0xFFFFFFFF):
            self.inverts[side[self.merged < side]] = True

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank at which each pair merges; NONE if it doesn't."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], NONE) if len(self.pair) else np.full(len(key), NONE)

    def decode(self, ids: np.ndarray, offset: np.ndarray) -> list[bytes]:
        """The bytes of each stretch of ids between two offsets."""
        token, bounds = self.tokens, offset.tolist()
        return [b"".join([token[i] for i in ids[a:b].tolist()]) for a, b in itertools.pairwise(bounds)]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each piece's ids end. A piece that is a token is that one id, merges or not."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        ids, end = self._merged([p for p, w in zip(pieces, whole.tolist(), strict=True) if w < 0])
        counts = np.ones(len(pieces), np.int64)
        counts[whole < 0] = np.diff(end, prepend=0)
        ends = np.cumsum(counts)
        out = np.empty(counts.sum(), np.int64)
        merged = np.repeat(whole < 0, counts)
        out[merged], out[~merged] = ids, whole[whole >= 0]
        return out, ends

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces by merges alone, and where each piece's ids end."""
        if not any(len(p) > LONG for p in pieces):
            return self._together(pieces)
        ids, ends = self._together([p for p in pieces if len(p) <= LONG])
        short = iter(np.split(ids, ends[:-1])) if len(ends) else iter(())
        found = [self._alone(p) if len(p) > LONG else next(short) for p in pieces]
        return np.concatenate(found), np.cumsum([len(f) for f in found])

    def _alone(self, piece: bytes) -> np.ndarray:
        """Ids of one piece by merges, the leftmost of the lowest rank each time."""
        n, joins = len(piece), self.joins
        start = self.byte[np.frombuffer(piece, np.uint8)]
        found = self.rank(start[:-1], start[1:])
        token, rank = array("i", start.astype(np.int32).tobytes()), array("i", np.append(found, NONE).astype(np.int32).tobytes())
        after, before = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        queue, order = Ordered(self.size), np.argsort(found, kind="stable").astype(np.int32)
        order = order[: np.count_nonzero(found < NONE)]
        cut = np.flatnonzero(np.diff(found[order])) + 1
        for some in np.split(order, cut) if len(order) else ():
            queue.begin(int(found[some[0]]), some)
        del found, start
        while (r := queue.first()) >= 0:
            at = queue.leftmost(r)
            if rank[at] != r:
                continue
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone], rank[gone] = r, -1, NONE
            after[at] = beyond
            if beyond < n:
                before[beyond] = at
                new = rank[at] = joins.get(r << 32 | token[beyond], NONE)
                if new < NONE:
                    queue.add(new, at)
            else:
                rank[at] = NONE
            left = before[at]
            if left >= 0:
                new = rank[left] = joins.get(token[left] << 32 | r, NONE)
                if new < NONE:
                    queue.add(new, left)
        ids = np.frombuffer(token, np.int32)
        return ids[ids >= 0].astype(np.int64)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, merged all at once, and where each piece's ids end."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, ends = len(data), np.cumsum(length)
        if not n:
            return np.empty(0, np.int64), np.zeros(len(pieces), np.int64)
        kind = np.int32 if 1 << 24 < n < 1 << 30 else np.int64  # five numbers for each byte; narrow ones are slower, but a very long pre-token needs memory
        piece = np.repeat(np.arange(len(pieces), dtype=kind), length)
        token = np.append(self.byte[data], -1).astype(kind)
        after, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
        after[ends[length > 0] - 1] = n
        before[(ends - length)[length > 0]] = n
        rank = np.full(n + 1, NONE, kind)
        queue = RankQueue(self.size)

        def look(at: np.ndarray) -> None:
            """Rank of the pair at each position, and into the buckets."""
            right = after[at]
            found = self.rank(token[at], token[right])
            found[right == n] = NONE
            rank[at] = found
            live = found < NONE
            at, found = at[live], found[live]
            if len(at) == 1:
                queue.push(int(found[0]), at)
            elif len(at):
                order = np.argsort(found, kind="stable")
                at, found = at[order], found[order]
                cut = np.flatnonzero(found[1:] != found[:-1]) + 1
                start = [0, *cut.tolist()]
                for r, s, e in zip(found[start].tolist(), start, [*start[1:], len(at)], strict=True):
                    queue.push(r, at[s:e])

        look(np.arange(n, dtype=kind))
        while (r := queue.first()) >= 0:
            at = queue.take(r)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                if self.inverts[r]:
                    of = piece[at]
                    lead = np.append(True, of[1:] != of[:-1])
                    if not lead.all():
                        queue.push(r, at[~lead])
                        at = at[lead]
                else:
                    touches = after[at[:-1]] == at[1:]
                    if touches.any():  # of overlapping pairs in a row every other one merges, from the left
                        k = np.arange(len(at))
                        run = np.maximum.accumulate(np.where(np.append(True, ~touches), k, 0))
                        at = at[(k - run) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone] = r, -1
            after[at], before[beyond] = beyond, at
            rank[gone] = NONE
            left = before[at]
            left = left[left != n]
            look(np.unique(np.concatenate((left, at))) if len(left) else at)
        live = token[:n] >= 0
        counts = np.bincount(piece[live], minlength=len(pieces))
        return token[:n][live], np.cumsum(counts)


@functools.lru_cache(2)
def _vocabulary(digest: str, shipped) -> Vocabulary:
    return Vocabulary.parse(shipped.value if hasattr(shipped, "value") else shipped)


class Encoder:
    """Texts to ids; remembers the pre-tokens that it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # pre-token to its place in ``end``
        self.ids, self.end = np.empty(0, np.int32), np.empty(0, np.int64)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end; null counts as empty."""
        pieces = [self.split(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        new = list({p for own in pieces for p in own if p not in known})
        ids, end = self.vocabulary.encode([p.encode("utf-8", "surrogatepass") for p in new])
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.end = np.concatenate((self.end, end + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, counts.sum())
        start = np.concatenate(([0], self.end))[place]
        length = self.end[place] - start
        to = np.concatenate(([0], np.cumsum(length)))
        found = self.ids[np.repeat(start - to[:-1], length) + np.arange(to[-1])]
        return found, to[np.concatenate(([0], np.cumsum(counts)))]


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` as array<int> in ``out`` and without ``text``.

    With ``back``, that column gets the bytes that the ids decode to, as ``decode`` gives
    them, without another pass through Python workers.

    ``vocabulary`` is a file of ranks that the driver can read; it is broadcast (a
    vocabulary's size doesn't depend on the corpus). Each match of ``pattern`` is
    encoded by itself; there are no special tokens. Null and empty texts give an empty
    array. All other columns pass unchanged; one named as ``out`` or ``back`` gets a number
    after its name (the first that is free).
    """
    docs = make_room(docs, {out, back} - {text})
    bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        data = f.read()
    shipped, digest = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    rest = [c for c in docs.columns if c not in (text, out, back)]
    schema = docs.select(*rest).schema.add(out, ArrayType(IntegerType()))
    if back:
        schema = schema.add(back, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(digest, shipped), pattern)
        for batch in batches:
            at = 0
            for some in _together(batch.column(0).to_pylist()):
                ids, offset = encoder.texts(some)
                columns = [*batch.slice(at, len(some)).columns[1:], pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(ids))]
                if back:
                    columns.append(pa.array(encoder.vocabulary.decode(ids, offset), pa.binary()))
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(text, *rest).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``tokens`` with the bytes that ``ids`` stand for in ``out`` and without ``ids``.

    A column that is named as ``out`` gets a number after its name. Null arrays give empty bytes; a null id, or one outside the
    vocabulary, is an error, as no bytes could be right.
    """
    tokens = make_room(tokens, {out} - {ids})
    bound_batches(tokens.sparkSession)
    with open(vocabulary, "rb") as f:
        data = f.read()
    shipped, digest = tokens.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    rest = [c for c in tokens.columns if c not in (ids, out)]
    schema = tokens.select(*rest).schema.add(out, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(digest, shipped)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = part.column(0).flatten()
                offset = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part.column(0)), 0).to_numpy())))
                found = known.decode(flat.to_numpy(zero_copy_only=not flat.null_count), offset)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.binary())], names=[*rest, out])

    return tokens.select(ids, *rest).mapInArrow(run, schema)


def token_report(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Number and digest of the ids of every text of ``docs``, and the digest of the bytes they decode to.

    Null and empty texts have no ids (and the digests of nothing); repeated rows have
    equal results; an empty table gives no rows. Only doc_id and text are read.
    """
    return encode(docs.select("doc_id", "text"), vocabulary, pattern, back="bytes").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
