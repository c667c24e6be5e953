"""Near copies: groups of documents that share at least 0.8 of their word shingles.

The method is that of ``simhash``, for a wider bound: a SimHash of 255 bits is cut into segments
of 16, and every set is indexed under each segment with one of its bits taken out. Rows are brought
together by equal signature and the whole sketches are verified. Sets that differ in at most 31 bits
agree in some segment but for one bit, so none of them is lost; of those at 39, which is what likeness
(Jaccard) 0.8 gives on average, more than 0.99 meet.

Pairs that differ more and still are alike are met in an exact way. Sets of likeness 0.8 share at
least 0.8 of the larger one. So in any order of all shingles, the same for every set, the first ones
of each set, a fifth and one, have one in common (prefix filter). They are keys of the same index and
verified as the signatures are. The order puts shingles that a sample finds common last, so that few sets meet.

What meets and differs in at most ``DISTANCE`` bits is a candidate. The bound
is far above those 39 bits, and far below the 128 of sets
that have nothing to do with each other, so chance doesn't chain them. Components of candidates are
blocks; within a block the sets themselves are compared, and only likeness 0.8 links.
No pairs are listed: candidates and links are kept as stars, from each component's first.

A few of the signatures make a first round; in the second, sets that it connected count as one, so
that a crowd of copies, which meets under dozens of keys, is connected once. A key with more than
``HOT`` sets is covered with balls as its sets stream by: a set that is near to a ball's centre is linked to it and done. Two
balls whose centres lie too far apart for their radii have no candidates between them (sketches' distance is a metric), the
others are compared; so a crowd of copies and some strangers cost a few comparisons a set. Only of keys for which that
doesn't settle all (``WORK``) are the sets brought together once more, dealt into parts like blocks with more than ``HOT`` sets.

Each part's sets are compared with each other and with some pivots, which are the same for all parts: so a
group becomes one component at a cost linear in its sets. Those that are not in the group's largest
component then are compared with all of the group, so no pair of two components goes unseen. Joins
on such a group's key or component rely on AQE, which splits the partitions of skewed keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_columns, remove, with_columns, written
from .simhash import components, connected, star

SEED, SHINGLE = 42, 5
#: Bits of a sketch; the first one isn't SimHash but tells a set of fewer than ``TINY`` shingles.
BITS, TINY = 256, 16
#: Differing bits up to which sets are candidates: likeness 0.8 gives 38.9 on average, with a deviation of 5.7;
#: and where one is tiny (sets of four and five shingles: 48 and 6.2).
DISTANCE, LOOSE = 70, 100
#: The same where one is tiny and a signature is all that they share: few votes give sketches that are near by chance.
SURE = 31
#: Bits of a segment: the first of these that holds the sets which meet by chance to ``CROWD`` a signature. Wider segments find
#: less by themselves (README: 0.999, 0.934 and 0.477 of measured pairs), and the prefix filter the same.
SEGMENTS, CROWD = (16, 21, 32), 512
#: Up to so many sets of a key or block, and shingles of a block, are compared with each other by one task.
HOT, TOKENS = 1024, 1 << 20
#: Signatures of the first round.
EARLY = 8
#: Of a larger key so many sets are held, and comparisons made (for each set of it, as many as ``EACH`` in any case).
HELD, WORK, EACH = 1 << 18, 1 << 26, 64
#: Up to so many keys, and texts' hashes, are broadcast.
MARKS, MEMBERS = 1 << 17, 1 << 18
#: Pairs of groups of up to so many sets are looked at all at once.
FEW = 32
#: A task thins its edges to a forest whenever it holds so many.
SPAN = 1 << 18
#: One text of ``SAMPLE`` tells which ``COMMON`` shingles come last; results don't depend on it.
SAMPLE, COMMON = 16, 1 << 18
CHUNK = 1 << 15
MINUS = "shiftleft(1L, 63)"

WORDS = [f"f{k}" for k in range(BITS // 64)]
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order.

    A-Z is lower-cased; words are runs without ASCII white space. A text with fewer words
    is one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def sketch(h: np.ndarray) -> list[int]:
    """Four words of SimHash and whether the set is tiny, as signed 64-bit integers."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), CHUNK):
        some = h[at : at + CHUNK, None] * _ODD
        ones += np.unpackbits((some ^ (some >> np.uint64(32))).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(h)
    bits[0] = len(h) < TINY
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def prefix(h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a set of which it shares one with each set of likeness 0.8; ``common`` ones come last, by ``rank``."""
    if not len(h):
        return h
    last = np.full(len(h), -1)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        last = np.where(common[at] == h, rank[at], -1)
    return h[np.lexsort((h, last))[: len(h) + 1 + -4 * len(h) // 5]]


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``COMMON`` shingles that a sample of ``texts`` (text, t) has most often, in order, and their ranks from the least common on.

    Counts are combined before they are shuffled. How often is often enough is told by a
    histogram over eighths of powers of two, so no task sorts all shingles.
    """
    heads = map_columns(texts.where(F.pmod("t", F.lit(SAMPLE)) == 0).select("text"), lambda x: ([shingles(t, shingle).view(np.int64) for t in x],), "h array<long>")
    counted, path = written(heads.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 3").withColumn("level", F.floor(F.log2("count") * 8).cast("int")))
    least, total = 1 << 30, 0
    for level, rows in sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        total += rows
        if total > COMMON:
            break
        least = level
    found = counted.where(F.col("level") >= least).select("h", "count").toArrow()
    remove(texts.sparkSession, path)
    common, many = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    rank = np.empty(len(common), np.int64)
    rank[np.lexsort((common, many))] = np.arange(len(common))
    order = np.argsort(common)
    return common[order], rank[order]


def sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, t (hash of the text), d (of the set of shingles), n (their number), sketch (f0 to f3) and prefix (p) of every row."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    shipped = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, shingle))  # ``COMMON`` pairs of numbers at most

    def rows(ids, texts, ts):
        out = []
        for t in texts:
            h = shingles(t, shingle)
            d = xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0
            out.append((d - (d >> 63 << 64), len(h), *sketch(h), prefix(h, *shipped.value).view(np.int64)))
        return ids, ts, *(list(c) for c in zip(*out, strict=True))

    return map_columns(texts, rows, f"doc_id long, t long, d long, n long, {', '.join(f'{f} long' for f in WORDS)}, p array<long>")


def segment_bits(count: int) -> int:
    """Bits of a segment for ``count`` sets."""
    return next((wide for wide in SEGMENTS if count <= CROWD << (wide - 1)), SEGMENTS[-1])


def indexed(distinct: DataFrame, wide: int, early: bool | None = None) -> DataFrame:
    """key and the columns of each set (d, n, words, p, ...) but n and p, under its signatures and the shingles of its prefix; empty sets have none.

    With ``early``, only under the signatures of the first round, or else only under all other keys.

    Signature v is segment v // wide without its bit v % wide. Equal segments agree in all of
    theirs, so none is indexed as it is. Bit 0 of a sketch belongs to no signature. Keys of
    shingles are negative, those of signatures aren't.
    """
    per = 64 // wide
    many = len(WORDS) * per * wide
    step = many // EARLY
    some = [v for v in range(1, many) if early is None or early == (v % step == 1)]
    signatures = F.array(*(F.lit(v).cast("long") for v in some))
    keys = F.when(F.col("n") > 0, signatures if early else F.concat(signatures, "p"))
    word = f"element_at(array(f0 & -2L, {', '.join(WORDS[1:])}), cast(v div {wide * per} as int) + 1)"
    segment = f"shiftrightunsigned({word}, cast({wide} * (v div {wide} % {per}) as int)) & {(1 << wide) - 1}L"
    signature = f"shiftleft(v, 32) | ({segment} & ~shiftleft(1L, cast(v % {wide} as int)))"
    own = [c for c in distinct.columns if c not in ("n", "p", "t")]
    rows = distinct.select(*own, F.posexplode(keys).alias("at", "v"))
    return rows.selectExpr(f"case when at < {len(some)} then {signature} else v | {MINUS} end as key", *own)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches (rows of id and words), by broadcasting."""
    apart = a[..., 1:] ^ b[..., 1:]
    apart[..., 0] &= ~np.uint64(1)
    return np.bitwise_count(apart).sum(axis=-1, dtype=np.int32)


def near(a: np.ndarray, b: np.ndarray, signed) -> np.ndarray:
    """Whether sketches (rows of id and words) are candidates, by broadcasting; ``signed``: they met by a signature."""
    tiny = ((a[..., 1] | b[..., 1]) & np.uint64(1)).astype(bool)
    return distance(a, b) <= np.where(tiny, np.where(signed, SURE, LOOSE), DISTANCE)


def forest(n: int, links_to: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (leaf, first) from each component's first node; links_to(u, others) tells which others u links to."""
    todo, leaf, root = np.arange(n), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(todo):
        first, todo = int(todo[0]), todo[1:]
        open_ = [first]
        while open_ and len(todo):
            u = open_.pop()
            hit = links_to(u, todo)
            new, todo = todo[hit], todo[~hit]
            leaf.append(new), root.append(np.full(len(new), first))
            open_ += new.tolist()
    return np.concatenate(leaf), np.concatenate(root)


def pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all pairs within groups of consecutive rows."""
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    more = np.repeat(start + size, size) - at - 1  # rows of the group that follow
    i = np.repeat(at, more)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)


class Crowd:
    """The sets of a large key, covered with balls as they stream by.

    A set near to a ball's centre belongs to that ball (the first such) and is linked to the centre; one that is near to none
    is the centre of another ball. Members are held up to ``HELD`` sets, centres always.
    """

    def __init__(self, signed: bool):
        self.signed, self.count, self.work, self.over = signed, 0, 0, False
        self.bound = DISTANCE
        self.centers: list[np.ndarray] = []
        self.radius: list[int] = []
        self.members: list[list[np.ndarray]] | None = []
        self.leaf, self.root = [], []

    def _spent(self, comparisons: int) -> bool:
        self.work += comparisons
        return self.work > WORK + EACH * self.count

    def _into(self, ball: int, rows: np.ndarray) -> np.ndarray:
        """Puts what is near to a ball's centre into the ball; the other rows."""
        center = self.centers[ball]
        hit = near(center, rows, self.signed)
        self.over |= self._spent(len(rows))
        if not hit.any():
            return rows
        own = rows[hit]
        self.radius[ball] = max(self.radius[ball], int(distance(center, own).max()))
        if self.members is not None:
            self.members[ball].append(own)
        self.leaf.append(own[:, 0]), self.root.append(np.full(len(own), center[0]))
        return rows[~hit]

    def add(self, rows: np.ndarray) -> None:
        self.count += len(rows)
        if self.count > HELD:
            self.members = None
        if not self.signed and (rows[:, 1] & np.uint64(1)).any():
            self.bound = LOOSE
        for ball in range(len(self.centers)):
            if self.over or not len(rows):
                return
            rows = self._into(ball, rows)
        while len(rows) and not self.over:
            self.centers.append(rows[0].copy()), self.radius.append(0)
            if self.members is not None:
                self.members.append([])
            rows = self._into(len(self.centers) - 1, rows)

    def settled(self) -> bool:
        """Links balls with candidates between them; whether all such are linked."""
        if self.over:
            return False
        centers, radius, of = np.array(self.centers), np.array(self.radius), list(range(len(self.centers)))

        def first(ball: int) -> int:
            while of[ball] != ball:
                of[ball] = ball = of[of[ball]]
            return ball

        for i in range(len(centers)):
            if self._spent(len(centers) - i):
                return False
            close = np.flatnonzero(distance(centers[i], centers[i + 1 :]) - radius[i] - radius[i + 1 :] <= self.bound) + i + 1
            for j in close.tolist():
                if first(i) == first(j):
                    continue
                if self.members is None:
                    return False
                a, b = (np.concatenate(self.members[k]) for k in (i, j))
                a = a[distance(centers[j], a) <= self.bound + radius[j]]  # others are too far from all of the other ball
                b = b[distance(centers[i], b) <= self.bound + radius[i]]
                if len(a) > len(b):
                    a, b = b, a
                for row in a:
                    if self._spent(len(b)):
                        return False
                    hit = near(row, b, self.signed)
                    if hit.any():
                        self.leaf.append(row[:1]), self.root.append(b[hit.argmax()][:1])
                        of[first(j)] = first(i)
                        break
        return True


def _linked(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, words) sorted by key -> (key, d, b): an edge d-b between ids, or, with a key only, that its sets have to be brought together again.

    Sets with one id are connected already. A group of more than ``hot`` sets (None: none is) is a ``Crowd``.
    """

    def rows(a: np.ndarray, b: np.ndarray, key: list | None = None) -> pa.RecordBatch:
        apart = a != b
        a, b = a[apart].view(np.int64), b[apart].view(np.int64)
        marks = pa.array([*([None] * len(a)), *(key or [])], pa.int64())
        ends = [pa.array([*x.tolist(), *([None] * len(key or []))], pa.int64()) if key else pa.array(x) for x in (a, b)]
        return pa.RecordBatch.from_arrays([marks, *ends], names=["key", "d", "b"])

    def told(key: int, crowd: Crowd) -> pa.RecordBatch:
        done = crowd.settled()
        return rows(np.concatenate(crowd.leaf), np.concatenate(crowd.root), None if done else [int(key)])

    width = len(WORDS) + 1
    held_key, held, crowd = None, np.empty((0, width), np.uint64), None
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            key, fps = np.empty(0, np.int64), np.empty((0, width), np.uint64)
        else:
            key = batch.column(0).to_numpy()
            fps = np.column_stack([batch.column(k).to_numpy() for k in range(1, width + 1)]).view(np.uint64)
        if crowd is not None:
            more = int(np.searchsorted(key != held_key, True))
            crowd.add(fps[:more])
            key, fps = key[more:], fps[more:]
            if len(key) or batch is None:
                yield told(held_key, crowd)
                crowd = None
        key, fps = np.concatenate([np.full(len(held), held_key if len(held) else 0, np.int64), key]), np.concatenate([held, fps])
        held = held[:0]
        if not len(key):
            continue
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        large = np.zeros(len(start), bool) if hot is None else end - start > hot
        if batch is not None:
            held_key = key[-1]
            if large[-1]:
                crowd = Crowd(bool(held_key >= 0))
                crowd.add(fps[start[-1] :])
            else:
                held = fps[start[-1] :].copy()
            start, end, large = start[:-1], end[:-1], large[:-1]
        for a, z in zip(start[large].tolist(), end[large].tolist(), strict=True):
            whole = Crowd(bool(key[a] >= 0))
            whole.add(fps[a:z])
            yield told(key[a], whole)
        size = end - start
        few = (size > 1) & ~large
        s, n = start[few], size[few]
        first = np.repeat(s, n)  # most groups are near to their first set as a whole
        own = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = near(fps[own], fps[first], key[own] >= 0)
        whole = np.logical_and.reduceat(hit, np.cumsum(n) - n) if len(n) else np.empty(0, bool)
        done = np.repeat(whole | (n == 2), n) & hit & (own != first)
        leaf, root = [own[done]], [first[done]]
        rest = ~whole & (n > 2)
        small = rest & (n <= FEW)
        i, j = pairs(s[small], n[small])
        hit = near(fps[i], fps[j], key[i] >= 0)
        i, j = i[hit], j[hit]
        group = np.searchsorted(s, i, "right") - 1
        lean = np.bincount(group, minlength=len(s)) < n  # no more edges than a forest has
        leaf.append(j[lean[group]]), root.append(i[lean[group]])
        rest &= ~(small & lean)
        for a, z in zip(s[rest].tolist(), (s + n)[rest].tolist(), strict=True):
            some = fps[a:z]
            x, y = forest(z - a, lambda u, others, some=some, signed=key[a] >= 0: near(some[u], some[others], signed))
            leaf.append(x + a), root.append(y + a)
        leaf, root = np.concatenate(leaf), np.concatenate(root)
        if len(leaf):
            yield rows(fps[leaf, 0], fps[root, 0])


def _spanned(batches: Iterator[pa.RecordBatch], most: int = SPAN) -> Iterator[pa.RecordBatch]:
    """Rows of ``_linked``, but of its edges those of a spanning forest, from each component's first; they connect the same.

    A copy meets the others under most of its keys, each time from another first set. Edges
    are thinned whenever ``most`` are held; a forest of more than half of that is given and
    another one begun.
    """

    def rows(d: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(b)], names=["key", "d", "b"])

    held, count = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if batch.column("key").null_count < batch.num_rows:
                marked = batch.column("key").is_valid()
                yield batch.filter(marked)
                batch = batch.filter(pc.invert(marked))
            held.append((batch.column("d").to_numpy(), batch.column("b").to_numpy()))
            count += batch.num_rows
        if count and (batch is None or count >= most):
            d, b = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, at = np.unique(np.concatenate((d, b)), return_inverse=True)
            d, b = star(nodes, components(len(nodes), at[:count], at[count:]))
            held, count = [(d, b)], len(d)
            if count and (batch is None or count > most // 2):
                yield rows(d, b)
                held, count = [], 0


def alike(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect sets of shingles of likeness 0.8, by what they have in common."""
    size = np.array([len(h) for h in own], np.int64)
    end = np.cumsum(size)
    _, token = np.unique(np.concatenate(own), return_inverse=True)
    holders = np.repeat(np.arange(len(own)), size)[np.argsort(token, kind="stable")]
    many = np.bincount(token)
    first = np.cumsum(many) - many

    def links_to(u: int, others: np.ndarray) -> np.ndarray:
        t = token[end[u] - size[u] : end[u]]
        at = np.repeat(first[t] - np.cumsum(many[t]) + many[t], many[t]) + np.arange(many[t].sum())
        common = np.bincount(holders[at], minlength=len(own))[others]
        return 9 * common >= 4 * (size[u] + size[others])

    return forest(len(own), links_to)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, d, h) sorted by key, d -> edges (a, b) between sets that likeness 0.8 connects."""

    def edges(ids: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
        ids, (leaf, root) = np.array(ids, np.int64), alike(own)
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root])], names=["a", "b"])

    of, ids, own = None, [], []
    for batch in batches:
        at, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        for k, (key, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != of and ids:
                yield edges(ids, own)
                ids, own = [], []
            of = key
            ids.append(d), own.append(values[at[k] : at[k + 1]].copy())
    if ids:
        yield edges(ids, own)


def _dealt(rows: DataFrame, to) -> DataFrame:
    """``rows`` once for each task in the array column ``to``; key becomes the task's and keeps its sign."""
    return rows.withColumn("to", F.explode(to)).withColumn("key", F.expr(f"xxhash64(key, to) & ~{MINUS} | key & {MINUS}")).repartition("key").sortWithinPartitions("key", "d")


def _parts(count, tokens, hot: int):
    """How many parts of half of what a task compares; one for all that a task can hold."""
    parts = F.ceil(F.greatest(count / hot, tokens / TOKENS) * 2).cast("int")
    return F.when(parts > 2, parts).otherwise(1)


def sized(rows: DataFrame, hot: int) -> DataFrame:
    """Rows (key, d, n, ...) and the number of parts of their key."""
    return rows.join(rows.groupBy("key").agg(_parts(F.count(F.lit(1)), F.sum("n"), hot).alias("parts")), "key")


def with_pivots(rows: DataFrame) -> DataFrame:
    """Rows of ``sized`` dealt to parts of their key; about a part's worth of them, the pivots, goes to all parts."""
    pivot = F.pmod(F.xxhash64("key", "d"), "parts") == 0
    to = F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("d"), "parts").cast("int")))
    return _dealt(rows, to)


def left_over(rows: DataFrame, roots: DataFrame, hot: int) -> DataFrame:
    """Of keys with several parts and components, the rows, and how those outside the largest component (rest) are dealt."""
    rooted = rows.join(roots, F.col("d") == F.col("node"), "left").withColumn("root", F.coalesce("root", "d")).drop("node")
    each = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
    size = each.groupBy("key").agg(F.max(F.struct("rows", "root", "tokens")).alias("top"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
    size = size.select(
        "key", F.col("top.root").alias("top"), _parts(F.col("rows"), F.col("tokens"), hot).alias("parts"),
        _parts(F.col("rows") - F.col("top.rows"), F.col("tokens") - F.col("top.tokens"), hot).alias("chunks"), (F.col("rows") - F.col("top.rows")).alias("rest"),
    )
    return rooted.join(size.where("parts > 1 and rest > 0").drop("rest"), "key").withColumn("rest", F.col("root") != F.col("top")).drop("root", "top")


def with_rest(rows: DataFrame) -> DataFrame:
    """Rows of ``left_over`` dealt so that each chunk of the rest meets each part of its key."""
    own, chunk = F.pmod(F.xxhash64("d"), "parts").cast("int"), F.pmod(F.xxhash64("key", "d"), "chunks").cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("c"), own.alias("p")))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(chunk.alias("c"), p.alias("p")))
    return _dealt(rows, F.when(F.col("rest"), F.array_union(met, meets)).otherwise(met))


_FOUND = "key long, d long, b long"


def candidates(distinct: DataFrame, hot: int = HOT) -> tuple[DataFrame, str]:
    """(node, root) of the components of candidates among distinct sets (d, n, words, p), and a scratch path."""
    spark, wide = distinct.sparkSession, segment_bits(distinct.count())

    def found(keyed: DataFrame, most: int | None) -> DataFrame:
        return keyed.mapInArrow(lambda it: _spanned(_linked(it, most)), _FOUND)

    def met(rows: DataFrame, early: bool, by: str) -> tuple[DataFrame, str]:
        keyed = indexed(rows, wide, early).select("key", by, *WORDS)
        return written(found(keyed.repartition("key").sortWithinPartitions("key", by), hot))

    def edges(rows: DataFrame) -> DataFrame:
        return rows.where("key is null").mapInArrow(_spanned, _FOUND).selectExpr("d as a", "b")  # what tasks have in common

    first, path = met(distinct, True, "d")
    early, to = connected(edges(first))
    as_one = distinct.join(early, F.col("d") == F.col("node"), "left").withColumn("root", F.coalesce("root", "d")).drop("node")
    second, at = met(as_one, False, "root")
    both = lambda roots: roots.selectExpr("node as a", "root as b")
    roots, last = connected(both(early).unionByName(edges(second)))
    scratch = [path, to, at]
    marks = first.unionByName(second).where("key is not null").select("key").distinct()
    many = marks.count()
    if many:
        again = indexed(distinct, wide).select("key", "d", *WORDS, F.lit(0).alias("n"))
        crowd, rows = written(again.join(F.broadcast(marks) if many <= MARKS else marks, "key", "left_semi"))
        linked = lambda dealt: found(dealt.select("key", "d", *WORDS), None).selectExpr("d as a", "b")
        grown, more = connected(both(roots).unionByName(linked(with_pivots(sized(crowd, hot)))))
        final, end = connected(both(grown).unionByName(linked(with_rest(left_over(crowd, grown, hot)))))
        scratch += [rows, last, more]
        roots, last = final, end
    remove(spark, *scratch)
    return roots, last


def links(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> tuple[DataFrame, str]:
    """(node, root) of the components that likeness 0.8 connects among sets (d, t, n, ...), and a scratch path."""
    spark = docs.sparkSession
    blocks, path = candidates(distinct, hot)
    members = blocks.unionByName(blocks.selectExpr("root as node", "root")).distinct().selectExpr("node as d", "root as key")
    members, at = written(sized(members.join(distinct.select("d", "t", "n"), "d"), hot))
    own = members.select("t").distinct()
    own = F.broadcast(own) if own.count() <= MEMBERS else own
    texts = docs.select("text", F.xxhash64("text").alias("t")).join(own, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))

    def settled(rows: DataFrame, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
        held = with_columns(texts.join(rows, "t").drop("t"), ["text"], lambda x: ([shingles(t, shingle).view(np.int64) for t in x],), "h array<long>", drop=("text",), rows=256)
        return deal(held).select("key", "d", "h").mapInArrow(_settled, "a long, b long")

    roots, last = connected(settled(members, with_pivots))
    rest, to = written(left_over(members.where("parts > 1").drop("parts"), roots, hot))
    if not rest.isEmpty():
        final, again = connected(roots.selectExpr("node as a", "root as b").unionByName(settled(rest, with_rest)))
        remove(spark, last)
        roots, last = final, again
    remove(spark, path, at, to)
    return roots, last


def _grouped(docs: DataFrame, shingle: int, hot: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sets of all rows (doc_id, t, d), of each distinct set d the first row of its group (least), and the paths both read.

    Rows are ordered by doc_id (null last) and then by a hash of the text.
    """
    bound_batches(docs.sparkSession)
    every, path = written(sets(docs, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    distinct = every.groupBy("d").agg(F.min("t").alias("t"), *(F.first(c).alias(c) for c in ("n", *WORDS, "p")))
    roots, to = links(docs, distinct, shingle, hot)
    first = every.groupBy("d").agg(F.min(row).alias("least"))
    rooted = first.join(roots, F.col("d") == F.col("node"), "left").select("d", "least", F.coalesce("root", "d").alias("r"))
    return every.select("doc_id", "t", "d"), rooted, [path, to]


def near_copies(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its group of near copies, of every row of ``docs``.

    Null and empty texts form one group. A null doc_id is a component's smallest only if all
    are null (then null). Repeated rows stay, with equal results; an empty table gives an
    empty result. Only doc_id and text are read, so other columns may have any name.
    """
    every, rooted, scratch = _grouped(docs, shingle, hot)
    least = rooted.groupBy("r").agg(F.min("least").alias("least"))
    named = rooted.select("d", "r").join(least, "r").select("d", "least.doc_id")
    out, _ = written(every.select("doc_id", "d").join(named.selectExpr("d", "doc_id as component_id"), "d").select("doc_id", "component_id"))
    remove(docs.sparkSession, *scratch)
    return out


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the first one, with its columns.

    First is the row with the smallest doc_id (null ids last); of rows with one id and
    different texts the choice is by a hash of the text, so it is made by row, not by id.
    Of rows with one id and one text any one stays.
    """
    _, rooted, scratch = _grouped(docs, shingle, hot)
    least, _ = written(rooted.groupBy("r").agg(F.min("least").alias("least")).select("least.doc_id", "least.t"))
    remove(docs.sparkSession, *scratch)
    id_, t = (next(f"{c}{k}" for k in range(len(docs.columns) + 1) if f"{c}{k}" not in docs.columns) for c in ("id", "t"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63) + 1))  # a plain key, so that join and duplicates share one exchange
    kept = least.select(key.alias(id_), F.col("t").alias(t)).distinct()
    return docs.select("*", key.alias(id_), F.xxhash64("text").alias(t)).join(kept, [id_, t], "left_semi").dropDuplicates([id_, t]).select(*docs.columns)
