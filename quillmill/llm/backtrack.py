"""BPE by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is what merging gives if and only if any two neighbours are compatible, that
is, if merging the bytes of the two gives just these two. So no merge is carried out: an
Aho-Corasick automaton of the reversed tokens reads the bytes backwards and knows at every place the longest token that begins there;
the encoder takes it if it is compatible with the one before it, else the next shorter token that begins there, and goes
back a token where none is left. What merging makes of a text's first bytes is unique, so a place from which
there is no way on is never entered again, and the work is linear in bytes, however long a pre-token is.

Compatibility is told by the two sides' own merges, last ones first (``Vocabulary.compatible``), and
kept in a table, as few pairs make up most texts.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .bpe import Encoder, _together
from .common import bound_batches, make_room

#: Pairs whose compatibility a worker remembers at most; then it starts anew.
REMEMBERED = 2_000_000
#: Pre-tokens and stretches of text that a worker remembers at most, likewise.
STRETCHES = 800_000
NEVER = 1 << 60

# The split of byte-level tokenizers, and the letters and numbers that came with Unicode 17 and later,
# which the tokenizers library (Unicode 16) takes for neither: first and last code points.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


class Splitter:
    """Pre-tokens of a text; an added token's text is one by itself wherever it stands."""

    def __init__(self, added: list[str]):
        self.added = added
        later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER)
        self.later = regex.compile(f"[{later}]").search
        self.plain = regex.compile(SPLIT.format(letter=r"\p{L}", number=r"\p{N}", letters=r"\p{L}", numbers=r"\p{N}")).findall
        none = f"(?![{later}])"
        self.careful = regex.compile(
            SPLIT.format(letter=rf"(?:{none}\p{{L}})", number=rf"(?:{none}\p{{N}})", letters="", numbers="").replace(r"[^\s]", rf"(?:[{later}]|[^\s\p{{L}}\p{{N}}])")
        ).findall
        self.borders = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)) + ")").split if added else None

    def has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def __call__(self, text: str) -> list[str]:
        if self.has_added(text):
            return [p for k, part in enumerate(self.borders(text)) for p in ([part] if k % 2 else self.parts(part))]
        return self.parts(text)

    def parts(self, text: str) -> list[str]:
        """Pre-tokens of what is an added token or has none in it."""
        if text in self.added:
            return [text]
        return self.plain(text) if text.isascii() or not self.later(text) else self.careful(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE tokenizer's file.

    Merges have to be in the order of training: what a merge joins is a byte or
    comes from an earlier merge, and no two merges give the same token. Then, and only then, pairs of tokens tell
    what merging does. Another file, or one with settings that aren't plain byte-level BPE, is a ValueError.
    """

    def __init__(self, data: bytes):
        file = json.loads(data)
        model, before = file["model"], file.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("add_prefix_space",) if before.get(k)] + [k for k in ("normalizer",) if file.get(k)]
        odd += [a["content"] for a in file.get("added_tokens", ()) if a["single_word"] or a["lstrip"] or a["rstrip"]]
        if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or odd:
            raise ValueError(f"not a plain byte-level BPE tokenizer: {odd}")
        letter = byte_letters()
        self.added = {a["content"].encode(): a["id"] for a in file.get("added_tokens", ())}
        token = {i: bytes(map(letter.__getitem__, t)) for t, i in model["vocab"].items() if t.encode() not in self.added}
        size = max([*token, *self.added.values()]) + 1
        # the offset table: the bytes of all tokens one after the other, and where each one begins
        parts = [token.get(i, b"") for i in range(size)]
        for content, i in self.added.items():
            parts[i] = content
        self.bytes, self.offset = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        self.length = np.diff(self.offset).tolist()
        self.most = max(self.length)
        id_of = {t: i for i, t in token.items()}
        missing = [b for b in range(256) if bytes([b]) not in id_of]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.rank, self.left, self.right, self.pair = [-1] * size, [-1] * size, [-1] * size, {}
        made = {id_of[bytes([b])] for b in range(256)}
        seen = set(made)
        for r, merge in enumerate(model["merges"]):
            a, b = (id_of[bytes(map(letter.__getitem__, s))] for s in (merge.split(" ") if isinstance(merge, str) else merge))
            both = id_of[token[a] + token[b]]
            if a not in seen or b not in seen or both in made:
                raise ValueError(f"merge {r} isn't in the order of training")
            seen.add(both)
            if a not in made or b not in made or not self.compatible(a, b, r):
                continue  # other merges come first wherever its bytes stand, so it never is made
            made.add(both)
            self.rank[both], self.left[both], self.right[both], self.pair[a << 32 | b] = r, a, b, r
        #: The next shorter token that begins like each token, or -1.
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for i in made:
            t = token[i]
            self.shorter[i] = next((id_of[t[:n]] for n in range(len(t) - 1, 0, -1) if id_of.get(t[:n], -1) in made), -1)
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def compatible(self, a: int, b: int, ends: int = NEVER) -> bool:
        """Whether merging the bytes of two tokens gives the two again, by merges before ``ends``.

        Both are taken apart at the border, the later merge first. The two that touch there exist together until
        one of them is taken into a larger one; if they would merge with each other before, they don't stay apart.
        Of equal merges the left one comes first.
        """
        rank, pair = self.rank, self.pair
        a_ends = b_ends = ends
        while True:
            r = pair.get(a << 32 | b, NEVER)
            if r < a_ends and r <= b_ends:
                return False
            if rank[a] > rank[b]:
                a_ends, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_ends, b = rank[b], self.left[b]
            else:
                return True

    def _fit(self, a: int, b: int) -> bool:
        """``compatible``, from the table where it is known."""
        fit = self.fits.get(a << 32 | b)
        if fit is None:
            fit = self.fits[a << 32 | b] = self.compatible(a, b)
        return fit

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each piece's ids end.

        Longest matches, each from where the last one ends, are looked up for all pieces together, and so is
        whether neighbours are compatible. Pieces with neighbours that aren't are encoded one by one.
        """
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        joined = "Ā".join([p.decode("latin-1") for p in pieces])  # no token reaches over the letter between pieces
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(joined)), np.int64)
        last, token = found[::2], found[1::2]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(size + 1) - size - 1
        of = np.searchsorted(begin, last, "right") - 1
        pair, place = np.unique((token[:-1] << 32 | token[1:])[of[:-1] == of[1:]], return_inverse=True)
        fit = np.ones(max(len(token) - 1, 0), bool)
        fit[of[:-1] == of[1:]] = np.fromiter((self._fit(k >> 32, k & 0xFFFFFFFF) for k in pair.tolist()), bool, len(pair))[place]
        again = np.zeros(len(pieces), bool)
        again[of[:-1][~fit]] = True
        counts = np.bincount(of, minlength=len(pieces))
        own, first = {}, np.cumsum(counts) - counts
        for k in np.flatnonzero(again).tolist():
            own[k] = self._backtracked(joined[begin[k] : begin[k] + size[k]], token[first[k] : first[k] + counts[k]].tolist())
        own |= {k: [self.added[p]] for k, p in enumerate(pieces) if p in self.added}
        odd = np.fromiter(own, np.int64, len(own))
        keep = np.ones(len(pieces), bool)
        keep[odd] = False
        counts[odd] = [len(x) for x in own.values()]
        end = np.cumsum(counts)
        ids = np.empty(counts.sum(), np.int64)
        mine = np.repeat(keep, counts)
        ids[mine] = token[keep[of]]
        order = np.sort(odd).tolist()
        ids[~mine] = np.fromiter((i for k in order for i in own[k]), np.int64, int(counts[odd].sum()))
        return ids, end

    def _backtracked(self, piece: str, greedy: list[int]) -> list[int]:
        """The ids of one piece whose longest matches, one after the other, are ``greedy``."""
        length, shorter, fits, search, most = self.length, self.shorter, self.fits, self.automaton.iter_long, self.most
        longest, at = {}, 0
        for token in greedy:
            longest[at] = token
            at += length[token]
        end, at, own, dead, token = at, 0, [], set(), greedy[0]
        while True:
            to = at + length[token]
            fit = to not in dead
            if fit and own:
                fit = fits.get(own[-1] << 32 | token)
                if fit is None:
                    fit = self._fit(own[-1], token)
            if fit:
                own.append(token)
                if to == end:
                    return own
                at, token = to, longest.get(to)
                if token is None:
                    _, token = next(search(piece[at : at + most]))
                    longest[at] = token
                continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = own.pop()
                at -= length[token]
                token = shorter[token]

    def decode(self, ids: np.ndarray, offset: np.ndarray) -> list[bytes]:
        """The bytes of each stretch of ids between two offsets; ids that the vocabulary doesn't have stand for nothing."""
        known = (ids >= 0) & (ids < len(self.offset) - 1)
        ids = np.where(known, ids, 0).astype(np.int64)
        start, length = self.offset[ids], np.where(known, self.offset[ids + 1] - self.offset[ids], 0)
        end = np.concatenate(([0], np.cumsum(length)))
        data = self.bytes[np.repeat(start - end[:-1], length) + np.arange(end[-1])].tobytes()
        cut = end[offset].tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]


@functools.lru_cache(2)
def _vocabulary(digest: str, shipped) -> tuple[Vocabulary, Splitter]:
    vocabulary = Vocabulary(shipped.value if hasattr(shipped, "value") else shipped)
    return vocabulary, Splitter([a.decode() for a in vocabulary.added])


class BacktrackingEncoder(Encoder):
    """Texts to ids; remembers what it has met: pre-tokens, and the stretches between blanks.

    A blank after something that is no white space begins a pre-token, and no pre-token before it depends on what
    follows. So a text without white space before a blank is cut at its blanks, and most stretches are known.
    """

    def __init__(self, vocabulary: Vocabulary, split: Splitter):
        self.vocabulary, self.split = vocabulary, split
        self.wide = regex.compile(r"\s ").search
        self._forget()

    def _gathered(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places, and where each place's begin and end."""
        start = np.concatenate(([0], self.end))[place]
        length = self.end[place] - start
        to = np.concatenate(([0], np.cumsum(length)))
        return self.ids[np.repeat(start - to[:-1], length) + np.arange(to[-1])], to

    def _learn(self, new: list[str], ids: np.ndarray, end: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.end = np.concatenate((self.end, end + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end; null counts as empty."""
        collects = gc.isenabled()
        gc.disable()  # millions of short texts and no cycles: looking for some takes a fifth of the time
        try:
            return self._texts(texts)
        finally:
            if collects:
                gc.enable()

    def _texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > STRETCHES:
            self._forget()
        known, split = self.known, self.split
        stretches = []
        for t in texts:
            if not t:
                stretches.append([])
            elif self.wide(t) or split.has_added(t):
                stretches.append(split(t))
            else:
                first, *rest = t.split(" ")
                own = [" " + s for s in rest]
                stretches.append([first, *own] if first else own)
        counts = np.fromiter(map(len, stretches), np.int64, len(stretches))
        flat = list(itertools.chain.from_iterable(stretches))
        place = np.fromiter(map(known.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(place < 0).tolist()
        parts = {s: split.parts(s) for s in {flat[k] for k in unknown}}
        new = list({p for own in parts.values() for p in own if p not in known})
        self._learn(new, *self.vocabulary.encode([p.encode("utf-8", "surrogatepass") for p in new]))
        several = {s: own for s, own in parts.items() if len(own) > 1}
        many = np.fromiter(map(len, several.values()), np.int64, len(several))
        ids, to = self._gathered(np.fromiter((known[p] for own in several.values() for p in own), np.int64, many.sum()))
        self._learn(list(several), ids, to[np.cumsum(many)])
        place[unknown] = [known[flat[k]] for k in unknown]
        ids, to = self._gathered(place)
        return ids, to[np.concatenate(([0], np.cumsum(counts)))]


def _shipped(df: DataFrame, tokenizer: str):
    with open(tokenizer, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()  # a vocabulary's size doesn't depend on the corpus


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` as array<int> in ``out`` and without ``text``.

    With ``back``, that column gets the text that the ids decode to, without another pass through Python workers.

    ``tokenizer`` is a tokenizer's JSON file that the driver can read. Added tokens are found in the text, none is put
    before or after it. Null and empty texts give an empty array. All other columns pass
    unchanged; one named as ``out`` or ``back`` gets a number after its name (the first that is free).
    """
    docs = make_room(docs, {out, back} - {text})
    bound_batches(docs.sparkSession)
    shipped, digest = _shipped(docs, tokenizer)
    rest = [c for c in docs.columns if c not in (text, out, back)]
    schema = docs.select(*rest).schema.add(out, ArrayType(IntegerType()))
    if back:
        schema = schema.add(back, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BacktrackingEncoder(*_vocabulary(digest, shipped))
        for batch in batches:
            at = 0
            for some in _together(batch.column(0).to_pylist()):
                ids, offset = encoder.texts(some)
                columns = [*batch.slice(at, len(some)).columns[1:], pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(ids))]
                if back:
                    columns.append(pa.array([b.decode("utf-8", "replace") for b in encoder.vocabulary.decode(ids, offset)], pa.string()))
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(text, *rest).mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text that ``ids`` stand for in ``out`` and without ``ids``.

    Bytes that are no UTF-8 become replacement characters. Null arrays give the empty text; null ids
    and ids that the vocabulary doesn't have stand for nothing. A column that is named as ``out`` gets a number after its name.
    """
    tokens = make_room(tokens, {out} - {ids})
    bound_batches(tokens.sparkSession)
    shipped, digest = _shipped(tokens, tokenizer)
    rest = [c for c in tokens.columns if c not in (ids, out)]
    schema = tokens.select(*rest).schema.add(out, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = _vocabulary(digest, shipped)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = pc.fill_null(part.column(0).flatten().cast(pa.int64()), -1).to_numpy()
                offset = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part.column(0)), 0).to_numpy())))
                found = [b.decode("utf-8", "replace") for b in vocabulary.decode(flat, offset)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.string())], names=[*rest, out])

    return tokens.select(ids, *rest).mapInArrow(run, schema)


def token_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Number and digest of the ids of every text of ``docs``, and the digest of the text that they decode to.

    Null and empty texts have no ids (and the digests of nothing); repeated rows have
    equal results; an empty table gives no rows. Only doc_id and text are read.
    """
    return encode(docs.select("doc_id", "text"), tokenizer, back="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
