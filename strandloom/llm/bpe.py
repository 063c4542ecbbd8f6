"""Encoding a corpus with a public byte-level BPE vocabulary.

Method, per Arrow batch: texts are cut into pieces (the vocabulary's
pre-tokenisation) with array operations on code points; distinct pieces that the
worker has not met before are concatenated, and a *pair occurrence index* maps
each mergeable pair to all its positions among them.  Active ranks are applied in
ascending order to all their positions at once, and only the lists of the pairs
next to a merge are updated.  A merge can only create pairs of a higher rank, so
one ascending pass is exact.  Pieces already encoded come from a bounded cache; a
piece is found by a hash and taken only if its characters are the same, so two pieces
of one hash never share their ids.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import require, ship
from .arrow import mix, ragged, text_bytes

#: Vocabulary of the stated problem, and the session setting that names its folder.
VOCABULARY, FOLDER_SETTING = "byte_bpe_50k.json", "spark.strandloom.tokenizers"
#: Code points handled at once, pieces kept in a worker's cache, and the longest piece that is kept.
CHUNK, CACHE, KEPT = 1 << 21, 1 << 20, 256
#: Characters on both sides of a character that decide whether a piece starts there, and more.
NEAR = 8

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: Contractions that the pre-tokenisation splits off, without their apostrophe (fixed values).
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The file of a vocabulary: in ``folder`` if given, else where the public package of
    tokenizer files has it. RuntimeError if it is in neither."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    try:
        import public_tokenizers
    except ModuleNotFoundError as e:
        raise RuntimeError(f"name the vocabulary's file, or its folder in {FOLDER_SETTING}") from e
    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The vocabulary's printable stand-ins for bytes: printable bytes stand for
    themselves, the others for code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            out[chr(extra)] = b
            extra += 1
    return out


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """byte -> id, and merges as rows (left id, right id, merged id) by rank."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, symbols = model["vocab"], byte_symbols()
    single = np.zeros(256, np.int32)
    for symbol, b in symbols.items():
        single[b] = vocab[symbol]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
    return {"single": single, "merges": merges, "classes": char_classes(), "key": xxhash.xxh64_hexdigest(single.tobytes() + merges.tobytes())}


def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            table[a:b] = kind
    return table


def piece_starts(cp: np.ndarray, cls: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where pieces start, as a mask over code points. ``fresh`` marks text starts.

    White space before a word: all but its last character is one piece; a last
    plain blank belongs to the word, any other last character is a piece of its
    own.  A run of white space that ends the text is one piece.  A contraction
    starts where an apostrophe follows a word directly.
    """
    n = len(cp)
    prev_cls = np.empty_like(cls)
    prev_cls[0], prev_cls[1:] = 255, cls[:-1]
    prev_cls[fresh] = 255
    space = cls == _SPACE
    next_word = np.zeros(n, bool)
    next_word[:-1] = ~space[1:] & ~fresh[1:]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (cp[:-1] == 32) & space[:-1]
    after_blank &= ~fresh
    start = fresh | (cls != prev_cls) | (space & next_word)
    start &= ~(~space & after_blank)
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        big = np.concatenate([cp, np.zeros(2, cp.dtype)])
        cut = np.concatenate([fresh, np.ones(2, bool)])
        one, two = np.where(cut[quote + 1], 0, big[quote + 1]), np.where(cut[quote + 1] | cut[quote + 2], 0, big[quote + 2])
        taken = np.zeros(len(quote), np.int64)
        for c in _CONTRACTIONS:
            hit = (taken == 0) & (one == ord(c[0])) & ((two == ord(c[1])) if len(c) == 2 else True)
            taken[hit] = len(c)
        q, t = quote[taken > 0], taken[taken > 0]
        start[q + 1] = False
        rest = q + t + 1
        rest = rest[rest < n]
        start[rest] = True
    return start


class Encoder:
    """Encodes code points; keeps a bounded cache of pieces."""

    def __init__(self, vocabulary: dict[str, np.ndarray]):
        self.single, merges, self.classes = vocabulary["single"], vocabulary["merges"], vocabulary["classes"]
        self.left, self.right, self.made = (merges[:, i].tolist() for i in range(3))
        self.size = int(max(merges.max() if len(merges) else 0, self.single.max())) + 1
        self.rank = {a * self.size + b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        order = np.argsort(merges[:, 0] * self.size + merges[:, 1]) if len(merges) else np.empty(0, np.int64)
        self.pair_keys, self.pair_rank = (merges[:, 0] * self.size + merges[:, 1])[order], order
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.power = self.unpower = np.ones(1, np.uint64)
        self.clear()

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            size = max(n, CHUNK + 1)
            both = []
            for b in (self.base, np.uint64(pow(int(self.base), -1, 1 << 64))):
                out = np.full(size, b, np.uint64)
                out[0] = 1
                both.append(np.cumprod(out, dtype=np.uint64))
            self.power, self.unpower = both
        return self.power, self.unpower

    def clear(self) -> None:
        self.slots = 1 << 22
        self.table_hash = np.zeros(self.slots, np.uint64)
        self.table_piece = np.full(self.slots, -1, np.int32)
        self.overflow: dict[int, int] = {}
        self.flat, self.letters = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.uint32)
        self.offset, self.letter_offset = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pieces = 0

    def encode(self, cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of code points whose pieces start at ``start`` (the first at 0)."""
        end = np.append(start[1:], len(cp))
        power, unpower = self._powers(len(cp) + 1)
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * unpower[start] + (end - start).astype(np.uint64))
        kept = end - start <= KEPT
        piece = np.where(kept, self._find(h), -1)
        miss = np.flatnonzero((piece < 0) & kept)
        if len(miss):
            if self.pieces > CACHE:
                self.clear()
                miss = np.flatnonzero(kept)
            fresh_h, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            self._learn(fresh_h, cp, start[at], end[at])
            piece[miss] = self._find(h[miss])
        # long pieces, and those whose hash another piece has in the cache, are merged as they are
        other = np.flatnonzero(~self._same(piece, cp, start, end))
        lengths = self.offset[piece + 1] - self.offset[piece]
        if not len(other):
            return self.flat[ragged(self.offset[piece], lengths)], lengths
        size = end[other] - start[other]
        ids, lengths[other] = self.merge(cp[ragged(start[other], size)], size)
        out = np.empty(int(lengths.sum()), np.int32)
        place = np.cumsum(lengths) - lengths
        cached = np.ones(len(start), bool)
        cached[other] = False
        out[ragged(place[other], lengths[other])] = ids
        out[ragged(place[cached], lengths[cached])] = self.flat[ragged(self.offset[piece[cached]], lengths[cached])]
        return out, lengths

    def _same(self, piece: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each cached piece (-1: none) has the characters cp[start:end]."""
        size = end - start
        same = (piece >= 0) & (self.letter_offset[piece + 1] - self.letter_offset[piece] == size)
        at = np.flatnonzero(same)
        if len(at):
            n = size[at]
            equal = self.letters[ragged(self.letter_offset[piece[at]], n)] == cp[ragged(start[at], n)]
            same[at] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        out = np.where(self.table_hash[slot] == h, self.table_piece[slot], -1)
        if self.overflow:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.overflow.get(int(h[i]), -1)
        return out

    def _learn(self, h: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        lengths = end - start
        letters = cp[ragged(start, lengths)]
        ids, sizes = self.merge(letters, lengths)
        need = self.pieces + len(h) + 1
        if need >= len(self.offset):
            more = np.zeros(max(need, len(self.offset)), np.int64)
            self.offset, self.letter_offset = np.concatenate([self.offset, more]), np.concatenate([self.letter_offset, more])
        self.flat = self._put(self.flat, self.offset, ids, sizes)
        self.letters = self._put(self.letters, self.letter_offset, letters, lengths)
        number = np.arange(self.pieces, self.pieces + len(h))
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        free = self.table_piece[slot] < 0
        own = np.zeros(len(h), bool)
        own[np.unique(slot, return_index=True)[1]] = True
        free &= own
        self.table_hash[slot[free]], self.table_piece[slot[free]] = h[free], number[free]
        for i in np.flatnonzero(~free).tolist():
            self.overflow[int(h[i])] = int(number[i])
        self.pieces += len(h)

    def _put(self, store: np.ndarray, offset: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        base = int(offset[self.pieces])
        if base + len(values) > len(store):
            store = np.concatenate([store, np.empty(max(len(values), len(store)), store.dtype)])
        store[base : base + len(values)] = values
        offset[self.pieces + 1 : self.pieces + 1 + len(sizes)] = base + np.cumsum(sizes)
        return store

    def merge(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of concatenated pieces by the pair occurrence index: (ids, ids per piece)."""
        data = np.frombuffer(letters.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        width = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
        stop = np.cumsum(np.add.reduceat(width, np.cumsum(lengths) - lengths))
        tok_array = self.single[data].astype(np.int64)
        n = len(tok_array)
        last = np.zeros(n, bool)
        last[stop - 1] = True
        # index of the first pairs: one sort by rank
        left = np.flatnonzero(~last)
        key = tok_array[left] * self.size + tok_array[left + 1]
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        known = self.pair_keys[at] == key if len(self.pair_keys) else np.zeros(len(key), bool)
        ranks, places = self.pair_rank[at[known]], left[known]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        index = {int(ranks[g[0]]): places[g[0] : g[1]].tolist() for g in zip(np.append(0, cut), np.append(cut, len(ranks)))} if len(ranks) else {}
        active = list(index)
        heapq.heapify(active)
        tok = tok_array.tolist()
        following = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.arange(-1, n - 1)
        before[np.append(0, stop[:-1])] = -1
        before = before.tolist()
        rank, size, lefts, rights, made = self.rank, self.size, self.left, self.right, self.made
        while active:
            r = heapq.heappop(active)
            where = index.pop(r)
            a, b, new = lefts[r], rights[r], made[r]
            if len(where) > 1:
                where.sort()
            for i in where:
                if tok[i] != a:
                    continue
                j = following[i]
                if j < 0 or tok[j] != b:
                    continue
                tok[i], tok[j] = new, -1
                k = following[i] = following[j]
                if k >= 0:
                    before[k] = i
                    x = rank.get(new * size + tok[k])
                    if x is not None:
                        if x in index:
                            index[x].append(i)
                        else:
                            index[x] = [i]
                            heapq.heappush(active, x)
                k = before[i]
                if k >= 0:
                    x = rank.get(tok[k] * size + new)
                    if x is not None:
                        if x in index:
                            index[x].append(k)
                        else:
                            index[x] = [k]
                            heapq.heappush(active, x)
        out = np.array(tok, np.int32)
        alive = out >= 0
        sizes = np.add.reduceat(alive.astype(np.int64), np.append(0, stop[:-1]))
        return out[alive], sizes


def starts_between(cp: np.ndarray, cls: np.ndarray, fresh: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Where pieces start within [lo, hi); what lies around that stretch is looked at too."""
    a, b = max(lo - NEAR, 0), min(hi + NEAR, len(cp))
    return lo + np.flatnonzero(piece_starts(cp[a:b], cls[a:b], fresh[a:b])[lo - a : hi - a])


def chunk_end(cp: np.ndarray, cls: np.ndarray, fresh: np.ndarray, at: int) -> int:
    """The last start of a piece (or the end) within CHUNK of ``at``, else the next one after it."""
    n, far = len(cp), at + CHUNK
    if far >= n:
        return n
    step = 1024
    hi = far + 1
    while hi > at + 1:  # backwards, in growing steps
        lo = max(at + 1, hi - step)
        found = starts_between(cp, cls, fresh, lo, hi)
        if len(found):
            return int(found[-1])
        hi, step = lo, step * 4
    lo = far + 1
    while lo < n:
        hi = min(n, lo + CHUNK)
        found = starts_between(cp, cls, fresh, lo, hi)
        if len(found):
            return int(found[0])
        lo = hi
    return n


#: The worker's encoder, kept between tasks, by the vocabulary's content.
_WORKER: dict[str, Encoder] = {}


def encode_texts(encoder: Encoder, column: pa.Array) -> pa.Array:
    """A list<int32> column: the ids of every text; empty for null and empty."""
    data, off = text_bytes(column)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    bounds = lead[off]
    fresh = np.zeros(len(cp) + 1, bool)
    fresh[bounds[:-1]] = True
    fresh = fresh[:-1]
    at, parts = 0, []
    ids_at = np.zeros(len(cp) + 1, np.int64)
    cls = encoder.classes[cp]
    while at < len(cp):
        end = chunk_end(cp, cls, fresh, at)
        start = starts_between(cp, cls, fresh, at, end)
        ids, lengths = encoder.encode(cp[at:end], start - at)
        parts.append(ids)
        ids_at[start + 1] = lengths
        at = end
    total = np.cumsum(ids_at)
    return pa.ListArray.from_arrays(pa.array(total[bounds].astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, count) of a string column with about ``size`` bytes each; a longer text is a run of its own."""
    _, off = text_bytes(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, to - at
        at = to


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """One row per row of ``df``: ``key`` and ``ids``, the text's token ids without
    special tokens (their strings are ordinary text).

    Null and empty texts give the empty list; a null key is kept; repeated rows
    stay. Texts of any length are encoded whole, also without any blank. Other columns
    are ignored. ``vocabulary`` is a file; without it, ``VOCABULARY`` is looked for (see
    ``vocabulary_path``) in the folder that the session names in ``FOLDER_SETTING``. It
    (bounded by its file) is sent to the executors once; no shuffle.
    """
    require(df, key, text)
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path(folder=df.sparkSession.conf.get(FOLDER_SETTING, None))
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _WORKER.get(shared.value["key"])
        if encoder is None:
            _WORKER.clear()
            encoder = _WORKER[shared.value["key"]] = Encoder(shared.value)
        for b in batches:
            for i, n in slices(b.column(1), CHUNK):
                part = b.slice(i, n)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_texts(encoder, part.column(1))], [key, ids])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("string").alias(f"{key}_text")).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")
