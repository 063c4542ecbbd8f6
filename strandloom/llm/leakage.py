"""Held-out texts leaking into a corpus, by winnowing.

Method: every run of K words has a hash; of every W consecutive hashes the
smallest is kept as a fingerprint (the last one on ties), in the held-out items
and in the corpus alike.  With K + W - 1 = the wanted span, every shared span
of that many words contains a fingerprint of both.  Fingerprints of corpus and items
are joined by hash; the hits of a document and an item on one diagonal (word place in
the one less that in the other) are one row, which meets both texts again and is
extended word by word, comparing the words themselves.

The items' fingerprints are broadcast only if they were measured to be small;
otherwise the join shuffles fingerprints, never texts. A fingerprint that is
frequent on both sides gives a row for each document and item that have it in common,
as the result does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import lookup_join, materialize, require, ship
from .arrow import mix, ragged, text_bytes

#: Words hashed together; the window follows from the wanted span.
K = 6
#: Bytes of corpus text handled at once.
CHUNK = 4 << 20

_LOWER = np.zeros(256, np.uint8)
_LOWER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_SOFT, _WORD = re.compile(rb"=\r?\n"), re.compile(rb"[A-Za-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        _POWERS[:] = []
        for b in (_BASE, _INVERSE):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _POWERS.append(np.cumprod(a, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, off: np.ndarray, soft_breaks: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end). Words are longest runs
    of ASCII letters and digits, without regard to case; with ``soft_breaks`` a ``=``
    directly before LF or CRLF is first taken out with that break."""
    if soft_breaks and len(data):
        eq = np.flatnonzero(data == 61)
        if len(eq):
            padded = np.concatenate([data, np.zeros(2, np.uint8)])
            row_end = off[np.searchsorted(off, eq, "right")]
            lf = (padded[eq + 1] == 10) & (eq + 1 < row_end)
            crlf = (padded[eq + 1] == 13) & (padded[eq + 2] == 10) & (eq + 2 < row_end)
            keep = np.ones(len(data), bool)
            keep[eq[lf | crlf]] = False
            keep[eq[lf | crlf] + 1] = False
            keep[eq[crlf] + 2] = False
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            data = data[keep]
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low > 0
    first = np.zeros(len(low) + 1, bool)
    first[off[:-1]] = True
    first = first[:-1]
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first))
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    last = np.ones(len(low), bool)
    last[:-1] = first[1:]
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | last)) + 1
    power, unpower = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * power[: len(low)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * unpower[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, off)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words, across text ends too."""
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + h[i : len(h) - k + 1 + i]
    return mix(out)


def winnow(h: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as (hash, word position): of every w consecutive k-grams within a
    text the smallest, the last one on ties."""
    g = gram_hashes(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for i in range(1, w):
        x = g[i : i + n]
        less = x <= best
        best[less] = x[less]
        at[less] = np.flatnonzero(less) + i
    ok = np.zeros(n, bool)  # windows that don't cross a text end
    size = np.diff(bounds) - (k + w - 2)
    ok[ragged(bounds[:-1][size > 0], size[size > 0])] = True
    picked = np.unique(at[ok])
    return g[picked], picked


def plain_words(text: str, soft_breaks: bool) -> list[bytes]:
    """The words of a text, in lower case: those that ``word_hashes`` numbers."""
    data = text.encode()
    if soft_breaks:
        data = _SOFT.sub(b"", data)
    return _WORD.findall(data.lower())


def longest_run(a: list[bytes], b: list[bytes], places: list[int], shift: int) -> tuple[int, int]:
    """(words, first place in a) of the longest run of equal words a[i] = b[i - shift] that
    holds one of ``places`` (sorted); (0, 0) if the words there differ."""
    best, at, end = 0, 0, -1
    lowest, highest = max(0, shift), min(len(a), len(b) + shift)
    for p in places:
        if p < end or not lowest <= p < highest or a[p] != b[p - shift]:
            continue
        lo = hi = p
        while lo > lowest and a[lo - 1] == b[lo - 1 - shift]:
            lo -= 1
        while hi < highest and a[hi] == b[hi - shift]:
            hi += 1
        end = hi
        if hi - lo > best:
            best, at = hi - lo, lo
    return best, at


def _fingerprints(texts: DataFrame, kind: str, soft_breaks: bool, k: int, w: int) -> DataFrame:
    """(id, fp, at) of a table (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, CHUNK * max(b.num_rows, 1) // (b.column(1).nbytes + 1))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                h, bounds = word_hashes(*text_bytes(part.column(1)), soft_breaks)
                fp, at = winnow(h, bounds, k, w)
                row = np.searchsorted(bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(fp.view(np.int64)), pa.array((at - bounds[row]).astype(np.int32))], ["id", "fp", "at"])

    return texts.mapInArrow(run, f"id {kind}, fp long, at int")


def leaked_items(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, span: int = 12, soft_breaks: bool = True, k: int = K) -> DataFrame:
    """Documents that share ``span`` consecutive words with a held-out item:
    key, item key, ``span_words`` (longest common run) and ``at_word`` (where it
    starts in the document, from 0; the first of the longest).

    Words are longest runs of ASCII letters and digits, compared without case;
    with ``soft_breaks`` a ``=`` before a line break joins the lines in the corpus.
    Null and short texts share nothing; null keys are left out. One row for each
    document and item: of several texts under one key, the longest run of all. An empty
    side gives an empty result. Other columns are ignored. Runs jobs.
    """
    require(corpus, key, text)
    require(items, item_key, item_text)
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    spark = corpus.sparkSession
    ship(spark)
    w = span - k + 1
    kind, item_kind = corpus.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    docs = corpus.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and length(text) >= " + str(span))
    held = items.select(F.col(item_key).alias("id"), F.col(item_text).cast("string").alias("text")).filter("id is not null and length(text) >= " + str(span)).distinct()
    theirs = materialize(_fingerprints(held, item_kind, False, k, w).distinct().select("fp", F.col("id").alias("item"), F.col("at").alias("item_at")))
    ours = _fingerprints(docs, kind, soft_breaks, k, w)
    hits = lookup_join(ours, theirs, ["fp"]).groupBy("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.array_sort(F.collect_set("at")).alias("places"))
    # the diagonals of one document and item travel together with its text once
    pairs = materialize(hits.groupBy("id", "item").agg(F.collect_list(F.struct("shift", "places")).alias("hits")))
    touched = materialize(pairs.df.select("id").distinct())
    texts = lookup_join(docs, touched, ["id"])
    known = materialize(held.select(F.col("id").alias("item"), F.col("text").alias("item_text")))
    both = lookup_join(texts.join(pairs.df, "id"), known, ["item"]).select("id", "item", "text", "item_text", "hits")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[str, list[bytes]] = {}
        for b in batches:
            rows = []
            last, words = None, []
            for i in range(b.num_rows):
                t, it = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                if t != last:
                    last, words = t, plain_words(t, soft_breaks)
                if it not in mine:
                    if len(mine) > 1000:
                        mine.clear()
                    mine[it] = plain_words(it, False)
                runs = [longest_run(words, mine[it], x["places"], x["shift"]) for x in b.column(4)[i].as_py()]
                n, at = max(runs, key=lambda r: (r[0], -r[1]))
                if n >= span:
                    rows.append((i, n, at))
            if rows:
                pick, n, at = (pa.array(x, pa.int32()) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), n, at], ["id", "item", "span_words", "at_word"])

    found = both.mapInArrow(extend, f"id {kind}, item {item_kind}, span_words int, at_word int")
    best = found.groupBy("id", "item").agg(F.max(F.struct("span_words", (-F.col("at_word")).alias("before"))).alias("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item_key), F.col("b.span_words").alias("span_words"), (-F.col("b.before")).alias("at_word"))
