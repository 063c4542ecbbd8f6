"""Long exact spans shared between records, by compact windows.

Method: the tokens of a sequence are its q-grams inside runs of allowed letters;
each has a hash.  A Cartesian tree over the hashes gives every token its compact
window: the widest stretch in which it is the (leftmost) minimum.  All spans of
t = span - q + 1 tokens that share a minimum lie in one window, so two records
can only share a span if windows of both have the same minimum hash.  One hash
function is enough for exact spans: equal spans have equal minima, so windows are
grouped by that hash and no interval join over several hashes is needed.

Windows are pre-aggregated by minimum hash; only those seen with two records go
on.  Their spans are then told apart by their letters, packed into a few integers
without loss (two bits a letter for four letters), again by pre-aggregation and
never by pairs, so a third of all records being copies costs no more than any
other third.  No row but a sequence's own carries letters beyond one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, require, ship
from .arrow import mix, ragged, text_bytes

#: Letters of a q-gram token.
Q = 16


def nearest_smaller(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Cartesian trees over h, as windows: for each i the first and last index of
    the widest stretch within [lo[i], hi[i]] where h[i] is the leftmost minimum.
    Pointer jumping over all sequences at once."""
    n = len(h)
    idx = np.arange(n)
    left = idx - 1
    live = np.flatnonzero(left >= lo)
    while len(live):
        c = left[live]
        go = h[c] > h[live]
        live, c = live[go], c[go]
        left[live] = left[c]
        live = live[left[live] >= lo[live]]
    right = idx + 1
    live = np.flatnonzero(right <= hi)
    while len(live):
        c = right[live]
        go = h[c] >= h[live]
        live, c = live[go], c[go]
        right[live] = right[c]
        live = live[right[live] <= hi[live]]
    return left + 1, right - 1


def compact_windows(data: np.ndarray, offsets: np.ndarray, span: int, letters: bytes, q: int = Q):
    """(row, min hash, first letter, min token, last letter) of every compact window
    that holds at least one span; letters count within the row."""
    ok = np.zeros(256, bool)
    ok[np.frombuffer(letters, np.uint8)] = True
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < span:
        return empty, empty.astype(np.uint64), empty, empty, empty
    good = ok[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    breaks = np.flatnonzero(~good[1:] | ~good[:-1] | (row[1:] != row[:-1])) + 1
    starts = np.concatenate([[0], breaks])
    lengths = np.diff(np.concatenate([starts, [n]]))
    keep = good[starts] & (lengths >= span)
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return empty, empty.astype(np.uint64), empty, empty, empty
    h = np.zeros(n - q + 1, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x100000001B3) + data[k : n - q + 1 + k].astype(np.uint64)
    h = mix(h)
    tokens = lengths - q + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(tokens)[:-1]]), tokens) + np.arange(tokens.sum())
    first = np.repeat(np.concatenate([[0], np.cumsum(tokens)[:-1]]), tokens)
    last = np.repeat(np.cumsum(tokens) - 1, tokens)
    hh = h[at]
    lo, hi = nearest_smaller(hh, first, last)
    wide = np.flatnonzero(hi - lo + 1 >= span - q + 1)
    r = row[at[wide]]
    base = offsets[r]
    return r, hh[wide], at[lo[wide]] - base, at[wide] - base, at[hi[wide]] + q - base


def pack_spans(data: np.ndarray, at: np.ndarray, span: int, letters: bytes) -> np.ndarray:
    """(len(at), k) integers that spell the ``span`` letters from each place: equal rows
    are equal spans and the other way round. All letters of the spans must be allowed ones."""
    code = np.zeros(256, np.uint64)
    code[np.frombuffer(letters, np.uint8)] = np.arange(len(letters))
    bits = max(1, (len(letters) - 1).bit_length())
    per = 64 // bits  # letters of an integer
    runs = {1: code[data]}  # run[i]: the letters from i on, as one integer
    n = 1
    while 2 * n <= min(per, span):
        x = runs[n]
        runs[2 * n] = (x[:-n] << np.uint64(bits * n)) | x[n:] if len(x) > n else x[:0]
        n *= 2
    width = n  # a power of two; the last integer may overlap the one before
    places = [*range(0, span - width + 1, width)]
    if places[-1] + width < span:
        places.append(span - width)
    return np.stack([runs[width][at + p] for p in places], 1) if len(at) else np.empty((0, len(places)), np.uint64)


def _owner(column) -> list:
    """Two independent 64-bit hashes of a record's id: ids are compared by both."""
    return [F.xxhash64(column).alias("h1"), F.xxhash64(F.lit(7), column).alias("h2")]


#: Whether the rows of a group belong to two records or more.
_TWO = "max(many) or min(h1) <> max(h1) or min(h2) <> max(h2)"


def shared_spans(df: DataFrame, record: str, sequence: str, span: int = 40, letters: str = "ACGT") -> DataFrame:
    """Per record how much of it is shared: ``record``, ``shared_bp``, ``spans``.

    A span is ``span`` or more consecutive ``letters`` of ``sequence``; it is shared
    if it occurs in a record of another id. ``shared_bp`` counts the positions in
    shared spans, ``spans`` the separate stretches they form. Only records with a
    shared span come out. Rows with a null id or sequence, and sequences without a
    span, give none. Rows of one id with the same sequence count once; of one id
    with several sequences a position counts once that is shared in any of them, and
    they don't count as another record. Other columns are ignored. Intermediate rows
    hold record numbers, places and packed spans, so their size grows with the length
    of a sequence and not with its square. Ids are told apart by 128 hash bits. Runs jobs.
    """
    require(df, record, sequence)
    ship(df.sparkSession)
    if span < Q:
        raise ValueError(f"span must be at least {Q}")
    if not letters.isascii() or len(set(letters)) != len(letters) or not letters:
        raise ValueError("letters must be different ASCII letters")
    allowed = letters.encode()
    # non-ASCII letters would make byte and letter offsets differ; they are no letters of a span, so they become one byte
    plain = F.regexp_replace(sequence, r"[^\x00-\x7F]", "?")
    rows = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("rid"), plain.alias("seq")).filter(F.length("seq") >= span)
    digest = [F.xxhash64("seq").alias("d1"), F.xxhash64(F.lit(7), F.col("seq")).alias("d2")]
    # copies: one row per distinct sequence, with an owner and whether it has several
    owned = rows.select("seq", *_owner(F.col("rid"))).withColumn("many", F.lit(False))
    texts = materialize(owned.groupBy("seq").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"), F.expr(_TWO).alias("many")).withColumn("no", F.monotonically_increasing_id()))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column("seq"))
            r, h, first, mid, last = compact_windows(data, off, span, allowed)
            lo, hi = np.maximum(first, mid + Q - span), np.minimum(mid, last - span)  # the spans of a window hold its minimum
            ok = lo <= hi
            pick = pa.array(r[ok])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in ("no", "h1", "h2", "many")), pa.array(h[ok].view(np.int64)), pa.array(lo[ok].astype(np.int32)), pa.array(hi[ok].astype(np.int32))], ["no", "h1", "h2", "many", "least", "lo", "hi"])

    windows = materialize(texts.df.select("no", "seq", "h1", "h2", "many").mapInArrow(windows_of, "no long, h1 long, h2 long, many boolean, least long, lo int, hi int"))
    common = windows.df.groupBy("least").agg(F.expr(_TWO).alias("two")).filter("two").select("least")
    # a sequence's candidate windows (no more than it has letters) meet its letters again
    found = windows.df.join(common, "least", "left_semi").groupBy("no").agg(F.collect_list(F.struct("lo", "hi")).alias("w"))
    candidates = texts.df.select("no", "seq", "h1", "h2", "many").join(found, "no")
    keys = [f"k{i}" for i in range(pack_spans(np.empty(0, np.uint8), np.empty(0, np.int64), span, allowed).shape[1])]

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column("seq"))
            w = b.column("w")
            n = np.diff(np.asarray(w.offsets))
            flat = w.flatten()
            lo, hi = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            row = np.repeat(np.repeat(np.arange(b.num_rows), n), hi - lo + 1)
            at = ragged(lo, hi - lo + 1)
            packed = pack_spans(data, at + off[row], span, allowed)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in ("no", "h1", "h2", "many")), pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(packed[:, i]).view(np.int64)) for i in range(len(keys)))], ["no", "h1", "h2", "many", "at", *keys])

    exact = materialize(candidates.select("no", "seq", "h1", "h2", "many", "w").mapInArrow(spans_of, "no long, h1 long, h2 long, many boolean, at int, " + ", ".join(f"{k} long" for k in keys)))
    windows.drop()
    hit = exact.df.groupBy(*keys).agg(F.expr(_TWO).alias("two")).filter("two").select(*keys)
    spots = materialize(exact.df.join(hit, keys, "left_semi").groupBy("no").agg(F.array_sort(F.collect_list("at")).alias("at")))
    exact.drop()
    holds = materialize(rows.select("rid", *digest).distinct().join(texts.df.select("no", *digest).join(spots.df.select("no"), "no"), ["d1", "d2"]).select("rid", "no"))
    several = holds.df.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rid")
    figures = lambda df: df.select("rid", _covered(F.col("at"), span).alias("f")).select(F.col("rid").alias(record), F.col("f.bp").alias("shared_bp"), F.col("f.n").alias("spans"))
    once = holds.df.join(several, "rid", "left_anti").join(spots.df.select("no", _covered(F.col("at"), span).alias("f")), "no")
    once = once.select(F.col("rid").alias(record), F.col("f.bp").alias("shared_bp"), F.col("f.n").alias("spans"))
    # ids with several sequences: the places of all of them, each once (no more than the longest has letters)
    union = holds.df.join(several, "rid", "left_semi").join(spots.df, "no").select("rid", F.explode("at").alias("at")).groupBy("rid").agg(F.array_sort(F.collect_set("at")).alias("at"))
    return once.unionByName(figures(union))


def _covered(at, span: int):
    """(bp, n) of the union of [at, at + span) over sorted starts: letters and stretches."""
    step = lambda s, x: F.struct(
        (s["bp"] + F.least(x - s["last"], F.lit(span))).cast("int").alias("bp"),
        (s["n"] + F.when(x - s["last"] > span, 1).otherwise(0)).cast("int").alias("n"),
        x.alias("last"),
    )
    start = F.struct(F.lit(0).alias("bp"), F.lit(0).alias("n"), F.lit(-2 * span).alias("last"))
    return F.aggregate(at, start, step)
