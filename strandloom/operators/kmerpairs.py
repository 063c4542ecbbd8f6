"""Pairs of sequences that share many k-mers, without a row for each k-mer they share.

A sequence's k-mers are dealt into GROUPS groups by a hash. A group's k-mers with all their
sequences come to one task, which counts pairs in arrays. Of two sequences that share ``need``
k-mers at least ceil(need / GROUPS) are shared in some group, so only such pairs leave a task; they are verified
on the whole sequences. What is shuffled grows with the k-mers and not with the pairs that share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of k-mers, and how many shared k-mers a task lists at once.
GROUPS, LISTED = 16, 3_000_000

_LETTER = np.full(128, 4, np.uint8)
_LETTER[[ord(x) for x in "ACGT"]] = range(4)
_SWAP = str.maketrans("ACGT", "TGCA")


def _named(kmer: str) -> int:
    """A negative code for a k-mer of other letters or of more than 31 (63 bits of a hash)."""
    kmer = min(kmer, kmer.translate(_SWAP)[::-1])
    return -1 - (int.from_bytes(hashlib.blake2b(kmer.encode(), digest_size=8).digest()) >> 1)


def _rolled(letters: np.ndarray, k: int) -> np.ndarray:
    """The canonical code of each window of k letters 0 to 3, lengths doubled from one letter on."""
    letters = letters.astype(np.int32 if k <= 15 else np.int64)
    other, n = 3 - letters, 1
    there, back = letters, other
    for bit in bin(k)[3:]:
        there, back = (there[:-n] << 2 * n) + there[n:], back[:-n] + (back[n:] << 2 * n)
        n *= 2
        if bit == "1":
            there, back = (there[:-1] << 2) + letters[n:], back[:-1] + (other[n:] << 2 * n)
            n += 1
    return np.minimum(there, back).astype(np.int64)


def _distinct(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return rows[new], codes[new]


def cut(seqs: pa.Array, k: int, keep: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct canonical k-mers without N of each row's list of upper-case sequences, sorted; only codes that ``keep`` picks."""
    seqs = seqs.combine_chunks() if isinstance(seqs, pa.ChunkedArray) else seqs
    texts = seqs.flatten().to_pylist()
    row = np.repeat(np.arange(len(seqs)), seqs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    text = "".join(texts)
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(x) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = owner[: len(x) - k + 1] == owner[k - 1 :]
    plain = _LETTER[np.minimum(x, 127)]
    plain[x > 127] = 4
    before = lambda hit: np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
    windows = lambda hit: (lambda c: c[k:] - c[:-k])(before(hit)) > 0
    other = windows(plain == 4) if k <= 31 else np.ones(len(inside), bool)
    odd = np.flatnonzero(inside & other & ~windows(x == ord("N")))
    named = np.array([_named(text[at : at + k]) for at in odd.tolist()], np.int64)
    at = np.flatnonzero(inside & ~other)
    codes = _rolled(plain & 3, k)[at] if k <= 31 else np.zeros(0, np.int64)
    if keep is not None:
        here, there = keep(codes), keep(named)
        at, codes, odd, named = at[here], codes[here], odd[there], named[there]
    rows = row[owner[at]]
    if len(seqs) and 2 * k + len(seqs).bit_length() < 63:  # a row and its code in one number
        both = rows << 2 * k | codes
        both.sort()
        both = both[np.r_[len(both) > 0, both[1:] != both[:-1]][: len(both)]]
        rows, codes = both >> 2 * k, both & (1 << 2 * k) - 1
    else:
        rows, codes = _distinct(rows, codes)
    if not len(odd):
        return rows, codes
    odd, named = _distinct(row[owner[odd]], named)  # their codes are negative, so they come first
    rows, codes = np.r_[odd, rows], np.r_[named, codes]
    order = np.argsort(rows, kind="stable")
    return rows[order], codes[order]


def _dealt(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(s, w, seqs) to (part, s, n, w, codes): a row for each group in which a sequence has k-mers."""
    for b in batches:
        rows, codes = cut(b["seqs"], k)
        n = np.bincount(rows, minlength=b.num_rows)
        part = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GROUPS
        order = np.lexsort((part, rows))
        rows, part, codes = rows[order], part[order], codes[order]
        first = np.flatnonzero(np.r_[len(rows) > 0, (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])][: len(rows)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)].astype(np.int32)), pa.array(codes))
        of = rows[first]
        s, w = (b[c].to_numpy(zero_copy_only=False)[of] for c in ("s", "w"))
        yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(s), pa.array(n[of].astype(np.int32)), pa.array(w), lists], ["part", "s", "n", "w", "codes"])


def _listed(ids: np.ndarray, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs a < b of ``ids`` (ascending within each run) that have runs in common, with how many: (a, b, count)."""
    size = np.diff(np.r_[runs, len(ids)])
    left = np.repeat(runs + size, size) - np.arange(len(ids)) - 1
    by = np.argsort(ids, kind="stable")
    total = np.cumsum(left[by])
    ends = np.r_[np.flatnonzero(np.diff(ids[by])) + 1, len(by)] if len(by) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(by):
        done = total[lo - 1] if lo else 0
        at = max(np.searchsorted(total[ends - 1], done + LISTED, "right") - 1, np.searchsorted(ends, lo, "right"))
        hi = int(ends[at])
        p, lo = by[lo:hi], hi
        m = left[p]
        start = np.cumsum(m) - m
        b = ids[np.repeat(p + 1 - start, m) + np.arange(m.sum())]
        pair = np.repeat(ids[p], m) * (int(ids.max()) + 1) + b
        pair.sort()
        first = np.flatnonzero(np.r_[len(pair) > 0, pair[1:] != pair[:-1]][: len(pair)])
        yield *np.divmod(pair[first], int(ids.max()) + 1), np.diff(np.r_[first, len(pair)])


def _counted(batches: Iterator[pa.RecordBatch], min_shared: float, max_freq: int) -> Iterator[pa.RecordBatch]:
    """One group's rows to (a, b, null), pairs that may share enough, and (s, null, codes), the k-mers of s that are too frequent."""
    t = pa.Table.from_batches(list(batches), schema=pa.schema([("part", pa.int32()), ("s", pa.int64()), ("n", pa.int32()), ("w", pa.int64()), ("codes", pa.list_(pa.int64()))]))
    s, n, w = (t[c].to_numpy() for c in ("s", "n", "w"))
    lists = t["codes"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    codes, ids = lists.flatten().to_numpy(), np.repeat(np.arange(len(s)), lists.value_lengths().to_numpy(zero_copy_only=False))
    del t, lists
    order = np.argsort(codes, kind="stable")
    codes, ids = codes[order], ids[order]
    del order
    runs = np.flatnonzero(np.r_[len(codes) > 0, codes[1:] != codes[:-1]][: len(codes)])
    size = np.diff(np.r_[runs, len(codes)])
    freq = np.add.reduceat(w[ids], runs) if len(runs) else size
    hot = np.repeat(freq > max_freq, size)
    if hot.any():
        hid, hcode = ids[hot], codes[hot]
        order = np.argsort(hid, kind="stable")
        hid, hcode = hid[order], hcode[order]
        first = np.flatnonzero(np.r_[True, hid[1:] != hid[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(hid)].astype(np.int32)), pa.array(hcode))
        yield pa.RecordBatch.from_arrays([pa.array(s[hid[first]]), pa.nulls(len(first), pa.int64()), lists], ["a", "b", "hot"])
    used = ~hot & np.repeat(size > 1, size)
    codes, ids = codes[used], ids[used]
    runs = np.flatnonzero(np.r_[len(codes) > 0, codes[1:] != codes[:-1]][: len(codes)])
    for a, b, count in _listed(ids, runs):
        may = count * GROUPS >= np.ceil(np.minimum(n[a], n[b]) * min_shared - 1e-9)
        x, y = s[a[may]], s[b[may]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.list_(pa.int64()))], ["a", "b", "hot"])


def _both(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) that are in both; neither repeats one."""
    rows, codes = np.r_[x[0], y[0]], np.r_[x[1], y[1]]
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    twice = np.flatnonzero((rows[1:] == rows[:-1]) & (codes[1:] == codes[:-1]))
    return rows[twice], codes[twice]


def _verified(batches: Iterator[pa.RecordBatch], k: int, min_shared: float) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb, hot) to (a, b, shared, smaller) of those that share enough k-mers outside ``hot``."""
    for b in batches:
        sa, sb = cut(b["sa"], k), cut(b["sb"], k)
        shared = _both(sa, sb)
        hot = np.repeat(np.arange(b.num_rows), b["hot"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), b["hot"].flatten().to_numpy(zero_copy_only=False)
        count = lambda x: np.bincount(x[0], minlength=b.num_rows)  # noqa: B023, E731
        common, smaller = count(shared) - count(_both(shared, hot)), np.minimum(count(sa), count(sb))
        good = np.flatnonzero((common > 0) & (common >= smaller * min_shared))
        yield pa.RecordBatch.from_arrays([b["a"].take(pa.array(good)), b["b"].take(pa.array(good)), pa.array(common[good]), pa.array(smaller[good])], ["a", "b", "shared", "smaller"])


def classes(df: DataFrame, key: str, seq: str):
    """(table, members): a table of the distinct sequences (s, c the smallest key, w keys, seqs) and (key, s) of every key."""
    from ..plans.runtime import materialize

    each = df.filter(F.col(seq).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.upper(F.col(seq)))).alias("seqs"))
    table = materialize(each.groupBy("seqs").agg(F.min(key).alias("c"), F.count(F.lit(1)).alias("w")).select(F.monotonically_increasing_id().alias("s"), "c", "w", "seqs"))
    alone = table.df.filter("w = 1").select(F.col("c").alias(key), "s")
    return table, alone.unionByName(each.join(table.df.filter("w > 1").select("seqs", "s"), "seqs").select(key, "s"))


def class_edges(table: DataFrame, k: int, min_shared: float, max_freq: int) -> DataFrame:
    """(a, b, shared, smaller), a <= b: classes whose sequences share enough k-mers of those in at most
    ``max_freq`` sequences; a class of two or more may be linked with itself. Runs jobs."""
    from ..plans.runtime import materialize, ship

    ship(table.sparkSession)
    dealt = table.select("s", "w", "seqs").mapInArrow(lambda x: _dealt(x, k), "part int, s long, n int, w long, codes array<long>")
    # a group is one task; the rows of a group come together and are not written in between
    found = materialize(dealt.repartitionById(GROUPS, F.col("part")).mapInArrow(lambda x: _counted(x, min_shared, max_freq), "a long, b long, hot array<long>")).df
    pairs = found.filter("b is not null").select("a", "b").distinct().unionByName(table.filter("w > 1").select(F.col("s").alias("a"), F.col("s").alias("b")))
    hot = found.filter("b is null").groupBy("a").agg(F.flatten(F.collect_list("hot")).alias("hot"))
    side = lambda s, seqs: table.select(F.col("s").alias(s), F.col("seqs").alias(seqs))
    whole = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").join(hot, "a", "left").select("a", "b", "sa", "sb", "hot")
    return whole.mapInArrow(lambda x: _verified(x, k, min_shared), "a long, b long, shared long, smaller long")
