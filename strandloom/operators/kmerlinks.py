"""Links of sequences that share many k-mers, without a shuffled row for a k-mer, a pair or a link.

Sequences are dealt into blocks by a hash. A task holds the k-mers of one block by their codes and reads
the other blocks against them (each two blocks meet in one task), so a pair's shared k-mers are counted
at once and exactly. Of the links a task found only a forest leaves it, which has the same groups, and where they are
asked for the sequences' numbers of links. Equal sequences are one vertex: ``s`` is a hash of 64 bits, and
a second one (``t``) tells where two sequences would have the same. A task's memory holds the sequences of
half the blocks compressed (some 25 bytes each) and the k-mers of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmerpairs import cut

#: Sequences in a block, pairs a task lists at once, and in how many sequences of a block a k-mer is frequent.
BLOCK, LISTED, FREQUENT = 65_536, 3_000_000, 100


def sequences(df: DataFrame, key: str, seq: str):
    """A table of (key, s, t, times, longest, seqs): a row for each key with its distinct sequences, rows in ``df`` and greatest length."""
    from ..plans.runtime import materialize

    own = F.array_sort(F.collect_set(F.upper(F.col(seq)))).alias("seqs")
    each = df.filter(F.col(seq).isNotNull()).groupBy(key).agg(own, F.count(F.lit(1)).alias("times"), F.max(F.length(seq)).alias("longest"))
    return materialize(each.select(key, F.xxhash64("seqs").alias("s"), F.xxhash64(F.lit(1), "seqs").alias("t"), "times", "longest", "seqs"), compression="zstd")


def _frequent(batches: Iterator[pa.RecordBatch], k: int, part: int, parts: int, max_freq: int) -> Iterator[pa.RecordBatch]:
    """(seqs) to the k-mers of one part that more than ``max_freq`` rows have."""
    codes = [np.zeros(0, np.int64)]
    for b in batches:
        codes.append(cut(b["seqs"], k, lambda x: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts == part)[1])
    all_codes = np.concatenate(codes)
    del codes
    all_codes.sort()
    first = np.flatnonzero(np.r_[len(all_codes) > 0, all_codes[1:] != all_codes[:-1]][: len(all_codes)])
    hot = all_codes[first[np.diff(np.r_[first, len(all_codes)]) > max_freq]]
    for i in range(0, len(hot), 1_000_000):
        yield pa.RecordBatch.from_arrays([pa.array(hot[i : i + 1_000_000])], ["code"])


class _Forest:
    """Groups of vertices; ``join`` tells which links joined two."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        new = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                new[i] = True
        return new


class _Index:
    """The vertices that have a code, as runs of ``owner`` (by label, then vertex)."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, k: int, label: np.ndarray | None = None):
        order = np.argsort(codes, kind="stable") if label is None else np.lexsort((owner, label[owner], codes))
        self.codes, self.owner, self.table = codes[order], owner[order], None
        if k <= 11:
            self.odd = int(np.searchsorted(self.codes, 0))
            self.table = np.r_[0, np.cumsum(np.bincount(self.codes[self.odd :], minlength=4**k))].astype(np.int32) + np.int32(self.odd)
        if label is not None:
            self.rank = np.cumsum(np.r_[len(codes) > 0, self.codes[1:] != self.codes[:-1]][: len(codes)])
            self.width = len(label)
            self.by = self.rank * self.width + label[self.owner]

    def runs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            return np.searchsorted(self.codes, codes, "left"), np.searchsorted(self.codes, codes, "right")
        at = np.maximum(codes, 0)
        lo, hi = self.table[at], self.table[at + 1]
        odd = np.flatnonzero(codes < 0)
        lo[odd], hi[odd] = (np.searchsorted(self.codes[: self.odd], codes[odd], side) for side in ("left", "right"))
        return lo, hi

    def labelled(self, lo: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the owners of one label lie in the runs that begin at ``lo``."""
        x = self.rank[lo] * self.width + label
        return np.searchsorted(self.by, x, "left"), np.searchsorted(self.by, x, "right")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    first = np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]][: len(x)])
    return x[first], np.diff(np.r_[first, len(x)])


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, and so on."""
    m = (hi - lo).astype(np.int64)
    return np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(m.sum())


def _counted(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, owner, how often they meet) over stretches of ``owner``; the stretches of one row come together."""
    total = np.cumsum(hi - lo, dtype=np.int64)
    ends = np.r_[np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)] if len(row) else np.zeros(0, np.int64)
    at = 0
    while at < len(row):
        done = total[at - 1] if at else 0
        i = max(np.searchsorted(total[ends - 1], done + LISTED, "right") - 1, np.searchsorted(ends, at, "right"))
        p, at = slice(at, int(ends[i])), int(ends[i])
        pair = np.repeat(row[p].astype(np.int64), hi[p] - lo[p]) * n + owner[_spread(lo[p], hi[p])]
        pair.sort()
        pair, count = _runs(pair)
        yield *np.divmod(pair, n), count


def _common(a: tuple[np.ndarray, np.ndarray], x: np.ndarray, b: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> np.ndarray:
    """Shared codes of the pairs (x, y); ``a`` and ``b`` are (start of each row, codes)."""
    out = np.zeros(len(x), np.int64)
    for i in range(0, len(x), 20_000):
        pair, code = [], []
        for (start, codes), at in ((a, x[i : i + 20_000]), (b, y[i : i + 20_000])):
            pair.append(np.repeat(np.arange(len(at)), start[at + 1] - start[at]))
            code.append(codes[_spread(start[at], start[at + 1])])
        p, c = np.concatenate(pair), np.concatenate(code)
        if len(c) and (c.min() < 0 or c.max() >= 1 << 47):
            c = np.unique(c, return_inverse=True)[1]
        both = p << 47 | c
        both.sort()
        out[i : i + 20_000] = np.bincount(both[1:][both[1:] == both[:-1]] >> 47, minlength=min(20_000, len(x) - i))
    return out


def _linked(batches: Iterator[pa.RecordBatch], k: int, block: int, blocks: int, min_shared: float, degrees: bool, frequent: int) -> Iterator[pa.RecordBatch]:
    """(s, t, seqs) of all rows to (a, b, null), a forest of one block's links with itself and with the
    blocks it meets, and (s, null, links of s in this task) if ``degrees``. Rows without t are codes to leave out."""
    ids, checks, hot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kind, sink = pa.schema([("seqs", pa.list_(pa.string()))]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for b in batches:
            if b["t"].null_count:
                hot.append(b.filter(b["t"].is_null())["s"].to_numpy(zero_copy_only=False))
                b = b.filter(b["t"].is_valid())
            s = b["s"].to_numpy(zero_copy_only=False)
            other = np.mod(s, blocks)
            ahead = (other - block) % blocks
            at = np.flatnonzero((2 * ahead < blocks) | (2 * ahead == blocks) & (block < other))
            if len(at):
                ids.append(s[at])
                checks.append(b["t"].to_numpy(zero_copy_only=False)[at])
                writer.write_batch(pa.RecordBatch.from_arrays([b["seqs"].take(pa.array(at)).cast(kind.field(0).type)], schema=kind))
    kept, all_ids, check, hot = sink.getvalue(), np.concatenate(ids), np.concatenate(checks), np.unique(np.concatenate(hot))
    own, first, vertex, w = np.unique(all_ids, return_index=True, return_inverse=True, return_counts=True)
    if (check[first][vertex] != check).any():
        raise RuntimeError("two sequences have one hash")
    once, indexed, n = np.zeros(len(all_ids), bool), np.mod(own, blocks) == block, np.zeros(len(own), np.int64)
    once[first] = True
    del all_ids, check, checks, ids, first

    def replayed(which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vertices, row, code) of the rows asked for, a batch at a time, without hot codes."""
        done = 0
        for b in pa.ipc.open_stream(kept):
            at = np.flatnonzero(which[done : done + b.num_rows])
            v, done = vertex[done + at], done + b.num_rows
            row, code = cut(b["seqs"].take(pa.array(at)), k)
            n[v] = np.bincount(row, minlength=len(v))
            if len(hot):
                cold = hot[np.minimum(np.searchsorted(hot, code), len(hot) - 1)] != code
                row, code = row[cold], code[cold]
            yield v, row, code

    owner, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for v, row, code in replayed(once & indexed[vertex]):
        owner.append(v[row])
        codes.append(code)
    owner, codes = np.concatenate(owner), np.concatenate(codes)
    index, forest, degree = _Index(codes, owner, k), _Forest(len(own)), np.zeros(len(own) if degrees else 0, np.int64)

    def enough(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return (shared > 0) & (shared >= np.minimum(n[x], n[y]) * min_shared)

    def tree(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        new = forest.join(x, y)
        a, b = own[x[new]], own[y[new]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "degree"])

    copies = np.flatnonzero(indexed & (w > 1))
    copies = copies[enough(copies, copies, np.bincount(owner, minlength=len(own))[copies])]
    if degrees:
        degree[copies] += w[copies] - 1
    yield pa.RecordBatch.from_arrays([pa.array(own[copies])] * 2 + [pa.nulls(len(copies), pa.int64())], ["a", "b", "degree"])

    # a large family's members are linked with the few that begin, halve or end their frequent k-mers' runs, and then with none of that group again
    label, mine = None, None
    many = not degrees and bool((_runs(index.codes)[1] > frequent).any())

    def met(v: np.ndarray, row: np.ndarray, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (place in v, vertex) with vertices that many frequent k-mers of a row name."""
        often = np.flatnonzero(hi - lo > frequent)
        named = np.concatenate([row[often].astype(np.int64) * len(own) + index.owner[at] for at in (lo[often], (lo[often] + hi[often]) // 2, hi[often] - 1)])
        named.sort()
        pair, count = _runs(named)
        i, y = np.divmod(pair, len(own))
        likely = (8 * count >= np.bincount(row[often], minlength=len(v))[i]) & (v[i] != y)
        i, y = i[likely], y[likely]
        start = np.r_[0, np.cumsum(np.bincount(row, minlength=len(v)))]
        good = enough(v[i], y, _common((start, code), i, mine, y))
        return i[good], y[good]

    if many:
        order = np.argsort(owner, kind="stable")
        mine = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(own)))], codes[order]
        for v, row, code in replayed(once & indexed[vertex]):
            i, y = met(v, row, code, *index.runs(code))
            yield tree(v[i], y)
        label = np.array([forest.find(x) if here else x for x, here in enumerate(indexed.tolist())])
        index = _Index(codes, owner, k, label)
        members = np.bincount(label[indexed], minlength=len(own))
        size = _runs(index.codes)[1]
        least = n[index.owner[np.repeat(size > frequent, size)]].min()
    del owner, codes
    for v, row, code in replayed(once):
        lo, hi = index.runs(code)
        start, left_out = np.r_[0, np.cumsum(np.bincount(row, minlength=len(v)))], np.zeros(len(v), np.int64)
        if many:
            i, y = met(v, row, code, lo, hi)
            yield tree(v[i], y)
            # the most frequent k-mers are not listed as long as a link must show in four others; such pairs are counted again
            often = np.flatnonzero(hi - lo > frequent)
            often = often[np.lexsort((lo[often] - hi[often], row[often]))]
            may = np.ceil(np.minimum(n[v], least) * min_shared - 1e-9).astype(np.int64) - 4
            out = often[np.arange(len(often)) - np.searchsorted(row[often], row[often]) < may[row[often]]]
            left_out = np.bincount(row[out], minlength=len(v))
            hi[out] = lo[out]
            group = np.where(indexed[v], label[v], -1)
            i, y = (x[np.argsort(members[label[y]], kind="stable")] for x in (i, y))
            group[i] = np.where(indexed[v[i]], group[i], label[y])  # of several, the largest
            known = np.flatnonzero((hi - lo > frequent) & (group[row] >= 0))
            a, b = index.labelled(lo[known], group[row[known]])
            row, lo, hi = np.r_[row, row[known]], np.r_[lo, b], np.r_[hi, hi[known]]
            hi[known] = a
            order = np.argsort(row, kind="stable")
            row, lo, hi = row[order], lo[order], hi[order]
        used = hi > lo
        for i, y, shared in _counted(row[used], lo[used], hi[used], index.owner, len(own)):
            x = v[i]
            good = np.flatnonzero(enough(x, y, shared + left_out[i]) & (~indexed[x] | (y > x)))
            if many:
                again = left_out[i[good]] > 0
                a, b = i[good[again]], y[good[again]]
                again[again] = ~enough(v[a], b, _common((start, code), a, mine, b))
                good = good[~again]
            x, y = x[good], y[good]
            if degrees:
                np.add.at(degree, x, w[y])
                np.add.at(degree, y, w[x])
            yield tree(x, y)
    at = np.flatnonzero(degree)
    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.nulls(len(at), pa.int64()), pa.array(degree[at])], ["a", "b", "degree"])


def _side_by_side(table, rows: DataFrame, tasks: list, schema: str) -> DataFrame:
    """All ``rows`` to each of the tasks (functions for mapInArrow), at the same time."""
    from ..plans.runtime import union_all

    parts = [rows.coalesce(1).mapInArrow(f, schema) for f in tasks]
    # a union of single partitions only would be one partition: a branch without rows (s is never null) keeps them apart
    none = table.df.filter("s is null").select(*[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in schema.split(", "))])
    return union_all([*parts, none])


def links(table, k: int, min_shared: float, max_freq: int | None = None, degrees: bool = False) -> DataFrame:
    """(a, b, null), a forest of the vertices of ``sequences`` that share at least ``min_shared`` of the smaller
    one's k-mers, K-mers in more than ``max_freq`` keys left out if it is given; a vertex of two or more keys may be
    linked with itself. With ``degrees`` also (s, null, links of one of its keys found by a task), to be summed up. Runs jobs."""
    from ..plans.runtime import materialize, ship

    ship(table.spark)
    blocks, frequent = max(1, -(-table.rows() // BLOCK)), FREQUENT
    rows = table.df.select("s", "t", "seqs")
    if max_freq is not None:
        parts = blocks // 2 + 1
        hot = materialize(_side_by_side(table, table.df.select("seqs"), [lambda x, i=i: _frequent(x, k, i, parts, max_freq) for i in range(parts)], "code long")).df
        rows = rows.unionByName(hot.select(F.col("code").alias("s"), F.lit(None).cast("long").alias("t"), F.array().cast("array<string>").alias("seqs")))
    tasks = [lambda x, i=i: _linked(x, k, i, blocks, min_shared, degrees, frequent) for i in range(blocks)]
    return _side_by_side(table, rows, tasks, "a long, b long, degree long")
