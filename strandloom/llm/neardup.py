"""Near-duplicate sets (of shingles, of members) with a MinHash LSH forest.

Method: every distinct set has a label in each of several trees: a sequence of signature
values (MinHash).  All labels are range-partitioned and sorted, which is the forest:
neighbours in that order share the longest prefixes, so a walk over a partition finds the
subtries of at least ``depth`` values and, for each two sets in one, how long their
common prefix is.  Pairs are then verified exactly, those with the longest prefixes
first.  The prefix is shortened by a value as long as the recall so far is below the
target.  That recall is estimated from the pairs found: a pair of similarity s meets in
some of l trees with probability 1 - (1 - s^d)^l, so each found pair stands for one
over that many.  ``depth`` is the shortest prefix: with it, pairs at the threshold itself
reach the target, whatever was found.

Skew: equal sets are one class before anything is paired.  Labels are cut into
partitions of equal size, so a prefix that a third of all sets share lies in many; what
touches a border is walked once more by itself.  A subtrie of more than ``hot`` sets is not
paired inside; its sets go through an exact prefix filter instead (two sets at the
threshold must share one of the rarest few of their items), so no pair is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Table, materialize, require, ship, union_all
from .arrow import mix, ragged, text_bytes

#: Defaults: most trees, signature values of a label beyond the shortest prefix, recall to reach.
TREES, DEEPER, RECALL = 64, 2, 0.9995


def plan(threshold: float, recall: float = RECALL, most: int = TREES) -> tuple[int, int]:
    """(trees, shortest prefix): the longest prefix with which pairs at the threshold meet
    in some of at most ``most`` trees with the target recall, and the trees that takes."""
    for depth in range(16, 0, -1):
        p = threshold**depth
        trees = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if trees <= most:
            return trees, depth
    raise ValueError("no prefix length reaches the recall with so few trees")


def grams(text: Column, n: int) -> Column:
    """The distinct n-letter substrings of a text, as an array; empty if shorter."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def words(text: Column, n: int = 5) -> Column:
    """The distinct n-word shingles of a text (lower case, runs of letters and digits)."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))


def gram_codes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-letter substrings of each row's texts (a list of strings), as sorted
    codes and offsets. Substrings of up to nine ASCII letters are their code (7 bits a
    letter), others a hash with the top bit set."""
    rows = len(texts)
    data, off = text_bytes(texts.flatten())
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    first = lead[off]
    many = np.maximum(np.diff(first) - n + 1, 0)
    at = ragged(first[:-1], many)
    per = np.diff(np.asarray(texts.offsets))
    row = np.repeat(np.repeat(np.arange(rows), per), many)
    code, plain = np.zeros(len(at), np.uint64), np.full(len(at), n <= 9)
    if n <= 9:
        for k in range(n):
            x = cp[at + k]
            plain &= x < 128
            code |= (x & np.uint64(127)) << np.uint64(7 * k)
    if not plain.all():
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cp[at + k] + np.uint64(1))
        code = np.where(plain, code, h | np.uint64(1 << 63))
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(rows + 1))


def _list_codes(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of rows that are lists of int64 already."""
    return np.asarray(items.flatten()).view(np.uint64), np.asarray(items.offsets).astype(np.int64) - int(items.offsets[0].as_py())


def labels(flat: np.ndarray, starts: np.ndarray, trees: int, depth: int, deeper: int = DEEPER) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, rest) of non-empty sets in every tree, (sets, trees) each: a hash of the first
    ``depth`` signature values, and 32 bits for each of up to two further ones."""
    rng = np.random.default_rng(20_241)
    each = depth + deeper
    mult = rng.integers(1, 2**63, trees * each, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, trees * each, np.uint64)
    flat = mix(flat)
    prefix, rest = np.empty((len(starts), trees), np.uint64), np.zeros((len(starts), trees), np.uint64)
    for t in range(trees):
        key = np.full(len(starts), t + 1, np.uint64)
        for d in range(each):
            k = t * each + d
            low = np.minimum.reduceat((flat * mult[k] + add[k]) >> np.uint64(16), starts)
            if d < depth:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
            else:
                rest[:, t] |= (mix(low) & np.uint64(0xFFFFFFFF)) << np.uint64(32 * (depth + 1 - d))
        prefix[:, t] = key
    return prefix, rest


#: What a walk gives: pairs with the length of their common prefix, rows of runs that touch a border, sets of crowded runs.
_PAIR, _EDGE, _CROWDED = 0, 1, 2


def walk_runs(batches, depth: int, hot: int, border: bool):
    """Walks sorted (prefix, rest, cls) batches; yields (kind, a, b, c) arrays.

    Runs of one prefix give their pairs: (cls, cls, common prefix). The first and the
    last run of the stream are given row by row instead if ``border``. Runs of more than
    ``hot`` rows, or with a mark (cls -1), give their sets as crowded, and at a
    border a mark. Holds one batch and at most ``hot`` rows."""
    none = np.empty(0, np.int64)
    key, rest, cls = none, none, none
    crowd, first = None, True  # the prefix of a crowded run that goes on; whether the stream's first run isn't over

    def out(kind, a, b=None, c=None):
        zero = np.zeros(len(a), np.int64)
        return np.full(len(a), kind, np.int8), a, zero if b is None else b, zero if c is None else c

    def marked(k):
        return out(_EDGE, np.array([k]), np.array([0]), np.array([-1]))

    def close(k, r, c, edge):
        """A run at the stream's border, or one that is too long."""
        if len(c) > hot or (c < 0).any():
            yield out(_CROWDED, c[c >= 0])
            if edge:
                yield marked(k[0])
        elif edge:
            yield out(_EDGE, k, r, c)
        elif len(c) > 1:
            yield from pairs(k, r, c)

    def pairs(k, r, c):
        at = np.arange(len(k) - 1)
        d = 1
        while len(at):
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]
            if len(at):
                i, j = at, at + d
                same = depth + ((r[i] >> 32) == (r[j] >> 32)).astype(np.int64) + (r[i] == r[j])
                differ = c[i] != c[j]
                yield out(_PAIR, np.minimum(c[i], c[j])[differ], np.maximum(c[i], c[j])[differ], same[differ])
            d += 1

    for k, r, c in batches:
        if crowd is not None:
            n = int(np.searchsorted(k != crowd, True)) if (k != crowd).any() else len(k)
            if n:
                yield out(_CROWDED, c[:n][c[:n] >= 0])
            k, r, c = k[n:], r[n:], c[n:]
            if not len(k):
                continue
            crowd, first = None, False
        key, rest, cls = np.concatenate([key, k]), np.concatenate([rest, r]), np.concatenate([cls, c])
        if not len(key):
            continue
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = int(begin[-1])
        if last:
            a = 0
            if first:
                a = int(begin[1])
                yield from close(key[:a], rest[:a], cls[:a], border)
                first = False
            size = np.diff(begin)
            bad = np.logical_or.reduceat(cls[:last] < 0, begin[:-1]) | (size > hot)
            for s, n in zip(begin[:-1][bad].tolist(), size[bad].tolist()):
                if s >= a:
                    yield from close(key[s : s + n], rest[s : s + n], cls[s : s + n], False)
            fine = np.repeat(~bad, size)
            fine[:a] = False
            yield from pairs(key[:last][fine], rest[:last][fine], cls[:last][fine])
        key, rest, cls = key[last:], rest[last:], cls[last:]
        if len(key) > hot:
            yield from close(key, rest, cls, border and first)
            crowd = key[0]
            key, rest, cls = none, none, none
    if crowd is not None and border:
        yield marked(crowd)
    if len(key):
        yield from close(key, rest, cls, border)


def _walk(forest: DataFrame, depth: int, hot: int, border: bool) -> Table:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = (tuple(np.asarray(b.column(i)) for i in range(3)) for b in batches if b.num_rows)
        for kind, *values in walk_runs(arrays, depth, hot, border):
            if len(kind):
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), *(pa.array(v, pa.int64()) for v in values)], ["kind", "a", "b", "c"])

    return materialize(forest.mapInArrow(run, "kind byte, a long, b long, c long"), ["kind"])


def similar_pairs(
    df: DataFrame, record: str, items: Column, threshold: float, min_items: int = 1, gram: int | None = None, trees: int = TREES, recall: float = RECALL, hot: int = 2000
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the similar pairs between them.

    Returns (members, pairs): members has ``record`` and ``cls`` (one row per
    record), pairs has cls_a < cls_b and ``similarity`` (Jaccard, exact) of at least
    ``threshold``. ``items`` is an array of strings; repeats and nulls inside it count once
    and not at all. With ``gram`` it is a text, whose items are its substrings of so many
    letters. Records with a null id, null items or fewer than ``min_items`` distinct
    items take no part; several sets of one record are united. Empty tables give
    empty results. Equal sets are told by 128 hash bits. Runs jobs.
    """
    require(df, record)
    spark = df.sparkSession
    ship(spark)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    trees, depth = plan(threshold, recall, trees)
    rows = df.select(F.col(record).alias("rid"), items.alias("x")).filter("rid is not null and x is not null")
    if gram:
        rows = rows.groupBy("rid").agg(F.array_sort(F.collect_set("x")).alias("x"))
    else:
        one = rows.select("rid", F.array_sort(F.array_distinct(F.array_compact("x"))).alias("x"))
        rows = one.groupBy("rid").agg(F.collect_set("x").alias("x")).select("rid", F.when(F.size("x") == 1, F.element_at("x", 1)).otherwise(F.array_sort(F.array_distinct(F.flatten("x")))).alias("x"))
    rows = materialize(rows)
    kind = rows.df.schema["rid"].dataType.simpleString()
    codes = (lambda column: gram_codes(column, gram)) if gram else _list_codes

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = codes(b.column(1))
            total = lambda v: np.diff(np.append(np.uint64(0), np.cumsum(v, dtype=np.uint64))[off])  # noqa: B023, E731
            d1, d2 = total(mix(flat ^ np.uint64(0x5851F42D4C957F2D))), total(mix(flat ^ np.uint64(0x14057B7EF767814F)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(np.diff(off).astype(np.int32))], ["rid", "d1", "d2", "n"])

    if gram:
        sizes = rows.df.mapInArrow(measure, f"rid {kind}, d1 long, d2 long, n int")
    else:
        sizes = rows.df.select("rid", F.xxhash64("x").alias("d1"), F.xxhash64(F.lit(7), F.col("x")).alias("d2"), F.size("x").alias("n"))
    sizes = materialize(sizes.filter(F.col("n") >= max(1, min_items)))
    classes = materialize(sizes.df.groupBy("d1", "d2").agg(F.min("rid").alias("rid")).withColumn("cls", F.monotonically_increasing_id()))
    members = sizes.df.join(classes.df.select("d1", "d2", "cls"), ["d1", "d2"]).select(F.col("rid").alias(record), "cls")
    sets = materialize(rows.df.join(classes.df.select("rid", "cls"), "rid").select("cls", "x"))
    rows.drop()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, off = codes(b.column(1))
            prefix, rest = labels(flat, off[:-1], trees, depth)
            ids = np.repeat(np.asarray(b.column(0)), trees)
            yield pa.RecordBatch.from_arrays([pa.array(prefix.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)), pa.array(ids)], ["prefix", "rest", "cls"])

    coded = sets.df if gram else sets.df.select("cls", F.transform("x", lambda v: F.xxhash64(v)).alias("x"))
    leaves = materialize(coded.mapInArrow(sign, "prefix long, rest long, cls long"))
    order = ["prefix", "rest", "cls"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    walked = _walk(leaves.df.repartitionByRange(parts, *order).sortWithinPartitions(*order), depth, hot, True)
    of_kind = lambda t, k: t.read("kind byte, a long, b long, c long").filter(F.col("kind") == k)
    edges = of_kind(walked, _EDGE).select(F.col("a").alias("prefix"), F.col("b").alias("rest"), F.col("c").alias("cls"))
    again = _walk(edges.repartition("prefix").sortWithinPartitions(*order), depth, hot, False)
    met = union_all([of_kind(t, _PAIR) for t in (walked, again)]).groupBy(F.col("a").alias("cls_a"), F.col("b").alias("cls_b")).agg(F.max("c").alias("common"))
    candidates = materialize(met, ["common"])
    crowded = materialize(union_all([of_kind(t, _CROWDED).select(F.col("a").alias("cls")) for t in (walked, again)]).distinct())
    for t in (leaves, walked, again):
        t.drop()

    found: list[Table] = []
    for level in range(depth + DEEPER, depth - 1, -1):
        here = candidates.read("cls_a long, cls_b long, common int").filter(F.col("common") == level).select("cls_a", "cls_b")
        found.append(materialize(_verified(here, sets.df, codes, gram, threshold)))
        if level > depth and _recall(union_all([t.df for t in found]), level, trees) >= recall:
            break
    pairs = union_all([t.df for t in found])
    if not crowded.df.isEmpty():
        dense = _prefix_filter(_explode_codes(coded.join(crowded.df, "cls", "left_semi"), codes), threshold)
        pairs = pairs.unionByName(_verified(dense.join(pairs.select("cls_a", "cls_b"), ["cls_a", "cls_b"], "left_anti"), sets.df, codes, gram, threshold))
    return members, pairs


def _recall(found: DataFrame, depth: int, trees: int) -> float:
    """The share of all similar pairs that was found with prefixes of ``depth``: each found pair
    stands for as many as its similarity makes it unlikely to meet; 0 if none was found."""
    met = 1 - F.pow(1 - F.pow("similarity", F.lit(depth)), F.lit(trees))
    n, whole = found.agg(F.count(F.lit(1)), F.sum(1 / met)).first()
    return n / whole if n else 0.0


def _verified(candidates: DataFrame, sets: DataFrame, codes, gram: int | None, threshold: float) -> DataFrame:
    left, right = sets.select(F.col("cls").alias("cls_a"), F.col("x").alias("x")), sets.select(F.col("cls").alias("cls_b"), F.col("x").alias("y"))
    both = candidates.join(left, "cls_a").join(right, "cls_b").select("cls_a", "cls_b", "x", "y")
    if gram:

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                (x, ox), (y, oy) = codes(b.column(2)), codes(b.column(3))
                rows = np.arange(b.num_rows)
                row = np.concatenate([np.repeat(rows, np.diff(ox)), np.repeat(rows, np.diff(oy))])
                both = np.concatenate([x, y])
                at = np.lexsort((both, row))
                both, row = both[at], row[at]
                twice = (both[1:] == both[:-1]) & (row[1:] == row[:-1])
                c = np.bincount(row[1:][twice], minlength=b.num_rows)
                u = np.diff(ox) + np.diff(oy) - c
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.astype(np.int64)), pa.array(u.astype(np.int64))], ["cls_a", "cls_b", "c", "u"])

        measured = both.mapInArrow(compare, "cls_a long, cls_b long, c long, u long")
    else:
        c = F.size(F.array_intersect("x", "y"))
        measured = both.select("cls_a", "cls_b", c.alias("c"), (F.size("x") + F.size("y") - c).alias("u"))
    return measured.filter(F.col("c") >= F.col("u") * threshold - 1e-9).select("cls_a", "cls_b", (F.col("c") / F.col("u")).alias("similarity"))


def _explode_codes(coded: DataFrame, codes) -> DataFrame:
    """(cls, size, item) of all items of all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = codes(b.column(1))
            n = np.diff(off)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), n)), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(flat.view(np.int64))], ["cls", "size", "item"])

    return coded.mapInArrow(run, "cls long, size int, item long")


def _prefix_filter(flat: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates: sets that share one of the |s| - ceil(t|s|) + 1 items of
    each that are rarest among them. A hot item's join is split by adaptive execution."""
    flat = materialize(flat).df
    rarity = flat.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(rarity, "item").groupBy("cls", "size").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("r"))
    keep = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    lead = materialize(ranked.select("cls", "size", F.explode(F.slice("r", F.lit(1), keep)).alias("x")).select("cls", "size", "x.item")).df
    a = lead.select(F.col("cls").alias("cls_a"), F.col("size").alias("sa"), "item")
    b = lead.select(F.col("cls").alias("cls_b"), F.col("size").alias("sb"), "item")
    near = (F.col("cls_a") < F.col("cls_b")) & (F.least("sa", "sb") >= F.greatest("sa", "sb") * threshold - 1e-9)
    return a.join(b, "item").filter(near).select("cls_a", "cls_b").distinct()


def record_pairs(members: DataFrame, pairs: DataFrame, record: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """The similar pairs written out between records, smaller id first, equal sets included.
    As long as its result: ``record_links`` says the same in one row per record."""
    left = members.select(F.col(record).alias("r1"), "cls")
    right = members.select(F.col(record).alias("r2"), F.col("cls").alias("other"))
    loops = left.select("cls").distinct().select("cls", F.col("cls").alias("other"))
    linked = pairs.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(loops)
    out = linked.join(left, "cls").join(right, "other").filter((F.col("cls") != F.col("other")) | (F.col("r1") < F.col("r2")))
    return out.select(F.least("r1", "r2").alias(a), F.greatest("r1", "r2").alias(b))


def record_links(members: DataFrame, pairs: DataFrame, record: str) -> DataFrame:
    """One row per record: ``record``, ``class_id`` (the smallest record with an equal set) and
    ``links`` (other records that are alike enough, equal sets included)."""
    size = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min(record).alias("class_id"))
    both = pairs.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(pairs.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    beside = both.join(size.select(F.col("cls").alias("other"), "n"), "other").groupBy("cls").agg(F.sum("n").alias("m"))
    links = size.join(beside, "cls", "left").select("cls", "class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return members.join(links, "cls").select(record, "class_id", "links")
