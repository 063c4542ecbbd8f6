"""Interval operators over (chr, start, end), 0-based and half-open.

Point-in-interval joins are equi-joins on position bins: an interval is exploded
to the bins it touches, a point lies in one bin. Bins are as wide as intervals
typically are, so an interval gives few rows; one that spans many bins is merged
away beforehand where only membership is asked (``covered``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import reverse_complement_keep

#: Width of a join bin.
BIN = 10_000


def clean_intervals(bed: DataFrame) -> DataFrame:
    """Intervals with chr and both ends and end > start."""
    return bed.filter("chr is not null and start is not null and end is not null and end > start")


#: Width of the tiles in which running maxima are taken.
TILE = 100_000


def running_max(df: DataFrame, keys: list[str], at: str, value: str, out: str, width: int = TILE) -> DataFrame:
    """Adds ``out``: the largest ``value`` among the rows of the same keys with a smaller ``at``;
    null where there is none. (keys, at) must be unique; null keys are equal.

    Chromosomes and genes are too few and too uneven to be tasks, so the window runs inside
    tiles of ``width`` positions (no more rows than that each), and each tile gets the largest
    value of the tiles before it, of which there is one row a tile."""
    tile, own, carry = "_tile", "_own_max", "_carry"
    t = df.withColumn(tile, F.floor(F.col(at) / width))
    top = t.groupBy(*keys, tile).agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    there = top.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, tile])], F.max("_top").over(before).alias(carry))
    inside = Window.partitionBy(*keys, tile).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn(own, F.max(value).over(inside))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, tile])])
    return t.join(there, same).withColumn(out, F.greatest(own, carry)).drop(tile, own, carry, *[f"_k{i}" for i in range(len(keys) + 1)])


def merge_intervals(bed: DataFrame, by: list[str] = ("chr",), distance: int = 0) -> DataFrame:
    """Intervals of one key united where the next start is at most ``distance`` behind the
    running end: keys, start, end, ``n`` (intervals united). Null or empty intervals are
    left out."""
    keys = list(by)
    # intervals of one start are pre-aggregated to the longest: they are always in one island
    starts = clean_intervals(bed).groupBy(*keys, "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("_n"))
    t = running_max(starts, keys, "start", "end", "_before")
    t = t.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + distance), F.col("start")))
    # an island is named by its first start, the last new one so far
    t = running_max(t, keys, "start", "_new", "_last").withColumn("_island", F.coalesce("_new", "_last"))
    return t.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("n")).drop("_island")


def complement(bed: DataFrame, chroms: DataFrame) -> DataFrame:
    """The parts of (chr, len) that no interval covers: chr, start, end. Chromosomes
    without an interval come out whole; intervals are clipped to the chromosome."""
    inside = clean_intervals(bed).join(chroms, "chr").select("chr", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "len").alias("end"))
    merged = merge_intervals(inside.filter("end > start"))
    ends = merged.select("chr", "start", "end").unionByName(chroms.select("chr", F.col("len").alias("start"), F.col("len").alias("end")))
    gaps = running_max(ends, ["chr"], "start", "end", "_before")
    return gaps.select("chr", F.coalesce("_before", F.lit(0)).cast("long").alias("s"), F.col("start").cast("long").alias("e")).filter("s < e").select("chr", F.col("s").alias("start"), F.col("e").alias("end"))


def slop(bed: DataFrame, chroms: DataFrame, distance: int) -> DataFrame:
    """Intervals grown (or, below 0, shrunk) by ``distance`` at both ends, clipped to the
    chromosome; empty ones are dropped. Other columns are kept."""
    out = clean_intervals(bed).join(chroms, "chr")
    out = out.withColumn("start", F.greatest(F.col("start") - distance, F.lit(0))).withColumn("end", F.least(F.col("end") + distance, F.col("len"))).drop("len")
    return out.filter("end > start")


def _inside(p: Column, start: Column, end: Column, base: str) -> Column:
    if base == "one_based":  # a 1-based position in a 0-based half-open interval
        return (p > start) & (p <= end)
    if base == "as_is":
        return (p >= start) & (p < end)
    if base == "inclusive":
        return (p >= start) & (p <= end)
    raise ValueError("base must be one_based, as_is or inclusive")


def binned(bed: DataFrame, width: int = BIN) -> DataFrame:
    return bed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def _merged_bins(bed: DataFrame, base: str, width: int) -> tuple[DataFrame, Column]:
    """Merged intervals by bin (_c, _bin, _s, _e), and the condition that a point lies in one;
    a point lies in one at most."""
    if base == "inclusive":
        merged = merge_intervals(bed.withColumn("end", F.col("end") + 1)).withColumn("end", F.col("end") - 1)
    else:
        merged = merge_intervals(bed)
    b = binned(merged, width).select(F.col("chr").alias("_c"), "_bin", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return b, (F.col("chr") == F.col("_c")) & (F.floor(F.col("pos") / width) == F.col("_bin")) & _inside(F.col("pos"), F.col("_s"), F.col("_e"), base)


def covered(points: DataFrame, bed: DataFrame, keep: bool = True, base: str = "one_based", width: int = BIN) -> DataFrame:
    """Points (chr, pos, …) inside some interval, or with ``keep=False`` inside none.

    Intervals are merged first, so a position meets few; then a semi or anti join on
    bins. Points with a null chr or pos are inside none. No interval: none kept.
    """
    b, on = _merged_bins(bed, base, width)
    return points.join(b, on, "left_semi" if keep else "left_anti")


def flag_covered(points: DataFrame, bed: DataFrame, flag: str = "in_region", base: str = "inclusive", width: int = BIN) -> DataFrame:
    """Adds ``flag``: whether the point lies in some interval. One pass over points and intervals."""
    b, on = _merged_bins(bed, base, width)
    return points.join(b, on, "left").withColumn(flag, F.col("_bin").isNotNull()).drop("_c", "_bin", "_s", "_e")


def features_at(points: DataFrame, bed: DataFrame, base: str = "inclusive", width: int = BIN) -> DataFrame:
    """Each point with each interval that holds it (columns of both; the interval's
    chr, start and end come as f_chr, f_start, f_end)."""
    b = binned(clean_intervals(bed), width).withColumnsRenamed({"chr": "f_chr", "start": "f_start", "end": "f_end"})
    on = (F.col("chr") == F.col("f_chr")) & (F.floor(F.col("pos") / width) == F.col("_bin")) & _inside(F.col("pos"), F.col("f_start"), F.col("f_end"), base)
    return points.join(b, on).drop("_bin")


def region_sequences(bed: DataFrame, genome: DataFrame, stranded: bool = True) -> DataFrame:
    """Adds ``seq`` to intervals inside the genome table (chr, seq); minus-strand regions
    are reverse-complemented if ``stranded``. Intervals beyond an end are dropped;
    repeated rows count once. Regions meet chunks of the genome by (chr, chunk) and
    are put together again, so only the letters of a region are moved and grouped."""
    from .probes import CHUNK, genome_chunks, genome_sizes

    sizes = genome_sizes(genome)
    ok = clean_intervals(bed).distinct().join(sizes, "chr").filter((F.col("start") >= 0) & (F.col("end") <= F.col("_len"))).drop("_len")
    t = ok.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK)))).join(genome_chunks(genome, 0), ["chr", "_chunk"])
    lo, hi = F.greatest("start", "_from"), F.least(F.col("end"), F.col("_from") + CHUNK)
    t = t.withColumn("_part", F.substr("_piece", (lo - F.col("_from") + 1).cast("int"), (hi - lo).cast("int")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_part"))), lambda x: x["_part"])
    got = t.groupBy(*bed.columns).agg(F.array_join(parts, "").alias("seq"))
    return got.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement_keep(F.col("seq"))).otherwise(F.col("seq"))) if stranded and "strand" in bed.columns else got


def region_totals(bed: DataFrame) -> DataFrame:
    """One row: regions and their total length."""
    return clean_intervals(bed).agg(F.count(F.lit(1)).alias("n_regions"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("total_bp"))
