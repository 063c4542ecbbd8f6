"""Choosing variants evenly along the genome.

Random choice is an order by md5 of seed and key: the same on every run, in any
partitioning. Per-window ranks become partial top-k before the shuffle, so a full
window is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = ["gc", "tm", "complexity", "hairpin", "dimer"]
#: Targets and ranges of the composite score, in the order of SCORES.
TARGETS = [50.0, 70.0, 0.0, 0.0, 0.0]
RANGES = [50.0, 30.0, 5.0, 50.0, 1.0]


def shuffled(seed: int, *key: Column) -> Column:
    """A random-looking order of keys that depends on the seed only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def snp_key() -> Column:
    """The set-operation key of a variant."""
    return F.concat(F.col("chr"), F.lit(":"), F.col("pos").cast("string"), F.lit("_"), F.col("ref"), F.lit("_"), F.col("alt"))


def windows(df: DataFrame, size: int) -> DataFrame:
    """Adds ``win`` = pos div size."""
    return df.withColumn("win", F.floor(F.col("pos") / F.lit(size)).cast("long"))


def select_uniform(df: DataFrame, total: int, size: int = 10_000, seed: int = 42) -> DataFrame:
    """``total`` rows spread over the windows: each window gives total div W of its rows,
    the first total mod W windows (by chr, win) one more; at least one if total < W."""
    w = windows(df, size)
    sizes = w.select("chr", "win").distinct()
    from .probes import dense_index

    ranked = dense_index(sizes, ["chr", "win"], "_i")
    n = sizes.count()
    quota = F.lit(max(total // n, 0) if n else 0) + (F.col("_i") < (total % n if n else 0)).cast("int")
    order = Window.partitionBy("chr", "win").orderBy(shuffled(seed, F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt")), "pos", "ref", "alt")
    picked = w.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max(1, total // n + 1) if n else F.lit(False))
    return picked.join(ranked, ["chr", "win"]).filter(F.col("_r") <= quota).drop("_r", "_i")


def select_random(df: DataFrame, total: int, key: list[str], seed: int = 42) -> DataFrame:
    """``total`` rows, or all of a smaller table."""
    return df.orderBy(shuffled(seed, *[F.col(k) for k in key]), *key).limit(total)


def select_priority(df: DataFrame, flag: str, per_window: int = 1, size: int = 10_000, seed: int = 42) -> DataFrame:
    """Up to ``per_window`` rows of each window, flagged ones first, then random."""
    order = Window.partitionBy("chr", "win").orderBy(F.col(flag).desc(), shuffled(seed, F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt")), "pos", "ref", "alt")
    return windows(df, size).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_window).drop("_r")


def window_scores(df: DataFrame, scores: list[str], weights: list[float], targets: list[float], size: int = 10_000) -> DataFrame:
    """Adds ``win`` and ``weighted_score``: per score 1 - the min-max normalised distance to
    its target within the window (1 where all are equal), weighted and summed. Rows with
    a null score are left out. Window extremes are pre-aggregated and joined back."""
    d = [F.abs(F.col(s) - F.lit(t)) for s, t in zip(scores, targets)]
    w = windows(df, size)
    for s in scores:
        w = w.filter(F.col(s).isNotNull())
    ends = w.groupBy("chr", "win").agg(*[f(x).alias(f"_{k}{i}") for i, x in enumerate(d) for f, k in ((F.min, "lo"), (F.max, "hi"))])
    total = F.lit(0.0)
    for i, x in enumerate(d):
        span = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        total = total + F.lit(float(weights[i])) * (F.lit(1.0) - (x - F.col(f"_lo{i}")) / F.when(span == 0, F.lit(1.0)).otherwise(span))
    out = w.join(ends, ["chr", "win"]).withColumn("weighted_score", total)
    return out.drop(*[f"_{k}{i}" for i in range(len(d)) for k in ("lo", "hi")])


def select_weighted(df: DataFrame, scores: list[str], weights: list[float], targets: list[float], per_window: int = 1, size: int = 10_000) -> DataFrame:
    """The best ``per_window`` rows of each window by weighted score, ties by pos, ref, alt."""
    order = Window.partitionBy("chr", "win").orderBy(F.col("weighted_score").desc(), "pos", "ref", "alt")
    return window_scores(df, scores, weights, targets, size).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_window).drop("_r")


def composite_score(scores: dict[str, Column], weights: list[float] | None = None) -> Column:
    """Sum of weights * max(0, 1 - |value - target| / range); a null value counts as its target."""
    w = weights or [1.0] * 5
    total = F.lit(0.0)
    for name, t, r, k in zip(SCORES, TARGETS, RANGES, w):
        value = F.coalesce(scores[name], F.lit(t)) if name in scores else F.lit(t)
        total = total + F.lit(float(k)) * F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(value - F.lit(t)) / F.lit(r))
    return total


def stratified(df: DataFrame, stratum: list[str], n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each stratum."""
    order = Window.partitionBy(*stratum).orderBy(shuffled(seed, *[F.col(k) for k in key]), *key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def equal_strata(df: DataFrame, stratum: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """From each stratum as many rows as the smallest one has, ``n`` at most."""
    least = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).agg(F.least(F.min("_n"), F.lit(n)).alias("_least"))
    order = Window.partitionBy(stratum).orderBy(shuffled(seed, *[F.col(k) for k in key]), *key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).join(F.broadcast(least)).filter("_r <= _least").drop("_r", "_least")


def coverage(df: DataFrame, size: int = 10_000) -> DataFrame:
    """One row: windows and chromosomes with a row, rows, mean and population deviation
    of the rows per chromosome."""
    per = windows(df, size).groupBy("chr", "win").agg(F.count(F.lit(1)).alias("n")).groupBy("chr").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w"))
    return per.agg(F.sum("w").alias("n_windows"), F.count(F.lit(1)).alias("n_chroms"), F.sum("n").alias("n_snps"), F.avg("n").alias("mean_per_chrom"), F.stddev_pop("n").alias("std_per_chrom"))


def before_after(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean and sample deviation before and after, and the difference of means."""
    def stats(df, tag):
        flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null")
        return flat.groupBy("metric").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.avg("v").alias(f"mean_{tag}"), F.stddev_samp("v").alias(f"std_{tag}"))

    j = stats(before, "before").join(stats(after, "after"), "metric", "left")
    return j.withColumn("delta_mean", F.col("mean_after") - F.col("mean_before"))


def proportional_sample(a: DataFrame, b: DataFrame, key: list[str], total: int, seed: int = 42) -> DataFrame:
    """``total`` keys over three strata (only in a, only in b, in both), each with its share
    of all keys, rounded down, at least one where it has any: key columns, ``stratum``."""
    both = a.select(*key, F.lit(1).alias("s")).distinct().unionByName(b.select(*key, F.lit(2).alias("s")).distinct())
    one = both.groupBy(*key).agg(F.sum("s").alias("stratum"))
    sizes = one.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    all_keys = F.sum("n").over(Window.partitionBy())  # three rows
    quota = sizes.select("stratum", F.greatest(F.lit(1), F.floor(F.col("n") * total / all_keys)).alias("quota"))
    order = Window.partitionBy("stratum").orderBy(shuffled(seed, *[F.col(k) for k in key]), *key)
    return one.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= total).join(F.broadcast(quota), "stratum").filter("_r <= quota").select(*key, "stratum")


def pick_weighted(df: DataFrame, scores: list[str], weights: list[float], order: list[str], size: int = 10_000) -> DataFrame:
    """One row of each window of ``size`` places (the first is 1 to size): the one with the largest
    ``weighted_score``, the sum of weight times 1 - (score - least) / (greatest - least)
    within the window; a missing score, or one that is equal in all of the window, adds
    nothing. Ties go by pos and ``order``. Rows without chr or pos are left out."""
    d = df.filter("chr is not null and pos is not null").withColumn("win", F.floor((F.col("pos") - 1) / F.lit(size)))
    w = Window.partitionBy("chr", "win")
    total = F.lit(0.0)
    for c, weight in zip(scores, weights):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        total = total + F.coalesce(F.when(hi > lo, (1 - (F.col(c) - lo) / (hi - lo)) * float(weight)), F.lit(0.0))
    ranked = d.withColumn("weighted_score", total)
    first = w.orderBy(F.col("weighted_score").desc(), "pos", *order)
    return ranked.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in ``order`` (a reader's ``ord``, or a total order)."""
    return df.orderBy(*order).limit(n)


def without_scores(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the biophysical columns that it has, but for those to ``keep``."""
    return df.drop(*[c for c in (*SCORES, "entropy") if c in df.columns and c not in keep])
