"""Summaries of probe sets: statistics, histograms, families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, v) of all columns, nulls and NaN left out."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return flat.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: n, mean, population deviation, min, max, median (interpolated, exact)."""
    return melt(df, columns).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", 0.5).alias("median"))


def rank_statistics(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, min, max, upper median and 95th percentile, both by nearest rank."""
    from .filters import nearest_rank

    base = df.filter(F.col(value).isNotNull())
    s = base.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    mid, p95 = nearest_rank(base, value, 0.5).withColumnRenamed("threshold", "upper_median"), nearest_rank(base, value, 0.95).withColumnRenamed("threshold", "p95")
    return s.join(mid, how="left").join(p95, how="left")


def histogram(df: DataFrame, column: str, width: float, lo: float = 0.0) -> DataFrame:
    """Bins of fixed width: ``bin`` (number), ``n``, ``percent`` of all values."""
    v = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    h = v.groupBy(F.floor((F.col(column) - lo) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.join(F.broadcast(h.agg(F.sum("n").alias("_t")))).select("bin", "n", (100.0 * F.col("n") / F.col("_t")).alias("percent"))


def plot_limits(df: DataFrame, column: str, discrete: int = 60, margin: float = 0.05) -> DataFrame:
    """One row ``lo``, ``hi``: half a unit around the extremes of up to ``discrete`` distinct
    values, else the 1st and 99th percentile and 5 % of their distance on both sides."""
    v = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    s = v.agg(F.countDistinct(column).alias("k"), F.min(column).alias("a"), F.max(column).alias("b"), F.percentile(column, F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    few, gap = F.col("k") <= discrete, (F.element_at("p", 2) - F.element_at("p", 1)) * margin
    return s.select(F.when(few, F.col("a") - 0.5).otherwise(F.element_at("p", 1) - gap).alias("lo"), F.when(few, F.col("b") + 0.5).otherwise(F.element_at("p", 2) + gap).alias("hi"))


def family_report(members: DataFrame) -> DataFrame:
    """Per family (family_id, member_no, member): n_members, its share of all members, and the
    member list in order (a family's list is its own row, as in the clustering output)."""
    g = members.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_no", "member"))), lambda x: x["member"]), ",").alias("members"))
    return g.join(F.broadcast(members.agg(F.count(F.lit(1)).alias("_t")))).select("family_id", "n_members", (F.col("n_members") / F.col("_t")).alias("proportion"), "members")


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def greedy_families(df: DataFrame, key: str, seq: str, k: int = 11, min_shared: float = 0.8) -> DataFrame:
    """Families of similar sequences: those linked by shared k-mers (see linked_families);
    the representative is the longest, ties by key. Linked groups stand in for a greedy
    clustering and are not identical to it. (key, family_id, representative)."""
    from .kmers import linked_families

    return linked_families(df, key, seq, k, min_shared).withColumnRenamed("group_id", "family_id")
