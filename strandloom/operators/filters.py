"""Filters: ranges, cascades with a reason, thresholds, validators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(value: Column, lo: float, hi: float) -> Column:
    """Inclusive; a bound of -1 is no bound; null passes only if there is no bound."""
    tests = ([value >= lo] if lo != -1 else []) + ([value <= hi] if hi != -1 else [])
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def cascade(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``fail_reason``: the name of the first test that isn't true, or null."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), out).otherwise(name)
    return df.withColumn("fail_reason", out)


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("fail_reason").agg(F.count(F.lit(1)).alias("n"))


def low_entropy(df: DataFrame, seq: str = "seq", threshold: float = 1.5) -> DataFrame:
    """Sequences whose letters have an entropy below ``threshold`` bits; null and empty ones are none."""
    from ..functions.seq import entropy

    return df.filter(entropy(F.upper(F.col(seq))) < threshold)


def strong_hairpins(df: DataFrame, score: str = "hairpin", threshold: float = 5.0) -> DataFrame:
    """Rows whose hairpin score lies above ``threshold``; missing scores are none."""
    return df.filter(F.col(score) > threshold)


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row ``threshold``: sorted value number min(int(share n), n - 1), from 0.

    Exact and distributed: values are counted, range-partitioned and only partition
    totals are compared, so no task holds all values. Null values are left out."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    from ..plans.runtime import materialize

    cut = materialize(hist.repartitionByRange(parts, "v").withColumn("p", F.spark_partition_id()))
    sums = cut.df.groupBy("p").agg(F.sum("n").alias("s"))  # at most `parts` rows
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("p", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    inside = cut.df.join(F.broadcast(sums), "p").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    rank = F.least((F.lit(share) * F.col("total")).cast("long"), F.col("total") - 1)
    return inside.filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)).select(F.col("v").alias("threshold"))


def resolve_threshold(df: DataFrame, value: str, x: float) -> DataFrame | None:
    """None for x <= 0 (no filter); the share's nearest rank for 0 < x < 1; x itself from 1 on."""
    if x <= 0:
        return None
    if x < 1:
        return nearest_rank(df, value, x)
    return df.sparkSession.createDataFrame([(float(x),)], "threshold double")


def at_most(df: DataFrame, value: str, x: float) -> DataFrame:
    """Rows with value up to the resolved threshold; nulls fail unless there is no filter."""
    t = resolve_threshold(df, value, x)
    return df if t is None else df.join(F.broadcast(t)).filter(F.col(value) <= F.col("threshold")).drop("threshold")


def rank_band(df: DataFrame, value: str, key: list[str], lo: float, hi: float) -> DataFrame:
    """Rows whose share of rank (rank / n, rank from 1 by value, then key) is within [lo, hi]."""
    from .probes import dense_index

    n = df.filter(F.col(value).isNotNull()).count()
    ranked = dense_index(df.filter(F.col(value).isNotNull()), [value, *key], "_i")
    return ranked.filter(((F.col("_i") + 1) / n).between(lo, hi)).drop("_i")


def all_in_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with every column inside its range."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()]))


def by_expression(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a SQL expression is true; a wrong expression raises."""
    return df.filter(F.expr(expression))


def kraken_hits(line: Column) -> Column:
    """k-mers assigned to a taxon in a classifier's ``taxid:count …`` field; taxid 0, ``A``,
    paired-end marks and what can't be read count nothing."""
    parts = F.split(F.coalesce(line, F.lit("")), r"\s+")

    def count(s, x):
        tax, n = F.split_part(x, F.lit(":"), F.lit(1)).try_cast("bigint"), F.split_part(x, F.lit(":"), F.lit(2)).try_cast("bigint")
        return s + F.when(tax > 0, F.coalesce(n, F.lit(0))).otherwise(F.lit(0))

    return F.aggregate(parts, F.lit(0).cast("long"), count)


def background_filter(ids: DataFrame, lines: list[DataFrame], threshold: int = 1) -> DataFrame:
    """Ids that no classifier output (id, line) gives ``threshold`` k-mers or more; an id
    that is missing from an output stays."""
    noisy = reduce(lambda a, b: a.unionByName(b), [x.filter(kraken_hits(F.col("line")) >= threshold).select("id") for x in lines]).distinct()
    return ids.join(noisy, "id", "left_anti")


def kmer_bins(df: DataFrame, hits: str) -> DataFrame:
    """Ids per band of hits: 0, 1-5, 6-10, 11-20, 21-50, >50."""
    h = F.col(hits)
    band = F.when(h <= 0, "0").when(h <= 5, "1-5").when(h <= 10, "6-10").when(h <= 20, "11-20").when(h <= 50, "21-50").otherwise(">50")
    return df.groupBy(band.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def family_filter(families: DataFrame, least: int = 1, most: int | None = None, share_lo: float = 0.0, share_hi: float = 1.0, total: int | None = None) -> DataFrame:
    """Families (family_id, member) with least to most members and a share of all
    members within bounds: family_id, n_members, proportion."""
    g = families.groupBy("family_id").agg(F.count(F.lit(1)).alias("n_members"))
    all_members = F.lit(total) if total else F.col("_all")
    g = g if total else g.join(F.broadcast(g.agg(F.sum("n_members").alias("_all"))))
    g = g.withColumn("proportion", F.col("n_members") / all_members).drop("_all")
    size = (F.col("n_members") >= least) & (F.col("n_members") <= most if most else F.lit(True))
    return g.filter(size & F.col("proportion").between(share_lo, share_hi))


def mapping_filter(hits: DataFrame, mode: str = "strict", mapq: int = 30, nm: int = 3, ratio: float = 0.8) -> DataFrame:
    """Alignments (mapq, nm, xo, as_score, xs_score) that place a read well: quality at least
    ``mapq``, at most ``nm`` mismatches, no gap, and no second place (strict) or one below
    ``ratio`` of the best score (moderate)."""
    second = F.col("xs_score").isNull() if mode == "strict" else F.col("xs_score").isNull() | (F.col("xs_score") < F.col("as_score") * ratio)
    return hits.filter((F.col("mapq") >= mapq) & (F.col("nm") <= nm) & (F.coalesce("xo", F.lit(0)) == 0) & second)


def validate_snps(df: DataFrame) -> DataFrame:
    """One row: rows, repeated (chr, pos), positions and alleles that aren't valid."""
    dup = df.groupBy("chr", "pos").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_dup_sites"))
    base = lambda c: F.coalesce(F.upper(F.col(c)).rlike("^[ACGT]$"), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(F.col("pos") < 1, F.lit(True))).alias("n_bad_pos"), F.count_if(~base("ref")).alias("n_bad_ref"), F.count_if(~base("alt")).alias("n_bad_alt"), F.count_if(F.col("chr").isNull()).alias("n_no_chr")).join(F.broadcast(dup))


def validate_sequences(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: sequences, empty ones, those with other letters than A, T, C, G, N, lengths."""
    n = F.length(seq)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(n == 0, F.lit(True))).alias("n_empty"), F.count_if(F.upper(seq).rlike("[^ATCGN]")).alias("n_bad_letters"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def validate_intervals(df: DataFrame) -> DataFrame:
    """One row: intervals, those without an end, with a negative start, with end < start."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("start").isNull() | F.col("end").isNull()).alias("n_no_end"), F.count_if(F.col("start") < 0).alias("n_negative"), F.count_if(F.col("end") < F.col("start")).alias("n_reversed"))


def classifier_database(files: list[str]) -> list[str]:
    """Which of the files that a k-mer classifier's database needs are not among ``files``."""
    have = {f.rstrip("/").rsplit("/", 1)[-1] for f in files}
    return sorted({"hash.k2d", "opts.k2d", "taxo.k2d"} - have)


def aligner_index(files: list[str], prefix: str) -> list[str]:
    """Which of the six files of an aligner's index ``prefix`` are not among ``files``;
    the short and the long form (``.bt2``, ``.bt2l``) count alike."""
    have = {f.rsplit("/", 1)[-1] for f in files}
    need = ["1", "2", "3", "4", "rev.1", "rev.2"]
    return [f"{prefix}.{n}.bt2" for n in need if not {f"{prefix}.{n}.bt2", f"{prefix}.{n}.bt2l"} & have]
