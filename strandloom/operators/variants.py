"""Variant operators: validity, types, local density, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import mutation_type


def is_snp(ref: Column, alt: Column) -> Column:
    """One reference base and one alternative base out of A, C, G, T; false for nulls."""
    return F.coalesce((F.length(ref) == 1) & F.upper(alt).isin("A", "C", "G", "T"), F.lit(False))


def valid_snps(df: DataFrame, biallelic_only: bool = False) -> DataFrame:
    """Rows (chr, pos, ref, alt, n_alt, …) that are SNPs; first allele of several
    alternatives unless ``biallelic_only``."""
    keep = is_snp(F.col("ref"), F.col("alt"))
    return df.filter(keep & (F.col("n_alt") == 1) if biallelic_only else keep)


def snp_rejects(df: DataFrame) -> DataFrame:
    """Every row with ``reject``: null for valid rows, else the first reason."""
    base = lambda c: F.upper(c).isin("A", "C", "G", "T")
    reason = (
        F.when(F.col("chr").isNull(), "no_chr")
        .when(F.col("pos").isNull() | (F.col("pos") < 1), "bad_pos")
        .when(F.col("ref").isNull() | F.col("alt").isNull(), "no_allele")
        .when((F.length("ref") != 1) | (F.length("alt") != 1), "not_snp")
        .when(~base(F.col("ref")) | ~base(F.col("alt")), "bad_base")
        .when(F.upper("ref") == F.upper("alt"), "no_change")
    )
    return df.withColumn("reject", reason)


def stage_counts(df: DataFrame) -> DataFrame:
    """One row: records, SNPs, indels, records without an alternative, multi-allelic records."""
    snp = is_snp(F.col("ref"), F.col("alt"))
    no_alt = F.col("alt").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(snp).alias("n_snp"),
        F.count_if(~no_alt & ((F.length("ref") != 1) | (F.length("alt") != 1))).alias("n_indel"),
        F.count_if(no_alt).alias("n_no_alt"),
        F.count_if(snp & (F.col("n_alt") > 1)).alias("n_multi"),
    )


def with_type(df: DataFrame) -> DataFrame:
    """Adds ``type`` (ts or tv) from ref and alt."""
    return df.withColumn("type", mutation_type(F.col("ref"), F.col("alt")))


def neighbour_counts(df: DataFrame, flank: int, tile: int = 100_000) -> DataFrame:
    """Adds ``n_near``: rows of the same chr within ``flank`` of pos, itself included.

    Chromosomes are too few and too uneven to be partitions, so rows are first
    counted per position, the positions are cut into tiles with a halo of ``flank``
    on both sides, and the window runs inside tiles. Exact; rows with a null chr or
    pos are left out; the halo adds at most 2 flank / tile of the positions.
    """
    if flank < 0 or tile < 1:
        raise ValueError("flank must be at least 0 and tile at least 1")
    at = df.filter("chr is not null and pos is not null").groupBy("chr", "pos").agg(F.count(F.lit(1)).alias("_n"))
    pos = F.col("pos").cast("long")
    first, last = F.floor((pos - flank) / F.lit(tile)), F.floor((pos + flank) / F.lit(tile))
    tiled = at.withColumn("_own", F.floor(pos / F.lit(tile))).withColumn("_tile", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("chr", "_tile").orderBy(F.col("pos").cast("long")).rangeBetween(-flank, flank)
    counts = tiled.withColumn("n_near", F.sum("_n").over(w)).filter("_tile = _own").select("chr", "pos", "n_near")
    return df.join(counts, ["chr", "pos"])


def cluster_filter(df: DataFrame, flank: int = 60, most: int = 3, least: int = 1) -> DataFrame:
    """Rows with ``least`` to ``most`` rows within ``flank``, themselves included."""
    return neighbour_counts(df, flank).filter(F.col("n_near").between(least, most))


def row_limited_counts(df: DataFrame, flank: int, order: list[str], tile: int = 100_000) -> DataFrame:
    """Adds ``n_near``: rows of the same chr within ``flank`` of pos that are also no more than
    ``flank`` rows away in the order (pos, ``order``), itself included; it differs from
    ``neighbour_counts`` only where more than that lie so near. ``order`` must make the order
    total. All rows between two near ones are near too, so a tile with a halo sees them all."""
    d = df.filter("chr is not null and pos is not null")
    pos = F.col("pos").cast("long")
    first, last = F.floor((pos - flank) / F.lit(tile)), F.floor((pos + flank) / F.lit(tile))
    tiled = d.withColumn("_own", F.floor(pos / F.lit(tile))).withColumn("_tile", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("chr", "_tile").orderBy(pos, *order).rowsBetween(-flank, flank)
    near = F.size(F.filter(F.collect_list(pos).over(w), lambda x: F.abs(x - pos) <= flank))  # 2 flank + 1 values at most
    return tiled.withColumn("n_near", near.cast("long")).filter("_tile = _own").drop("_own", "_tile")


def at_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows (a VCF's, or genotypes) at the places (chr, pos) of ``sites``, each as often as it is there."""
    return rows.join(sites.select("chr", "pos"), ["chr", "pos"], "left_semi")


def of_samples(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Genotypes (…, sample, …) of the samples listed."""
    return genotypes.join(samples.select("sample"), "sample", "left_semi")
