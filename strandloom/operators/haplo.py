"""Haplotypes: building, counting and tiling alleles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .probes import tile_starts


def apply_variants(regions: DataFrame, variants: DataFrame) -> DataFrame:
    """Allele sequences: regions (region_id, start, seq; 0-based start) with the variants
    (region_id, sample, hap, pos, ref, alt; 1-based pos) carried by each haplotype.

    Substitutions of any length are overlaid; a deletion blanks the reference bases
    and an insertion puts its allele at the first base. Variants that start before the
    region, end behind it, or don't match the region's sequence are skipped; of
    overlapping ones the first by position holds. Haplotypes without variants have
    the region's sequence. One haplotype of one region is folded at a time, in place
    order, inside an aggregate: no group is larger than a region's variants.
    """
    order = F.array_sort(F.collect_list(F.struct("pos", "ref", "alt")))
    carried = variants.filter("pos is not null and ref is not null and alt is not null").groupBy("region_id", "sample", "hap").agg(order.alias("vs"))
    j = carried.join(regions.select("region_id", "start", "seq"), "region_id")
    off = lambda v: v["pos"] - 1 - F.col("start")
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def fold(s, v):
        fits = (off(v) >= s["at"]) & (off(v) + F.length(v["ref"]) <= F.length("seq")) & (F.substr(F.col("seq"), (off(v) + 1).cast("int"), F.length(v["ref"])) == v["ref"])
        between = F.substr(F.col("seq"), (s["at"] + 1).cast("int"), (off(v) - s["at"]).cast("int"))
        return F.when(fits, F.struct(F.concat(s["out"], between, v["alt"]).alias("out"), (off(v) + F.length(v["ref"])).cast("long").alias("at"))).otherwise(s)

    walked = F.aggregate("vs", state, fold, lambda s: F.concat(s["out"], F.substr(F.col("seq"), (s["at"] + 1).cast("int"), F.length("seq"))))
    return j.select("region_id", "sample", "hap", walked.alias("allele"))


def haplotype_frequencies(alleles: DataFrame, min_freq: float = 0.05) -> DataFrame:
    """Distinct sequences of each region: region_id, ``label`` (H1 is the most frequent,
    ties by sequence), seq, n, freq; those below ``min_freq`` are dropped."""
    n = alleles.groupBy("region_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("region_id").agg(F.sum("n").alias("_t"))
    w = Window.partitionBy("region_id").orderBy(F.col("n").desc(), "seq")
    f = n.join(total, "region_id").withColumn("freq", F.col("n") / F.col("_t")).withColumn("label", F.concat(F.lit("H"), F.row_number().over(w).cast("string")))
    return f.filter(F.col("freq") >= min_freq).select("region_id", "label", "seq", "n", "freq")


def allele_windows(alleles: DataFrame, length: int = 81, step: int = 30) -> DataFrame:
    """Windows of all alleles (region_id, label, seq): region_id, start (0-based), tile, label.
    Windows with N are dropped; alleles shorter than a window give none."""
    up = F.upper("seq")
    t = alleles.select("region_id", "label", up.alias("_s"), F.explode(tile_starts(F.length("seq"), length, step)).alias("start"))
    return t.select("region_id", "label", "start", F.substr("_s", F.col("start") + 1, F.lit(length)).alias("tile")).filter(~F.contains("tile", F.lit("N")))


def haplotype_tiles(alleles: DataFrame, length: int = 81, step: int = 30, variant_only: bool = False) -> DataFrame:
    """Distinct windows over the alleles of each region: region_id, start, tile, ``label`` (the
    smallest that has it), ``n_alleles``, ``n_forms`` (distinct tiles at that place)."""
    g = allele_windows(alleles, length, step).groupBy("region_id", "start", "tile").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n_alleles"))
    forms = g.groupBy("region_id", "start").agg(F.count(F.lit(1)).alias("n_forms"))
    out = g.join(forms, ["region_id", "start"])
    return out.filter("n_forms > 1") if variant_only else out


def variable_positions(alleles: DataFrame, length: int = 81, step: int = 30, shown: int = 5) -> DataFrame:
    """Per window the offsets at which the alleles differ: region_id, start, ``n_variable``,
    ``first`` (the first ``shown``)."""
    tiles = allele_windows(alleles, length, step).select("region_id", "start", "tile").distinct()
    chars = tiles.select("region_id", "start", F.posexplode(F.split("tile", "")).alias("off", "base"))
    ends = chars.groupBy("region_id", "start", "off").agg(F.min("base").alias("lo"), F.max("base").alias("hi")).filter("lo <> hi")
    return ends.groupBy("region_id", "start").agg(F.count(F.lit(1)).alias("n_variable"), F.slice(F.array_sort(F.collect_list("off")), 1, shown).alias("first"))


def window_variation(tiles: DataFrame) -> DataFrame:
    """One row: windows with one form and with several, and the tiles in each."""
    per = tiles.groupBy("region_id", "start").agg(F.count(F.lit(1)).alias("n"))
    one = F.col("n") == 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return per.agg(F.count_if(one).alias("n_fixed"), F.count_if(~one).alias("n_variant"), zero(F.sum(F.when(one, F.col("n")))).alias("tiles_fixed"), zero(F.sum(F.when(~one, F.col("n")))).alias("tiles_variant"))


def aligned_tiles(aligned: DataFrame, length: int = 81, step: int = 30) -> DataFrame:
    """Windows on alignment columns (region_id, label, aligned) mapped back to each allele:
    ``column`` (0-based), ``tile`` without gaps, ``start`` in the ungapped allele (first
    occurrence). Only windows of exactly ``length`` bases without N remain."""
    n = F.length("aligned")
    t = aligned.select("region_id", "label", "aligned", F.explode(tile_starts(n, length, step)).alias("column"))
    tile = F.upper(F.replace(F.substr("aligned", F.col("column") + 1, F.lit(length)), F.lit("-"), F.lit("")))
    whole = F.upper(F.replace("aligned", F.lit("-"), F.lit("")))
    out = t.select("region_id", "label", "column", tile.alias("tile"), (F.position(tile, whole) - 1).alias("start"))
    return out.filter((F.length("tile") == length) & ~F.contains("tile", F.lit("N")))


def prune_linked(genotypes: DataFrame, window: int = 50, step: int = 5, r2: float = 0.2) -> DataFrame:
    """Sites (chr, pos) left after greedy pruning: within windows of ``window`` sites moved by
    ``step`` sites, of two sites with squared correlation above ``r2`` the later goes.

    ``genotypes``: chr, pos, gts (array of 0/1/2, null missing, one order of samples; one row
    a site). A site that is left when its first window is done is left for good, so a site goes
    exactly if one that stays lies before it in a common window and is linked with it. The links
    are found in chunks with the last ``window`` sites of the chunk before in front; what
    stays follows from them in one walk along each chromosome, which streams a bit mask per
    site and remembers one window.
    """
    from .probes import dense_index

    block = max(1000 * step, window)  # a halo reaches into one chunk only
    numbered = dense_index(genotypes.filter("chr is not null and pos is not null"), ["chr", "pos"], "_i")
    first = numbered.groupBy("chr").agg(F.min("_i").alias("_first"))
    sites = numbered.join(first, "chr").withColumn("_n", F.col("_i") - F.col("_first")).select("chr", "pos", "gts", "_n")
    parts = F.array_distinct(F.array(F.floor(F.col("_n") / block), F.floor((F.col("_n") + window) / block)))
    tiled = sites.withColumn("_c", F.explode(parts))

    def links(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Bit d - 1 of ``_before``: the site d places before is linked and in a common window."""
        import numpy as np

        pdf = pdf.sort_values("_n").reset_index(drop=True)
        n = pdf["_n"].to_numpy()
        g = np.array([[np.nan if v is None else v for v in x] for x in pdf["gts"]], float).reshape(len(pdf), -1)
        known = (~np.isnan(g)).astype(float)
        x = np.nan_to_num(g)
        square = x * x
        dot = lambda a, b: np.einsum("ij,ij->i", a, b)
        linked = np.zeros((len(pdf), max(window - 1, 1)), bool)
        for d in range(1, min(window, len(pdf))):
            a, b = slice(None, -d), slice(d, None)
            both, sx, sy = dot(known[a], known[b]), dot(x[a], known[b]), dot(known[a], x[b])
            cov = both * dot(x[a], x[b]) - sx * sy
            vx, vy = both * dot(square[a], known[b]) - sx * sx, both * dot(known[a], square[b]) - sy * sy
            with np.errstate(divide="ignore", invalid="ignore"):
                high = np.nan_to_num(cov * cov / (vx * vy)) > r2
            linked[d:, d - 1] = high & (n[b] < n[a] // step * step + window)
        own = n // block == key[1]
        out = pdf.loc[own, ["chr", "pos", "_n"]]
        return out.assign(_before=[r.tobytes() for r in np.packbits(linked[own], axis=1, bitorder="little")])

    def walk(batches):
        import pyarrow as pa

        at, kept, full = None, 0, (1 << window) - 1
        for batch in batches:
            stays = []
            for c, before in zip(batch.column("chr").to_pylist(), batch.column("_before").to_pylist()):
                if c != at:
                    at, kept = c, 0
                stay = not int.from_bytes(before, "little") & kept
                kept = (kept << 1 | stay) & full
                stays.append(stay)
            yield batch.select(["chr", "pos"]).filter(pa.array(stays, pa.bool_()))

    kinds = {f.name: f.dataType.simpleString() for f in genotypes.schema}
    masks = tiled.groupBy("chr", "_c").applyInPandas(links, f"chr {kinds['chr']}, pos {kinds['pos']}, _n bigint, _before binary")
    return masks.repartition("chr").sortWithinPartitions("chr", "_n").mapInArrow(walk, f"chr {kinds['chr']}, pos {kinds['pos']}")
