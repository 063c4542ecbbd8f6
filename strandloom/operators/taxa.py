"""Alignment hits and taxonomy: accessibility, best hits, common ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import similarity_percent
from .graph import ancestors, descendants


def hit_rollup(hits: DataFrame, by: list[str] = ("qname", "genome")) -> DataFrame:
    """Per read and genome: ``hits``, ``best_as``, ``second_as`` (the next lower place's score, or
    the best one's XS if larger; null if neither), ``diff``. Unmapped rows (as_score null)
    count no hit. Only the two best scores are kept while aggregating."""
    m = hits.filter("as_score is not null")
    g = m.groupBy(*by).agg(F.count(F.lit(1)).alias("hits"), F.max(F.struct("as_score", "xs_score")).alias("_b"), F.sum(F.lit(1)).alias("_n"))
    top = g.select(*by, "hits", F.col("_b.as_score").alias("best_as"), F.col("_b.xs_score").alias("_xs"))
    per_score = m.groupBy(*by, "as_score").agg(F.count(F.lit(1)).alias("_k"))
    j = per_score.join(top.select(*by, "best_as"), list(by))
    second = j.groupBy(*by).agg(F.max(F.when((F.col("as_score") < F.col("best_as")) | (F.col("_k") > 1), F.col("as_score"))).alias("_second"))
    out = top.join(second, list(by)).withColumn("second_as", F.greatest("_second", "_xs"))
    return out.select(*by, "hits", "best_as", "second_as", (F.col("best_as") - F.col("second_as")).alias("diff"))


def mappable(hits: Column, diff: Column, mode: str = "strict", threshold: int = 10) -> Column:
    """strict: one hit; relaxed: one hit, or a score gap of at least ``threshold``; any: a hit."""
    if mode == "strict":
        return hits == 1
    if mode == "relaxed":
        return (hits == 1) | F.coalesce(diff >= threshold, F.lit(False))
    return hits >= 1


def accessible(ids: DataFrame, rollup: DataFrame, genomes: int, least: int | None = None, mode: str = "strict", threshold: int = 10) -> DataFrame:
    """Every id with ``aligned`` and ``multi`` (genomes where it aligns, and where not uniquely)
    and ``verdict``: ok, not_aligned (in fewer than ``least`` genomes, default all) or
    multi_mapped. A genome without a hit counts as not aligned; no grid is built."""
    good = mappable(F.col("hits"), F.col("diff"), mode, threshold)
    g = rollup.groupBy(F.col("qname").alias("id")).agg(F.count(F.lit(1)).alias("aligned"), F.count_if(~good).alias("multi"))
    need = genomes if least is None else least
    out = ids.select("id").join(g, "id", "left").select("id", F.coalesce("aligned", F.lit(0)).alias("aligned"), F.coalesce("multi", F.lit(0)).alias("multi"))
    return out.withColumn("verdict", F.when(F.col("aligned") < need, "not_aligned").when(F.col("multi") > 0, "multi_mapped").otherwise("ok"))


def with_taxid(hits: DataFrame, accessions: DataFrame) -> DataFrame:
    """Adds ``taxid`` to hits (rname, …): by full accession, else without its version; one
    taxid per accession (the smallest). Hits of unknown references have null."""
    one = accessions.filter("accession is not null").groupBy("accession").agg(F.min("taxid").alias("taxid"))
    full = one.withColumnsRenamed({"accession": "_a", "taxid": "_t1"})
    bare = one.withColumnsRenamed({"accession": "_b", "taxid": "_t2"})
    j = hits.join(full, F.col("rname") == F.col("_a"), "left").join(bare, F.split_part("rname", F.lit("."), F.lit(1)) == F.col("_b"), "left")
    return j.withColumn("taxid", F.coalesce("_t1", "_t2")).drop("_a", "_b", "_t1", "_t2")


def best_per_taxon(hits: DataFrame) -> DataFrame:
    """Per read and taxon the best hit: fewest mismatches, then the largest similarity
    (percent, of qlen): qname, taxid, nm, sim."""
    sim = similarity_percent(F.col("qlen"), F.col("nm"))
    g = hits.filter("taxid is not null").groupBy("qname", "taxid").agg(F.min(F.struct(F.col("nm"), (-sim).alias("s"))).alias("b"))
    return g.select("qname", "taxid", F.col("b.nm").alias("nm"), (-F.col("b.s")).alias("sim"))


def best_hit_verdict(best: DataFrame, tree: DataFrame, targets: DataFrame, outgroups: DataFrame | None = None, min_sim: float = 90.0, max_nm: int = 5, exclude: str = "diff", value: float = 2) -> DataFrame:
    """Per read whether it belongs to the target clades: ``verdict`` is assigned,
    not_target (the best hit lies elsewhere; ties by taxid), low_quality, or ambiguous
    (a hit outside the targets, within the outgroups if given, is too good: similarity at
    least, mismatches at most, or mismatches less than ``value`` above the best)."""
    inside = descendants(tree, targets).withColumn("_t", F.lit(True))
    b = best.join(inside, "taxid", "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    if outgroups is not None:
        out = descendants(tree, outgroups).withColumn("_o", F.lit(True))
        b = b.join(out, "taxid", "left").withColumn("_o", F.coalesce("_o", F.lit(False)) & ~F.col("_t"))
    else:
        b = b.withColumn("_o", ~F.col("_t"))
    outside = F.col("_o")
    g = b.groupBy("qname").agg(F.min(F.struct("nm", (-F.col("sim")).alias("s"), "taxid", "_t")).alias("b"), F.max(F.when(outside, F.col("sim"))).alias("osim"), F.min(F.when(outside, F.col("nm"))).alias("onm"))
    tests = {"sim": F.col("osim") >= value, "nm": F.col("onm") <= value, "diff": F.col("onm") - F.col("b.nm") < value}
    if exclude not in tests:
        raise ValueError("exclude must be sim, nm or diff")
    good = (-F.col("b.s") >= min_sim) | (F.col("b.nm") <= max_nm)
    v = F.when(~F.col("b._t"), "not_target").when(~good, "low_quality").when(F.coalesce(tests[exclude], F.lit(False)), "ambiguous").otherwise("assigned")
    return g.select("qname", F.col("b.taxid").alias("taxid"), v.alias("verdict"))


def names_to_ids(names: DataFrame, wanted: list[str]) -> DataFrame:
    """Taxids (taxid, name) of scientific names, each once; ValueError for unknown names."""
    found = names.filter(F.col("name").isin(*wanted)).select("taxid", "name").distinct()
    missing = set(wanted) - {r[0] for r in found.select("name").distinct().collect()}  # at most the wanted names
    if missing:
        raise ValueError(f"unknown name(s): {', '.join(sorted(missing))}")
    return found


def common_ancestor(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """The lowest common ancestor of each read's taxa: qname, ``lca``. Taxa that aren't in the
    tree are ignored; a read with none left is left out."""
    taxa = hits.filter("taxid is not null").select("qname", "taxid").distinct()
    up = ancestors(tree)
    depth = up.groupBy(F.col("taxid").alias("ancestor")).agg(F.max("up").alias("depth"))
    known = taxa.join(tree.select("taxid").distinct(), "taxid")
    n = known.groupBy("qname").agg(F.count(F.lit(1)).alias("n"))
    shared = known.join(up, "taxid").groupBy("qname", "ancestor").agg(F.count(F.lit(1)).alias("k"))
    return shared.join(n, "qname").filter("k = n").join(depth, "ancestor").groupBy("qname").agg(F.max(F.struct("depth", "ancestor"))["ancestor"].alias("lca"))


def taxon_counts(lca: DataFrame) -> DataFrame:
    return lca.groupBy(F.col("lca").alias("taxid")).agg(F.count(F.lit(1)).alias("n"))
