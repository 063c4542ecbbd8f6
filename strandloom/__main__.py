"""Command line: ``python -m strandloom COMMAND …``; every command reads files, applies operators
and writes a folder of part files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import seq as sequences
from .functions import thermo
from .operators import assess, filters, intervals, probes, select, sets, variants
from .plans import pipeline
from .sources import sinks, text


def _genome(spark, path: str) -> DataFrame:
    return text.read_genome(spark, path)


def _fasta(spark, path: str) -> DataFrame:
    return text.read_fasta(spark, path).select("id", "seq")


def extract(spark, a) -> None:
    """SNPs of a VCF, outside dense clusters and inside or outside regions."""
    v = variants.with_type(variants.valid_snps(text.read_vcf(spark, a.input), a.biallelic))
    if a.flank:
        v = variants.cluster_filter(v, a.flank, a.most)
    for bed, keep in ((a.keep, True), (a.remove, False)):
        if bed:
            v = intervals.covered(v, text.read_bed(spark, bed), keep)
    sinks.write_snps(v.select("chr", "pos", "type", "ref", "alt"), a.out)


def filter_scores(spark, a) -> None:
    """SNPs whose probes' GC, melting temperature and complexity lie within bounds."""
    cut = probes.cut_probes(text.read_snp_tsv(spark, a.input), _genome(spark, a.genome), a.length).filter("reject is null")
    s = F.col("seq")
    scored = cut.withColumn("gc", sequences.gc_percent(s)).withColumn("tm", thermo.tm_probe(s, a.table)).withColumn("complexity", sequences.dust(s))
    bounds = [("gc", *a.gc), ("tm", *a.tm), ("complexity", -1, a.complexity)]
    kept = filters.cascade(scored, [(c, filters.in_range(F.col(c), lo, hi)) for c, lo, hi in bounds]).filter("fail_reason is null")
    sinks.write_snps(kept.select("chr", "pos", "type", "ref", "alt", "gc", "tm", "complexity"), a.out)


def select_snps(spark, a) -> None:
    """SNPs spread over the genome: uniform, random, weighted, or of priority regions first."""
    p = {"strategy": a.strategy, "total": a.total, "window": a.window, "seed": a.seed}
    tables = {"last": text.read_snp_tsv(spark, a.input)} | ({"regions": text.read_bed(spark, a.regions)} if a.regions else {})
    sinks.write_snps(pipeline.step_select(spark, tables, p).select("chr", "pos", "type", "ref", "alt"), a.out)


def build(spark, a) -> None:
    """Probe sequences around SNPs."""
    cut = probes.cut_probes(text.read_snp_tsv(spark, a.input), _genome(spark, a.genome), a.length, a.shift, a.replace_snp)
    sinks.write_fasta(cut.filter("reject is null"), a.out, "probe_id", wrap=0)


def assess_probes(spark, a) -> None:
    """Statistics of a probe set's GC, melting temperature, complexity and entropy."""
    s = F.col("seq")
    scored = _fasta(spark, a.input).select(sequences.gc_percent(s).alias("gc"), thermo.tm_probe(s, a.table).alias("tm"), sequences.dust(s).alias("complexity"), sequences.entropy(s).alias("entropy"))
    sinks.write_metrics(assess.summary(scored, ["gc", "tm", "complexity", "entropy"]), a.out)


def tile(spark, a) -> None:
    """Windows of sequences."""
    sinks.write_fasta(probes.tile_sequences(_fasta(spark, a.input), length=a.length, step=a.step), a.out, "tile_id", "tile", wrap=0)


def dedup(spark, a) -> None:
    """The first of equal sequences."""
    sinks.write_fasta(sets.first_wins(_fasta(spark, a.input), ["seq"], ["id"]), a.out, wrap=0)


def merge(spark, a) -> None:
    """Several sets in one, each sequence once, with a list of what was taken out."""
    kept, removed = sets.merge_dedup([(f"set{i}", _fasta(spark, p)) for i, p in enumerate(a.inputs)])
    sinks.write_fasta(kept, a.out, wrap=0)
    sinks.write_tsv(removed, f"{a.out}.removed", ["removed_id", "kept_id"])


def adapter(spark, a) -> None:
    """Adapters in front of and behind each sequence."""
    sinks.write_fasta(_fasta(spark, a.input).withColumn("seq", probes.add_adapters(F.col("seq"), a.five, a.three)), a.out, wrap=0)


def rename(spark, a) -> None:
    """Ids of a prefix and a number."""
    sinks.write_fasta(probes.rename_by_prefix(_fasta(spark, a.input), ["id", "seq"], a.prefix).withColumn("id", F.col("new_id")), a.out, wrap=0)


def sample(spark, a) -> None:
    """A number of sequences, the same ones for the same seed."""
    sinks.write_fasta(select.select_random(_fasta(spark, a.input), a.number, ["id", "seq"], a.seed), a.out, wrap=0)


def convert(spark, a) -> None:
    """A table of sequences with length and GC content."""
    t = _fasta(spark, a.input).select("id", "seq", F.length("seq").alias("length"), sequences.gc_percent(F.col("seq")).alias("gc"))
    sinks.write_tsv(t, a.out, ["id", "seq", "length", "gc"], header=True)


def validate(spark, a) -> None:
    """Counts of what isn't valid in a FASTA, SNP or interval file."""
    kind = {"fasta": lambda: filters.validate_sequences(_fasta(spark, a.input)), "snps": lambda: filters.validate_snps(text.read_snp_tsv(spark, a.input)), "bed": lambda: filters.validate_intervals(text.read_bed(spark, a.input))}
    sinks.write_metrics(kind[a.kind](), a.out)


def run(spark, a) -> None:
    """The steps of a pipeline file."""
    tables = {"variants": text.read_vcf(spark, a.variants)}
    if a.regions:
        tables["regions"] = text.read_bed(spark, a.regions)
    if a.genome:
        tables["genome"] = _genome(spark, a.genome)
    pipeline.run(spark, pipeline.load_config(spark, a.input), tables, a.out, a.resume)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    commands = top.add_subparsers(required=True, metavar="COMMAND")

    def command(name: str, act, *options: tuple[str, dict], many: bool = False) -> None:
        c = commands.add_parser(name, help=(act.__doc__ or "").strip())
        c.set_defaults(act=act)
        if many:
            c.add_argument("inputs", nargs="+")
        else:
            c.add_argument("input")
        c.add_argument("-o", "--out", required=True)
        for flag, how in options:
            c.add_argument(flag, **how)

    number, text_, flag = (lambda d: {"type": int, "default": d}), {"default": None}, {"action": "store_true"}
    table = ("--table", {"default": thermo.PROBES, "choices": list(thermo.TABLES)})
    pair = lambda lo, hi: {"type": float, "nargs": 2, "default": [lo, hi]}
    command("extract", extract, ("--biallelic", flag), ("--flank", number(60)), ("--most", number(3)), ("--keep", text_), ("--remove", text_))
    command("filter", filter_scores, ("--genome", {"required": True}), ("--length", number(81)), ("--gc", pair(35, 65)), ("--tm", pair(60, 80)), ("--complexity", {"type": float, "default": 2.0}), table)
    command("select", select_snps, ("--strategy", {"default": "uniform"}), ("--total", number(50_000)), ("--window", number(10_000)), ("--seed", number(42)), ("--regions", text_))
    command("build", build, ("--genome", {"required": True}), ("--length", number(81)), ("--shift", number(0)), ("--replace-snp", flag))
    command("assess", assess_probes, table)
    command("tile", tile, ("--length", number(81)), ("--step", number(30)))
    command("dedup", dedup)
    command("merge", merge, many=True)
    command("adapter", adapter, ("--five", {"default": ""}), ("--three", {"default": ""}))
    command("rename", rename, ("--prefix", {"default": "probe"}))
    command("sample", sample, ("--number", {"type": int, "required": True}), ("--seed", number(42)))
    command("convert", convert)
    command("validate", validate, ("--kind", {"choices": ["fasta", "snps", "bed"], "default": "fasta"}))
    command("run", run, ("--variants", {"required": True}), ("--regions", text_), ("--genome", text_), ("--resume", flag))
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.act(SparkSession.builder.appName("strandloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
