"""Writers: text formats as folders of part files, written in parallel."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import write_text

SNP_ORDER = ["chr", "pos", "type", "ref", "alt", "gc", "tm", "complexity", "hairpin", "dimer", "entropy"]


def fasta_record(key: Column, seq: Column, wrap: int = 80) -> Column:
    """One FASTA record; lines of ``wrap`` letters, or one line for 0."""
    body = F.regexp_replace(seq, rf"(.{{{wrap}}})(?=.)", "$1\n") if wrap else seq
    return F.concat(F.lit(">"), key, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, key: str = "id", seq: str = "seq", wrap: int = 80, order: str | None = None) -> None:
    """Records with an id and a sequence (empty ones too); in ``order`` if given."""
    out = df.filter(F.col(key).isNotNull() & F.col(seq).isNotNull())
    if order:
        out = out.orderBy(order)
    out.select(fasta_record(F.col(key), F.col(seq), wrap).alias("value")).write.mode("overwrite").text(path)


def write_snps(df: DataFrame, path: str) -> None:
    """Tab-separated with a header: canonical columns first, then the others; sorted."""
    columns = [c for c in SNP_ORDER if c in df.columns] + [c for c in df.columns if c not in SNP_ORDER]
    df.orderBy("chr", "pos").select(*columns).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_tsv(df: DataFrame, path: str, columns: list[str], header: bool = False) -> None:
    """Chosen columns, tab-separated: sizes (chr, len), populations (sample, pop), intervals."""
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=header)


def write_rejects(before: DataFrame, after: DataFrame, key: str, path: str, seq: str = "seq") -> None:
    """The sequences that a filter took out."""
    write_fasta(before.join(after.select(key), key, "left_anti"), path, key, seq)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_sfs(spectrum: DataFrame, path: str, pop: str, n: int) -> None:
    """A folded spectrum (bin, sites) of one population in the dadi text form."""
    full = spectrum.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("bin")).join(spectrum.filter(F.col("pop") == pop), "bin", "left")
    row = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("sites", F.lit(0.0)).alias("v")))), lambda x: x["v"].cast("string")).alias("v"))  # n + 1 values
    mask = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.when((i == 0) | (i > n // 2), "1").otherwise("0"))
    row.select(F.concat(F.lit(f'{n + 1} folded "{pop}"\n'), F.array_join("v", " "), F.lit("\n"), F.array_join(mask, " ")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_status(spark: SparkSession, path: str, steps: list[dict]) -> None:
    """The state of a pipeline's steps, on the file system of its output."""
    write_text(spark, path, json.dumps({"updated": datetime.now(UTC).isoformat(timespec="seconds"), "steps": steps}, indent=1))
