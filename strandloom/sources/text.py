"""Readers of text formats into DataFrames.

All read lines in parallel and parse them with JVM expressions; lines that can't be
read are dropped where a reader says so.  Line order is no part of a DataFrame, so
readers whose records are ordered carry ``ord`` (record place within the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.popgen import genotype
from ..plans.runtime import materialize


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file (also gzip), without a carriage return at their end."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def _fields(df: DataFrame, sep: str, names: list[tuple[str, str]]) -> DataFrame:
    parts = F.split("line", sep, -1)
    return df.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)])


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF: chr, pos, id, ref, alt (the first alternative; null for ``.``),
    n_alt, qual, filter, info, format, fields (the sample columns). Header lines and
    lines of fewer than five columns are dropped."""
    rows = lines(spark, path).filter(~F.startswith("line", F.lit("#")))
    p = F.split("line", "\t")
    at = lambda i: F.try_element_at(p, F.lit(i))
    alts = F.split(at(5), ",")
    first = F.try_element_at(alts, F.lit(1))
    real = (first != ".") & (first != "")
    return rows.filter(F.size(p) >= 5).select(
        at(1).alias("chr"), at(2).try_cast("bigint").alias("pos"), at(3).alias("id"), at(4).alias("ref"),
        F.when(real, first).alias("alt"), F.when(real, F.size(alts)).otherwise(0).alias("n_alt"),
        at(6).try_cast("double").alias("qual"), at(7).alias("filter"), at(8).alias("info"), at(9).alias("format"), F.slice(p, 10, 1 << 30).alias("fields"),
    )


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the #CHROM line; empty without one."""
    head = lines(spark, path).filter(F.startswith("line", F.lit("#CHROM"))).limit(1).collect()
    return head[0][0].split("\t")[9:] if head else []


def vcf_genotypes(spark: SparkSession, path: str, sites: DataFrame | None = None) -> DataFrame:
    """Long genotypes (chr, pos, sample, gt): non-reference alleles by the GT part of the
    format, null for missing ones; only ``sites`` (chr, pos) if given."""
    v = read_vcf(spark, path)
    if sites is not None:
        v = v.join(sites.select("chr", "pos").distinct(), ["chr", "pos"], "left_semi")
    names = F.array(*[F.lit(s) for s in vcf_samples(spark, path)])
    e = v.select("chr", "pos", "format", F.posexplode("fields").alias("_i", "_f"))
    return e.select("chr", "pos", F.try_element_at(names, F.col("_i") + 1).alias("sample"), genotype(F.col("_f"), F.col("format")).alias("gt"))


def count_snps(vcf: DataFrame) -> DataFrame:
    """One row ``n``: records with a one-letter reference and a base as first alternative."""
    return vcf.agg(F.count_if((F.length("ref") == 1) & F.upper("alt").isin("A", "C", "G", "T")).alias("n"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records (ord, id, description, seq): id is the first word, seq in upper case without
    white space. Records are split at ``>`` by the line reader, so a record is one row
    and files stay splittable; an empty file gives no rows."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("v"), F.monotonically_increasing_id().alias("ord"))
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s+", ""))
    return rec.filter(F.trim("v") != "").select("ord", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("seq"))


def read_genome(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """A FASTA genome in pieces: (chr, from, piece), piece being up to ``size`` letters in upper
    case and ``from`` the 0-based place of the first; chr is the first word of the header.

    The file is read by lines in all of its blocks at once, so no row holds a chromosome and
    a chromosome is no task. Each block numbers the records it meets and the places in them;
    a record that began in an earlier block is found by the totals of the blocks before
    (one row for each block and record). Lines in front of the first header are dropped.
    The cutting and region operators take this table in place of (chr, seq)."""

    def cut(batches):
        import pyarrow as pa

        names = ["file", "block", "rec", "name", "at", "piece"]
        rows: list[tuple] = []
        place, rec, name, at, parts, have = (None, None), 0, None, 0, [], 0

        def flush():
            nonlocal at, parts, have
            if have or name is not None:
                rows.append((*place, rec, name, at, "".join(parts)))
            at, parts, have = at + have, [], 0

        for b in batches:
            for line, file, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (file, block) != place:
                    flush()
                    place, rec, name, at = (file, block), 0, None, 0
                if line.startswith(">"):
                    flush()
                    rec, name, at = rec + 1, (line[1:].split() or [""])[0], 0
                    continue
                text = "".join(line.split()).upper()
                for i in range(0, len(text), size):
                    part = text[i : i + size]
                    if have and have + len(part) > size:
                        flush()
                    parts.append(part)
                    have += len(part)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names)
                rows = []
        flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names)

    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = materialize(raw.mapInArrow(cut, "file string, block long, rec long, name string, at long, piece string")).df
    each = pieces.groupBy("file", "block", "rec").agg(F.max("name").alias("name"), F.sum(F.length("piece")).alias("n"))
    w = Window.partitionBy("file").orderBy("block", "rec")
    each = each.withColumn("g", F.count("name").over(w))
    run = Window.partitionBy("file", "g").orderBy("block", "rec")
    known = each.select("file", "block", "rec", F.first("name").over(run).alias("chr"), F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return pieces.filter(F.length("piece") > 0).join(known.filter("chr is not null"), ["file", "block", "rec"]).select("chr", (F.col("before") + F.col("at")).alias("from"), "piece")


def read_snp_tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """SNP tables with a header; ``chrom`` is read as ``chr``; pos and scores are numbers. A
    table without a header has chr, pos, type, ref, alt. ValueError for missing columns."""
    df = spark.read.csv(path, sep="\t", header=header)
    if not header:
        df = df.toDF(*["chr", "pos", "type", "ref", "alt"][: len(df.columns)])
    if "chrom" in df.columns and "chr" not in df.columns:
        df = df.withColumnRenamed("chrom", "chr")
    missing = {"chr", "pos", "ref", "alt"} - set(df.columns)
    if missing:
        raise ValueError(f"missing column(s): {', '.join(sorted(missing))}")
    df = df.withColumn("pos", F.col("pos").try_cast("bigint"))
    for c in ("gc", "tm", "complexity", "hairpin", "dimer", "entropy"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast("double"))
    return df


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (chr, start, end, name, score, strand): columns apart by any white space;
    comments, ``track`` and ``browser`` lines, and lines without two numbers are dropped;
    a missing name is ``chr:start-end``, a ``.`` score null."""
    rows = lines(spark, path).filter(~F.col("line").rlike(r"^\s*(#|track\b|browser\b|$)"))
    t = rows.withColumn("line", F.regexp_replace(F.trim("line"), r"\s+", "\t"))
    f = _fields(t, "\t", [("chr", "string"), ("start", "bigint"), ("end", "bigint"), ("name", "string"), ("score", "double"), ("strand", "string")])
    default = F.concat(F.col("chr"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return f.filter("start is not null and end is not null").withColumn("name", F.coalesce("name", default))


def gff_attributes(text: Column) -> Column:
    """Attributes of a GFF3 (``k=v;``) or GTF (``k "v";``) field as a map; the first of
    repeated keys holds."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.when(F.contains(x, F.lit("=")), F.struct(F.regexp_extract(x, r"^([^=\s]+)\s*=", 1).alias("key"), F.regexp_extract(x, r"=\s*(.*)$", 1).alias("value"))).otherwise(F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(x, r"^\S+\s*(.*)$", 1), '^"|"$', "").alias("value"))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    first = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), 1)["value"].alias("value")))
    return F.map_from_entries(first)


def read_gff(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """Features of a GFF or GTF: chr, source, kind, start (0-based), end, score, strand, phase,
    attributes (map), id, parent, gene; only ``kinds`` if given."""
    rows = lines(spark, path).filter(~F.col("line").rlike(r"^\s*(#|$)"))
    p = F.split("line", "\t")
    at = lambda i: F.try_element_at(p, F.lit(i))
    g = rows.filter(F.size(p) >= 9).select(at(1).alias("chr"), at(2).alias("source"), at(3).alias("kind"), (at(4).try_cast("bigint") - 1).alias("start"), at(5).try_cast("bigint").alias("end"), at(6).try_cast("double").alias("score"), at(7).alias("strand"), at(8).try_cast("int").alias("phase"), gff_attributes(at(9)).alias("attributes"))
    a = lambda *ks: F.coalesce(*[F.try_element_at("attributes", F.lit(k)) for k in ks])
    g = g.withColumn("id", a("ID", "gene_id", "transcript_id")).withColumn("parent", a("Parent", "transcript_id")).withColumn("gene", a("gene", "gene_name", "Name", "gene_id"))
    return g.filter(F.col("kind").isin(*kinds)) if kinds else g


def genes_only(features: DataFrame, genes: list[str]) -> DataFrame:
    """Features whose id, gene name or parent is among ``genes``."""
    return features.filter(F.col("id").isin(*genes) | F.col("gene").isin(*genes) | F.col("parent").isin(*genes))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chr, len) of an index or sizes file."""
    return _fields(lines(spark, path), "\t", [("chr", "string"), ("len", "bigint")]).filter("len is not null")


def read_kraken(spark: SparkSession, path: str) -> DataFrame:
    """(status, id, taxid, length, line) of classifier output; ``line`` is its k-mer field."""
    return _fields(lines(spark, path), "\t", [("status", "string"), ("id", "string"), ("taxid", "string"), ("length", "string"), ("line", "string")]).filter("id is not null")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments (qname, flag, rname, pos, mapq, cigar, qlen, as_score, xs_score, nm, mapped);
    a missing NM is 0; scores of unmapped reads are null. Lines of fewer than 11 columns are dropped."""
    rows = lines(spark, path).filter(~F.startswith("line", F.lit("@")))
    p = F.split("line", "\t")
    at = lambda i: F.try_element_at(p, F.lit(i))
    r = rows.filter(F.size(p) >= 11).select(at(1).alias("qname"), at(2).try_cast("int").alias("flag"), at(3).alias("rname"), at(4).try_cast("bigint").alias("pos"), at(5).try_cast("int").alias("mapq"), at(6).alias("cigar"), F.length(at(10)).alias("qlen"), F.slice(p, 12, 1 << 30).alias("_t"))
    tag = lambda k: F.split_part(F.try_element_at(F.filter("_t", lambda x: F.startswith(x, F.lit(f"{k}:"))), F.lit(1)), F.lit(":"), F.lit(3)).try_cast("int")
    r = r.withColumn("_t", F.when(F.size("_t") > 0, F.col("_t")))
    safe = lambda k: F.when(F.exists("_t", lambda x: F.startswith(x, F.lit(f"{k}:"))), tag(k))
    mapped = (F.col("flag").bitwiseAND(4) == 0) & (F.col("rname") != "*")
    return r.select("qname", "flag", "rname", "pos", "mapq", "cigar", "qlen", F.when(mapped, safe("AS")).alias("as_score"), F.when(mapped, safe("XS")).alias("xs_score"), F.coalesce(safe("NM"), F.lit(0)).alias("nm"), mapped.alias("mapped"))


def mapping_summary(sam: DataFrame) -> DataFrame:
    """One row: reads, those aligned nowhere, once and several times, and the percent aligned."""
    per = sam.groupBy("qname").agg(F.count_if("mapped").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(F.col("n") == 0).alias("n_zero"), F.count_if(F.col("n") == 1).alias("n_once"), F.count_if(F.col("n") > 1).alias("n_multi")).withColumn("percent_aligned", F.when(F.col("n_reads") > 0, 100.0 * (F.col("n_once") + F.col("n_multi")) / F.col("n_reads")))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, name) of scientific names in a names dump."""
    p = F.transform(F.split("line", r"\|"), lambda x: F.trim(F.regexp_replace(x, "\t", "")))
    r = lines(spark, path).select(p.alias("p")).filter(F.size("p") >= 4)
    return r.filter(F.try_element_at("p", F.lit(4)) == "scientific name").select(F.try_element_at("p", F.lit(1)).try_cast("int").alias("taxid"), F.try_element_at("p", F.lit(2)).alias("name"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, parent) of a nodes dump."""
    p = F.transform(F.split("line", r"\|"), lambda x: F.trim(F.regexp_replace(x, "\t", "")))
    return lines(spark, path).select(p.alias("p")).filter(F.size("p") >= 2).select(F.try_element_at("p", F.lit(1)).try_cast("int").alias("taxid"), F.try_element_at("p", F.lit(2)).try_cast("int").alias("parent")).filter("taxid is not null")


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """(accession, taxid) of maps with 2 (accession, taxid), 3 or 4 columns (accession,
    versioned accession, taxid, …); both spellings are keys; a header is dropped."""
    p = F.split("line", r"\s+")
    r = lines(spark, path).select(p.alias("p")).filter((F.size("p") >= 2) & ~F.startswith(F.try_element_at("p", F.lit(1)), F.lit("accession")))
    wide = F.size("p") >= 3
    keys = F.when(wide, F.array(F.try_element_at("p", F.lit(1)), F.try_element_at("p", F.lit(2)))).otherwise(F.array(F.try_element_at("p", F.lit(1))))
    tax = F.when(wide, F.try_element_at("p", F.lit(3))).otherwise(F.try_element_at("p", F.lit(2))).try_cast("int")
    return r.select(F.explode(keys).alias("accession"), tax.alias("taxid")).filter("taxid is not null").distinct()


def read_lca(spark: SparkSession, path: str) -> DataFrame:
    """(id, taxid): the read id is the first field without its last three ``:`` parts, the taxid
    the first number before ``:`` in the fields after it."""
    p = F.split("line", "\t")
    rest = F.array_join(F.slice(p, 2, 1 << 30), "\t")
    r = lines(spark, path).filter(~F.startswith("line", F.lit("#"))).filter(F.size(p) >= 2)
    return r.select(F.regexp_replace(F.try_element_at(p, F.lit(1)), r"(:[^:]*){3}$", "").alias("id"), F.regexp_extract(rest, r"(\d+):", 1).try_cast("int").alias("taxid")).filter("taxid is not null")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(family_id, member_no, member, representative) of a clustering listing with
    ``>Cluster n`` sections; the member marked ``*`` represents its family."""
    rec = spark.read.option("lineSep", ">Cluster ").text(path).filter(F.trim("value") != "")
    rows = rec.select(F.regexp_extract("value", r"^\s*(\d+)", 1).try_cast("int").alias("family_id"), F.regexp_extract_all("value", F.lit(r">(\S+?)\.\.\."), F.lit(1)).alias("m"), F.regexp_extract("value", r">(\S+?)\.\.\. \*", 1).alias("representative"))
    return rows.select("family_id", F.posexplode("m").alias("_i", "member"), "representative").select("family_id", (F.col("_i") + 1).alias("member_no"), "member", "representative")


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    """(sample, pop): two columns apart by white space; comments are skipped; of a sample
    named twice the smallest population holds, ``n`` tells how often it is named."""
    p = F.split(F.trim("line"), r"\s+")
    r = lines(spark, path).filter(~F.col("line").rlike(r"^\s*(#|$)")).filter(F.size(p) >= 2)
    return r.select(F.try_element_at(p, F.lit(1)).alias("sample"), F.try_element_at(p, F.lit(2)).alias("pop")).groupBy("sample").agg(F.min("pop").alias("pop"), F.count(F.lit(1)).alias("n"))


def read_sfs(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, count, masked) of a one- or two-population spectrum file: dimensions, counts, mask.
    j is null for one population. A spectrum file is one small record."""
    f = spark.read.text(path, wholetext=True)
    ls = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    dims = F.transform(F.filter(F.split(F.try_element_at(ls, F.lit(1)), r"\s+"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))
    c = F.transform(F.split(F.trim(F.try_element_at(ls, F.lit(2))), r"\s+"), lambda x: x.try_cast("double"))
    m = F.split(F.trim(F.try_element_at(ls, F.lit(3))), r"\s+")
    r = f.select(dims.alias("d"), m.alias("m"), F.posexplode(c).alias("k", "count"))
    two = F.size("d") == 2
    w = F.when(two, F.try_element_at("d", F.lit(-1))).otherwise(1)
    return r.select(F.floor(F.col("k") / w).cast("int").alias("i"), F.when(two, F.col("k") % w).alias("j"), "count", F.coalesce(F.try_element_at("m", F.col("k") + 1) == "1", F.lit(False)).alias("masked"))


def variants_table(vcf: DataFrame, path: str) -> None:
    """A VCF kept for repeated use: Parquet by chromosome, sorted by position, so that region
    filters prune files and row groups."""
    vcf.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos").write.partitionBy("chr").mode("overwrite").parquet(path)


def first_in_order(df: DataFrame, by: list[str]) -> DataFrame:
    """The first record (by ``ord``) of each key."""
    w = Window.partitionBy(*by).orderBy("ord")
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
