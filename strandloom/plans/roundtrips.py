"""Queries of the readers and writers: a view is written as text, read back, and compared
with the view itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import popgen
from ..sources import sinks, text
from .registry import ORACLE, p4_found, query
from .runtime import shared_dir
from .views import view

_CLEAN = "regexp_replace(id, '\\s+', '_'@g@)"


def _path(spark: SparkSession) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark)}/strandloom/text-{uuid.uuid4().hex}"


def _written(df: DataFrame, line: Column, head: str | None = None) -> str:
    path = _path(df.sparkSession)
    df.select(line.alias("value")).write.text(path)
    if head is not None:
        df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def _tabs(*columns: str | Column) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def _probes(spark, d):
    return view(spark, d, "v_probes").select(F.regexp_replace("id", r"\s+", "_").alias("id"), "seq")


@query("s1_vcf", "select chr, pos, ref, alt, case when alt is null then 0 else n_alt end as n_alt from @v_variants@ where chr is not null and pos is not null and ref is not null")
def s1_vcf(spark, d):
    v = view(spark, d, "v_variants").filter("chr is not null and pos is not null and ref is not null")
    more = F.when(F.col("alt").isNull(), ".").when(F.col("n_alt") > 1, F.concat("alt", F.lit(",<X>"))).otherwise(F.col("alt"))
    path = _written(v, _tabs("chr", "pos", F.lit("."), "ref", more, F.lit("50"), F.lit("PASS"), F.lit(".")), "##fileformat=VCFv4.2\n#CHROM\tPOS")
    return text.read_vcf(spark, path).select("chr", "pos", "ref", "alt", "n_alt")


@query("s3_vcf_count", "select count(*) as n from @v_variants@ where chr is not null and pos is not null and length(ref) = 1 and upper(alt) in ('A', 'C', 'G', 'T')")
def s3_vcf_count(spark, d):
    v = view(spark, d, "v_variants").filter("chr is not null and pos is not null and ref is not null")
    path = _written(v, _tabs("chr", "pos", F.lit("."), "ref", F.coalesce("alt", F.lit("."))), "#CHROM\tPOS")
    return text.count_snps(text.read_vcf(spark, path))


@query("s2_vcf_region", "select chr, pos, ref from @v_variants@ where chr = 'chr1' and pos between 1000 and 100000")
def s2_vcf_region(spark, d):
    """A VCF kept by chromosome and place; the region filter prunes files and row groups."""
    path = _path(spark)
    text.variants_table(view(spark, d, "v_variants").filter("chr is not null and pos is not null"), path)
    return spark.read.parquet(path).filter("chr = 'chr1' and pos between 1000 and 100000").select("chr", "pos", "ref")


@query("s5_fasta", f"select {_CLEAN} as id, seq from @v_probes@")
def s5_fasta(spark, d):
    path = _path(spark)
    sinks.write_fasta(_probes(spark, d), path)
    return text.read_fasta(spark, path).select("id", "seq")


@query("k2_fasta_unwrapped", f"select {_CLEAN} as id, seq from @v_probes@")
def k2_fasta_unwrapped(spark, d):
    path = _path(spark)
    sinks.write_fasta(_probes(spark, d), path, wrap=0)
    return text.read_fasta(spark, path).select("id", "seq")


@query("s5_genome_pieces", "select chr, length(seq) as n, md5(seq) as digest from @v_wgenome@")
def s5_genome_pieces(spark, d):
    """A genome written with line breaks, read in pieces, and put together for the comparison."""
    path = _path(spark)
    sinks.write_fasta(view(spark, d, "v_wgenome"), path, key="chr")
    whole = text.read_genome(spark, path).groupBy("chr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    return whole.select("chr", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


@query("s7_snp_tsv", "select snp_id, chr, pos, type, ref, alt, gc, tm, complexity, hairpin from @v_snps@")
def s7_snp_tsv(spark, d):
    path = _path(spark)
    sinks.write_snps(view(spark, d, "v_snps"), path)
    r = text.read_snp_tsv(spark, path)
    return r.select(F.col("snp_id").cast("long").alias("snp_id"), "chr", "pos", "type", "ref", "alt", "gc", "tm", "complexity", "hairpin")


@query("k3_snp_columns", "select string_agg(c, ',' order by i) as columns from (values (1, 'chr'), (2, 'pos'), (3, 'type'), (4, 'ref'), (5, 'alt'), (6, 'gc'), (7, 'tm'), (8, 'complexity'), (9, 'hairpin'), (10, 'snp_id'), (11, 'run_id')) t(i, c)")
def k3_snp_columns(spark, d):
    """Canonical columns first, the others behind them."""
    path = _path(spark)
    sinks.write_snps(view(spark, d, "v_snps"), path)
    return spark.createDataFrame([(",".join(spark.read.csv(path, sep="\t", header=True).columns),)], "columns string")


@query("s8_bed", "select name, chr, start, @end@ as stop, coalesce(strand, '') as strand from @v_bed@")
def s8_bed(spark, d):
    bed = view(spark, d, "v_bed")
    path = _written(bed, F.concat_ws("  ", "chr", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.lit("."), F.coalesce("strand", F.lit("*"))), "track name=x\n# comment\nbroken line")
    r = text.read_bed(spark, path).filter("score is null")
    return r.select("name", "chr", "start", F.col("end").alias("stop"), F.when(F.col("strand") == "*", "").otherwise(F.col("strand")).alias("strand"))


@query("s9_bed_tab", "select name, chr, start, @end@ as stop, cast(length(name) as double) as score from @v_bed@")
def s9_bed_tab(spark, d):
    path = _path(spark)
    sinks.write_tsv(view(spark, d, "v_bed").withColumn("score", F.length("name").cast("double")).withColumn("strand", F.coalesce("strand", F.lit("."))), path, ["chr", "start", "end", "name", "score", "strand"])
    return text.read_bed(spark, path).select("name", "chr", "start", F.col("end").alias("stop"), "score")


@query("s10_gff", "select 'g' || name as id, name as parent, 'G ' || chr as gene, chr, start, @end@ as stop from @v_bed@")
def s10_gff(spark, d):
    """Ids, parents and gene names of a GFF3 file."""
    gff = _tabs("chr", F.lit("x"), F.lit("exon"), F.col("start") + 1, "end", F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), F.concat(F.lit("ID=g"), "name", F.lit(";Parent="), "name", F.lit("; gene=G "), "chr"))
    path = _written(view(spark, d, "v_bed"), gff, "##gff-version 3\n\nshort\tline")
    return text.read_gff(spark, path, ["exon"]).select("id", "parent", "gene", "chr", "start", F.col("end").alias("stop"))


@query("j21_genes", "select 'g' || name as id, chr, start from @v_bed@ where chr in ('chr1', 'chrX')")
def j21_genes(spark, d):
    """Features of a GTF file, of two genes."""
    gtf = _tabs("chr", F.lit("x"), F.lit("exon"), F.col("start") + 1, "end", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "g'), "name", F.lit('"; gene_name "'), "chr", F.lit('"; transcript_id "t";')))
    f = text.read_gff(spark, _written(view(spark, d, "v_bed"), gtf))
    return text.genes_only(f, ["chr1", "chrX"]).select("id", "chr", "start")


@query("s11_sizes", "select chr, len from @v_chroms@")
def s11_sizes(spark, d):
    path = _path(spark)
    sinks.write_tsv(view(spark, d, "v_chroms"), path, ["chr", "len"])
    return text.read_sizes(spark, path)


@query("s12_kraken", f"select {_CLEAN} as id, line from @v_kraken@")
def s12_kraken(spark, d):
    k = view(spark, d, "v_kraken").withColumn("id", F.regexp_replace("id", r"\s+", "_"))
    return text.read_kraken(spark, _written(k, _tabs(F.lit("C"), "id", F.lit("9606"), F.lit("81"), "line"))).select("id", "line")


def _sam(spark, d) -> DataFrame:
    h = view(spark, d, "v_hits")
    tags = F.concat_ws("\t", F.concat(F.lit("AS:i:"), F.col("as_score").cast("string")), F.concat(F.lit("XS:i:"), F.col("xs_score").cast("string")), F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))
    line = F.concat(_tabs("qname", F.when(F.col("as_score").isNull(), 4).otherwise(0), "rname", F.lit(7), "mapq", F.lit("81M"), F.lit("*"), F.lit(0), F.lit(0), F.repeat(F.lit("A"), F.col("qlen")), F.lit("*")), F.lit("\t"), tags)
    return text.read_sam(spark, _written(h, line, "@HD\tVN:1.6"))


@query("s13_sam", "select cast(qname as varchar) as qname, rname, mapq, nm, qlen, as_score, case when as_score is not null then xs_score end as xs_score, as_score is not null as mapped from @v_hits@")
def s13_sam(spark, d):
    return _sam(spark, d).select("qname", "rname", "mapq", "nm", "qlen", "as_score", "xs_score", "mapped")


@query("s20_mapping_summary", "with q as (select qname, count(as_score) as n from @v_hits@ group by qname) select count(*) as n_reads, count(*) filter (n = 0) as n_zero, count(*) filter (n = 1) as n_once, count(*) filter (n > 1) as n_multi, 100.0::double * count(*) filter (n > 0) / count(*) as percent_aligned from q")
def s20_mapping_summary(spark, d):
    return text.mapping_summary(_sam(spark, d))


@query("s15_taxonomy", "select t.taxid, parent, name from @v_tree@ t")
def s15_taxonomy(spark, d):
    t = view(spark, d, "v_tree")
    names = text.read_names(spark, _written(t, F.concat(F.col("taxid").cast("string"), F.lit("\t|\t"), "name", F.lit("\t|\t\t|\tscientific name\t|")), "5\t|\tother\t|\t\t|\tsynonym\t|"))
    nodes = text.read_nodes(spark, _written(t, F.concat(F.col("taxid").cast("string"), F.lit("\t|\t"), F.col("parent").cast("string"), F.lit("\t|\tno rank\t|"))))
    return nodes.join(names, "taxid").select("taxid", "parent", "name")


@query("s15_accessions", "select accession, taxid from @v_acc@")
def s15_accessions(spark, d):
    return text.read_accessions(spark, _written(view(spark, d, "v_acc"), _tabs("accession", "taxid"), "accession\ttaxid"))


@query("s16_lca", f"select {_CLEAN} as id, cast(length(seq) as int) as taxid from @v_probes@")
def s16_lca(spark, d):
    p = _probes(spark, d)
    line = _tabs(F.concat("id", F.lit(":ACGT:4:1")), F.concat(F.length("seq").cast("string"), F.lit(':"name":"species"')), F.lit('1:"root":"no rank"'))
    return text.read_lca(spark, _written(p, line, "# comment"))


@query("s17_clusters", f"with m as ({ORACLE['p4_found'].strip()}), n as (select dense_rank() over (order by family_id) as family_id, member_no, regexp_replace(member, '\\s+', '_', 'g') as member, max(member_no) over (partition by family_id) as last from m) select cast(family_id as int) as family_id, member_no, member, max(case when member_no = last then member end) over (partition by family_id) as representative from n")
def s17_clusters(spark, d):
    """Families as sections of a clustering listing; their last member represents them."""
    m = p4_found(spark, d).withColumn("member", F.regexp_replace("member", r"\s+", "_"))
    names = m.select("family_id").distinct().orderBy("family_id")
    from ..operators.probes import dense_index

    numbered = dense_index(names, ["family_id"], "no").withColumn("no", F.col("no") + 1)
    g = m.join(numbered, "family_id").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("member_no", "member"))).alias("x"))
    lines = F.transform("x", lambda x, i: F.concat(i.cast("string"), F.lit("\t81nt, >"), x["member"], F.when(i == F.size("x") - 1, "... *").otherwise("... at +/95.00%")))
    path = _written(g, F.concat(F.lit(">Cluster "), F.col("no").cast("string"), F.lit("\n"), F.array_join(lines, "\n")))
    return text.read_clusters(spark, path)


@query("s18_populations", "select sample, pop from @v_pops@")
def s18_populations(spark, d):
    path = _path(spark)
    sinks.write_tsv(view(spark, d, "v_pops"), path, ["sample", "pop"])
    return text.read_populations(spark, path).select("sample", "pop")


@query("s19_sfs", "with c as (select chr, pos, pop, cast(sum(gt) as int) as ac, cast(count(gt) * 2 as int) as an from @v_gt@ join @v_pops@ using (sample) where pop = 'A' and gt is not null group by all), k as (select least(ac, an - ac) as bin, count(*)::double as sites from c where an = (select max(an) from c) group by all) select cast(i as int) as i, coalesce(sites, 0.0) as count, i = 0 or i > 4 as masked from range(0, 9) t(i) left join k on k.bin = i")
def s19_sfs(spark, d):
    counts = popgen.allele_counts(view(spark, d, "v_gt"), view(spark, d, "v_pops"))
    path = _path(spark)
    sinks.write_sfs(popgen.sfs(counts), path, "A", 8)
    return text.read_sfs(spark, path).select("i", "count", "masked")


@query("k5_metrics", "select count(*) as n_total, count(*) filter (length(ref) = 1 and alt in ('A','C','G','T')) as n_snp from @v_variants@")
def k5_metrics(spark, d):
    from ..operators import variants

    path = _path(spark)
    sinks.write_metrics(variants.stage_counts(view(spark, d, "v_variants")), path)
    return spark.read.schema("n_total bigint, n_snp bigint").json(path)


@query("k6_rejects", f"select {_CLEAN} as id, seq from @v_probes@ where not (length(seq) >= 60 and not contains(seq, 'N'))")
def k6_rejects(spark, d):
    """The sequences that a filter took out, as a FASTA file."""
    p = view(spark, d, "v_probes").withColumn("id", F.concat(F.regexp_replace("id", r"\s+", "_"), F.lit("|"), F.md5(F.concat_ws("|", "id", "seq"))))
    path = _path(spark)
    sinks.write_rejects(p, p.filter("length(seq) >= 60 and not contains(seq, 'N')"), "id", path)
    return text.read_fasta(spark, path).select(F.regexp_replace("id", r"\|[0-9a-f]{32}$", "").alias("id"), "seq")
