"""The queries of the library and the SQL that each is checked against.

A query is registered with ``@query(name, sql)``; ``@view@`` in the SQL names a
view or table (see ``views``). Queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fold, seq, thermo
from ..operators import assess, filters, haplo, intervals, kmers, popgen, probes, select, sets, taxa, unpack, variants
from .views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = ctes(sql)
        return f

    return add


# ---- the flagship: variants, density, regions, one per window ----

_W1 = "select *, count(*) over (partition by chr order by pos range between 60 preceding and 60 following) as n_near from @v_sites@"


@query(
    "flagship_select",
    f"""with near as ({_W1}), kept as (select * from near where n_near <= 3),
    inside as (select * from kept s where exists (select 1 from @v_bed@ b where b.chr = s.chr and s.pos > b.start and s.pos <= b.@end@))
    select chr, pos, ref, alt, type from inside qualify row_number() over (partition by chr, pos // 10000 order by md5('42:' || chr || ':' || pos || ':' || ref || ':' || alt), pos, ref, alt) = 1""",
)
def flagship_select(spark, d):
    """Variants that lie neither in a cluster nor outside the regions, one per window."""
    v = view(spark, d, "v_sites")
    kept = intervals.covered(variants.cluster_filter(v, 60, 3), view(spark, d, "v_bed"))
    return select.select_priority(kept.withColumn("_p", F.lit(0)), "_p").select("chr", "pos", "ref", "alt", "type")


# ---- packed fields ----


@query(
    "p4_found",
    r"""with rows as (select distinct family_id, members from out_sample_clust where members is not null and family_id is not null),
    toks as (select family_id, unnest(t) as tok, unnest(range(len(t))) as i from (select family_id, regexp_extract_all(members, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^\s,;|\[\]{}()]+') as t from rows)),
    vals as (select family_id, i, trim(case when len(tok) >= 2 and tok[1] = '"' and tok[-1] = '"' then replace(tok[2:-2], '""', '"')
      when len(tok) >= 2 and tok[1] = '''' and tok[-1] = '''' then replace(tok[2:-2], '''''', '''') else tok end) as member from toks)
    select distinct family_id, cast(row_number() over (partition by family_id order by i) as int) as member_no, member from vals where member <> ''""",
)
def p4_found(spark, d):
    families = view(spark, d, "out_sample_clust").filter("family_id is not null")
    return unpack.split_packed(families, "members", ["family_id"], "member", "member_no").distinct()


# ---- record expressions ----


@query("rec1_tstv", "select chr, pos, ref, alt, case when ref || alt in ('AG', 'GA', 'CT', 'TC') then 'ts' else 'tv' end as type from (select distinct chr, pos, ref, alt from @v_snps@) as s")
def rec1_tstv(spark, d):
    return variants.with_type(view(spark, d, "v_snps").select("chr", "pos", "ref", "alt").distinct())


@query("rec2_coords", "select chr, pos, ref, alt, pos - 41 as start, pos + 40 as stop, cast(40 as bigint) as off, pos - 40 as start80, pos + 40 as stop80 from @v_sites@")
def rec2_coords(spark, d):
    v = view(spark, d, "v_sites")
    (s, e, o), (s80, e80, _) = probes.probe_window(F.col("pos"), 81), probes.probe_window(F.col("pos"), 80)
    return v.select("chr", "pos", "ref", "alt", s.alias("start"), e.alias("stop"), o.alias("off"), s80.alias("start80"), e80.alias("stop80"))


_CUT = """select s.*, pos - 41 as a, pos + 40 as z, upper(substr(g.seq, cast(pos - 40 as int), 81)) as raw, g.seq as g from @v_gsnps@ s left join @v_genome@ g on g.chr = s.chr"""
_REJECT = "case when g is null then 'no_chr' when a < 0 then 'before_start' when z > length(g) then 'after_end' when substr(g, cast(pos as int), 1) <> ref then 'ref_mismatch' end"
_PID = "chr || ':' || cast(a + 1 as string) || '-' || cast(z as string) || '_' || cast(pos as string) || '_' || type || '_' || ref || '_' || alt"


@query("rec4_probe_cut", f"select probe_id, reject, case when reject is null then raw end as seq from (select {_PID} as probe_id, {_REJECT} as reject, raw from ({_CUT}))")
def rec4_probe_cut(spark, d):
    return probes.cut_probes(view(spark, d, "v_gsnps"), view(spark, d, "v_genome")).select("probe_id", "reject", "seq")


def _pick_sql(choices: str, key: str) -> str:
    h = f"substr(md5({key}), 1, 6)"
    value = " + ".join(f"(instr('0123456789abcdef', substr({h}, {i + 1}, 1)) - 1) * {16 ** (5 - i)}" for i in range(6))
    return f"substr({choices}, cast(({value}) % length({choices}) + 1 as int), 1)"


@query(
    "rec5_third_base",
    f"""with c as (select *, {_PID} as probe_id from ({_CUT}) where {_REJECT} is null)
    select probe_id, substr(raw, 1, 40) || {_pick_sql("translate('ACGT', ref || alt, '')", 'probe_id')} || substr(raw, 42) as seq from c""",
)
def rec5_third_base(spark, d):
    return probes.cut_probes(view(spark, d, "v_gsnps"), view(spark, d, "v_genome"), replace_snp=True).filter("reject is null").select("probe_id", "seq")


@query("rec6_probe_id", f"select {_PID} as probe_id from (select *, pos - 41 as a, pos + 40 as z from @v_sites@)")
def rec6_probe_id(spark, d):
    start, end, _ = probes.probe_window(F.col("pos"), 81)
    return view(spark, d, "v_sites").select(probes.probe_id(start, end).alias("probe_id"))


_IDRX = r"^(.+):(\d+)-(\d+)_(\d+)_([a-z]+)_([A-Z]+)_([A-Z]+)$"


@query("rec7_parse_id", f"select probe_id, regexp_extract(probe_id, '{_IDRX}', 1) as chr, " + ", ".join(f"cast(regexp_extract(probe_id, '{_IDRX}', {i}) as bigint) as {n}" for i, n in ((2, "start1"), (3, "end1"), (4, "pos"))) + ", " + ", ".join(f"regexp_extract(probe_id, '{_IDRX}', {i}) as {n}" for i, n in ((5, "type"), (6, "ref"), (7, "alt"))) + f" from (select distinct probe_id from probe) where regexp_matches(probe_id, '{_IDRX}')")
def rec7_parse_id(spark, d):
    return probes.parse_probe_id(view(spark, d, "probe").select("probe_id").distinct(), "probe_id")


@query("rec8_tiling", f"select chr, pos, tag, a as start, z as stop, {_PID} || '_' || tag as probe_id from (select *, pos - 41 + shift as a, pos + 40 + shift as z from @v_sites@, (values ('C', 0), ('L', 15), ('R', -15)) t(tag, shift))")
def rec8_tiling(spark, d):
    return probes.tile_shifts(view(spark, d, "v_sites")).select("chr", "pos", "tag", "start", F.col("end").alias("stop"), "probe_id")


@query(
    "rec12_positions",
    f"""select chr, pos, place, allele, case when allele = 'REF' then ref else alt end as base, a as start, z as stop, {_PID} || '_' || place || '_' || allele as probe_id
    from (select *, pos - 41 + shift as a, pos + 40 + shift as z from @v_sites@, (values ('C', 0), ('L1', 20), ('R2', -20), ('L3', 7)) t(place, shift), (values ('REF'), ('ALT')) u(allele))""",
)
def rec12_positions(spark, d):
    return probes.tile_alleles(view(spark, d, "v_sites"), "center,left,right,7").withColumnRenamed("end", "stop")


@query("rec13_adapter", "select id, 'ACGTN' || seq || 'TTT' as seq from @v_probes@")
def rec13_adapter(spark, d):
    return view(spark, d, "v_probes").select("id", probes.add_adapters(F.col("seq"), "ACGTN", "TTT").alias("seq"))


@query("rec14_rename", "select id, 'panel_' || case when n < 10 ** greatest(4, length(cast(1 + (select count(*) from @v_probes@) as string))) then lpad(cast(n as string), cast(greatest(4, length(cast(1 + (select count(*) from @v_probes@) as string))) as int), '0') else cast(n as string) end as new_id from (select id, row_number() over (order by id, seq) as n from @v_probes@)")
def rec14_rename(spark, d):
    return probes.rename_by_prefix(view(spark, d, "v_probes"), ["id", "seq"], "panel").select("id", "new_id")


_MAP = "select trim(removed_id) as old_id, trim(kept_id) as new_id from @out_merge@ where removed_id is not null and kept_id is not null"


@query("rec15_rename_map", f"select p.id, p.seq, m.old_id is not null as mapped, coalesce(m.new_id, p.id) as new_id from @v_probes@ p left join (select old_id, min(new_id) as new_id from ({_MAP}) group by old_id) m on m.old_id = p.id")
def rec15_rename_map(spark, d):
    m = view(spark, d, "out_merge").filter("removed_id is not null and kept_id is not null").select(F.trim("removed_id").alias("old_id"), F.trim("kept_id").alias("new_id"))
    return probes.rename_by_map(view(spark, d, "v_probes"), m, "id").select("id", "seq", "mapped", "new_id")


@query("rec16_haplotype_id", r"select id, case when regexp_matches(id, '^(.*)_([0-9]+)$') then regexp_extract(id, '^(.*)_([0-9]+)$', 1) else id end as gene, case when regexp_matches(id, '^(.*)_([0-9]+)$') then regexp_extract(id, '^(.*)_([0-9]+)$', 2) end as allele from (select distinct probe_id as id from probe where probe_id is not null)")
def rec16_haplotype_id(spark, d):
    ids = view(spark, d, "probe").select(F.col("probe_id").alias("id")).filter("id is not null").distinct()
    gene, allele = probes.haplotype_id(F.col("id"))
    return ids.select("id", gene.alias("gene"), allele.alias("allele"))


@query("rec17_snp_to_bed", "select chr, pos - 1 as start, pos as stop from @v_sites@")
def rec17_snp_to_bed(spark, d):
    return probes.snp_to_bed(view(spark, d, "v_sites")).withColumnRenamed("end", "stop")


@query("rec18_fasta_to_tsv", "select id, seq, length(seq) as length, 100.0::double * (length(seq) - length(regexp_replace(seq, '[GC]', '', 'g'))) / nullif(length(seq) - length(regexp_replace(seq, '[ACGT]', '', 'g')), 0) as gc from @v_probes@")
def rec18_fasta_to_tsv(spark, d):
    return view(spark, d, "v_probes").select("id", "seq", F.length("seq").cast("long").alias("length"), seq.gc_percent(F.col("seq")).alias("gc"))


@query("rec19_window", "select chr, pos, pos // 10000 as win from @v_sites@")
def rec19_window(spark, d):
    return select.windows(view(spark, d, "v_sites"), 10_000).select("chr", "pos", "win")


@query("rec10_flank_clip", "select chr, pos, ref, alt, substr(g.seq, cast(greatest(pos - 40, 1) as int), cast(pos - greatest(pos - 40, 1) as int)) || ref || substr(g.seq, cast(pos + 1 as int), 40) as seq from @v_gsnps@ s join @v_genome@ g using (chr) where pos <= length(g.seq)")
def rec10_flank_clip(spark, d):
    return probes.flanked(view(spark, d, "v_gsnps"), view(spark, d, "v_genome"), clip=True).select("chr", "pos", "ref", "alt", "seq")


@query("rec11_flank_full", "select chr, pos, ref, alt, substr(g.seq, cast(pos - 40 as int), 40) || ref || substr(g.seq, cast(pos + 1 as int), 40) as seq from @v_gsnps@ s join @v_genome@ g using (chr) where pos > 40 and pos + 40 <= length(g.seq)")
def rec11_flank_full(spark, d):
    return probes.flanked(view(spark, d, "v_gsnps"), view(spark, d, "v_genome")).select("chr", "pos", "ref", "alt", "seq")


@query("rec20_iupac", "select id, length(regexp_replace(seq, '[ACGT]', '', 'g')) as n_other from @v_probes@ where length(regexp_replace(seq, '[ACGT]', '', 'g')) <= 2")
def rec20_iupac(spark, d):
    p = view(spark, d, "v_probes").select("id", seq.ambiguous_count(F.col("seq")).cast("long").alias("n_other"))
    return p.filter("n_other <= 2")


_IUPAC_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in seq.IUPAC.items())


@query(
    "rec20_iupac_replaced",
    f"""with p as (select row_number() over () as no, id, seq from @v_probes@), c as (select no, id, unnest(string_split(seq, '')) as ch, unnest(range(0, length(seq))) as i from p where seq <> ''),
    r as (select no, i, case when choices is null then ch else {_pick_sql('choices', "id || ':' || i")} end as x from (select *, case ch {_IUPAC_SQL} end as choices from c))
    select id, seq, coalesce(plain, '') as plain from p left join (select no, string_agg(x, '' order by i) as plain from r group by no) using (no)""",
)
def rec20_iupac_replaced(spark, d):
    """Ambiguity letters replaced; nothing but other unknown letters is left of them."""
    p = view(spark, d, "v_probes")
    return p.select("id", "seq", seq.replace_ambiguous(F.col("seq"), F.col("id")).alias("plain"))


# ---- filters ----


@query("f1_snp_valid", "select chr, pos, ref, alt, n_alt from @v_variants@ where length(ref) = 1 and alt in ('A', 'C', 'G', 'T')")
def f1_snp_valid(spark, d):
    return variants.valid_snps(view(spark, d, "v_variants"))


@query("f2_biallelic", "select chr, pos, ref, alt, n_alt from @v_variants@ where length(ref) = 1 and alt in ('A', 'C', 'G', 'T') and n_alt = 1")
def f2_biallelic(spark, d):
    return variants.valid_snps(view(spark, d, "v_variants"), biallelic_only=True)


@query("f5_reject_reasons", "select reject, count(*) as n from (select case when chr is null then 'no_chr' when pos is null or pos < 1 then 'bad_pos' when ref is null or alt is null then 'no_allele' when length(ref) <> 1 or length(alt) <> 1 then 'not_snp' when upper(ref) not in ('A','C','G','T') or upper(alt) not in ('A','C','G','T') then 'bad_base' when upper(ref) = upper(alt) then 'no_change' end as reject from @v_variants@) group by reject")
def f5_reject_reasons(spark, d):
    return variants.snp_rejects(view(spark, d, "v_variants")).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


@query("f3_chr_pos_type", "select chr, pos, ref, alt, type from @v_sites@ where chr in ('chr1', 'chrX') and pos between 1000 and 150000 and type = 'ts'")
def f3_chr_pos_type(spark, d):
    return view(spark, d, "v_sites").filter(F.col("chr").isin("chr1", "chrX") & F.col("pos").between(1000, 150_000) & (F.col("type") == "ts"))


@query(
    "f9_cascade",
    "select fail_reason, count(*) as n from (select case when not coalesce(gc between 35 and 65, false) then 'gc' when not coalesce(tm between 60 and 80, false) then 'tm' when not coalesce(complexity <= 2, false) then 'complexity' when not coalesce(hairpin <= 15, false) then 'hairpin' end as fail_reason from @v_snps@) group by fail_reason",
)
def f9_cascade(spark, d):
    r = filters.in_range
    tests = [("gc", r(F.col("gc"), 35, 65)), ("tm", r(F.col("tm"), 60, 80)), ("complexity", r(F.col("complexity"), -1, 2)), ("hairpin", r(F.col("hairpin"), -1, 15))]
    return filters.reason_counts(filters.cascade(view(spark, d, "v_snps"), tests))


_RANK = "(select v from (select {c} as v, row_number() over (order by {c}) - 1 as i, count(*) over () as n from {t} where {c} is not null) where i = least(cast(floor({p} * n) as bigint), n - 1))"


@query("f10_threshold", f"select {_RANK.format(c='hairpin', t='@v_snps@', p=0.9)} as threshold")
def f10_threshold(spark, d):
    return filters.nearest_rank(view(spark, d, "v_snps"), "hairpin", 0.9)


@query("f11_hairpin_filter", f"select snp_id, hairpin from @v_snps@ where hairpin <= {_RANK.format(c='hairpin', t='@v_snps@', p=0.9)}")
def f11_hairpin_filter(spark, d):
    return filters.at_most(view(spark, d, "v_snps").select("snp_id", "hairpin"), "hairpin", 0.9)


@query("f14_kraken", "select p.id from @v_probes@ p where p.id not in (select id from (select id, sum(case when try_cast(split_part(x, ':', 1) as bigint) > 0 then coalesce(try_cast(split_part(x, ':', 2) as bigint), 0) else 0 end) as n from (select id, unnest(string_split(line, ' ')) as x from @v_kraken@) group by id) where n >= 30)")
def f14_kraken(spark, d):
    return filters.background_filter(view(spark, d, "v_probes").select("id"), [view(spark, d, "v_kraken")], 30)


@query("f16_expression", "select snp_id, chr, pos from @v_snps@ where gc > 40 and type = 'tv' or tm < 60")
def f16_expression(spark, d):
    return filters.by_expression(view(spark, d, "v_snps"), "gc > 40 and type = 'tv' or tm < 60").select("snp_id", "chr", "pos")


@query("f17_family", "with g as (select family_id, count(*) as n_members from @out_sample_clust@ group by family_id) select family_id, n_members, n_members / (select sum(n_members) from g) as proportion from g where n_members between 1 and 50 and n_members / (select sum(n_members) from g) between 0 and 0.5")
def f17_family(spark, d):
    return filters.family_filter(view(spark, d, "out_sample_clust").select("family_id", F.col("members").alias("member")), 1, 50, 0.0, 0.5)


@query("f21_ranges", "select snp_id from @v_snps@ where gc between 40 and 60 and tm between 62 and 78 and hairpin between 0 and 20")
def f21_ranges(spark, d):
    return filters.all_in_ranges(view(spark, d, "v_snps"), {"gc": (40, 60), "tm": (62, 78), "hairpin": (0, 20)}).select("snp_id")


@query("f22_rank_band", "select snp_id from (select snp_id, row_number() over (order by tm, snp_id) as r, count(*) over () as n from @v_snps@ where tm is not null) where r / n between 0.2 and 0.8")
def f22_rank_band(spark, d):
    return filters.rank_band(view(spark, d, "v_snps").select("snp_id", "tm"), "tm", ["snp_id"], 0.2, 0.8).select("snp_id")


@query("f24_mapping", "select qname, rname, nm, mapq from @v_hits@ where mapq >= 30 and nm <= 3 and xo = 0 and (xs_score is null or xs_score < as_score * 0.8)")
def f24_mapping(spark, d):
    return filters.mapping_filter(view(spark, d, "v_hits"), "moderate").select("qname", "rname", "nm", "mapq")


@query("f25_validate_snps", "select count(*) as n_rows, count(*) filter (pos is null or pos < 1) as n_bad_pos, count(*) filter (ref is null or not regexp_full_match(upper(ref), '[ACGT]')) as n_bad_ref, count(*) filter (alt is null or not regexp_full_match(upper(alt), '[ACGT]')) as n_bad_alt, count(*) filter (chr is null) as n_no_chr, (select count(*) from (select 1 from @v_variants@ group by chr, pos having count(*) > 1)) as n_dup_sites from @v_variants@")
def f25_validate_snps(spark, d):
    return filters.validate_snps(view(spark, d, "v_variants"))


@query("f25_validate_sequences", "select count(*) as n_rows, count(*) filter (length(seq) = 0) as n_empty, count(*) filter (regexp_matches(seq, '[^ATCGN]')) as n_bad_letters, cast(min(length(seq)) as int) as min_length, cast(max(length(seq)) as int) as max_length from @v_probes@")
def f25_validate_sequences(spark, d):
    return filters.validate_sequences(view(spark, d, "v_probes"))


@query("f25_validate_intervals", "select count(*) as n_rows, count(*) filter (start_pos is null or end_pos is null) as n_no_end, count(*) filter (start_pos < 0) as n_negative, count(*) filter (end_pos < start_pos) as n_reversed from bed_region")
def f25_validate_intervals(spark, d):
    return filters.validate_intervals(view(spark, d, "bed_region").select(F.col("start_pos").alias("start"), F.col("end_pos").alias("end")))


# ---- joins and intervals ----


@query("j2_bed_keep", "select chr, pos from @v_sites@ s where exists (select 1 from @v_bed@ b where b.chr = s.chr and s.pos > b.start and s.pos <= b.@end@)")
def j2_bed_keep(spark, d):
    return intervals.covered(view(spark, d, "v_sites"), view(spark, d, "v_bed")).select("chr", "pos")


@query("j3_bed_remove", "select chr, pos from @v_sites@ s where not exists (select 1 from @v_bed@ b where b.chr = s.chr and s.pos > b.start and s.pos <= b.@end@)")
def j3_bed_remove(spark, d):
    return intervals.covered(view(spark, d, "v_sites"), view(spark, d, "v_bed"), keep=False).select("chr", "pos")


_SLOP = "select name, b.chr, greatest(start - 500, 0) as start, least(@end@ + 500, len) as stop from @v_bed@ b join @v_chroms@ c using (chr) where least(@end@ + 500, len) > greatest(start - 500, 0)"


@query("j4_slop_keep", f"select chr, pos from @v_sites@ s where exists (select 1 from ({_SLOP}) b where b.chr = s.chr and s.pos >= b.start and s.pos < b.stop)")
def j4_slop_keep(spark, d):
    wide = intervals.slop(view(spark, d, "v_bed"), view(spark, d, "v_chroms"), 500)
    return intervals.covered(view(spark, d, "v_sites"), wide, base="as_is").select("chr", "pos")


@query("j5_priority_flag", "select chr, pos, exists (select 1 from @v_bed@ b where b.chr = s.chr and s.pos >= b.start and s.pos <= b.@end@) as in_region from @v_sites@ s")
def j5_priority_flag(spark, d):
    return intervals.flag_covered(view(spark, d, "v_sites"), view(spark, d, "v_bed")).select("chr", "pos", "in_region")


@query("j6_features", "select s.chr, s.pos, b.name from @v_sites@ s join @v_bed@ b on b.chr = s.chr and s.pos between b.start and b.@end@ where b.strand = '+'")
def j6_features(spark, d):
    return intervals.features_at(view(spark, d, "v_sites"), view(spark, d, "v_bed").filter("strand = '+'")).select("chr", "pos", "name")


@query("j7_semi", "select snp_id, chr, pos, ref, alt from @v_snps@ s where (chr, pos, ref, alt) in (select chr, pos, ref, alt from @v_sites@ where type = 'tv')")
def j7_semi(spark, d):
    return view(spark, d, "v_snps").join(view(spark, d, "v_sites").filter("type = 'tv'"), ["chr", "pos", "ref", "alt"], "left_semi").select("snp_id", "chr", "pos", "ref", "alt")


@query("j8_id_anti", "select distinct probe_id from probe where probe_id not in (select trim(removed_id) from out_merge where removed_id is not null)")
def j8_id_anti(spark, d):
    gone = view(spark, d, "out_merge").select(F.trim("removed_id").alias("probe_id")).filter("probe_id is not null")
    return view(spark, d, "probe").select("probe_id").distinct().join(gone, "probe_id", "left_anti")


@query("j11_accession", "select h.qname, h.rname, h.nm, coalesce(a.taxid, b.taxid) as taxid from @v_hits@ h left join @v_acc@ a on a.accession = h.rname left join @v_acc@ b on b.accession = split_part(h.rname, '.', 1)")
def j11_accession(spark, d):
    return taxa.with_taxid(view(spark, d, "v_hits"), view(spark, d, "v_acc")).select("qname", "rname", "nm", "taxid")


@query("j15_sample_pop", "select pop, count(*) as n_samples from @v_pops@ where pop <> 'unknown' and sample in (select distinct sample from @v_gt@) group by pop")
def j15_sample_pop(spark, d):
    known = view(spark, d, "v_gt").select("sample").distinct()
    return view(spark, d, "v_pops").filter("pop <> 'unknown'").join(known, "sample").groupBy("pop").agg(F.count(F.lit(1)).alias("n_samples"))


@query("j18_tags_merge", "select a.snp_id, a.gc, b.tm, c.hairpin from (select snp_id, gc from @v_snps@) a join (select snp_id, tm from @v_snps@) b using (snp_id) join (select snp_id, hairpin from @v_snps@) c using (snp_id)")
def j18_tags_merge(spark, d):
    v = view(spark, d, "v_snps")
    return sets.natural_merge([v.select("snp_id", c) for c in ("gc", "tm", "hairpin")])


@query("s6_region_fetch", "select name, b.chr, case when strand = '-' then reverse(translate(substr(g.seq, cast(start + 1 as int), cast(@end@ - start as int)), 'ACGT', 'TGCA')) else substr(g.seq, cast(start + 1 as int), cast(@end@ - start as int)) end as seq from @v_bed@ b join @v_genome@ g on g.chr = b.chr where @end@ <= length(g.seq)")
def s6_region_fetch(spark, d):
    return intervals.region_sequences(view(spark, d, "v_bed"), view(spark, d, "v_genome")).select("name", "chr", "seq")


@query("w7_complement", """with e as (select b.chr, greatest(start, 0) as s, least(@end@, len) as e from @v_bed@ b join @v_chroms@ c using (chr) where least(@end@, len) > greatest(start, 0)
    union all select chr, len, len from @v_chroms@),
    r as (select chr, s, coalesce(max(e) over (partition by chr order by s, e rows between unbounded preceding and 1 preceding), 0) as p from e)
    select chr, p as start, s as stop from r where p < s""")
def w7_complement(spark, d):
    return intervals.complement(view(spark, d, "v_bed"), view(spark, d, "v_chroms")).withColumnRenamed("end", "stop")


def _merge_sql(keys: str, source: str, distance: int) -> str:
    return f"""with b as (select {keys}, start, @end@ as e from {source}),
    r as (select *, max(e) over (partition by {keys} order by start, e rows between unbounded preceding and 1 preceding) as p from b),
    i as (select *, sum(case when p is null or start > p + {distance} then 1 else 0 end) over (partition by {keys} order by start, e rows unbounded preceding) as g from r)
    select {keys}, min(start) as start, max(e) as stop, count(*) as n from i group by {keys}, g"""


@query("w8_merge_by_gene", _merge_sql("gene, chr", "@v_features@", 0))
def w8_merge_by_gene(spark, d):
    return intervals.merge_intervals(view(spark, d, "v_features"), ["gene", "chr"]).withColumnRenamed("end", "stop")


@query("w9_merge", _merge_sql("chr", "@v_bed@", 1000))
def w9_merge(spark, d):
    return intervals.merge_intervals(view(spark, d, "v_bed"), distance=1000).withColumnRenamed("end", "stop")


@query("a27_region_totals", f"with m as ({_merge_sql('chr', '@v_bed@', 0)}) select count(*) as n_regions, cast(sum(stop - start) as bigint) as total_bp from m")
def a27_region_totals(spark, d):
    return intervals.region_totals(intervals.merge_intervals(view(spark, d, "v_bed")))


# ---- windows and tiles ----


@query("w1_cluster", f"select chr, pos, ref, alt, cast(n_near as bigint) as n_near from ({_W1}) where n_near between 1 and 3")
def w1_cluster(spark, d):
    return variants.cluster_filter(view(spark, d, "v_sites"), 60, 3).select("chr", "pos", "ref", "alt", "n_near")


@query("f23_count_band", f"select chr, pos, cast(n_near as bigint) as n_near from ({_W1}) where n_near between 2 and 5")
def f23_count_band(spark, d):
    return variants.cluster_filter(view(spark, d, "v_sites"), 60, 5, 2).select("chr", "pos", "n_near")


_RND = "md5('42:' || chr || ':' || pos || ':' || ref || ':' || alt)"


@query(
    "w3_uniform",
    f"""with w as (select *, pos // 10000 as win from @v_sites@), n as (select chr, win, row_number() over (order by chr, win) - 1 as i, count(*) over () as k from w group by chr, win),
    r as (select w.*, row_number() over (partition by chr, win order by {_RND}, pos, ref, alt) as r from w)
    select chr, pos, ref, alt from r join n using (chr, win) where r <= 1500 // k + case when i < 1500 % k then 1 else 0 end""",
)
def w3_uniform(spark, d):
    return select.select_uniform(view(spark, d, "v_sites"), 1500).select("chr", "pos", "ref", "alt")


_SCORED = """select *, {} as weighted_score from (select *, pos // 10000 as win, abs(gc - 50) as d0, abs(tm - 70) as d1, abs(complexity) as d2, abs(hairpin) as d3 from @v_snps@ where gc is not null and tm is not null and complexity is not null and hairpin is not null)""".format(
    "0.0 + " + " + ".join(f"{w:.1f}::double * (1.0::double - (d{i} - min(d{i}) over (partition by chr, win)) / coalesce(nullif(max(d{i}) over (partition by chr, win) - min(d{i}) over (partition by chr, win), 0), 1.0))" for i, w in enumerate((1, 2, 1, 1)))
)


@query("w4_weighted", f"select chr, pos, ref, alt, round(weighted_score, 6) as weighted_score from ({_SCORED}) qualify row_number() over (partition by chr, win order by weighted_score desc, pos, ref, alt) <= 2")
def w4_weighted(spark, d):
    s = select.select_weighted(view(spark, d, "v_snps"), select.SCORES[:4], [1, 2, 1, 1], select.TARGETS[:4], 2)
    return s.select("chr", "pos", "ref", "alt", F.round("weighted_score", 6).alias("weighted_score"))


@query("w5_priority", f"select chr, pos, ref, alt from (select *, exists (select 1 from @v_bed@ b where b.chr = s.chr and s.pos between b.start and b.@end@) as f from @v_sites@ s) qualify row_number() over (partition by chr, pos // 10000 order by f desc, {_RND}, pos, ref, alt) <= 2")
def w5_priority(spark, d):
    flagged = intervals.flag_covered(view(spark, d, "v_sites"), view(spark, d, "v_bed"))
    return select.select_priority(flagged, "in_region", 2).select("chr", "pos", "ref", "alt")


_TILES = "select *, unnest(list_distinct(list_concat(range(0, n - 80, 30), [n - 81]))) as s from (select *, length(seq) as n from {}) where n >= 81"


@query("w10_tile", f"select region_id, label, cast(row_number() over (partition by region_id, label order by s) as int) as tile_no, cast(s + 1 as int) as start1, cast(s + 81 as int) as end1, substr(seq, s + 1, 81) as tile from ({_TILES.format('@v_alleles@')}) qualify not contains(substr(seq, s + 1, 81), 'N')")
def w10_tile(spark, d):
    return probes.tile_regions(view(spark, d, "v_alleles"))


@query(
    "w11_tile_util",
    "select id, id || ':' || s || '-' || (s + 40) || '_tile' || row_number() over (partition by id, seq order by s) as tile_id, substr(seq, s + 1, 40) as tile from (select *, unnest(list_distinct(list_concat(range(0, n - 39, 15), [n - 40]))) as s from (select *, length(seq) as n from @v_probes@) where n >= 40) union all select id, id || '_tile1', seq from @v_probes@ where length(seq) < 40",
)
def w11_tile_util(spark, d):
    return probes.tile_sequences(view(spark, d, "v_probes"), length=40, step=15)


@query("w12_haplo_tile", f"with t as (select region_id, label, s, substr(seq, s + 1, 81) as tile from ({_TILES.format('@v_alleles@')})), g as (select region_id, cast(s as int) as start, tile, min(label) as label, count(*) as n_alleles from t where not contains(tile, 'N') group by all) select *, count(*) over (partition by region_id, start) as n_forms from g")
def w12_haplo_tile(spark, d):
    return haplo.haplotype_tiles(view(spark, d, "v_alleles"))


@query("a19_window_variation", f"with t as (select region_id, s, substr(seq, s + 1, 81) as tile from ({_TILES.format('@v_alleles@')})), g as (select region_id, s, count(distinct tile) as n from t where not contains(tile, 'N') group by all) select count(*) filter (n = 1) as n_fixed, count(*) filter (n > 1) as n_variant, cast(coalesce(sum(n) filter (n = 1), 0) as bigint) as tiles_fixed, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as tiles_variant from g")
def a19_window_variation(spark, d):
    return haplo.window_variation(haplo.haplotype_tiles(view(spark, d, "v_alleles")))


@query("a20_variable_positions", f"with t as (select distinct region_id, cast(s as int) as start, substr(seq, s + 1, 81) as tile from ({_TILES.format('@v_alleles@')})), c as (select region_id, start, tile, unnest(range(0, 81)) as off from t where not contains(tile, 'N')), v as (select region_id, start, cast(off as int) as off from c group by all having count(distinct substr(tile, off + 1, 1)) > 1) select region_id, start, count(*) as n_variable, list_sort(list(off))[1:5] as first from v group by all")
def a20_variable_positions(spark, d):
    return haplo.variable_positions(view(spark, d, "v_alleles"))


_MSA = """select region_id, label, cast(s as int) as column, tile, cast(strpos(replace(aligned, '-', ''), tile) - 1 as int) as start from (select *, upper(replace(substr(aligned, s + 1, 81), '-', '')) as tile
    from (select *, unnest(list_distinct(list_concat(range(0, n - 80, 30), [n - 81]))) as s from (select *, length(aligned) as n from ({})) where n >= 81)) where length(tile) = 81 and not contains(tile, 'N')"""


@query("w13_msa_tiles", _MSA.format("select region_id, label, substr(seq, 1, 50) || '---' || substr(seq, 51) as aligned from @v_alleles@"))
def w13_msa_tiles(spark, d):
    """Alleles with a gap put in as an aligner would; every tile maps back to its allele."""
    a = view(spark, d, "v_alleles").select("region_id", "label", F.concat(F.substring("seq", 1, 50), F.lit("---"), F.expr("substring(seq, 51)")).alias("aligned"))
    return haplo.aligned_tiles(a)


@query("w13_msa_gaps", _MSA.format("select region_id, label, substr(seq, 1, 90 + length(seq) % 70) || repeat('-', 1 + length(seq) % 7) || substr(seq, 91 + length(seq) % 70, 45) || repeat('-', 12) || substr(seq, 136 + length(seq) % 70) as aligned from @v_alleles@"))
def w13_msa_gaps(spark, d):
    """Alleles with gaps of several lengths at places of their own."""
    cut = F.lit(90) + F.length("seq") % 70
    aligned = F.concat(F.substr("seq", F.lit(1), cut), F.repeat(F.lit("-"), F.lit(1) + F.length("seq") % 7), F.substr("seq", cut + 1, F.lit(45)), F.repeat(F.lit("-"), F.lit(12)), F.substr(F.col("seq"), cut + 46, F.length("seq")))
    return haplo.aligned_tiles(view(spark, d, "v_alleles").select("region_id", "label", aligned.alias("aligned")))


@query("w14_dedup", "select id, seq from @v_probes@ qualify row_number() over (partition by seq order by id) = 1")
def w14_dedup(spark, d):
    return sets.first_wins(view(spark, d, "v_probes"), ["seq"], ["id"])


_ASSESSED = "select distinct probe_id as id, upper(regexp_replace(sequence, '[^A-Za-z]+', '', 'g')) as seq from assessment_result where sequence is not null and probe_id is not null"
_MERGED = f"""with every as (select 0 as no, 'probe' as name, id, seq from @v_probes@ union all select 1, 'assess', id, seq from ({_ASSESSED})),
    ids as (select *, case when no = min(no) over (partition by id) then id else id || '_' || name end as new from every),
    best as (select *, row_number() over (partition by seq order by no, id, new) as r, first_value(new) over (partition by seq order by no, id, new) as kept from ids)"""


def _merged(spark, d):
    a = view(spark, d, "assessment_result").filter("sequence is not null and probe_id is not null").select(F.col("probe_id").alias("id"), F.upper(F.regexp_replace("sequence", "[^A-Za-z]+", "")).alias("seq")).distinct()
    return sets.merge_dedup([("probe", view(spark, d, "v_probes")), ("assess", a)])


@query("w15_merge_dedup", f"{_MERGED} select new as id, seq from best where r = 1")
def w15_merge_dedup(spark, d):
    return _merged(spark, d)[0]


@query("k7_removed_map", f"{_MERGED} select new as removed_id, kept as kept_id from best where new <> kept")
def k7_removed_map(spark, d):
    return _merged(spark, d)[1]


@query(
    "w16_ld_prune",
    """with recursive g as (select chr, pos, list(gt order by sample) as g from @v_gt@ group by chr, pos), n as materialized (select *, row_number() over (partition by chr order by pos) - 1 as i from g),
    o as (select *, unnest(range(1, 50)) as d from n),
    p as (select a.chr, b.i, a.d, list_filter(list_zip(a.g, b.g), lambda z: z[1] is not null and z[2] is not null) as z from o a join n b on b.chr = a.chr and b.i = a.i + a.d and b.i < a.i // 5 * 5 + 50),
    m as (select chr, i, d, len(z)::double as k, list_sum(list_transform(z, lambda t: t[1]))::double as sx, list_sum(list_transform(z, lambda t: t[2]))::double as sy, list_sum(list_transform(z, lambda t: t[1] * t[2]))::double as xy,
      list_sum(list_transform(z, lambda t: t[1] * t[1]))::double as xx, list_sum(list_transform(z, lambda t: t[2] * t[2]))::double as yy from p where len(z) > 0),
    l as materialized (select chr, i, list(d) as ds from m where (k * xx - sx * sx) * (k * yy - sy * sy) > 0 and (k * xy - sx * sy) * (k * xy - sx * sy) / ((k * xx - sx * sx) * (k * yy - sy * sy)) > 0.2 group by chr, i),
    walk as (select chr, pos, i, [true] as kept from n where i = 0
      union all select s.chr, s.pos, s.i, list_concat([len(list_filter(coalesce(l.ds, []), lambda x: w.kept[x])) = 0], w.kept[1:49]) from walk w join n s on s.chr = w.chr and s.i = w.i + 1 left join l on l.chr = s.chr and l.i = s.i)
    select chr, pos from walk where kept[1]""",
)
def w16_ld_prune(spark, d):
    return haplo.prune_linked(popgen.site_arrays(view(spark, d, "v_gt")))


# ---- sorting, sampling, sets ----


@query("t2_sample", f"select chr, pos, ref, alt from @v_sites@ order by md5('42:' || chr || ':' || pos || ':' || ref || ':' || alt), chr, pos limit 500")
def t2_sample(spark, d):
    return select.select_random(view(spark, d, "v_sites"), 500, ["chr", "pos", "ref", "alt"]).select("chr", "pos", "ref", "alt")


@query("t6_proportional", """with o as (select id, sum(s) as stratum from (select distinct id, 1 as s from @v_probes@ union all select distinct trim(kept_id), 2 from out_merge where kept_id is not null) group by id),
    n as (select stratum, greatest(1, (count(*) * 300) // (select count(*) from o)) as quota from o group by stratum)
    select id, cast(stratum as bigint) as stratum from o join n using (stratum) qualify row_number() over (partition by stratum order by md5('42:' || id), id) <= any_value(quota) over (partition by stratum)""")
def t6_proportional(spark, d):
    b = view(spark, d, "out_merge").filter("kept_id is not null").select(F.trim("kept_id").alias("id"))
    return select.proportional_sample(view(spark, d, "v_probes").select("id"), b, ["id"], 300)


@query("t8_stratified", "select sample, pop from @v_pops@ where pop <> 'unknown' qualify row_number() over (partition by pop order by md5('42:' || sample), sample) <= 2")
def t8_stratified(spark, d):
    return select.stratified(view(spark, d, "v_pops").filter("pop <> 'unknown'"), ["pop"], 2, ["sample"])


@query("t9_equal_strata", "select chr, pos from @v_sites@ qualify row_number() over (partition by chr order by md5('42:' || chr || ':' || pos), chr, pos) <= least(40, (select min(n) from (select count(*) as n from @v_sites@ group by chr)))")
def t9_equal_strata(spark, d):
    return select.equal_strata(view(spark, d, "v_sites"), "chr", 40, ["chr", "pos"]).select("chr", "pos")


@query("t10_populations", "select distinct pop from @v_pops@ where pop <> 'unknown' order by pop limit 2")
def t10_populations(spark, d):
    return popgen.choose_populations(view(spark, d, "v_pops"), most=2)


def _runs(spark, d):
    s = view(spark, d, "v_snps")
    return [s.filter(f"run_id % 3 = {i}").select("chr", "pos", "ref", "alt", "type") for i in range(3)]


_RUNS = "with f as (select distinct chr, pos, ref, alt, type, run_id % 3 as no from @v_snps@ where run_id is not null), g as (select chr, pos, ref, alt, any_value(type) as type, count(distinct no) as n, min(no) as lo from f group by chr, pos, ref, alt) select chr, pos, ref, alt, type from g where "
for _name, _how, _test in (("u1_intersect", "intersection", "n = 3"), ("u2_union", "union", "true"), ("u3_diff", "difference", "n = 1 and lo = 0"), ("u4_symdiff", "symmetric", "n % 2 = 1"), ("u4_exactly_one", "exactly_one", "n = 1")):

    @query(_name, _RUNS + _test)
    def _set(spark, d, how=_how):
        return sets.combine(_runs(spark, d), ["chr", "pos", "ref", "alt"], how)


# ---- aggregates ----


@query("a1_stage_counts", "select count(*) as n_total, count(*) filter (length(ref) = 1 and alt in ('A','C','G','T')) as n_snp, count(*) filter (alt is not null and (length(ref) <> 1 or length(alt) <> 1)) as n_indel, count(*) filter (alt is null) as n_no_alt, count(*) filter (length(ref) = 1 and alt in ('A','C','G','T') and n_alt > 1) as n_multi from @v_variants@")
def a1_stage_counts(spark, d):
    return variants.stage_counts(view(spark, d, "v_variants"))


@query("a31_type_counts", "select type, count(*) as n from @v_sites@ group by type")
def a31_type_counts(spark, d):
    return assess.type_counts(view(spark, d, "v_sites"))


_KM = "select id, substr(seq, unnest(range(1, length(seq) - {k} + 2)), {k}) as m from {t} where length(seq) >= {k}"


@query("a2_dust", f"with k as ({_KM.format(k=3, t='@v_probes@')}), c as (select id, m, count(*) as c from k group by all), n as (select id, cast(sum(c * (c - 1) // 2) as bigint) as num from c group by id) select p.id, case when length(seq) <= 3 then 0 else num::double / (length(seq) - 3) end as dust from @v_probes@ p left join n using (id)")
def a2_dust(spark, d):
    return view(spark, d, "v_probes").select("id", seq.dust(F.col("seq")).alias("dust"))


@query("a3_entropy", "with c as (select id, seq, unnest(string_split(seq, '')) as ch from @v_probes@ where seq <> ''), n as (select id, seq, ch, count(*) as c from c group by all) select id, round(sum(-(c::double / length(seq)) * ln(c::double / length(seq))) / ln(2), 6) as entropy from n group by id, seq union all select id, null from @v_probes@ where seq = ''")
def a3_entropy(spark, d):
    return view(spark, d, "v_probes").select("id", F.round(seq.entropy(F.col("seq")), 6).alias("entropy"))


@query("a4_window_entropy", "with w as (select id, seq, unnest(range(1, length(seq) - 18, 10)) as s from @v_probes@ where length(seq) >= 20), x as (select id, s, substr(seq, s, 20) as t from w), c as (select id, s, t, unnest(string_split(t, '')) as ch from x), n as (select id, s, ch, count(*) as c from c group by all), e as (select id, s, sum(-(c / 20.0::double) * ln(c / 20.0::double)) / ln(2) as h from n group by id, s) select id, round(min(h), 6) as low, round(max(h), 6) as high, count(*) as n from e group by id")
def a4_window_entropy(spark, d):
    e = view(spark, d, "v_probes").select("id", F.explode(seq.window_entropy(F.col("seq"), 20, 10)).alias("h"))
    return e.groupBy("id").agg(F.round(F.min("h"), 6).alias("low"), F.round(F.max("h"), 6).alias("high"), F.count(F.lit(1)).alias("n"))


_RC = "reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"
_DIMER = f"""with p as (select id, seq from @v_probes@), r as (select id, {_RC} as seq from p), f as (select id, m, count(*) as n from ({_KM.format(k=11, t='p')}) group by all), b as (select id, m, count(*) as n from ({_KM.format(k=11, t='r')}) group by all), size as (select count(*) as pool from p)"""


@query("a5_dimer", f"{_DIMER}, q as (select m, sum(n) as q from b group by m), h as (select f.id, cast(sum(f.n * greatest(q - coalesce(b.n, 0), 0)) as bigint) as hits from f join q using (m) left join b on b.id = f.id and b.m = f.m group by f.id) select p.id, coalesce(hits, 0) as hits, cast(greatest(length(seq) - 10, 0) as bigint) as n_kmers, pool from p left join h using (id), size")
def a5_dimer(spark, d):
    return kmers.dimer_raw(view(spark, d, "v_probes"), "id", "seq", 11, "fast")


@query("a6_dimer", f"{_DIMER}, q as (select m, sum(n) as q from b where not contains(m, 'N') group by m), h as (select f.id, cast(sum(f.n * q) as bigint) as hits from f join q using (m) group by f.id) select p.id, round(100.0::double * coalesce(hits, 0) / pool, 6) as dimer from p left join h using (id), size")
def a6_dimer(spark, d):
    return kmers.dimer_scores(view(spark, d, "v_probes"), "id", "seq", 11, "total").withColumn("dimer", F.round("dimer", 6))


@query("a7_dimer", f"{_DIMER}, q as (select m, sum(n) as q from (select * from f union all select * from b) group by m having sum(n) >= 2), h as (select f.id, cast(sum(f.n * q) as bigint) as hits from f join q using (m) group by f.id) select p.id, coalesce(hits, 0) as hits, cast(greatest(length(seq) - 10, 0) as bigint) as n_kmers, pool from p left join h using (id), size")
def a7_dimer(spark, d):
    return kmers.dimer_raw(view(spark, d, "v_probes"), "id", "seq", 11, "classic")


_R6 = lambda c: f"round({c}, 6)"


@query("a8_summary", "select metric, count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, min(v) as min, max(v) as max, round(quantile_cont(v, 0.5), 6) as median from (" + " union all ".join(f"select '{c}' as metric, {c}::double as v from @v_snps@" for c in ("gc", "tm", "complexity", "hairpin")) + ") where v is not null group by metric")
def a8_summary(spark, d):
    s = assess.summary(view(spark, d, "v_snps"), ["gc", "tm", "complexity", "hairpin"])
    return s.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", "max", F.round("median", 6).alias("median"))


@query("a9_compare", "with b as (select 'gc' as metric, gc as v, type from @v_snps@ union all select 'tm', tm, type from @v_snps@) select metric, count(v) as n_before, round(avg(v), 6) as mean_before, round(stddev_samp(v), 6) as std_before, count(v) filter (type = 'ts') as n_after, round(avg(v) filter (type = 'ts'), 6) as mean_after, round(stddev_samp(v) filter (type = 'ts'), 6) as std_after, round(avg(v) filter (type = 'ts') - avg(v), 6) as delta_mean from b group by metric")
def a9_compare(spark, d):
    v = view(spark, d, "v_snps")
    c = select.before_after(v, v.filter("type = 'ts'"), ["gc", "tm"])
    return c.select("metric", "n_before", "n_after", *[F.round(x, 6).alias(x) for x in ("mean_before", "std_before", "mean_after", "std_after", "delta_mean")])


@query("a10_rank_stats", f"select round(avg(hairpin), 6) as mean, min(hairpin) as min, max(hairpin) as max, any_value({_RANK.format(c='hairpin', t='@v_snps@', p=0.5)}) as upper_median, any_value({_RANK.format(c='hairpin', t='@v_snps@', p=0.95)}) as p95 from @v_snps@")
def a10_rank_stats(spark, d):
    return assess.rank_statistics(view(spark, d, "v_snps"), "hairpin").withColumn("mean", F.round("mean", 6))


@query("a11_coverage", "with c as (select chr, count(*) as n, count(distinct pos // 10000) as w from @v_sites@ group by chr) select cast(sum(w) as bigint) as n_windows, count(*) as n_chroms, cast(sum(n) as bigint) as n_snps, round(avg(n), 6) as mean_per_chrom, round(stddev_pop(n), 6) as std_per_chrom from c")
def a11_coverage(spark, d):
    c = select.coverage(view(spark, d, "v_sites"))
    return c.withColumn("mean_per_chrom", F.round("mean_per_chrom", 6)).withColumn("std_per_chrom", F.round("std_per_chrom", 6))


@query("a28_family_report", f"with m as ({ORACLE['p4_found'].strip()}), g as (select family_id, count(*) as n_members, string_agg(member, ',' order by member_no) as members from m group by family_id) select family_id, n_members, n_members / (select sum(n_members) from g)::double as proportion, members from g")
def a28_family_report(spark, d):
    return assess.family_report(p4_found(spark, d))


@query("a29_bins", "with h as (select id, sum(case when try_cast(split_part(x, ':', 1) as bigint) > 0 then coalesce(try_cast(split_part(x, ':', 2) as bigint), 0) else 0 end) as n from (select id, unnest(string_split(line, ' ')) as x from @v_kraken@) group by id, x is null) select case when n <= 0 then '0' when n <= 5 then '1-5' when n <= 10 then '6-10' when n <= 20 then '11-20' when n <= 50 then '21-50' else '>50' end as bin, count(*) as n from h group by 1")
def a29_bins(spark, d):
    return filters.kmer_bins(view(spark, d, "v_kraken").select("id", filters.kraken_hits(F.col("line")).alias("hits")), "hits")


@query("a30_hist", "with h as (select cast(floor((tm - 40) / 2.5) as bigint) as bin, count(*) as n from @v_snps@ where tm is not null group by 1) select bin, n, round(100.0::double * n / (select sum(n) from h), 6) as percent from h")
def a30_hist(spark, d):
    return assess.histogram(view(spark, d, "v_snps"), "tm", 2.5, 40.0).withColumn("percent", F.round("percent", 6))


@query("a30_plot_limits", "select round(case when k <= 60 then a - 0.5 else p1 - (p99 - p1) * 0.05 end, 6) as lo, round(case when k <= 60 then b + 0.5 else p99 + (p99 - p1) * 0.05 end, 6) as hi from (select count(distinct hairpin) as k, min(hairpin) as a, max(hairpin) as b, quantile_cont(hairpin, 0.01) as p1, quantile_cont(hairpin, 0.99) as p99 from @v_snps@)")
def a30_plot_limits(spark, d):
    return assess.plot_limits(view(spark, d, "v_snps"), "hairpin").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


# ---- alignments and taxonomy ----

_ROLL = """with m as (select * from @v_hits@ where as_score is not null), o as (select *, row_number() over (partition by qname, genome order by as_score desc, xs_score desc nulls last) as r from m),
    g as (select qname, genome, count(*) as hits, max(case when r = 1 then as_score end) as best_as, max(case when r = 2 then as_score end) as s2, max(case when r = 1 then xs_score end) as xs from o group by all),
    roll as (select qname, genome, hits, best_as, greatest(s2, xs) as second_as, best_as - greatest(s2, xs) as diff from g)"""


def _rollup(spark, d):
    return taxa.hit_rollup(view(spark, d, "v_hits"))


@query("a12_hits", f"{_ROLL} select * from roll")
def a12_hits(spark, d):
    return _rollup(spark, d)


@query("a13_mappable", f"{_ROLL} select qname, genome, hits = 1 as strict, hits = 1 or coalesce(diff >= 10, false) as relaxed from roll")
def a13_mappable(spark, d):
    h, g = F.col("hits"), F.col("diff")
    return _rollup(spark, d).select("qname", "genome", taxa.mappable(h, g).alias("strict"), taxa.mappable(h, g, "relaxed").alias("relaxed"))


@query("a14_access", f"{_ROLL}, g2 as (select qname, count(*) as aligned, count(*) filter (not (hits = 1 or coalesce(diff >= 10, false))) as multi from roll group by qname), i as (select o_orderkey as id from orders) select id, coalesce(aligned, 0) as aligned, coalesce(multi, 0) as multi, case when coalesce(aligned, 0) < 3 then 'not_aligned' when multi > 0 then 'multi_mapped' else 'ok' end as verdict from i left join g2 on g2.qname = i.id")
def a14_access(spark, d):
    ids = view(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return taxa.accessible(ids, _rollup(spark, d), 3, mode="relaxed")


_BEST = """with t as (select h.*, coalesce(a.taxid, b.taxid) as taxid, case when qlen > 0 then (qlen - nm) / qlen::double * 100.0 else 0.0 end as sim from @v_hits@ h left join @v_acc@ a on a.accession = h.rname left join @v_acc@ b on b.accession = split_part(h.rname, '.', 1)),
    best as (select qname, taxid, nm, sim from t where taxid is not null qualify row_number() over (partition by qname, taxid order by nm, sim desc) = 1)"""


def _best(spark, d):
    return taxa.best_per_taxon(taxa.with_taxid(view(spark, d, "v_hits"), view(spark, d, "v_acc")))


@query("a15_besthit", f"{_BEST} select qname, taxid, nm, round(sim, 6) as sim from best")
def a15_besthit(spark, d):
    return _best(spark, d).withColumn("sim", F.round("sim", 6))


@query(
    "a16_besthit_verdict",
    f"""with recursive inside as (select taxid from @v_tree@ where taxid = 11 union select t.taxid from @v_tree@ t join inside i on t.parent = i.taxid), {_BEST[5:]},
    x as (select *, taxid in (select taxid from inside) as tg from best),
    f as (select qname, first(taxid order by nm, sim desc, taxid) as taxid, first(tg order by nm, sim desc, taxid) as tg, first(nm order by nm, sim desc, taxid) as nm, first(sim order by nm, sim desc, taxid) as sim, min(nm) filter (not tg) as onm from x group by qname)
    select qname, taxid, case when not tg then 'not_target' when not (sim >= 95 or nm <= 4) then 'low_quality' when coalesce(onm - nm < 2, false) then 'ambiguous' else 'assigned' end as verdict from f""",
)
def a16_besthit_verdict(spark, d):
    target = spark.createDataFrame([(11,)], "taxid int")
    return taxa.best_hit_verdict(_best(spark, d), view(spark, d, "v_tree"), target, min_sim=95.0, max_nm=4)


@query("g2_clade", "with recursive inside as (select taxid from @v_tree@ where taxid in (12, 101) union select t.taxid from @v_tree@ t join inside i on t.parent = i.taxid) select taxid from inside")
def g2_clade(spark, d):
    from ..operators.graph import descendants

    return descendants(view(spark, d, "v_tree"), spark.createDataFrame([(12,), (101,)], "taxid int"))


@query("g3_names", "select taxid, name from @v_tree@ where name in ('ASIA', 'root', 'EUROPE')")
def g3_names(spark, d):
    return taxa.names_to_ids(view(spark, d, "v_tree"), ["ASIA", "root", "EUROPE"])


_LCA = f"""with recursive up as (select taxid, taxid as a, 0 as u from @v_tree@ union all select up.taxid, t.parent, u + 1 from up join @v_tree@ t on t.taxid = up.a where t.parent <> t.taxid), {_BEST[5:]},
    q as (select distinct qname, b.taxid from best b join @v_tree@ t on t.taxid = b.taxid where nm between 0 and 2), n as (select qname, count(*) as n from q group by qname), dep as (select taxid, max(u) as dep from up group by taxid),
    s as (select qname, a, count(*) as k from q join up using (taxid) group by all), l as (select s.qname, max_by(a, dep * 100000 + a) as lca from s join n using (qname) join dep on dep.taxid = s.a where k = n group by s.qname)"""


def _lca(spark, d):
    return taxa.common_ancestor(_best(spark, d).filter(F.col("nm").between(0, 2)), view(spark, d, "v_tree"))


@query("g4_lca", f"{_LCA} select qname, lca from l")
def g4_lca(spark, d):
    return _lca(spark, d)


@query("a17_taxid_counts", f"{_LCA} select lca as taxid, count(*) as n from l group by lca")
def a17_taxid_counts(spark, d):
    return taxa.taxon_counts(_lca(spark, d))


# ---- haplotypes ----


@query("a18_haplo_freq", "with a as (select region_id, unnest(map_values(alleles)) as seq from haplotype_set where region_id is not null), n as (select region_id, upper(seq) as seq, count(*) as n from a where seq is not null and seq <> '' group by all), t as (select *, sum(n) over (partition by region_id) as t, row_number() over (partition by region_id order by n desc, seq) as r from n) select region_id, 'H' || r as label, seq, n, n / t::double as freq from t where n / t::double >= 0.05")
def a18_haplo_freq(spark, d):
    a = view(spark, d, "haplotype_set").filter("region_id is not null and alleles is not null").select("region_id", F.explode(F.map_values("alleles")).alias("seq")).filter("seq is not null and seq <> ''").withColumn("seq", F.upper("seq"))
    return haplo.haplotype_frequencies(a)


@query("rec21_apply_variant", """with r as (select name as region_id, b.chr, start, substr(g.seq, cast(start + 1 as int), cast(@end@ - start as int)) as seq from @v_bed@ b join @v_genome@ g on g.chr = b.chr where @end@ <= length(g.seq)),
    v as (select region_id, hap, min(pos) as pos, arg_min(ref, (pos, ref, alt)) as ref, arg_min(alt, (pos, ref, alt)) as alt from (select r.region_id, pos % 2 as hap, pos, ref, alt from r join @v_gsnps@ s on s.chr = r.chr and s.pos > r.start and s.pos <= r.start + length(r.seq) and substr(r.seq, cast(pos - r.start as int), 1) = ref) group by region_id, hap)
    select region_id, hap, substr(seq, 1, cast(pos - 1 - start as int)) || alt || substr(seq, cast(pos - start + 1 as int)) as allele from v join r using (region_id)""")
def rec21_apply_variant(spark, d):
    """The first matching variant of each of two haplotypes, put into its region."""
    r = intervals.region_sequences(view(spark, d, "v_bed"), view(spark, d, "v_genome"), stranded=False).withColumnRenamed("name", "region_id")
    at = intervals.features_at(view(spark, d, "v_gsnps"), r.select("chr", "start", "end", "region_id", "seq"), base="one_based")
    good = at.filter(F.substr("seq", (F.col("pos") - F.col("f_start")).cast("int"), F.lit(1)) == F.col("ref"))
    first = good.groupBy("region_id", (F.col("pos") % 2).alias("hap")).agg(F.min(F.struct("pos", "ref", "alt")).alias("v"))
    v = first.select("region_id", F.lit("s").alias("sample"), "hap", "v.*")
    return haplo.apply_variants(r, v).select("region_id", "hap", "allele")


# ---- cutting on chromosomes of whole length, at the SNPs' own places ----


def _whole(sql: str) -> str:
    return sql.replace("@v_gsnps@", "@v_wsnps@").replace("@v_genome@", "@v_wgenome@")


@query("rec4_probe_cut_whole", _whole(f"select probe_id, reject, case when reject is null then raw end as seq from (select {_PID} as probe_id, {_REJECT} as reject, raw from ({_CUT}))"))
def rec4_probe_cut_whole(spark, d):
    return probes.cut_probes(view(spark, d, "v_wsnps"), view(spark, d, "v_wgenome")).select("probe_id", "reject", "seq")


@query(
    "rec5_third_base_whole",
    _whole(f"""with c as (select *, {_PID} as probe_id from ({_CUT}) where {_REJECT} is null)
    select probe_id, substr(raw, 1, 40) || {_pick_sql("translate('ACGT', ref || alt, '')", 'probe_id')} || substr(raw, 42) as seq from c"""),
)
def rec5_third_base_whole(spark, d):
    return probes.cut_probes(view(spark, d, "v_wsnps"), view(spark, d, "v_wgenome"), replace_snp=True).filter("reject is null").select("probe_id", "seq")


@query("rec10_flank_clip_whole", "select chr, pos, ref, alt, substr(g.seq, cast(greatest(pos - 40, 1) as int), cast(pos - greatest(pos - 40, 1) as int)) || ref || substr(g.seq, cast(pos + 1 as int), 40) as seq from @v_wsnps@ s join @v_wgenome@ g using (chr) where pos <= length(g.seq)")
def rec10_flank_clip_whole(spark, d):
    return probes.flanked(view(spark, d, "v_wsnps"), view(spark, d, "v_wgenome"), clip=True).select("chr", "pos", "ref", "alt", "seq")


@query("rec11_flank_full_whole", "select chr, pos, ref, alt, substr(g.seq, cast(pos - 40 as int), 40) || ref || substr(g.seq, cast(pos + 1 as int), 40) as seq from @v_wsnps@ s join @v_wgenome@ g using (chr) where pos > 40 and pos + 40 <= length(g.seq)")
def rec11_flank_full_whole(spark, d):
    return probes.flanked(view(spark, d, "v_wsnps"), view(spark, d, "v_wgenome")).select("chr", "pos", "ref", "alt", "seq")


@query("s6_region_fetch_whole", "select name, b.chr, case when strand = '-' then reverse(translate(substr(g.seq, cast(start + 1 as int), cast(@end@ - start as int)), 'ACGT', 'TGCA')) else substr(g.seq, cast(start + 1 as int), cast(@end@ - start as int)) end as seq from @v_bed@ b join @v_wgenome@ g on g.chr = b.chr where @end@ <= length(g.seq)")
def s6_region_fetch_whole(spark, d):
    return intervals.region_sequences(view(spark, d, "v_bed"), view(spark, d, "v_wgenome")).select("name", "chr", "seq")


@query("rec21_apply_variants_whole")
def rec21_apply_variants_whole(spark, d):
    """All variants of each of two haplotypes, put into their regions."""
    r = intervals.region_sequences(view(spark, d, "v_bed"), view(spark, d, "v_wgenome"), stranded=False).withColumnRenamed("name", "region_id")
    at = intervals.features_at(view(spark, d, "v_wsnps"), r.select("chr", "start", "end", "region_id"), base="one_based")
    v = at.select("region_id", F.lit("s").alias("sample"), (F.col("pos") % 2).alias("hap"), "pos", "ref", "alt")
    return haplo.apply_variants(r, v).select("region_id", "hap", "allele")


# ---- population statistics ----

_PAIRS = "select a.sample as s1, b.sample as s2, cast(coalesce(sum(abs(a.gt - b.gt)), 0) as bigint) as diff, count(a.gt + b.gt) as n_sites from {0} a join {0} b on a.chr = b.chr and a.pos = b.pos and a.sample < b.sample group by all"


@query("s4_genotypes", "select distinct chr, pos, sample, gt from @v_gt@")
def s4_genotypes(spark, d):
    """Genotypes written as VCF fields and read back."""
    g = view(spark, d, "v_gt").withColumn("field", F.concat(F.lit("12:"), F.when(F.col("gt").isNull(), "./.").when(F.col("gt") == 2, "1|1").when(F.col("gt") == 1, "0/1").otherwise("0|0")))
    return g.select("chr", "pos", "sample", popgen.genotype(F.col("field"), F.lit("DP:GT")).alias("gt")).distinct()


@query("a21_ibs", f"select s1, s2, diff, n_sites, diff / (2.0::double * nullif(n_sites, 0)) as d from ({_PAIRS.format('@v_gt@')})")
def a21_ibs(spark, d):
    return popgen.ibs_distance(view(spark, d, "v_gt"))


@query(
    "a22_corr",
    f"""with half as (select * from @v_gt@ where pos % 2 = 0), a as (select s1, s2, diff / (2.0::double * nullif(n_sites, 0)) as x from ({_PAIRS.format('@v_gt@')})), b as (select s1, s2, diff / (2.0::double * nullif(n_sites, 0)) as y from ({_PAIRS.format('half')})),
    j as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from a join b using (s1, s2) where x is not null and y is not null)
    select count(*) as n_pairs, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman, round(avg(abs(x - y)), 6) as mean_abs_diff from j""",
)
def a22_corr(spark, d):
    g = view(spark, d, "v_gt")
    c = popgen.compare_distances(popgen.ibs_distance(g), popgen.ibs_distance(g.filter("pos % 2 = 0")))
    return c.select("n_pairs", *[F.round(x, 6).alias(x) for x in ("pearson", "spearman", "mean_abs_diff")])


_AC = "select chr, pos, pop, cast(sum(gt) as int) as ac, cast(count(gt) * 2 as int) as an from @v_gt@ join @v_pops@ using (sample) where pop <> 'unknown' and gt is not null group by all"


def _counts(spark, d):
    return popgen.allele_counts(view(spark, d, "v_gt"), view(spark, d, "v_pops"))


@query("a23_sfs", f"with c as ({_AC}), k as (select * from c qualify an = max(an) over (partition by pop)) select pop, least(ac, an - ac) as bin, count(*)::double as sites from k group by all")
def a23_sfs(spark, d):
    return popgen.sfs(_counts(spark, d))


@query("a23_joint_sfs", f"with c as ({_AC}), k as (select * from c qualify an = max(an) over (partition by pop)), j as (select a.pop as p1, b.pop as p2, case when 2 * (a.ac + b.ac) > a.an + b.an then a.an - a.ac else a.ac end as i, case when 2 * (a.ac + b.ac) > a.an + b.an then b.an - b.ac else b.ac end as j from k a join k b on a.chr = b.chr and a.pos = b.pos and a.pop < b.pop) select p1, p2, i, j, count(*) as sites from j group by all")
def a23_joint_sfs(spark, d):
    return popgen.joint_sfs(_counts(spark, d))


_CHOOSE = lambda a, b: f"(factorial(cast({a} as int)) / (factorial(cast({b} as int))::double * factorial(cast({a} - {b} as int))))"


@query("a23_projected", f"with c as ({_AC}), k as (select pop, ac, an, count(*) as n from c where an >= 4 group by all), j as (select *, unnest(range(greatest(0, 4 - an + ac), least(4, ac) + 1)) as i from k) select pop, cast(least(i, 4 - i) as int) as bin, round(sum(n * {_CHOOSE('ac', 'i')} * {_CHOOSE('(an - ac)', '(4 - i)')} / {_CHOOSE('an', '4')}), 6) as sites from j group by all")
def a23_projected(spark, d):
    return popgen.sfs(_counts(spark, d), 4).withColumn("sites", F.round("sites", 6))


@query("a24_tvd", f"with c as ({_AC}), k as (select *, pos % 2 = 0 as h from c qualify an = max(an) over (partition by pop)), b as (select pop, least(ac, an - ac) as bin, count(*) as n, count(*) filter (h) as m from k where least(ac, an - ac) >= 1 group by all) select pop, round(sum(abs(n / t - m / u)) / 2, 6) as tvd from (select *, sum(n) over (partition by pop)::double as t, sum(m) over (partition by pop)::double as u from b) group by pop")
def a24_tvd(spark, d):
    c = _counts(spark, d)
    return popgen.sfs_distance(popgen.sfs(c), popgen.sfs(c.filter("pos % 2 = 0"))).withColumn("tvd", F.round("tvd", 6))


@query("a25_projection", f"with c as ({_AC}), p as (select pop, an as projection, count(*) filter (ac > 0 and ac < an) as segregating from c group by all) select pop, max_by(projection, segregating * 1000 + projection) as projection, max(segregating) as segregating from p where projection <= 6 group by pop")
def a25_projection(spark, d):
    p = _counts(spark, d).groupBy("pop", F.col("an").alias("projection")).agg(F.count_if((F.col("ac") > 0) & (F.col("ac") < F.col("an"))).alias("segregating"))
    return popgen.best_projection(p, 6)


@query("g5_pca")
def g5_pca(spark, d):
    return popgen.pca(view(spark, d, "v_gt"))


@query("g6_procrustes")
def g6_procrustes(spark, d):
    g = view(spark, d, "v_gt")
    return popgen.pca_similarity(popgen.pca(g), popgen.pca(g.filter("pos % 2 = 0")))


@query("g8_missing", "select chr, pos, sample, case when (select sum((instr('0123456789abcdef', substr(h, 9 + i, 1)) - 1) * pow(16, 6 - i)) from (select unnest(range(0, 7)) as i)) / pow(16, 7) >= case when instr('0123456789abcdef', substr(h, 1, 1)) <= 8 then 0.1 else 0.3 end then gt end as gt from (select *, md5('42:' || chr || ':' || pos || ':' || sample) as h from @v_gt@)")
def g8_missing(spark, d):
    return popgen.with_missing(view(spark, d, "v_gt"), [0.1, 0.3])


# ---- scalar functions ----


@query("x1_gc", "select id, 100.0::double * gc / nullif(n, 0) as gc, 100.0::double * gc / nullif(len, 0) as gc_full from (select id, length(seq) as len, length(seq) - length(regexp_replace(seq, '[GC]', '', 'g')) as gc, length(seq) - length(regexp_replace(seq, '[ACGT]', '', 'g')) as n from @v_probes@)")
def x1_gc(spark, d):
    return view(spark, d, "v_probes").select("id", seq.gc_percent(F.col("seq")).alias("gc"), seq.gc_percent_of_length(F.col("seq")).alias("gc_full"))


@query("x2_revcomp", f"select id, {_RC} as rc, reverse(translate(seq, 'ACGT', 'TGCA')) as rc_keep, seq = reverse(translate(seq, 'ACGT', 'TGCA')) as palindrome from @v_probes@")
def x2_revcomp(spark, d):
    s = F.col("seq")
    return view(spark, d, "v_probes").select("id", seq.reverse_complement(s).alias("rc"), seq.reverse_complement_keep(s).alias("rc_keep"), seq.is_palindrome(s).alias("palindrome"))


def _nn_sql(part: int, table: str = "sugimoto_1996") -> str:
    values = " ".join(f"when '{k}' then {v}" for k, v in thermo.steps(table, part).items())
    t = thermo.TABLES[table]
    return f"(select cast(sum(case substr(seq, i, 2) {values} end) as int) from (select unnest(range(1, length(seq))) as i)) + {round(t['init'][part] * 10)} + case when seq = reverse(translate(seq, 'ACGT', 'TGCA')) then {round(t['sym'][part] * 10)} else 0 end"


_THERMO = f"select id, seq, case when ok then {_nn_sql(1)} end as s, case when ok then {_nn_sql(0)} end as h from (select *, length(seq) >= 2 and regexp_full_match(seq, '[ACGT]+') as ok from @v_probes@)"


@query("x5_thermo", f"select id, cast(s as int) as entropy_tenths, cast(h as int) as enthalpy_tenths, round(h / 10.0::double - 310.15::double * (s / 10.0::double) / 1000.0::double, 6) as gibbs from ({_THERMO})")
def x5_thermo(spark, d):
    s = F.col("seq")
    return view(spark, d, "v_probes").select("id", thermo.entropy_tenths(s).alias("entropy_tenths"), thermo.enthalpy_tenths(s).alias("enthalpy_tenths"), F.round(thermo.gibbs_energy(s), 6).alias("gibbs"))


@query("x3_tm", f"select id, round(100.0::double * h / (s / 10.0::double + 0.368::double * (length(seq) - 1) * ln(0.05::double) + 1.987::double * ln(2.5e-7::double)) - 273.15::double, 6) as tm from ({_THERMO}) where length(seq) >= 14")
def x3_tm(spark, d):
    p = view(spark, d, "v_probes").filter(F.length("seq") >= 14)
    return p.select("id", F.round(thermo.tm_nn(F.col("seq")), 6).alias("tm"))


@query(
    "x3_tm_all",
    f"""select id, case when length(seq) >= 14 then round(100.0::double * h / (s / 10.0::double + 0.368::double * (length(seq) - 1) * ln(0.05::double) + 1.987::double * ln(2.5e-7::double)) - 273.15::double, 6)
    when regexp_full_match(seq, '[ACGT]+') then 2.0::double * length(seq) + 2 * length(regexp_replace(seq, '[AT]', '', 'g')) end as tm from ({_THERMO})""",
)
def x3_tm_all(spark, d):
    """Of all probes, short ones by the Wallace rule."""
    return view(spark, d, "v_probes").select("id", F.round(thermo.tm_nn(F.col("seq")), 6).alias("tm"))


@query("x4_tm_simple", "select id, case when n > 0 then 2.0::double * n + 2 * gc end as wallace, case when n > 0 then round(81.5::double + 16.6::double * log10(0.05::double) + 41.0::double * gc / n - 500.0::double / length(seq), 6) end as tm_gc from (select *, length(seq) - length(regexp_replace(seq, '[GC]', '', 'g')) as gc, length(seq) - length(regexp_replace(seq, '[ACGT]', '', 'g')) as n from @v_probes@)")
def x4_tm_simple(spark, d):
    s = F.col("seq")
    return view(spark, d, "v_probes").select("id", thermo.tm_wallace(s).alias("wallace"), F.round(thermo.tm_gc(s), 6).alias("tm_gc"))


@query("x7_hairpin_energy")
def x7_hairpin_energy(spark, d):
    """Least free energies of folding by published stacking and loop energies; no SQL, see the tests."""
    return view(spark, d, "v_probes").select("id", fold.hairpin_energy(F.col("seq")).alias("hairpin"))


@query(
    "x8_hairpin_sw",
    f"""with recursive p as (select row_number() over () as no, id, seq, length(seq) as n, string_split(seq, '') as a, string_split({_RC}, '') as b from @v_probes@),
    w as (select no, n, a, b, 1 as d, list_transform(range(0, n + 1), lambda x: 0) as h2, list_transform(range(0, n + 1), lambda x: 0) as h1, 0 as best from p where n > 0
      union all select no, n, a, b, d, h1, h, greatest(best, list_max(h)) from (select no, n, a, b, d + 1 as d, h1, best, list_transform(range(0, n + 1), lambda i: case when i < 1 or d + 1 - i < 1 or d + 1 - i > n then 0 else greatest(0, h2[i] + case when a[i] = b[d + 1 - i] and a[i] in ('A', 'C', 'G', 'T') then 3 else -2 end, h1[i] - 5, h1[i + 1] - 5) end) as h from w where d < 2 * n))
    select id, cast(coalesce(best, 0) as int) as hairpin from p left join (select no, max(best) as best from w group by no) using (no)""",
)
def x8_hairpin_sw(spark, d):
    return view(spark, d, "v_probes").select("id", fold.hairpin_alignment(F.col("seq")).alias("hairpin"))


@query("x9_canonical", f"with k as (select m from ({_KM.format(k=11, t='@v_probes@')}) where not contains(m, 'N')) select least(m, reverse(translate(m, 'ACGT', 'TGCA'))) as kmer, count(*) as n from k group by 1")
def x9_canonical(spark, d):
    k = view(spark, d, "v_probes").select(F.explode(seq.kmers(F.col("seq"), 11)).alias("m")).filter(~F.contains("m", F.lit("N")))
    return k.groupBy(seq.canonical(F.col("m")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


@query("x10_score", "select snp_id, round(greatest(0, 1 - abs(coalesce(gc, 50) - 50) / 50) + greatest(0, 1 - abs(coalesce(tm, 70) - 70) / 30) + greatest(0, 1 - abs(coalesce(complexity, 0)) / 5) + greatest(0, 1 - abs(coalesce(hairpin, 0)) / 50) + 1, 6) as score from @v_snps@")
def x10_score(spark, d):
    s = select.composite_score({c: F.col(c) for c in ("gc", "tm", "complexity", "hairpin")})
    return view(spark, d, "v_snps").select("snp_id", F.round(s, 6).alias("score"))


# ---- k-mer graph ----

_EDGES = f"""k as (select distinct id, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) as m from ({_KM.format(k=11, t='@v_probes@')}) where not contains(m, 'N')), nk as (select id, count(*) as nk from k group by id),
    u as (select m from k group by m having count(*) between 2 and 100), kk as (select k.* from k semi join u using (m)),
    pr as (select a.id as a, b.id as b, count(*) as shared from kk a join kk b on a.m = b.m and a.id < b.id group by all),
    ed as (select a, b, shared, least(x.nk, y.nk) as smaller from pr join nk x on x.id = a join nk y on y.id = b where shared >= 0.5 * least(x.nk, y.nk))"""


@query("j10_kmer_edges", f"with {_EDGES} select * from ed")
def j10_kmer_edges(spark, d):
    return kmers.shared_kmer_edges(view(spark, d, "v_probes"), "id", "seq").withColumn("smaller", F.col("smaller").cast("long"))


@query(
    "g1_smart_dimer",
    f"""with recursive {_EDGES}, e2 as (select a, b from ed union select b, a from ed), rc as (select a as id, a as g from e2 union select e2.b, rc.g from rc join e2 on e2.a = rc.id), gr as (select id, min(g) as group_id from rc group by id),
    dg as (select a as id, count(*) as degree from e2 group by a), al as (select p.id, coalesce(gr.group_id, p.id) as group_id, coalesce(degree, 0) as degree from @v_probes@ p left join gr using (id) left join dg using (id))
    select id, group_id, degree, row_number() over (partition by group_id order by degree, id) = 1 as keep from al""",
)
def g1_smart_dimer(spark, d):
    return kmers.dimer_groups(view(spark, d, "v_probes"), "id", "seq")


@query("g1_group_stats", f"with g as ({ORACLE['g1_smart_dimer']}), z as (select group_id, count(*) as n, count(*) filter (not keep) as gone from g group by group_id having count(*) > 1) select count(*) as n_groups, cast(coalesce(sum(gone), 0) as bigint) as removed, coalesce(max(n), 0) as max_size, coalesce(avg(n), 0.0) as mean_size from z")
def g1_group_stats(spark, d):
    return kmers.dimer_group_stats(view(spark, d, "v_probes"), "id", "seq")


@query("g9_families")
def g9_families(spark, d):
    """Linked families standing in for greedy clustering."""
    return assess.greedy_families(view(spark, d, "v_probes"), "id", "seq")


# ---- further operators: each with its SQL ----


@query("rec9_shift", "select chr, pos, pos - 21 as start_l, pos + 60 as stop_l, pos - 48 as start_r, pos + 33 as stop_r from @v_sites@")
def rec9_shift(spark, d):
    """Probes with the SNP moved to the left by a quarter and to the right by seven."""
    shifts = [probes.position_shift("left", 81), probes.position_shift("right", 81, 7)]
    for s in shifts:
        probes.check_shift(81, s)
    (a, z, _), (b, y, _) = (probes.probe_window(F.col("pos"), 81, s) for s in shifts)
    return view(spark, d, "v_sites").select("chr", "pos", a.alias("start_l"), z.alias("stop_l"), b.alias("start_r"), y.alias("stop_r"))


@query("rec22_prune", "select snp_id, run_id, chr, pos, ref, alt, type, hairpin from @v_snps@")
def rec22_prune(spark, d):
    return select.without_scores(view(spark, d, "v_snps"), keep=("hairpin",))


_ENTROPY_SQL = "with c as (select id, seq, unnest(string_split(seq, '')) as ch from @v_probes@ where seq <> ''), n as (select id, seq, ch, count(*) as c from c group by all) select id, seq from n group by id, seq having sum(-(c::double / length(seq)) * ln(c::double / length(seq))) / ln(2) < {}"


@query("f12_low_entropy", _ENTROPY_SQL.format(1.9))
def f12_low_entropy(spark, d):
    """Below 1.9 bits: the default of 1.5 finds nothing in these tables."""
    return filters.low_entropy(view(spark, d, "v_probes"), threshold=1.9).select("id", "seq")


@query("f13_strong_hairpin", "select snp_id, hairpin from @v_snps@ where hairpin > 5")
def f13_strong_hairpin(spark, d):
    return filters.strong_hairpins(view(spark, d, "v_snps")).select("snp_id", "hairpin")


@query("f15_kraken_chain", "select p.id from @v_probes@ p where p.id not in (select id from (select id, length(id) % 2 as db, sum(case when try_cast(split_part(x, ':', 1) as bigint) > 0 then coalesce(try_cast(split_part(x, ':', 2) as bigint), 0) else 0 end) as n from (select id, unnest(string_split(line, ' ')) as x from @v_kraken@) group by all) where n >= 20)")
def f15_kraken_chain(spark, d):
    """Two classifier outputs one after the other."""
    k = view(spark, d, "v_kraken")
    return filters.background_filter(view(spark, d, "v_probes").select("id"), [k.filter("length(id) % 2 = 0"), k.filter("length(id) % 2 = 1")], 20)


@query("f19_variant_only", f"with t as (select region_id, label, s, substr(seq, s + 1, 81) as tile from ({_TILES.format('@v_alleles@')})), g as (select region_id, cast(s as int) as start, tile, min(label) as label, count(*) as n_alleles from t where not contains(tile, 'N') group by all) select * from (select *, count(*) over (partition by region_id, start) as n_forms from g) where n_forms > 1")
def f19_variant_only(spark, d):
    return haplo.haplotype_tiles(view(spark, d, "v_alleles"), variant_only=True)


@query("j16_subset", "select chr, pos, sample, gt from @v_gt@ where (chr, pos) in (select chr, pos from @v_sites@ where type = 'ts') and sample in (select sample from @v_pops@ where pop = 'B')")
def j16_subset(spark, d):
    sites, samples = view(spark, d, "v_sites").filter("type = 'ts'"), view(spark, d, "v_pops").filter("pop = 'B'")
    return variants.of_samples(variants.at_sites(view(spark, d, "v_gt"), sites), samples).select("chr", "pos", "sample", "gt")


@query("j17_common_samples", "select sample from @v_pops@ where sample in (select sample from @v_gt@)")
def j17_common_samples(spark, d):
    """The samples that two component tables would be compared on."""
    return variants.of_samples(view(spark, d, "v_pops"), view(spark, d, "v_gt").select("sample").distinct()).select("sample")


@query("j19_outer_merge", f"with f as (select chr, pos, ref, alt from @v_sites@ s where exists (select 1 from @v_bed@ b where b.chr = s.chr and s.pos between b.start and b.@end@)), w as (select chr, pos, ref, alt from @v_sites@ s qualify row_number() over (partition by chr, pos // 10000 order by {_RND}, pos, ref, alt) <= 1) select * from f union select * from w")
def j19_outer_merge(spark, d):
    """SNPs in features and one SNP of every window, together."""
    v = view(spark, d, "v_sites")
    picked = select.select_priority(v.withColumn("_p", F.lit(0)), "_p", 1)
    cols = ["chr", "pos", "ref", "alt"]
    return sets.outer_merge(intervals.covered(v, view(spark, d, "v_bed"), base="inclusive").select(*cols), picked.select(*cols))


@query("j20_vcf_rows", "select chr, pos, ref, alt, n_alt from @v_variants@ where (chr, pos) in (select chr, pos from @v_sites@ where type = 'tv')")
def j20_vcf_rows(spark, d):
    return variants.at_sites(view(spark, d, "v_variants"), view(spark, d, "v_sites").filter("type = 'tv'")).select("chr", "pos", "ref", "alt", "n_alt")


@query("w2_row_limited", "select chr, pos, ref, alt, cast(len(list_filter(near, lambda x: abs(x - pos) <= 20)) as bigint) as n_near from (select distinct chr, pos, ref, alt, list(pos) over (partition by chr order by pos, ref, alt rows between 20 preceding and 20 following) as near from (select distinct chr, pos, ref, alt from @v_snps@))")
def w2_row_limited(spark, d):
    v = view(spark, d, "v_snps").select("chr", "pos", "ref", "alt").distinct()
    return variants.row_limited_counts(v, 20, ["ref", "alt"]).select("chr", "pos", "ref", "alt", "n_near")


_PICK = " + ".join(f"coalesce(case when max({c}) over w > min({c}) over w then (1 - ({c} - min({c}) over w) / (max({c}) over w - min({c}) over w)) * {k}::double end, 0)" for c, k in (("gc", 1.0), ("tm", 2.0), ("hairpin", 0.5)))


@query("w6_pick_weighted", f"select snp_id, chr, pos, round(s, 6) as weighted_score from (select *, {_PICK} as s from (select *, (pos - 1) // 10000 as win from @v_snps@) window w as (partition by chr, win)) qualify row_number() over (partition by chr, win order by s desc, pos, snp_id) = 1")
def w6_pick_weighted(spark, d):
    p = select.pick_weighted(view(spark, d, "v_snps"), ["gc", "tm", "hairpin"], [1.0, 2.0, 0.5], ["snp_id"])
    return p.select("snp_id", "chr", "pos", F.round("weighted_score", 6).alias("weighted_score"))


@query("t1_sorted", "select chr, pos, ref, alt from @v_sites@")
def t1_sorted(spark, d):
    return view(spark, d, "v_sites").select("chr", "pos", "ref", "alt").orderBy("chr", "pos", "ref", "alt")


@query("t7_first", "select chr, pos, ref, alt from @v_sites@ order by pos, chr, ref, alt limit 200")
def t7_first(spark, d):
    return select.first_rows(view(spark, d, "v_sites"), 200, ["pos", "chr", "ref", "alt"]).select("chr", "pos", "ref", "alt")


@query("u5_merge_by_id", f"with e as (select 0 as no, id, seq from @v_probes@ union all select 1, id, seq from ({_ASSESSED})) select id, seq from e qualify row_number() over (partition by id order by no, seq) = 1")
def u5_merge_by_id(spark, d):
    a = view(spark, d, "assessment_result").filter("sequence is not null").select(F.col("probe_id").alias("id"), F.upper(F.regexp_replace("sequence", "[^A-Za-z]+", "")).alias("seq"))
    return sets.merge_by_id([view(spark, d, "v_probes"), a], "id")


def _overlapping(spark, d):
    s = view(spark, d, "v_snps")
    return [s.filter(x).select("chr", "pos", "ref", "alt", "type") for x in ("gc > 40", "tm > 60", "type = 'tv'")]


_OVERLAP = "with f as (select chr, pos, ref, alt, 0 as no from @v_snps@ where gc > 40 union select chr, pos, ref, alt, 1 from @v_snps@ where tm > 60 union select chr, pos, ref, alt, 2 from @v_snps@ where type = 'tv'), g as (select chr, pos, ref, alt, count(*) as n, min(no) as lo from f group by all) select chr, pos, ref, alt, case when ref || alt in ('AG', 'GA', 'CT', 'TC') then 'ts' else 'tv' end as type from g where "
for _name, _how, _test in (("u1_intersect_overlap", "intersection", "n = 3"), ("u3_diff_overlap", "difference", "n = 1 and lo = 0"), ("u4_symdiff_overlap", "symmetric", "n % 2 = 1")):

    @query(_name, _OVERLAP + _test)
    def _overlap_set(spark, d, how=_how):
        return sets.combine(_overlapping(spark, d), ["chr", "pos", "ref", "alt"], how)


@query("u6_bag_union", f"select region_id as id, substr(seq, s + 1, 81) as tile from ({_TILES.format('@v_alleles@')}) where not contains(substr(seq, s + 1, 81), 'N') union all select id, seq from @v_probes@")
def u6_bag_union(spark, d):
    tiles = probes.tile_regions(view(spark, d, "v_alleles")).select(F.col("region_id").alias("id"), "tile")
    return tiles.unionByName(view(spark, d, "v_probes").select("id", F.col("seq").alias("tile")))


def _probe_tm_sql(table: str) -> str:
    t = thermo.TABLES[table]

    def side(part: int) -> str:
        values = " ".join(f"when '{k}' then {v}" for k, v in thermo.steps(table, part).items())
        x = f"(select cast(sum(case substr(seq, i, 2) {values} end) as int) from (select unnest(range(1, length(seq))) as i)) + {round(t.get('init', (0, 0))[part] * 10)}"
        if "init_GC" in t:
            x += "".join(f" + case when seq[{i}] in ('G', 'C') then {round(t['init_GC'][part] * 10)} else {round(t['init_AT'][part] * 10)} end" for i in ("1", "-1"))
        if "one_GC" in t:
            x += f" + case when regexp_matches(seq, '[GC]') then {round(t['one_GC'][part] * 10)} else {round(t['all_AT'][part] * 10)} end"
        return x

    return f"""select id, round(case when n < 2 then null when n < 14 then 2.0::double * acgt + 2 * gc when ok then 100.0::double * h / (s / 10.0::double + 0.368::double * (n - 1) * ln(0.05::double) + 1.987::double * ln(2.5e-7::double)) - 273.15::double
        else 81.5::double + 16.6::double * log10(0.05::double) + 41.0::double * gc / n - 500.0::double / n end, 6) as tm from (select id, length(seq) as n, length(regexp_replace(seq, '[^GC]', '', 'g')) as gc, length(regexp_replace(seq, '[^ACGT]', '', 'g')) as acgt, regexp_full_match(seq, '[ACGT]+') as ok,
        case when regexp_full_match(seq, '[ACGT]+') then {side(0)} end as h, case when regexp_full_match(seq, '[ACGT]+') then {side(1)} end as s from @v_probes@)"""


for _table in thermo.TABLES:

    @query(f"x3_tm_probe_{_table}", _probe_tm_sql(_table))
    def _tm_probe(spark, d, table=_table):
        return view(spark, d, "v_probes").select("id", F.round(thermo.tm_probe(F.col("seq"), table), 6).alias("tm"))


@query("x13_ungapped", "select region_id, label, cast(strpos(seq, substr(seq, 31, 40)) - 1 as int) as at from @v_alleles@ where length(seq) >= 80")
def x13_ungapped(spark, d):
    """A window with gaps put in finds its first place in the allele without them."""
    a = view(spark, d, "v_alleles").filter("length(seq) >= 80")
    window = F.concat(F.substring("seq", 31, 15), F.lit("--"), F.substring("seq", 46, 25), F.lit("-"))
    return a.select("region_id", "label", seq.ungapped_position(window, F.col("seq")).alias("at"))


from . import roundtrips  # noqa: E402, F401  (registers its queries here)
