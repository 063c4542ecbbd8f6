"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import clean_chr, clean_id, clean_sequence, gc_fraction, score
from ..operators.unpack import split_packed
from ..plans.runtime import union_all
from . import abuse, bpe, chunks, components, leakage, neardup, outrank, spans, topn

#: Production parameters.
SPAN = 40
WINDOW, TOP = 10_000, 3
BEST = 10
ALLELE_LIMIT, ALLELE_OVERLAP, GAP = 2000, 60, 10
REGION_LIMIT, REGION_OVERLAP = 3000, 100
GRAM, PROBE_SIMILARITY = 8, 0.5
MEMBERS, FAMILY_SIMILARITY = 4, 0.6
LEAK = 12


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    probes = _t(spark, d, "probe").select("probe_id", clean_sequence(F.col("sequence")).alias("seq"))
    return spans.shared_spans(probes, "probe_id", "seq", SPAN).select("probe_id", "shared_bp")


def p1_shared_beside_dimer(spark: SparkSession, d: str) -> DataFrame:
    """Shared bases of every assessed probe beside its highest dimer score."""
    found = p1_found(spark, d)
    dimer = F.col("dimer").cast("double")
    assessed = _t(spark, d, "assessment_result").filter("probe_id is not null").groupBy("probe_id").agg(F.max(F.when(~F.isnan(dimer), dimer)).alias("max_dimer"))
    return assessed.join(found, "probe_id", "left").select("probe_id", "max_dimer", F.coalesce("shared_bp", F.lit(0)).alias("shared_bp"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    snps = _t(spark, d, "snps_with_biophysical").select("snp_id", clean_chr(F.col("chr")).alias("chr"), "pos", F.expr(f"cast(pos div {WINDOW} as bigint)").alias("win"), score(F.col("tm")).alias("tm"), gc_fraction(F.col("gc")).alias("gc"))
    ties = [F.col("gc").desc_nulls_last(), F.col("pos").asc(), F.col("snp_id").asc()]
    top = topn.top_n_per_group(snps.filter("pos >= 1"), ["chr", "win"], "tm", ties, TOP, ["gc", "pos", "snp_id"])
    return top.select("chr", "win", "snp_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "out_merge").select(clean_id(F.col("removed_id")).alias("a"), clean_id(F.col("kept_id")).alias("b"))
    return components.connected_groups(pairs, "a", "b", "probe_id", "group_id")


def _flows(spark: SparkSession, d: str) -> DataFrame:
    snps = _t(spark, d, "snps_with_biophysical").select(
        "run_id",
        "snp_id",
        F.round(F.abs(gc_fraction(F.col("gc")) - 0.5), 4).alias("gc_off"),
        F.round(F.abs(score(F.col("tm")) - 70), 1).alias("tm_off"),
        score(F.col("complexity")).alias("complexity"),
        score(F.col("hairpin")).alias("hairpin"),
    )
    return outrank.outranking_flows(snps, "run_id", "snp_id", {"gc_off": 1, "tm_off": 1, "complexity": 1, "hairpin": 1})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return outrank.best_per_group(_flows(spark, d), "run_id", "snp_id", BEST).select("run_id", "snp_id")


def p5_net_flow(spark: SparkSession, d: str) -> DataFrame:
    """The SNPs of each run with the highest net flow: positive less negative, over all others."""
    best = outrank.best_per_group(_flows(spark, d), "run_id", "snp_id", BEST, "net_flow", ascending=False)
    return best.select("run_id", "snp_id", "place", "net_flow", F.round("net_share", 9).alias("net_share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    gap_end = rf"(?<=[Nn]{{{GAP}}})(?![Nn])"
    alleles = _t(spark, d, "haplotype_set").filter("region_id is not null and alleles is not null").select("region_id", F.explode("alleles").alias("label", "seq")).filter(F.length("seq") > ALLELE_LIMIT).distinct()
    a = alleles.select(F.lit("allele").alias("kind"), "region_id", "label", chunks.split_text(F.col("seq"), ALLELE_LIMIT, ALLELE_OVERLAP, [gap_end]).alias("pieces"))
    length = F.col("end_pos").cast("long") - F.col("start_pos").cast("long")
    regions = _t(spark, d, "bed_region").filter(F.col("region_id").isNotNull() & (length > REGION_LIMIT)).select("region_id", length.cast("int").alias("len"), "block_ends").distinct()
    r = regions.select(F.lit("region").alias("kind"), "region_id", F.lit("").alias("label"), chunks.split_extent(F.col("len"), F.col("block_ends"), REGION_LIMIT, REGION_OVERLAP).alias("pieces"))
    return union_all([chunks.explode_pieces(x, "pieces") for x in (a, r)]).distinct()


#: Boundaries of mails, strongest first: paragraphs, lines, sentences, blanks.
MAIL_LIMIT, MAIL_OVERLAP, MAIL_ENDS = 2000, 100, [r"(?<=\n\r?\n)", r"(?<=\n)", r"(?<=[.!?]\s)", r"(?<=\s)"]


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every mail in pieces within the limit, cut at the strongest boundary in reach."""
    mails = _t(spark, d, "documents").select("doc_id", chunks.split_text(F.col("text"), MAIL_LIMIT, MAIL_OVERLAP, MAIL_ENDS).alias("pieces"))
    return chunks.explode_pieces(mails, "pieces")


def _alike(spark: SparkSession, d: str) -> list[tuple[str, str, DataFrame, DataFrame]]:
    """(kind, id column, members, pairs) of the near-duplicate probes and families."""
    probes = _t(spark, d, "probe").select("probe_id", clean_sequence(F.col("sequence")).alias("seq"))
    members = split_packed(_t(spark, d, "out_sample_clust").filter("family_id is not null"), "members", ["family_id"], "member", "member_no")
    families = members.groupBy("family_id").agg(F.collect_set("member").alias("members"))
    return [
        ("probe", "probe_id", *neardup.similar_pairs(probes, "probe_id", F.col("seq"), PROBE_SIMILARITY, gram=GRAM)),
        ("family", "family_id", *neardup.similar_pairs(families, "family_id", F.col("members"), FAMILY_SIMILARITY, MEMBERS)),
    ]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return union_all([neardup.record_pairs(m, p, key).select(F.lit(kind).alias("kind"), "id_a", "id_b") for kind, key, m, p in _alike(spark, d)])


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per probe and family: its class of equal sets and how many others are alike enough."""
    return union_all([neardup.record_links(m, p, key).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "class_id", "links") for kind, key, m, p in _alike(spark, d)])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(_t(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "benchmark"), "item_id", "text", LEAK)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out item the documents that hold a passage of it, and the longest one."""
    n = _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("span_words").alias("longest"))
    zero = F.lit(0)
    return _t(spark, d, "benchmark").select("item_id", "task").join(n, "item_id", "left").select("item_id", "task", F.coalesce("documents", zero).alias("documents"), F.coalesce("longest", zero).alias("longest"))


def _scored(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    documents = _t(spark, d, "documents")
    model = abuse.train_from(documents, "doc_id", "text", _t(spark, d, "labels"), "toxic")
    return abuse.score_documents(documents, "doc_id", "text", model, keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of affected documents per source."""
    return abuse.rates(_scored(spark, d, "source"), "source")


_CLEAN_SEQ = r"upper(regexp_replace({}, '\s+', '', 'g'))"
_CLEAN_ID = r"nullif(regexp_replace(regexp_replace({}, '^\s*(>\s*)?', ''), '\s+$', ''), '')"
_CHR = r"'chr' || nullif(regexp_replace(upper(trim(chr)), '^CHR', ''), '')"
_SCORE = "case when {0} >= 0 and not isnan({0}) then {0} end"
_GC = "case when gc > 1 and not isnan(gc) then round(gc / 100, 4) when gc >= 0 and not isnan(gc) then gc end"
_SNPS = f"select distinct snp_id, run_id, {_CHR} as chr, pos, {_GC} as gc, " + ", ".join(f"{_SCORE.format(c)} as {c}" for c in ("tm", "complexity", "hairpin")) + " from snps_with_biophysical"
_TOKENS = r"""regexp_extract_all(members, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^\s,;|\[\]{}()]+')"""
_PLACES = ", ".join(f"rank() over (partition by run_id order by {x}) as r{i}" for i, x in enumerate(("round(abs(gc - 0.5), 4)", "round(abs(tm - 70), 1)", "complexity", "hairpin")))

_MEMBERS_SQL = rf"""
with rows as (select distinct family_id, members from out_sample_clust where members is not null),
toks as (select family_id, unnest(t) as tok, unnest(range(len(t))) as i from (select family_id, {_TOKENS} as t from rows)),
vals as (select family_id, i, trim(case when len(tok) >= 2 and tok[1] = '"' and tok[-1] = '"' then replace(tok[2:-2], '""', '"')
  when len(tok) >= 2 and tok[1] = '''' and tok[-1] = '''' then replace(tok[2:-2], '''''', '''') else tok end) as member from toks)
"""
_P1_SQL = rf"""
with s as (select distinct probe_id, {_CLEAN_SEQ.format('sequence')} as seq from probe where probe_id is not null),
k as (select probe_id, seq, unnest(range(1, len(seq) - {SPAN} + 2)) as off from s where len(seq) >= {SPAN}),
w as (select probe_id, off, substr(seq, off, {SPAN}) as kmer from k),
ok as (select * from w where regexp_full_match(kmer, '[ACGT]+')),
sh as (select kmer from ok group by kmer having count(distinct probe_id) > 1),
pos as (select distinct probe_id, unnest(range(off, off + {SPAN})) as p from ok semi join sh using (kmer)),
found as (select probe_id, cast(count(*) as int) as shared_bp from pos group by probe_id)
"""
_PIECES = """
with recursive a as (select distinct region_id, key as label, value as seq from (select region_id, unnest(map_entries(alleles), recursive := true) from haplotype_set)
  where value is not null and len(value) > 2000),
m as (select 'allele' as kind, region_id, label, len(seq) as n, 2000 as lim, 60 as ov, regexp_extract_all(seq, '[Nn]{10,}|[Nn]{1,9}|[^Nn]+') as parts from a),
al as (select kind, region_id, label, n, lim, ov, list_filter(list_transform(range(1, len(parts) + 1), lambda i: case when len(parts[i]) >= 10 and upper(parts[i][1]) = 'N' then cast(list_sum(list_transform(parts[1:i], lambda x: len(x))) as bigint) end), lambda x: x is not null) as ends from m),
rg as (select distinct 'region' as kind, region_id, '' as label, end_pos - start_pos as n, 3000 as lim, 100 as ov, list_filter(coalesce(block_ends, []), lambda e: e > 0 and e < end_pos - start_pos) as ends from bed_region where end_pos - start_pos > 3000),
src as (select * from al union all select * from rg),
walk as (
  select kind, region_id, label, n, lim, ov, ends, 1 as piece_no, 0 as s, case when n <= lim then n else coalesce(list_max(list_filter(ends, lambda e: e <= lim and e > ov)), lim) end as e from src
  union all
  select kind, region_id, label, n, lim, ov, ends, piece_no + 1, e - ov, case when n - (e - ov) <= lim then n else coalesce(list_max(list_filter(ends, lambda x: x <= e - ov + lim and x > e)), e - ov + lim) end from walk where e < n
)
select distinct kind, region_id, label, cast(piece_no as int) as piece_no, cast(s as int) as start_off, cast(e as int) as end_off from walk
"""
_P7_PAIRS = rf"""
{_MEMBERS_SQL.strip()},
fam as (select distinct family_id as id, member as item from vals where member <> ''),
fs as (select id, count(*) as n from fam group by id having count(*) >= {MEMBERS}),
s as (select distinct probe_id as id, {_CLEAN_SEQ.format('sequence')} as seq from probe where probe_id is not null),
pg as (select distinct id, unnest(list_transform(range(1, len(seq) - {GRAM} + 2), lambda i: substr(seq, i, {GRAM}))) as item from s where len(seq) >= {GRAM}),
ps as (select id, count(*) as n from pg group by id),
pp as (select a.id as id_a, b.id as id_b, count(*) as c from pg a join pg b on a.item = b.item and a.id < b.id group by all),
ff as (select a.id as id_a, b.id as id_b, count(*) as c from (select fam.* from fam semi join fs using (id)) a join (select fam.* from fam semi join fs using (id)) b on a.item = b.item and a.id < b.id group by all)
"""
_P7_SQL = rf"""{_P7_PAIRS}
select 'probe' as kind, id_a, id_b from pp join ps x on x.id = id_a join ps y on y.id = id_b where c >= {PROBE_SIMILARITY} * (x.n + y.n - c) - 1e-9
union all
select 'family', id_a, id_b from ff join fs x on x.id = id_a join fs y on y.id = id_b where c >= {FAMILY_SIMILARITY} * (x.n + y.n - c) - 1e-9
"""
_P7_LINKS_SQL = rf"""{_P7_PAIRS},
every as ({_P7_SQL[len(_P7_PAIRS):]}),
ends as (select kind, id_a as id from every union all select kind, id_b from every),
deg as (select kind, id, count(*) as links from ends group by all),
whole as (select 'probe' as kind, id, list_sort(list(item)) as x from pg group by id union all select 'family', fam.id, list_sort(list(item)) from fam semi join fs using (id) group by fam.id)
select kind, id, min(id) over (partition by kind, x) as class_id, coalesce(links, 0) as links from whole left join deg using (kind, id)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_shared_beside_dimer": p1_shared_beside_dimer,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_net_flow": p5_net_flow,
    "p6_found": p6_found,
    "p6_documents": p6_documents,
    "p7_found": p7_found,
    "p7_links": p7_links,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaked_items": p9_leaked_items,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

ORACLE = {
    "p1_found": _P1_SQL + "select probe_id, shared_bp from found",
    "p1_shared_beside_dimer": _P1_SQL + "select probe_id, max_dimer, coalesce(shared_bp, 0) as shared_bp from (select probe_id, max(case when not isnan(dimer) then dimer end) as max_dimer from assessment_result where probe_id is not null group by probe_id) left join found using (probe_id)",
    "p2_found": f"select chr, cast(pos // {WINDOW} as bigint) as win, snp_id from ({_SNPS}) where chr is not null and pos >= 1 and tm is not null qualify row_number() over (partition by chr, pos // {WINDOW} order by tm desc, gc desc nulls last, pos, snp_id) <= {TOP}",
    "p3_found": f"""with recursive e as (select distinct {_CLEAN_ID.format('removed_id')} as a, {_CLEAN_ID.format('kept_id')} as b from out_merge),
        s as (select a, b from e where a is not null and b is not null union select b, a from e where a is not null and b is not null),
        r as (select a as id, a as g from s union select s.b, r.g from r join s on s.a = r.id)
        select id as probe_id, min(g) as group_id from r group by id""",
    "p5_found": f"select run_id, snp_id from (select run_id, snp_id, r0 + r1 + r2 + r3 as places from (select run_id, snp_id, {_PLACES} from ({_SNPS}) where run_id is not null and gc is not null and tm is not null and complexity is not null and hairpin is not null)) qualify row_number() over (partition by run_id order by places, snp_id) <= {BEST}",
    "p5_net_flow": f"""with s as (select *, round(abs(gc - 0.5), 4) as x0, round(abs(tm - 70), 1) as x1, complexity as x2, hairpin as x3, count(*) over (partition by run_id) as n from ({_SNPS}) where run_id is not null and gc is not null and tm is not null and complexity is not null and hairpin is not null),
        f as (select run_id, snp_id, n, cast({" + ".join(f"rank() over (partition by run_id order by x{i} desc) - rank() over (partition by run_id order by x{i})" for i in range(4))} as double) as net_flow from s)
        select run_id, snp_id, cast(row_number() over (partition by run_id order by net_flow desc, snp_id) as int) as place, net_flow, round(case when n > 1 then net_flow / (4.0::double * (n - 1)) end, 9) as net_share from f qualify row_number() over (partition by run_id order by net_flow desc, snp_id) <= {BEST}""",
    "p6_found": _PIECES,
    "p7_found": _P7_SQL,
    "p7_links": _P7_LINKS_SQL,
    "p9_found": rf"""
        with w as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '=\r?\n', '', 'g')), '[a-z0-9]+') as ws from documents),
        g as (select doc_id, unnest(list_transform(range(1, len(ws) - {LEAK} + 2), lambda i: array_to_string(ws[i:i + {LEAK} - 1], ' '))) as gram from w where len(ws) >= {LEAK}),
        v as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from benchmark),
        b as (select item_id, unnest(list_transform(range(1, len(ws) - {LEAK} + 2), lambda i: array_to_string(ws[i:i + {LEAK} - 1], ' '))) as gram from v where len(ws) >= {LEAK})
        select distinct doc_id, item_id from g join b using (gram)""",
    "p9_leaked_items": rf"""
        with w as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '=\r?\n', '', 'g')), '[a-z0-9]+') as ws from documents),
        g as (select doc_id, unnest(range(1, len(ws) - {LEAK} + 2)) as i, unnest(list_transform(range(1, len(ws) - {LEAK} + 2), lambda i: array_to_string(ws[i:i + {LEAK} - 1], ' '))) as gram from w where len(ws) >= {LEAK}),
        v as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from benchmark),
        b as (select item_id, unnest(range(1, len(ws) - {LEAK} + 2)) as j, unnest(list_transform(range(1, len(ws) - {LEAK} + 2), lambda i: array_to_string(ws[i:i + {LEAK} - 1], ' '))) as gram from v where len(ws) >= {LEAK}),
        h as (select distinct doc_id, item_id, i, i - j as shift from g join b using (gram)),
        r as (select *, i - row_number() over (partition by doc_id, item_id, shift order by i) as run from h),
        n as (select doc_id, item_id, count(*) + {LEAK} - 1 as words from r group by doc_id, item_id, shift, run),
        s as (select item_id, count(distinct doc_id) as documents, max(words) as longest from n group by item_id)
        select item_id, task, coalesce(documents, 0) as documents, cast(coalesce(longest, 0) as int) as longest from (select distinct item_id, task from benchmark) left join s using (item_id)""",
}
