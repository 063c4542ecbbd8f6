"""Derived views that give the test tables the shape of the domain's inputs.

Each view is SQL text; ``@name@`` names another view or a table, and a few marks
stand for what differs between Spark and DuckDB.  A view may have one text for
both engines or a pair (Spark, DuckDB).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings snps_with_biophysical probe assessment_result out_merge out_sample_clust haplotype_set bed_region benchmark labels".split()
MARKS = {"div": ("div", "//"), "g": ("", ", 'g'"), "end": ("`end`", '"end"'), "rx": ("regexp_like", "regexp_matches")}

_CHR = "'chr' || nullif(regexp_replace(upper(trim(chr)), '^CHR', ''), '')"
_SCORE = "case when {0} >= 0 and not isnan({0}) then {0} end"

VIEWS: dict[str, str | tuple[str, str]] = {
    "v_snps": f"""select distinct snp_id, run_id, chr, pos, ref, alt, case when ref || alt in ('AG', 'GA', 'CT', 'TC') then 'ts' else 'tv' end as type, gc, tm, complexity, hairpin from (
        select snp_id, run_id, {_CHR} as chr, cast(pos as bigint) as pos, upper(ref) as ref, upper(alt) as alt, case when gc > 1 and not isnan(gc) then gc when gc >= 0 and not isnan(gc) then gc * 100 end as gc,
        {_SCORE.format('tm')} as tm, {_SCORE.format('complexity')} as complexity, {_SCORE.format('hairpin')} as hairpin from @snps_with_biophysical@) as s
        where chr is not null and pos >= 1 and length(ref) = 1 and ref in ('A', 'C', 'G', 'T') and alt in ('A', 'C', 'G', 'T') and ref <> alt""",
    "v_variants": f"""select distinct {_CHR} as chr, cast(pos as bigint) as pos, case when snp_id % 11 = 0 then ref || 'C' else ref end as ref, case when snp_id % 29 = 0 then null else alt end as alt, cast(case when snp_id % 7 = 0 then 2 else 1 end as int) as n_alt from @snps_with_biophysical@""",
    "v_sites": "select chr, pos, ref, alt, case when ref || alt in ('AG', 'GA', 'CT', 'TC') then 'ts' else 'tv' end as type from (select chr, pos, min(ref) as ref, max(alt) as alt from @v_snps@ group by chr, pos) as s where ref <> alt",
    "v_bed": "select distinct region_id as name, chr, cast(s as bigint) as start, cast(s + n as bigint) as @end@, strand from (select region_id, 'chr' || nullif(regexp_replace(upper(trim(chrom)), '^CHR', ''), '') as chr, start_pos % 200000 as s, end_pos - start_pos as n, strand from @bed_region@) as b where n > 0 and chr is not null",
    "v_chroms": "select chr, cast(max(pos) as bigint) + 1000 as len from @v_snps@ group by chr",
    "v_probes": "select distinct probe_id as id, upper(regexp_replace(sequence, '[^A-Za-z]+', ''@g@)) as seq from @probe@ where sequence is not null and probe_id is not null",
    "v_genome": (
        "select chr, array_join(transform(sequence(0, 624), i -> translate(md5(chr || ':' || cast(i as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') as seq from @v_chroms@",
        "select chr, array_to_string(list_transform(range(0, 625), lambda i: translate(md5(chr || ':' || cast(i as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') as seq from @v_chroms@",
    ),
    # SNPs on that genome: two of three agree with its base, some lie near its ends, some on no chromosome of it
    "v_gsnps": """select distinct s.chr, p as pos, case when p % 3 > 0 then coalesce(substr(g.seq, cast(p as int), 1), ref) else ref end as ref, alt, type from (
        select case when pos % 97 = 0 then 'chrUn' else chr end as chr, pos % 20000 + 1 as p, ref, alt, type from @v_sites@) as s left join @v_genome@ as g on g.chr = s.chr""",
    # the same generator up to each chromosome's length and the last region's end, and all SNPs at their own places on it
    "v_wlens": "select c.chr, cast(greatest(len, coalesce(last, 0)) as bigint) as len from @v_chroms@ as c left join (select chr, max(@end@) as last from @v_bed@ group by chr) as b on b.chr = c.chr",
    "v_wgenome": (
        "select chr, array_join(transform(sequence(0, (len - 1) div 32), i -> translate(md5(chr || ':' || cast(i as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') as seq from @v_wlens@",
        "select chr, array_to_string(list_transform(range(0, (len - 1) // 32 + 1), lambda i: translate(md5(chr || ':' || cast(i as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') as seq from @v_wlens@",
    ),
    "v_wsnps": """select distinct chr, pos, case when pos % 3 > 0 and chr <> 'chrUn' then translate(substr(md5(chr || ':' || cast((pos - 1) @div@ 32 as string)), cast((pos - 1) % 32 + 1 as int), 1), '0123456789abcdef', 'ACGTACGTACGTACGT') else ref end as ref, alt, type from (
        select case when pos % 97 = 0 then 'chrUn' else chr end as chr, pos, ref, alt, type from @v_sites@) as s""",
    "v_gt": (
        "select chr, pos, sample, cast(nullif((instr('0123456789abcdef', substr(md5(chr || ':' || cast(pos as string) || sample), 1, 1)) - 1) % 4, 3) as int) as gt from @v_sites@ lateral view explode(array('s00', 's01', 's02', 's03', 's04', 's05', 's06', 's07', 's08', 's09', 's10', 's11')) as sample",
        "select chr, pos, sample, cast(nullif((instr('0123456789abcdef', substr(md5(chr || ':' || cast(pos as string) || sample), 1, 1)) - 1) % 4, 3) as int) as gt from @v_sites@, unnest(['s00', 's01', 's02', 's03', 's04', 's05', 's06', 's07', 's08', 's09', 's10', 's11']) as t(sample)",
    ),
    "v_pops": "select * from (values ('s00', 'A'), ('s01', 'A'), ('s02', 'A'), ('s03', 'A'), ('s04', 'B'), ('s05', 'B'), ('s06', 'B'), ('s07', 'C'), ('s08', 'C'), ('s09', 'C'), ('s10', 'unknown'), ('s99', 'C')) as t(sample, pop)",
    "v_tree": """select 1 as taxid, 1 as parent, 'root' as name union all select 10 + r_regionkey, 1, r_name from @region@ union all
        select 100 + n_nationkey, 10 + n_regionkey, n_name from @nation@ union all select cast(1000 + s_suppkey as int), 100 + s_nationkey, s_name from @supplier@""",
    "v_hits": """select l_orderkey as qname, 'ACC' || cast(l_suppkey as string) || case when l_linenumber % 2 = 0 then '.1' else '' end as rname, 'g' || cast(l_suppkey % 3 as string) as genome,
        cast((l_partkey + l_linenumber) % 8 as int) as nm, cast(case when l_linenumber = 5 then 0 else 81 end as int) as qlen, case when l_partkey % 13 <> 0 then cast(60 + l_partkey % 41 as int) end as as_score,
        case when l_partkey % 3 = 0 then cast(50 + l_partkey % 31 as int) end as xs_score, cast(l_partkey % 60 as int) as mapq, cast(case when l_quantity > 45 then 1 else 0 end as int) as xo from @lineitem@""",
    "v_acc": "select 'ACC' || cast(s_suppkey as string) || case when s_suppkey % 3 = 0 then '.1' else '' end as accession, cast(1000 + s_suppkey as int) as taxid from @supplier@ where s_suppkey % 17 > 0",
    "v_kraken": """select id, '0:' || cast(instr('0123456789abcdef', substr(h, 1, 1)) as string) || ' 9606:' || cast(case when substr(h, 2, 1) < '8' then 0 else instr('0123456789abcdef', substr(h, 3, 1)) * 4 end as string) || ' A:7 |:| 562:' ||
        case when substr(h, 4, 1) = '0' then 'x' when substr(h, 4, 1) < '3' then '2' else '0' end as line from (select id, md5(id) as h from @v_probes@ where length(seq) > 0) as p where substr(h, 5, 1) <> 'f'""",
    "v_alleles": (
        "select distinct region_id, label, upper(seq) as seq from @haplotype_set@ lateral view explode(alleles) as label, seq where seq is not null and seq <> '' and region_id is not null",
        "select distinct region_id, key as label, upper(value) as seq from (select region_id, unnest(map_entries(alleles), recursive := true) from @haplotype_set@) where value is not null and value <> '' and region_id is not null",
    ),
    "v_features": "select coalesce(b.name, b.region_id) as gene, v.chr, v.start, v.@end@ from @v_bed@ as v join (select distinct region_id, name from @bed_region@) as b on b.region_id = v.name",
}


def _refs(text: str) -> list[str]:
    return [x for x in dict.fromkeys(re.findall(r"@(\w+)@", text)) if x not in MARKS]


def _text(name: str, engine: int) -> str:
    v = VIEWS[name]
    text = v if isinstance(v, str) else v[engine]
    for mark, pair in MARKS.items():
        text = text.replace(f"@{mark}@", pair[engine])
    return text


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A view or a table over the folder ``d``, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{d}/{name}.parquet")
    text = _text(name, 0)
    parts = {x: view(spark, d, x) for x in _refs(text)}
    return spark.sql(re.sub(r"@(\w+)@", r"{\1}", text), **parts)


def ctes(sql: str) -> str:
    """DuckDB SQL with the views it names as ``@view@`` put in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for x in _refs(_text(name, 1)):
            visit(x)
        order.append(name)

    for x in _refs(sql):
        visit(x)
    plain = lambda t: re.sub(r"@(\w+)@", r"\1", t)
    for mark, pair in MARKS.items():
        sql = sql.replace(f"@{mark}@", pair[1])
    head = ", ".join(f"{n} as ({plain(_text(n, 1))})" for n in order)
    sql = plain(sql).strip()
    if not head:
        return sql
    if re.match(r"(?i)with recursive\b", sql):
        return f"with recursive {head}, {sql[15:]}"
    if re.match(r"(?i)with\b", sql):
        return f"with {head}, {sql[4:]}"
    return f"with {head} {sql}"
