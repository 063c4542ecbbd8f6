"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from strandloom.functions import thermo
from strandloom.plans import registry
from strandloom.plans.views import ctes, view

WITH_SQL = [n for n in registry.QUERIES if n in registry.ORACLE]
ROWS_ONLY = [n for n in registry.QUERIES if n not in registry.ORACLE]


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, str(DATA)), duck, registry.ORACLE[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, duck, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_whole_genome_holds_every_region_and_place(spark, duck):
    assert duck.execute(ctes("select count(*) from @v_bed@ b join @v_wgenome@ g using (chr) where @end@ > length(seq)")).fetchone() == (0,)
    regions = duck.execute(ctes("select count(*) from @v_bed@ b join @v_chroms@ using (chr)")).fetchone()[0]
    assert registry.QUERIES["s6_region_fetch_whole"](spark, str(DATA)).count() == regions
    assert view(spark, str(DATA), "v_wsnps").select("chr", "pos").exceptAll(view(spark, str(DATA), "v_sites").select(F.when(F.expr("pos % 97 = 0"), "chrUn").otherwise(F.col("chr")).alias("chr"), "pos")).count() == 0


def test_all_variants_are_applied(spark, duck):
    regions = duck.execute(ctes("select name, b.chr, start, substr(g.seq, start + 1, @end@ - start) as seq from @v_bed@ b join @v_wgenome@ g using (chr) where @end@ <= length(g.seq)")).fetchall()
    snps = duck.execute(ctes("select chr, pos, ref, alt from @v_wsnps@ order by all")).fetchall()
    want, most = {}, 0
    for name, c, start, seq in regions:
        for hap in (0, 1):
            here = [(p - start - 1, ref, alt) for k, p, ref, alt in snps if k == c and start < p <= start + len(seq) and p % 2 == hap]
            allele = list(seq)
            for at, ref, alt in here:
                allele[at] = alt if seq[at] == ref else seq[at]
            most = max(most, sum(x != y for x, y in zip(allele, seq)))
            if here:
                want[name, hap] = "".join(allele)
    got = {(r.region_id, r.hap): r.allele for r in registry.QUERIES["rec21_apply_variants_whole"](spark, str(DATA)).collect()}
    assert got == want and most > 1


def test_tm_of_short_probes(spark, duck):
    every = registry.QUERIES["x3_tm_all"](spark, str(DATA))
    assert every.count() == view(spark, str(DATA), "v_probes").count()
    short = spark.createDataFrame([("ACGTA",), ("",), ("ANA",), ("acg",), (None,)], "s string").select(thermo.tm_nn(F.col("s"))).collect()
    assert [r[0] for r in short] == [14.0, None, None, 10.0, None]


def test_entry(spark, duck):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
