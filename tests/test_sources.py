"""Readers and writers on small files of every format, the pipeline runner, streaming."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from strandloom.plans import pipeline
from strandloom.sources import sinks, text
from strandloom.streaming import variants as stream


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t10\t.\tA\tG\t50\tPASS\t.\tGT:DP\t0/1:3\t./.:0\nchr1\t20\t.\tAC\tA\t.\tPASS\t.\tDP:GT\t3:1|1\t4:0/0\nchr1\t30\t.\tC\tT,G\t.\t.\t.\tGT\t1/2\t.\nchr2\tx\t.\tC\t.\t.\t.\t.\tGT\t0\nbroken\n"


def test_vcf(spark, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text(VCF)
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(VCF)
    for path in (p, tmp_path / "b.vcf.gz"):
        v = text.read_vcf(spark, str(path))
        assert rows(v, "chr", "pos", "ref", "alt", "n_alt") == [("chr1", 10, "A", "G", 1), ("chr1", 20, "AC", "A", 1), ("chr1", 30, "C", "T", 2), ("chr2", None, "C", None, 0)]
        assert text.count_snps(v).first()[0] == 2
    g = text.vcf_genotypes(spark, str(p), spark.createDataFrame([("chr1", 10), ("chr1", 20)], "chr string, pos bigint"))
    assert rows(g, "pos", "sample", "gt") == [(10, "s1", 1), (10, "s2", None), (20, "s1", 2), (20, "s2", 0)]
    text.variants_table(text.read_vcf(spark, str(p)).filter("pos is not null"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("chr = 'chr1' and pos > 15").count() == 2


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">id1 some text\nacgt\nAC\r\n>id2\n>id3\nNNNN\n")
    f = text.read_fasta(spark, str(tmp_path / "a.fa"))
    assert rows(f, "id", "description", "seq") == [("id1", "some text", "ACGTAC"), ("id2", "", ""), ("id3", "", "NNNN")]
    long = spark.createDataFrame([("x", "ACGT" * 50), ("y", "A" * 80)], "id string, seq string")
    for wrap in (80, 0):
        sinks.write_fasta(long, str(tmp_path / f"o{wrap}"), wrap=wrap)
        assert rows(text.read_fasta(spark, str(tmp_path / f"o{wrap}")), "id", "seq") == rows(long, "id", "seq")
    assert spark.read.text(str(tmp_path / "o80")).agg(F.max(F.length("value"))).first()[0] == 80
    sinks.write_rejects(long, long.filter("id = 'x'"), "id", str(tmp_path / "rej"))
    assert rows(text.read_fasta(spark, str(tmp_path / "rej")), "id") == [("y",)]


def test_tables(spark, tmp_path):
    w = lambda n, t: str((tmp_path / n).write_text(t) and tmp_path / n)
    s = text.read_snp_tsv(spark, w("s.tsv", "chrom\tpos\ttype\tref\talt\tgc\nchr1\t5\tts\tA\tG\t0.5\nchr1\tx\tts\tA\tG\t\n"))
    assert rows(s, "chr", "pos", "gc") == [("chr1", 5, 0.5), ("chr1", None, None)]
    with pytest.raises(ValueError):
        text.read_snp_tsv(spark, w("t.tsv", "a\tb\n1\t2\n"))
    b = text.read_bed(spark, w("b.bed", "track x\n#c\nchr1\t1\t5\nchr1 2 9 n . -\nchr1\tx\t3\n"))
    assert rows(b, "chr", "start", "end", "name", "score", "strand") == [("chr1", 1, 5, "chr1:1-5", None, None), ("chr1", 2, 9, "n", None, "-")]
    g = text.read_gff(spark, w("g.gff", '##gff\nchr1\ts\tCDS\t11\t20\t.\t+\t0\tID=c1;Parent=t1;gene=G1;ID=c2\nchr1\ts\texon\t5\t9\t1.5\t-\t.\tgene_id "G2"; transcript_id "T2";\nchr1\tshort\n'))
    assert rows(g, "kind", "start", "end", "id", "parent", "gene") == [("CDS", 10, 20, "c1", "t1", "G1"), ("exon", 4, 9, "G2", "T2", "G2")]
    assert text.read_gff(spark, str(tmp_path / "g.gff"), ["CDS"]).count() == 1 and text.genes_only(g, ["G2"]).count() == 1
    assert rows(text.read_sizes(spark, w("z.fai", "chr1\t100\t5\t60\t61\nbad\n")), "chr", "len") == [("chr1", 100)]
    assert rows(text.read_kraken(spark, w("k.txt", "C\tr1\t9606\t81\t9606:5 0:2\n")), "id", "line") == [("r1", "9606:5 0:2")]
    sam = text.read_sam(spark, w("x.sam", "@HD\tx\nr1\t0\tA.1\t5\t40\t5M\t*\t0\t0\tACGTA\tIIIII\tAS:i:10\tXS:i:8\tNM:i:1\nr1\t256\tB\t5\t0\t5M\t*\t0\t0\tACGTA\tIIIII\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\tIII\n"))
    assert rows(sam, "qname", "rname", "as_score", "xs_score", "nm", "qlen", "mapped") == [("r1", "A.1", 10, 8, 1, 5, True), ("r1", "B", None, None, 0, 5, True), ("r2", "*", None, None, 0, 3, False)]
    assert text.mapping_summary(sam).first()[:] == (2, 1, 0, 1, 50.0)
    assert rows(text.read_names(spark, w("n.dmp", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tx\t|\t\t|\tsynonym\t|\n")), "taxid", "name") == [(1, "root")]
    assert rows(text.read_nodes(spark, w("o.dmp", "2\t|\t1\t|\tx\t|\n")), "taxid", "parent") == [(2, 1)]
    assert rows(text.read_accessions(spark, w("a.map", "accession\taccession.version\ttaxid\tgi\nA\tA.1\t7\t0\nB\t8\n")), "accession", "taxid") == [("A", 7), ("A.1", 7), ("B", 8)]
    assert rows(text.read_lca(spark, w("l.lca", "12:500_a:1:2:3\t9606:x\t1:root\n")), "id", "taxid") == [("12:500_a", 9606)]
    assert rows(text.read_clusters(spark, w("c.clstr", ">Cluster 0\n0\t81nt, >a... *\n1\t81nt, >b... at 99%\n>Cluster 1\n0\t81nt, >c... *\n")), "family_id", "member_no", "member", "representative") == [(0, 1, "a", "a"), (0, 2, "b", "a"), (1, 1, "c", "c")]
    assert rows(text.read_populations(spark, w("p.txt", "#x\ns1 A\ns2\tB\ns1 B\n")), "sample", "pop", "n") == [("s1", "A", 2), ("s2", "B", 1)]


def test_sfs_files(spark, tmp_path):
    (tmp_path / "a.sfs").write_text('5 folded "A"\n1 2 3 0 0\n1 0 0 1 1\n')
    (tmp_path / "b.sfs").write_text("2 3\n1 2 3 4 5 6\n")
    assert rows(text.read_sfs(spark, str(tmp_path / "a.sfs")), "i", "count", "masked")[:2] == [(0, 1.0, True), (1, 2.0, False)]
    assert rows(text.read_sfs(spark, str(tmp_path / "b.sfs")), "i", "j", "count")[-1] == (1, 2, 6.0)
    sinks.write_sfs(spark.createDataFrame([("A", 1, 4.0), ("A", 2, 1.0)], "pop string, bin int, sites double"), str(tmp_path / "o"), "A", 4)
    back = rows(text.read_sfs(spark, str(tmp_path / "o")), "i", "count", "masked")
    assert [(i, c) for i, c, m in back if not m] == [(1, 4.0), (2, 1.0)]


def test_pipeline_resumes(spark, tmp_path):
    config = {"steps": [{"step": "clean"}, {"step": "cluster", "most": 2}, {"step": "select", "strategy": "random", "total": 3}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    v = spark.createDataFrame([("chr1", i * 100, "A", "C", 1) for i in range(1, 9)] + [("chr1", 5, "AC", "C", 1)], "chr string, pos bigint, ref string, alt string, n_alt int")
    out = pipeline.run(spark, pipeline.load_config(spark, str(tmp_path / "c.json")), {"variants": v}, str(tmp_path / "out"))
    assert out.count() == 3 and [s["state"] for s in json.loads((tmp_path / "out/status.json").read_text())["steps"]] == ["done"] * 3
    again = pipeline.run(spark, config, {"variants": v.limit(0)}, str(tmp_path / "out"), resume=True)
    assert rows(again, "pos") == rows(out, "pos")
    with pytest.raises(KeyError):
        pipeline.run(spark, {"steps": [{"step": "regions"}]}, {"variants": v}, str(tmp_path / "bad"))
    assert json.loads((tmp_path / "bad/status.json").read_text())["steps"][0]["state"] == "failed"
    (tmp_path / "d.json").write_text('{"steps": [{"step": "nothing"}]}')
    with pytest.raises(ValueError):
        pipeline.load_config(spark, str(tmp_path / "d.json"))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows_in = [(1, "chr1", 5, "A", "G", "2024-01-01 00:00:00"), (1, "chr1", 5, "A", "G", "2024-01-01 00:00:00"), (2, "1 ", 7, "A", "C", "2024-01-02 00:00:00"), (3, None, 7, "A", "C", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows_in, "snp_id bigint, chr string, pos int, ref string, alt string, t string").withColumn("called_at", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(src / "one"))
    s = stream.first_deliveries(stream.read_stream(spark, str(src), df.schema), "snp_id", "called_at")
    q = stream.window_counts(s, "called_at", late=None).writeStream.outputMode("append").foreachBatch(lambda b, e: stream.upsert(b, e, str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        late = spark.createDataFrame([(9, "chr2", 1, "A", "G", "2025-06-01 00:00:00"), (10, "chr2", 1, "A", "G", "2025-06-02 00:00:00")], "snp_id bigint, chr string, pos int, ref string, alt string, t string").withColumn("called_at", F.col("t").cast("timestamp")).drop("t")
        late.write.parquet(str(src / "two"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "chr", "win", "n", "n_ts") == [("chr1", 0, 2, 1)]


def test_read_genome_in_pieces(spark, tmp_path):
    """Any block size gives the same genome, and the same probes and regions as whole sequences."""
    import random

    from strandloom.operators import intervals, probes

    rng = random.Random(5)
    seqs = {f"chr{i}": "".join(rng.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((9000, 130, 0, 20_011))}
    (tmp_path / "g").mkdir()
    for name, keys in (("a.fa", ("chr0", "chr1", "chr2")), ("b.fa", ("chr3",))):
        body = "".join(f">{k} some words\n" + "".join(seqs[k][i : i + 61] + "\r\n" for i in range(0, len(seqs[k]), 61)) for k in keys)
        (tmp_path / "g" / name).write_text("lost letters\n" + body)
    want = {k: v.upper() for k, v in seqs.items() if v}
    whole = spark.createDataFrame(list(want.items()), "chr string, seq string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for block in (700, 5000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            genome = text.read_genome(spark, str(tmp_path / "g"), 256)
            got = {}
            for r in sorted(genome.collect(), key=lambda r: (r[0], r[1])):
                assert len(got.get(r.chr, "")) == r["from"] and len(r.piece) <= 256
                got[r.chr] = got.get(r.chr, "") + r.piece
            assert got == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        snps = spark.createDataFrame([(c, p, "ts", want[c][p - 1], "A") for c in want for p in (1, 41, 60, 4096, 4097, 8190, 20_000) if p <= len(want[c])] + [("chrX", 5, "ts", "A", "G")], "chr string, pos long, type string, ref string, alt string")
        bed = spark.createDataFrame([("chr0", 0, 9000, "+"), ("chr3", 4090, 4100, "-"), ("chr3", 8000, 20_011, "+"), ("chr1", 5, 131, "+")], "chr string, start long, end long, strand string")
        for f in (lambda g: probes.cut_probes(snps, g).select("probe_id", "reject", "seq"), lambda g: probes.flanked(snps, g, clip=True).select("chr", "pos", "seq"), lambda g: intervals.region_sequences(bed, g)):
            assert sorted(map(str, f(genome).collect())) == sorted(map(str, f(whole).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pipeline_tiles_merges_and_assesses(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGTACGTAA"), ("b", "ACGTACGTAA"), ("c", "TTTT")], "id string, seq string")
    more = spark.createDataFrame([("d", "TTTT"), ("e", "GGGG")], "id string, seq string")
    got = pipeline.run(spark, {"steps": [{"step": "merge", "with": ["more"]}, {"step": "tile", "length": 4, "by": 3}]}, {"last": seqs, "more": more}, f"file://{tmp_path}/out")
    assert rows(got, "id", "tile_no", "tile") == [("a", 1, "ACGT"), ("a", 2, "TACG"), ("a", 3, "GTAA"), ("c", 1, "TTTT"), ("e", 1, "GGGG")]
    assert json.loads((tmp_path / "out/status.json").read_text())["steps"][1]["state"] == "done"
    stats = pipeline.run(spark, {"steps": [{"step": "assess", "columns": ["n"]}]}, {"last": seqs.selectExpr("length(seq) as n")}, str(tmp_path / "stats"))
    assert rows(stats, "metric", "n", "mean") == [("n", 3, 8.0)]
    with pytest.raises(FileNotFoundError):
        pipeline.load_config(spark, str(tmp_path / "none.json"))


def test_command_line(spark, tmp_path):
    """From a VCF to an assessed probe set, one command after the other."""
    import random

    from strandloom.__main__ import main

    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(30_000))
    at = lambda name: str(tmp_path / name)
    (tmp_path / "g.fa").write_text(">chr1 x\n" + "\n".join(genome[i : i + 60] for i in range(0, len(genome), 60)) + "\n")
    places = range(100, 29_900, 400)
    other = {"A": "G", "C": "T", "G": "A", "T": "C"}
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.2\n" + "".join(f"chr1\t{p}\t.\t{genome[p - 1]}\t{other[genome[p - 1]]}\t50\tPASS\t.\n" for p in places))
    (tmp_path / "keep.bed").write_text("chr1\t0\t20000\tregion\n")
    main(["extract", at("v.vcf"), "-o", at("snps"), "--keep", at("keep.bed")])
    assert text.read_snp_tsv(spark, at("snps")).count() == sum(p <= 20_000 for p in places)
    main(["filter", at("snps"), "-o", at("good"), "--genome", at("g.fa"), "--gc", "30", "70", "--tm", "-1", "-1", "--complexity", "3"])
    good = text.read_snp_tsv(spark, at("good")).count()
    assert 20 < good <= 50
    main(["select", at("good"), "-o", at("chosen"), "--total", "20", "--strategy", "random"])
    main(["build", at("chosen"), "-o", at("probes"), "--genome", at("g.fa")])
    probes = text.read_fasta(spark, at("probes")).collect()
    assert len(probes) == 20 and all(r.seq in genome and len(r.seq) == 81 for r in probes)
    main(["assess", at("probes"), "-o", at("stats")])
    assert {r.metric: r.n for r in spark.read.json(at("stats")).collect()} == dict.fromkeys(("gc", "tm", "complexity", "entropy"), 20)
    main(["tile", at("probes"), "-o", at("tiles"), "--length", "40", "--step", "20"])
    main(["merge", at("probes"), at("probes"), "-o", at("merged")])
    assert text.read_fasta(spark, at("merged")).count() == 20
    main(["sample", at("merged"), "-o", at("few"), "--number", "5"])
    main(["adapter", at("few"), "-o", at("long"), "--five", "ACGT"])
    main(["rename", at("long"), "-o", at("named"), "--prefix", "p"])
    assert sorted(r.id for r in text.read_fasta(spark, at("named")).collect()) == [f"p_{i:04d}" for i in range(1, 6)]
    main(["dedup", at("tiles"), "-o", at("single")])
    main(["convert", at("few"), "-o", at("table")])
    main(["validate", at("few"), "-o", at("counts")])
    assert spark.read.json(at("counts")).first().n_rows == 5
    (tmp_path / "p.json").write_text('{"steps": [{"step": "clean"}, {"step": "select", "strategy": "uniform", "total": 10, "window": 5000}, {"step": "build"}]}')
    main(["run", at("p.json"), "--variants", at("v.vcf"), "--genome", at("g.fa"), "-o", at("run")])
    assert spark.read.parquet(at("run") + "/02_build").count() == 10
