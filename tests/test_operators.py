"""Operators on small hand-made inputs: edge cases, invariants, brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import fold, seq, thermo
from strandloom.functions.clean import clean_chr, clean_id, clean_sequence, gc_fraction, score
from strandloom.operators import assess, filters, graph, haplo, intervals, kmers, popgen, probes, select, sets, taxa, variants
from strandloom.operators.unpack import split_packed


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_cleaning(spark):
    assert one(spark, "aC\r\n g t", "string", clean_sequence) == "ACGT"
    assert one(spark, " >  p 1 ", "string", clean_id) == "p 1"
    assert one(spark, " > ", "string", clean_id) is None
    assert [one(spark, x, "string", clean_chr) for x in (" 7", "CHRx ", "chr", None)] == ["chr7", "chrX", None, None]
    assert [one(spark, x, "double", score) for x in (1.5, -1.0, float("nan"), None, 0.0)] == [1.5, None, None, None, 0.0]
    assert [one(spark, x, "double", gc_fraction) for x in (0.5, 1.0, 73.72, -1.0)] == [0.5, 1.0, 0.7372, None]


PACKED = [
    ("a,b;c d|e\tf\ng", ["a", "b", "c", "d", "e", "f", "g"]),
    ('["x y", "z""q"]', ["x y", 'z"q']),
    ("'it''s',b'c", ["it's", "b'c"]),
    (",,a, ,b,,", ["a", "b"]),
    ('"open a', ['"open', "a"]),
    ('"","  ",x', ["x"]),
    ("", []), (None, []), ("[]", []), ("{(p1);[p2]}", ["p1", "p2"]),
    ("ü,😀 é", ["ü", "😀", "é"]),
]


def test_split_packed(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, (t, _) in enumerate(PACKED)], "family_id int, members string, value string")
    got = rows(split_packed(df, "members", ["family_id"], "member", "member_no"), "family_id", "member_no", "member")
    assert got == sorted((i, n + 1, v) for i, (_, vs) in enumerate(PACKED) for n, v in enumerate(vs))
    twice = df.unionByName(df)
    assert rows(split_packed(twice, "members", ["family_id"]), "family_id", "value_no", "value") == got
    assert split_packed(df.limit(0), "members", ["family_id"]).count() == 0
    with pytest.raises(ValueError, match="missing column"):
        split_packed(df, "nothing", ["family_id"])


def test_split_packed_long_field(spark):
    df = spark.createDataFrame([(1, ";".join(f"m{i}" for i in range(5000)))], "k int, f string")
    assert split_packed(df, "f", ["k"]).agg(F.count(F.lit(1)), F.max("value_no")).first()[:] == (5000, 5000)


SEQS = ["ACGTACGTAC", "AAAAAAAA", "acgtn", "", "A", "GGCCGGCC", "ACGTRYN" * 5]


def py_dust(s, k=3):
    s = s.upper()
    if len(s) <= k:
        return 0.0
    c = {}
    for i in range(len(s) - k + 1):
        c[s[i : i + k]] = c.get(s[i : i + k], 0) + 1
    return sum(x * (x - 1) / 2 for x in c.values()) / (len(s) - k)


def test_sequence_functions(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "i int, s string")
    c = F.col("s")
    got = df.select("i", seq.dust(c).alias("dust"), seq.entropy(c).alias("e"), seq.reverse_complement(c).alias("rc"), seq.gc_percent(c).alias("gc"), seq.is_palindrome(c).alias("p"), F.size(seq.kmers(c, 3)).alias("k")).orderBy("i").collect()
    for s, r in zip(SEQS, got):
        assert r.dust == pytest.approx(py_dust(s))
        h = -sum(s.count(x) / len(s) * math.log2(s.count(x) / len(s)) for x in set(s)) if s else None
        assert (r.e is None) if h is None else r.e == pytest.approx(h)
        assert r.k == max(len(s) - 2, 0)
        assert r.rc == "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(x, "N") for x in reversed(s.upper()))
    assert got[0].gc == 50 and got[3].gc is None and got[5].p and not got[1].p
    back = df.filter("s rlike '^[ACGT]+$'").select((seq.reverse_complement(seq.reverse_complement(c)) == c).alias("ok"))
    assert all(r.ok for r in back.collect())
    assert spark.range(1).select(seq.dust(F.lit(None).cast("string")), seq.entropy(F.lit(None).cast("string"))).first()[:] == (None, None)


def test_thermo(spark):
    s = "GCGATCGATCGC"
    steps = [s[i : i + 2] for i in range(len(s) - 1)]
    ds, dh = (thermo.steps("sugimoto_1996", p) for p in (1, 0))
    r = spark.createDataFrame([(s,), ("ACN",), ("A",), (None,)], "s string").select(thermo.entropy_tenths(F.col("s")).alias("ds"), thermo.enthalpy_tenths(F.col("s")).alias("dh"), thermo.entropy_tenths(F.col("s"), "santalucia_1998").alias("ds2")).collect()
    assert r[0].ds == sum(ds[x] for x in steps) - 90 - 14 and r[0].dh == sum(dh[x] for x in steps) + 6
    assert r[0].ds2 == sum(thermo.steps("santalucia_1998", 1)[x] for x in steps) - 56 - 14
    assert all(x.ds is None and x.dh is None for x in r[1:])
    with pytest.raises(ValueError):
        thermo.entropy_tenths(F.lit("AC"), "nothing")


def py_align(s):
    rc = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(x, "?") for x in reversed(s))
    best, h = 0, [[0] * (len(s) + 1) for _ in range(len(s) + 1)]
    for i, j in itertools.product(range(1, len(s) + 1), repeat=2):
        same = 3 if s[i - 1] == rc[j - 1] else -2
        h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] - 5, h[i][j - 1] - 5)
        best = max(best, h[i][j])
    return best


def test_hairpin_alignment(spark):
    rng = random.Random(1)
    s = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["", "GGGGAAAACCCC"]
    got = [r[1] for r in spark.createDataFrame(list(enumerate([*s, None])), "i int, s string").select("i", fold.hairpin_alignment("s")).orderBy("i").collect()]
    assert got == [py_align(x) for x in s] + [None]


def py_fold(s):
    """The same energies by plain recursion."""
    pair = {"A": "T", "T": "A", "C": "G", "G": "C"}
    back = {"A": "T", "C": "G", "G": "C", "T": "A"}
    stack = lambda x: fold.STACKS.get(x, fold.STACKS.get(back[x[1]] + back[x[0]]))
    import functools

    @functools.cache
    def inside(i, j):
        if j - i < 4 or pair.get(s[i]) != s[j]:
            return 1e6
        best = fold._sized(fold.HAIRPIN_LOOPS, 3, j - i - 1)
        for k in range(i + 1, min(j - 4, i + 32)):
            for q in range(j - 1, k + 3, -1):
                left, right = k - i - 1, j - q - 1
                if left + right > fold.LOOP:
                    break
                e = inside(k, q)
                if left + right == 0:
                    e += stack(s[i] + s[k])
                else:
                    e += fold.loop_energy(left, right)
                    if left + right == 1:
                        e += stack(s[i] + s[k])
                best = min(best, e)
        return best

    whole = [0.0] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        whole[j] = min([whole[j - 1]] + [whole[i] + inside(i, j - 1) + (0.05 if s[i] in "AT" else 0) for i in range(j - 4)])
    return whole[-1]


def test_fold_energies(spark):
    rng = random.Random(33)
    s = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 45))) for _ in range(25)] + ["", "GGGGGAAAACCCCC", "GGGGGGAAAACCCCCCTTTGCGCGCAAAGCGCGC", "A" * 30 + "CCCC" + "T" * 30]
    assert fold.fold_energies(s).tolist() == pytest.approx([py_fold(x) for x in s], abs=1e-4)
    got = [r[0] for r in spark.createDataFrame([("GGGGGAAAACCCCC",), (None,), ("",), ("NNNN",)], "s string").select(fold.hairpin_energy("s")).collect()]
    assert got == [pytest.approx(4 * 1.84 - 3.5, abs=0.011), None, 0.0, 0.0]


def test_intervals(spark):
    rng = random.Random(2)
    bed = [(f"chr{rng.randint(1, 2)}", a := rng.randint(0, 50_000), a + rng.randint(1, 15_000), f"n{i}") for i in range(30)] + [("chr1", 10, 10, "empty"), (None, 1, 2, "null"), ("chr1", None, 5, "open")]
    pts = [(f"chr{rng.randint(1, 3)}", rng.randint(1, 70_000)) for _ in range(300)] + [(None, 5), ("chr1", None)]
    b, p = spark.createDataFrame(bed, "chr string, start bigint, end bigint, name string"), spark.createDataFrame(pts, "chr string, pos bigint")
    ok = [x for x in bed if None not in x and x[2] > x[1]]
    tests = {"one_based": lambda q, x: x[1] < q <= x[2], "as_is": lambda q, x: x[1] <= q < x[2], "inclusive": lambda q, x: x[1] <= q <= x[2]}
    real = [x for x in pts if None not in x]
    for base, f in tests.items():
        want = sorted(q for q in real if any(q[0] == x[0] and f(q[1], x) for x in ok))
        assert sorted(tuple(r) for r in intervals.covered(p.na.drop(), b, True, base).collect()) == want
        assert intervals.covered(p, b, False, base).count() == len(pts) - len(want)
    assert intervals.covered(p, b.limit(0)).count() == 0 and intervals.covered(p, b.limit(0), keep=False).count() == len(pts)
    chroms = spark.createDataFrame([("chr1", 60_000), ("chr2", 60_000), ("chr9", 10)], "chr string, len bigint")
    cover = {(c, i) for c, s, e, _ in ok for i in range(s, min(e, 60_000))}
    gaps = {(r["chr"], i) for r in intervals.complement(b, chroms).collect() for i in range(r["start"], r["end"])}
    assert gaps == {(c, i) for c, n in (("chr1", 60_000), ("chr2", 60_000), ("chr9", 10)) for i in range(n)} - cover
    merged = intervals.merge_intervals(b).collect()
    assert sum(r.n for r in merged) == len(ok) and {(r["chr"], i) for r in merged for i in range(r["start"], r["end"])} == {(c, i) for c, s, e, _ in ok for i in range(s, e)}


@pytest.mark.parametrize("tile", [100, 100_000])
def test_neighbour_counts(spark, tile):
    rng = random.Random(3)
    pts = [("chr1", rng.randint(1, 3000)) for _ in range(400)] + [("chr1", 500)] * 5 + [(None, 1), ("chr1", None)]
    got = variants.neighbour_counts(spark.createDataFrame(pts, "chr string, pos bigint"), 60, tile)
    ok = [x for x in pts if None not in x]
    assert sorted(tuple(r) for r in got.select("chr", "pos", "n_near").collect()) == sorted((c, q, sum(abs(q - z) <= 60 for _, z in ok)) for c, q in ok)


def test_probe_shapes(spark):
    with pytest.raises(ValueError):
        probes.check_shift(81, 40)
    assert probes.position_shift("left", 81) == 20 and probes.position_shift("right", 81, 7) == -7
    assert probes.parse_positions("center, left,-5", 81) == [("C", 0), ("L1", 20), ("R2", -5)]
    with pytest.raises(ValueError):
        probes.add_adapters(F.lit("A"), "XX")
    df = spark.createDataFrame([("a", "A" * 100), ("b", "C" * 30), ("c", "G" * 50 + "N" + "G" * 60), ("d", ""), ("e", None)], "id string, seq string")
    t = rows(probes.tile_regions(df), "id", "tile_no", "start1", "end1")
    assert t == [("a", 1, 1, 81), ("a", 2, 20, 100)]
    u = rows(probes.tile_sequences(df), "id", "tile_id")
    assert ("b", "b_tile1") in u and ("a", "a:19-100_tile2") in u and ("d", "d_tile1") in u and not any(x[0] == "e" for x in u)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_dense_index_in_any_partitioning(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("x"), "id").repartition(5)
        got = rows(probes.dense_index(df, ["x", "id"]), "idx", "x")
        assert [g[0] for g in got] == list(range(500)) and [g[1] for g in got] == sorted(g[1] for g in got)
        assert filters.nearest_rank(df, "x", 0.9).first()[0] == sorted(i * 7919 % 1000 for i in range(500))[450]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_filters(spark):
    df = spark.createDataFrame([(1, 40.0), (2, None), (3, 70.0), (4, 50.0)], "id int, gc double")
    c = filters.cascade(df, [("gc", filters.in_range(F.col("gc"), 45, 65))])
    assert rows(c, "id", "fail_reason") == [(1, "gc"), (2, "gc"), (3, "gc"), (4, None)]
    assert filters.cascade(df, [("gc", filters.in_range(F.col("gc"), -1, -1))]).filter("fail_reason is null").count() == 4
    assert filters.at_most(df, "gc", 0).count() == 4 and filters.at_most(df, "gc", 0.5).count() == 2 and filters.at_most(df, "gc", 45).count() == 1
    k = spark.createDataFrame([("0:5 9606:12 A:3 562:x 10:2",), ("",), (None,)], "l string")
    assert [r[0] for r in k.select(filters.kraken_hits(F.col("l"))).collect()] == [14, 0, 0]
    with pytest.raises(Exception):
        filters.by_expression(df, "no_such_column > 1").count()


def py_dimer(pool, kind, k=4):
    rc = lambda s: "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(x, "N") for x in reversed(s))
    ks = lambda s: [s[i : i + k] for i in range(len(s) - k + 1)]
    out = {}
    back = [m for s in pool.values() for m in ks(rc(s))]
    both = back + [m for s in pool.values() for m in ks(s)]
    for i, s in pool.items():
        if kind == "fast":
            own = ks(rc(s))
            out[i] = sum(max(back.count(m) - own.count(m), 0) for m in ks(s))
        elif kind == "total":
            out[i] = sum(back.count(m) for m in ks(s) if "N" not in m)
        else:
            out[i] = sum(c for c in (both.count(m) for m in ks(s)) if c >= 2)
    return out


@pytest.mark.parametrize("kind", ["fast", "total", "classic"])
def test_dimer(spark, kind):
    rng = random.Random(4)
    pool = {f"p{i}": "".join(rng.choice("ACGTN" if i % 3 else "ACGT") for _ in range(rng.randint(2, 25))) for i in range(15)}
    df = spark.createDataFrame([*pool.items(), ("null", None)], "id string, seq string")
    assert dict(rows(kmers.dimer_raw(df, "id", "seq", 4, kind), "id", "hits")) == py_dimer(pool, kind)


@pytest.mark.parametrize("kind", ["fast", "total", "classic"])
def test_dimer_broadcasts_no_kmers(spark, tmp_path, kind):
    spark.createDataFrame([("a", "ACGTTGCATTGACC"), ("b", "GGTCAATGCAACGT")], "id string, seq string").write.parquet(str(tmp_path / "p"))
    plan = kmers.dimer_raw(spark.read.parquet(str(tmp_path / "p")), "id", "seq", 4, kind)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # the pool's size alone is broadcast


def test_kmer_edges_of_odd_pools(spark):
    rng = random.Random(11)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    base = [letters(40) for _ in range(5)]
    made = [(f"s{i}", b[: rng.randint(25, 40)] + letters(rng.randint(0, 9), "ACGTNRé")) for i in range(40) for b in [rng.choice(base)]]
    made += [("s0", letters(30)), ("low", base[0].lower()), ("copy", base[0]), ("", ""), ("short", "ACG"), ("n", "N" * 30), ("r", "ACRT" * 6), ("q", "ACRT" * 6), ("null", None)]
    comp = lambda m: min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    for k, part, most in ((5, 0.5, 12), (11, 0.5, 100), (33, 0.3, 100)):
        ks = {}
        for i, s in made:
            ks.setdefault(i, set()).update(comp(s.upper()[j : j + k]) for j in range(len(s or "") - k + 1) if "N" not in s.upper()[j : j + k])
        freq = {}
        for x in ks.values():
            for m in x:
                freq[m] = freq.get(m, 0) + 1
        want = {}
        for a, b in itertools.combinations(sorted(ks), 2):
            shared, smaller = sum(freq[m] <= most for m in ks[a] & ks[b]), min(len(ks[a]), len(ks[b]))
            if shared and shared >= part * smaller:
                want[a, b] = (shared, smaller)
        got = kmers.shared_kmer_edges(spark.createDataFrame(made, "id string, seq string"), "id", "seq", k, part, most).collect()
        assert {(r.a, r.b): (r.shared, r.smaller) for r in got} == want and len(got) == len(want) > 5


def test_pairs_of_one_shared_kmer_leave_no_task(spark, monkeypatch):
    import pyarrow as pa
    from strandloom.operators import kmerpairs

    monkeypatch.setattr(kmerpairs, "LISTED", 50)  # several lists
    rng = random.Random(3)
    seqs = ["ACGTTGCATTG" + "".join(rng.choice("ACGT") for _ in range(70)) for _ in range(90)]
    seqs += [seqs[0][:60] + "A" * 21]
    b = pa.RecordBatch.from_pydict({"s": list(range(91)), "w": [1] * 91, "seqs": [[x] for x in seqs]})
    rows = pa.Table.from_batches(kmerpairs._dealt(iter([b]), 11))
    out = set()
    for g in range(kmerpairs.GROUPS):
        part = rows.filter(pa.compute.equal(rows["part"], g))
        out |= {(x, y) for r in kmerpairs._counted(iter(part.to_batches()), 0.5, 100) for x, y in zip(r["a"].to_pylist(), r["b"].to_pylist())}
    assert out == {(0, 90)}  # 4095 pairs share a k-mer


def test_dimer_groups(spark):
    a = "ACGTTGCATTGACCAGTAGGCT"
    df = spark.createDataFrame([("a", a), ("b", a), ("c", a[:-2] + "AA"), ("d", "T" * 22), ("e", None)], "id string, seq string")
    g = {r.id: r for r in kmers.dimer_groups(df, "id", "seq").collect()}
    assert set(g) == {"a", "b", "c", "d"} and g["b"].group_id == "a" and [x for x in g if g[x].keep] == ["a", "d"]
    assert kmers.dimer_groups(df.limit(0), "id", "seq").count() == 0


def test_dimer_groups_of_copies_are_one_class(spark, monkeypatch):
    a = "ACGTTGCATTGACCAGTAGGCT"
    df = spark.createDataFrame([(f"a{i:02d}", a) for i in range(60)] + [("b", a[:-2] + "AA"), ("d", "T" * 22)], "id string, seq string")
    seen, plain = [], kmers.connected
    monkeypatch.setattr(kmers, "connected", lambda e, *x: seen.append(e.count()) or plain(e, *x))
    g = {r.id: (r.group_id, r.degree, r.keep) for r in kmers.dimer_groups(df, "id", "seq").collect()}
    assert g == {f"a{i:02d}": ("a00", 60, i == 0) for i in range(60)} | {"b": ("a00", 60, False), "d": ("d", 0, True)}
    assert seen == [2]  # not 1830 pairs of sequences


def test_group_stats_of_copies(spark, monkeypatch):
    a = "ACGTTGCATTGACCAGTAGGCT"
    df = spark.createDataFrame([(f"a{i:02d}", a) for i in range(60)] + [("c1", "AAAC" * 5), ("c2", "AAAC" * 5), ("d", "T" * 22)], "id string, seq string")
    seen, plain = [], kmers.connected
    monkeypatch.setattr(kmers, "connected", lambda e, *x: seen.append(e.count()) or plain(e, *x))
    assert kmers.group_stats(kmers.dimer_groups(df, "id", "seq"), "id").collect() == [(2, 60, 60, 31.0)]
    assert seen == [2]  # not 1771 pairs of sequences


def _dimer_groups_by_hand(seqs, k=11, part=0.5, most=100):
    comp = lambda m: min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    ks = [{comp(s[i : i + k]) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]} for s in seqs]
    freq = {}
    for m in itertools.chain(*ks):
        freq[m] = freq.get(m, 0) + 1
    group, degree = list(range(len(seqs))), [0] * len(seqs)
    for i, j in itertools.combinations(range(len(seqs)), 2):
        shared = sum(freq[m] <= most for m in ks[i] & ks[j])
        if shared and shared >= part * min(len(ks[i]), len(ks[j])):
            degree[i], degree[j] = degree[i] + 1, degree[j] + 1
            lo, hi = sorted((group[i], group[j]))
            group = [lo if x == hi else x for x in group]
    best = {g: min((degree[i], i) for i, x in enumerate(group) if x == g)[1] for g in set(group)}
    return [(i, g, d, best[g] == i) for i, (g, d) in enumerate(zip(group, degree))]


def _near_copies(rng, n, of):
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    made = [letters(70) for _ in range(30)] + ["", "ACGT", "ACGTN" * 8, "RYK" * 9, "RYK" * 9, "T" * 30]
    for _ in range(of):
        base = letters(80)
        for _ in range(n):
            x = list(base)
            for i in rng.sample(range(80), rng.choice([0, 1, 2, 3])):
                x[i] = rng.choice("ACGT")
            made.append("".join(x)[: rng.choice([80, 80, 60])])
    rng.shuffle(made)
    return made


@pytest.mark.parametrize(("block", "listed", "most"), [(1000, 3_000_000, 100), (40, 900, 100), (60, 50, 25), (25, 2000, 12)])
def test_dimer_groups_over_blocks(spark, monkeypatch, block, listed, most):
    from strandloom.operators import kmerlinks

    monkeypatch.setattr(kmerlinks, "BLOCK", block)
    monkeypatch.setattr(kmerlinks, "LISTED", listed)
    made = _near_copies(random.Random(block), 15, 6)
    df = spark.createDataFrame(list(enumerate(made)), "id int, seq string")
    want = _dimer_groups_by_hand(made, most=most)
    assert rows(kmers.dimer_groups(df, "id", "seq", max_freq=most), "id", "group_id", "degree", "keep") == want
    sizes = [n for g in {w[1] for w in want} if (n := sum(w[1] == g for w in want)) > 1]
    got = kmers.dimer_group_stats(df, "id", "seq", max_freq=most).first()
    assert tuple(got) == (len(sizes), sum(sizes) - len(sizes), max(sizes), pytest.approx(sum(sizes) / len(sizes)))


def test_group_stats_link_no_group_twice(spark, monkeypatch):
    a = "ACGTTGCATTGACCAGTAGGCTACCGATATCGGGCTAATCCAGT"
    made = [a[:i] + c + a[i + 1 :] for i in range(0, 44, 2) for c in "ACGT" if c != a[i]]  # 66 near copies: some 2000 links
    df = spark.createDataFrame(list(enumerate(made)), "id int, seq string")
    seen, plain = [], kmers.connected
    monkeypatch.setattr(kmers, "connected", lambda e, *x: seen.append(e.count()) or plain(e, *x))
    assert tuple(kmers.dimer_group_stats(df, "id", "seq").first()) == (1, 65, 66, 66.0) and seen == [65]
    assert tuple(kmers.dimer_group_stats(df.limit(0), "id", "seq").first()) == (0, 0, 0, 0.0)
    twice = spark.createDataFrame([(1, "ACG"), (1, "ACT"), (2, "AAA")], "id int, seq string")  # an id with two rows, as in SQL
    assert tuple(kmers.dimer_group_stats(twice, "id", "seq").first()) == (1, 1, 2, 2.0)


def test_links_tell_two_sequences_of_one_hash_apart():
    import pyarrow as pa
    from strandloom.operators import kmerlinks

    b = pa.RecordBatch.from_pydict({"s": [7, 7], "t": [1, 2], "seqs": [["ACGTTGCATTGACC"], ["TTTTGGGACACCAA"]]})
    with pytest.raises(RuntimeError, match="one hash"):
        list(kmerlinks._linked(iter([b]), 11, 0, 1, 0.5, False, 100))


def test_connected_long_chain_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    order = list(range(200))
    random.Random(6).shuffle(order)
    e = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(500, 500), (None, 3)], "a long, b long")
    assert dict(rows(graph.connected(e, "a", "b"), "id", "group_id")) == {i: 0 for i in range(200)} | {500: 500}


@pytest.mark.parametrize(("block", "listed", "frequent"), [(1000, 3_000_000, 100), (50, 800, 3), (1000, 800, 5), (30, 2000, 8)])
def test_families_over_blocks(spark, monkeypatch, block, listed, frequent):
    from strandloom.operators import kmerlinks

    for name, value in (("BLOCK", block), ("LISTED", listed), ("FREQUENT", frequent)):
        monkeypatch.setattr(kmerlinks, name, value)
    made = _near_copies(random.Random(block + frequent), 22, 5)
    want = {i: g for i, g, *_ in _dimer_groups_by_hand(made, part=0.8, most=len(made))}
    longest = {g: min((-len(made[i]), i) for i in want if want[i] == g)[1] for g in set(want.values())}
    seen, plain = [], kmers.connected
    monkeypatch.setattr(kmers, "connected", lambda e, *x: seen.append(e.count()) or plain(e, *x))
    df = spark.createDataFrame(list(enumerate(made)), "id int, seq string")
    assert rows(assess.greedy_families(df, "id", "seq"), "id", "family_id", "representative") == sorted((i, g, longest[g]) for i, g in want.items())
    if block == 1000:
        assert len(seen) == 1 and seen[0] < len(made)  # a forest, no pairs


def test_families_of_many_copies(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base, made = letters(80), [letters(80) for _ in range(10)] + ["", "ACGT", "ACGTN" * 10]
    made += [base] * 130 + [base[:40] + letters(1) + base[41:] + letters(i % 3) for i in range(20)]
    for _ in range(120):  # near copies, one or two letters changed: some are linked over others only
        x = list(base)
        for i in rng.sample(range(80), rng.choice([1, 2])):
            x[i] = rng.choice("ACGT")
        made.append("".join(x))
    rng.shuffle(made)
    comp = lambda m: min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    ks = [{comp(s[i : i + 11]) for i in range(len(s) - 10) if "N" not in s[i : i + 11]} for s in made]
    want = list(range(len(made)))
    for i, j in itertools.combinations(range(len(made)), 2):
        if min(len(ks[i]), len(ks[j])) and len(ks[i] & ks[j]) >= 0.8 * min(len(ks[i]), len(ks[j])) and want[i] != want[j]:
            lo, hi = sorted((want[i], want[j]))
            want = [lo if x == hi else x for x in want]
    df = spark.createDataFrame(list(enumerate(made)), "id int, seq string")
    got = dict(rows(assess.greedy_families(df, "id", "seq"), "id", "family_id"))
    assert max(want.count(x) for x in want) > 200 and got == dict(enumerate(want))


def test_connected_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    e = spark.createDataFrame([(f"{order[i]:04d}", f"{order[i + 1]:04d}") for i in range(n - 1)] + [("z1", "z1"), (None, "q")], "a string, b string")
    got = dict(rows(graph.connected(e, "a", "b"), "id", "group_id"))
    assert got == {f"{i:04d}": "0000" for i in range(n)} | {"z1": "z1"}


def test_sets(spark):
    t = [spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "a"), (2, "a")], [(2, "b"), (3, "b")], [(3, "c"), (2, "c"), (4, "c")])]
    want = {"intersection": [(2, "a")], "union": [(1, "a"), (2, "a"), (3, "b"), (4, "c")], "difference": [(1, "a")], "symmetric": [(1, "a"), (2, "a"), (4, "c")], "exactly_one": [(1, "a"), (4, "c")]}
    for how, w in want.items():
        assert rows(sets.combine(t, ["k"], how), "k", "v") == w
    with pytest.raises(ValueError):
        sets.combine(t, ["k"], "nothing")
    kept, removed = sets.merge_dedup([("x", spark.createDataFrame([("a", "AC"), ("b", "GG")], "id string, seq string")), ("y", spark.createDataFrame([("a", "TT"), ("c", "ac")], "id string, seq string"))])
    assert rows(kept, "id", "seq") == [("a", "AC"), ("a_y", "TT"), ("b", "GG")] and rows(removed, "removed_id", "kept_id") == [("c", "a")]


def test_selection(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(f"chr{rng.randint(1, 3)}", rng.randint(1, 99_999), "A", "C") for _ in range(600)], "chr string, pos bigint, ref string, alt string").distinct()
    u = select.select_uniform(df, 75)
    per = {(r["chr"], r.win): r["count"] for r in u.groupBy("chr", "win").count().collect()}
    assert u.count() == 75 and set(per.values()) == {2, 3} and rows(u, "chr", "pos") == rows(select.select_uniform(df.repartition(7), 75), "chr", "pos")
    assert select.select_random(df, 10, ["chr", "pos"]).count() == 10 and select.select_random(df, 10**6, ["chr", "pos"]).count() == df.count()
    assert select.select_uniform(df.limit(0), 5).count() == 0


def test_haplotypes(spark):
    r = spark.createDataFrame([("r", 100, "ACGTACGTAC")], "region_id string, start bigint, seq string")
    v = [("r", "s1", 1, 102, "C", "T"), ("r", "s1", 1, 105, "AC", "A"), ("r", "s1", 1, 110, "C", "CGG"), ("r", "s2", 1, 99, "AA", "A"), ("r", "s2", 1, 103, "A", "C"), ("r", "s2", 2, 105, "ACG", "TTT")]
    got = dict(((a, b), c) for a, b, c in rows(haplo.apply_variants(r, spark.createDataFrame(v, "region_id string, sample string, hap int, pos bigint, ref string, alt string")), "sample", "hap", "allele"))
    assert got == {("s1", 1): "ATGTAGTACGG", ("s2", 1): "ACGTACGTAC", ("s2", 2): "ACGTTTTTAC"}


def test_prune_linked(spark):
    rng = random.Random(7)
    g = [[rng.choice([0, 1, 2, None]) for _ in range(40)] for _ in range(120)]
    for i in range(0, 120, 10):
        g[i + 1] = g[i]
    df = spark.createDataFrame([("chr1", i + 1, x) for i, x in enumerate(g)], "chr string, pos int, gts array<int>")
    kept = {r.pos for r in haplo.prune_linked(df, 10, 5, 0.9).collect()}
    assert all(i + 1 in kept and i + 2 not in kept for i in range(0, 120, 10))
    assert haplo.prune_linked(df.limit(0)).count() == 0


def pruned(g, window, step, r2):
    """Indices left by the greedy rule over all sites at once, window after window."""
    alive = [True] * len(g)
    for s in range(0, len(g), step):
        for i in range(s, min(s + window, len(g))):
            for j in range(i + 1, min(s + window, len(g))) if alive[i] else ():
                if alive[j]:
                    both = [(x, y) for x, y in zip(g[i], g[j]) if x is not None and y is not None]
                    n, sx, sy = len(both), sum(x for x, _ in both), sum(y for _, y in both)
                    cov = n * sum(x * y for x, y in both) - sx * sy
                    v = (n * sum(x * x for x, _ in both) - sx * sx) * (n * sum(y * y for _, y in both) - sy * sy)
                    alive[j] = not (v and cov * cov / v > r2)
    return {i for i, x in enumerate(alive) if x}


@pytest.mark.parametrize("window, step, sites", [(10, 1, 2600), (7, 3, 3500)])
def test_prune_linked_over_chunks(spark, window, step, sites):
    rng = random.Random(window)
    g = {c: [[rng.choice([0, 1, 2, None]) for _ in range(8)] for _ in range(sites)] for c in ("chr1", "chr2")}
    df = spark.createDataFrame([(c, i + 1, x) for c in g for i, x in enumerate(g[c])], "chr string, pos int, gts array<int>").repartition(5)
    kept = {(r.chr, r.pos - 1) for r in haplo.prune_linked(df, window, step, 0.2).collect()}
    assert kept == {(c, i) for c in g for i in pruned(g[c], window, step, 0.2)}


def test_genotypes_and_p_values(spark):
    f = ["0/1", "1|1", "./.", ".", "0|0", "1/2", "x/1", "0", "2|0:9"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in f], "f string").select(popgen.genotype(F.col("f"))).collect()] == [1, 2, None, None, 0, 2, None, None, 1]
    assert popgen.correlation_p(0.5, 20) == pytest.approx(0.0247695, rel=1e-4) and math.isnan(popgen.correlation_p(0.5, 2))


def test_best_hit(spark):
    tree = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (20, 2), (30, 3)], "taxid int, parent int")
    best = spark.createDataFrame([("a", 20, 1, 98.0), ("a", 30, 2, 97.0), ("b", 20, 0, 100.0), ("c", 30, 0, 100.0), ("d", 20, 9, 80.0)], "qname string, taxid int, nm int, sim double")
    v = dict(rows(taxa.best_hit_verdict(best, tree, spark.createDataFrame([(2,)], "taxid int")), "qname", "verdict"))
    assert v == {"a": "ambiguous", "b": "assigned", "c": "not_target", "d": "low_quality"}
    hits = spark.createDataFrame([("a", 20), ("a", 30), ("b", 20), ("c", 99)], "qname string, taxid int")
    assert rows(taxa.common_ancestor(hits, tree), "qname", "lca") == [("a", 1), ("b", 20)]


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id string, seq string")
    assert kmers.dimer_raw(p, "id", "seq").count() == 0 and probes.tile_regions(p).count() == 0 and assess.summary(spark.createDataFrame([], "gc double"), ["gc"]).count() == 0
    assert filters.nearest_rank(spark.createDataFrame([], "x double"), "x", 0.5).count() == 0
    g = spark.createDataFrame([], "chr string, pos bigint, sample string, gt int")
    assert popgen.ibs_distance(g).count() == 0 and popgen.pca(g).count() == 0


def test_merged_intervals_over_tiles(spark):
    """The running maximum carries over tile borders, and over tiles without a start."""
    rng = random.Random(31)
    data = [(rng.choice("ab"), s := rng.randint(0, 1_000_000), s + rng.choice([5, 2000, 250_000])) for _ in range(120)] + [("a", 10, 10), (None, 1, 5), ("a", None, 4)]
    df = spark.createDataFrame(data + data[:7], "chr string, start long, end long")
    for distance in (0, 3000):
        want = []
        for c in "ab":
            cur = None
            for s, e in sorted((s, e) for k, s, e in data if k == c and s is not None and e > s):
                if cur and s <= cur[2] + distance:
                    cur[2] = max(cur[2], e)
                else:
                    cur = [c, s, e]
                    want.append(cur)
        got = intervals.merge_intervals(df, distance=distance)
        assert sorted(tuple(r) for r in got.select("chr", "start", "end").collect()) == sorted(map(tuple, want))


def test_pair_sums_with_missing_samples(spark):
    rng = random.Random(32)
    g = {(p, s): rng.choice([0, 1, 2, None]) for p in range(200) for s in "abcde" if rng.random() < 0.8}
    long = spark.createDataFrame([("c", p, s, v) for (p, s), v in g.items()], "chr string, pos int, sample string, gt int")
    got = {(r.s1, r.s2): (r["diff"], r.n_sites) for r in popgen.ibs_distance(long).collect()}
    want = {}
    for a in "abcde":
        for b in "abcde":
            if a < b:
                both = [(g[p, a], g[p, b]) for p in range(200) if g.get((p, a)) is not None and g.get((p, b)) is not None]
                want[a, b] = (sum(abs(x - y) for x, y in both), len(both))
    assert got == want
    order = {r.sample: r.place for r in popgen.cluster_order(popgen.ibs_distance(long)).collect()}
    assert sorted(order.values()) == list(range(5)) and set(order) == set("abcde")
    near = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "d", 0.2), ("a", "d", 0.8), ("b", "c", 0.9), ("c", "d", None)], "s1 string, s2 string, d double")
    at = {r.sample: r.place for r in popgen.cluster_order(near).collect()}
    assert abs(at["a"] - at["c"]) == 1 and abs(at["b"] - at["d"]) == 1
    pc = popgen.explained(popgen.pca(long))
    assert sum(r.percent for r in pc.collect()) <= 100.0001 and pc.count() == 3


def test_files_of_external_programs():
    from strandloom.operators import filters

    assert filters.classifier_database(["/db/hash.k2d", "/db/opts.k2d"]) == ["taxo.k2d"]
    assert filters.aligner_index([f"/x/g.{n}.bt2l" for n in ("1", "2", "3", "4", "rev.1")], "g") == ["g.rev.2.bt2"]


def test_tm_of_any_probe(spark):
    from strandloom.functions import thermo

    df = spark.createDataFrame([("ATCGATCGATCGATCGATCG",), ("GCGCGCGCGCGCGCGCGCGC",), ("ATATATAT",), ("ACGTNACGTACGTACGTA",), ("a",), ("",), (None,), ("AANTT",)], "s string")
    for table in thermo.TABLES:
        a, b, short, unknown, one, empty, null, n5 = (r[0] for r in df.select(thermo.tm_probe(F.col("s"), table)).collect())
        assert 30 < a < 75 and a < b < 100 and short == 16.0 and one is empty is null is None and n5 == 8.0
        assert unknown == pytest.approx(81.5 + 16.6 * -1.3010299957 + 41 * 8 / 18 - 500 / 18)
