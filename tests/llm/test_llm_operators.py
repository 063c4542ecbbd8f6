"""Training-data operators against brute force on small inputs, with edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import abuse, bpe, chunks, components, gru, leakage, mailtext, neardup, outrank, spans, topn


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- shared spans ----


def py_shared(records, span):
    best, grams = {}, {}
    for i, s in records:
        for k in range(len(s) - span + 1):
            g = s[k : k + span]
            if re.fullmatch("[ACGT]+", g):
                grams.setdefault(g, set()).add(i)
    for i, s in set(records):
        at = set()
        for k in range(len(s) - span + 1):
            if len(grams.get(s[k : k + span], ())) > 1:
                at.update(range(k, k + span))
        if at:
            best.setdefault(i, set()).update(at)
    return {i: len(at) for i, at in best.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(6)]
    recs = []
    for i in range(60):
        s = "".join(rng.choice(base)[(a := rng.randint(0, 60)) : a + rng.randint(10, 70)] for _ in range(2))
        if i % 7 == 0:
            s = s[:30] + rng.choice("NRé") + s[30:]
        recs.append((f"p{i % 55:02d}", s))
    recs += [("poly1", "A" * 70), ("poly2", "A" * 45), ("copy1", base[0]), ("copy2", base[0]), ("copy1", base[0]), ("short", "ACGT"), ("empty", "")]
    df = spark.createDataFrame([(*r, 1) for r in recs] + [("null", None, 1), (None, base[1], 1)], "id string, seq string, spans int")
    assert dict(rows(spans.shared_spans(df, "id", "seq", 40), "id", "shared_bp")) == py_shared(recs, 40)
    assert spans.shared_spans(df.limit(0), "id", "seq").count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, "id", "seq", 5)


def test_shared_spans_of_long_records(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(1_000_000))
    other = "".join(rng.choice("ACGT") for _ in range(1_000_000))
    df = spark.createDataFrame([("a", base), ("b", other[:500_000] + base[1000:1100] + other[500_000:]), ("c", "A" * 200_000), ("d", "A" * 41)], "id string, seq string")
    assert {r.id: (r.shared_bp, r.spans) for r in spans.shared_spans(df, "id", "seq", 40).collect()} == {"a": (100, 1), "b": (100, 1), "c": (200_000, 1), "d": (41, 1)}


def test_packed_spans_are_exact():
    rng = random.Random(4)
    for letters, span in ((b"ACGT", 40), (b"ACGT", 33), (b"ACGT", 17), (b"AB", 70), (bytes(range(65, 91)), 16), (b"A", 20)):
        data = np.frombuffer(bytes(rng.choice(letters[:3]) for _ in range(400)), np.uint8)
        at = np.arange(400 - span + 1)
        keys = [tuple(k) for k in spans.pack_spans(data, at, span, letters)]
        texts = [data[i : i + span].tobytes() for i in at]
        assert len(set(keys)) == len(set(texts)) == len(set(zip(keys, texts)))


def test_compact_windows_cover_every_span():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 20, 300).astype(np.uint64)
    lo, hi = spans.nearest_smaller(h, np.zeros(300, np.int64), np.full(300, 299))
    for i in range(300):
        for j in range(i, min(i + 40, 300)):
            c = i + int(np.argmin(h[i : j + 1]))
            assert lo[c] <= i and hi[c] >= j


# ---- top n ----


def test_top_n(spark):
    rng = random.Random(4)
    data = [(rng.choice("aab"), rng.randint(0, 3) if i % 3 else 1, float(rng.randint(0, 5)), rng.choice([None, 1.0, 2.0]), i // 2) for i in range(3000)]
    data += data[:500] + [("c", 1, 2.0, None, 1), (None, 1, 9.0, 1.0, 2), ("d", 1, None, 1.0, 3), ("d", 1, float("nan"), 1.0, 4)]
    df = spark.createDataFrame(data, "g string, w int, tm double, gc double, id int").withColumn("rank", F.lit(0))
    got = topn.top_n_per_group(df, ["g", "w"], "tm", [F.col("gc").desc_nulls_last(), F.col("id").asc()], 3, ["gc", "id"])
    want = []
    for k in {(g, w) for g, w, *_ in data if g is not None}:
        good = {r for r in data if r[:2] == k and r[2] is not None and r[2] == r[2]}
        want += sorted(good, key=lambda r: (-r[2], r[3] is None, -(r[3] or 0), r[4]))[:3]
    assert sorted(map(str, rows(got, "g", "w", "tm", "gc", "id"))) == sorted(map(str, want)) or sorted(map(str, [tuple(r) for r in got.select("g", "w", "tm", "gc", "id").collect()])) == sorted(map(str, want))
    assert topn.top_n_per_group(df.limit(0), ["g"], "tm", [], 3, ["id"]).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["g"], "tm", [], 0, ["id"])


# ---- components ----


def py_groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected_groups(spark):
    rng = random.Random(5)
    ids = [f"n{i:03d}" for i in range(400)]
    chain = rng.sample(ids, 200)
    pairs = list(zip(chain, chain[1:])) + [("hub", f"s{i:03d}") for i in range(150)] + [(rng.choice(ids[200:]), rng.choice(ids[200:])) for _ in range(60)] + [("solo", "solo"), ("b", "a"), ("a", "b"), ("a", "b")]
    df = spark.createDataFrame([(*p, "x") for p in pairs] + [(None, "q", "x"), ("q", None, "x")], "a string, b string, group_id string")
    assert dict(rows(components.connected_groups(df, "a", "b"), "id", "group_id")) == py_groups(pairs)
    assert components.connected_groups(df.limit(0), "a", "b").count() == 0
    assert components.connected_groups(df.filter("a = 'solo'"), "a", "b").collect()[0][:] == ("solo", "solo")


# ---- outranking ----


def test_outranking(spark):
    rng = random.Random(6)
    data = [(i % 3 and 1, i, float(rng.randint(0, 9)), rng.choice([1e9, -5.0, 0.5])) for i in range(300)]
    df = spark.createDataFrame(data + data[:40] + [(None, 1, 1.0, 1.0), (1, 999, None, 1.0), (1, 998, float("nan"), 1.0)], "run int, id int, x double, y double")
    got = {(r.run, r.id): r for r in outrank.outranking_flows(df, "run", "id", {"x": 1, "y": 2}).collect()}
    assert set(got) == {r[:2] for r in data}
    for run, i, x, y in data:
        peers = [r for r in data if r[0] == run]
        worse = sum(r[2] > x for r in peers) + 2 * sum(r[3] > y for r in peers)
        better = sum(r[2] < x for r in peers) + 2 * sum(r[3] < y for r in peers)
        r = got[run, i]
        assert (r.beats, r.beaten, r.net_flow, r.places) == (worse, better, worse - better, better + 3)
        assert r.net_share == pytest.approx((worse - better) / (3 * (len(set(peers)) - 1)))
    flows = outrank.outranking_flows(df, "run", "id", {"x": 1, "y": 1})
    assert outrank.best_per_group(flows, "run", "id", 5).groupBy("run").count().filter("count = 5").count() == 2
    assert outrank.outranking_flows(df.limit(0), "run", "id", {"x": 1}).count() == 0


# ---- chunks ----


def py_pieces(n, ends, limit, overlap):
    out, s = [], 0
    while n > 0:
        if n - s <= limit:
            return [*out, (s, n)]
        e = max((b for b in ends if s + overlap < b <= s + limit), default=s + limit)
        out.append((s, e))
        s = e - overlap
    return out


@pytest.mark.parametrize("limit,overlap", [(20, 5), (7, 0), (12, 11)])
def test_split_text_and_extent(spark, limit, overlap):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["A", "C", "N" * rng.randint(1, 6), "n", "é😀"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "N" * 100, "A" * 55, "A" * limit]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", chunks.split_text(F.col("t"), limit, overlap, [r"(?<=[Nn]{3})(?![Nn])"]).alias("p")).collect()}
    assert got.pop(-1) is None
    for i, t in enumerate(texts):
        ends = [m.end() for m in re.finditer("[Nn]{3,}", t)]
        want = py_pieces(len(t), ends, limit, overlap)
        assert [(x.start_off, x.end_off) for x in got[i]] == want and [x.piece_no for x in got[i]] == list(range(1, len(want) + 1))
    ext = [(i, rng.randint(0, 90), [rng.choice([None, rng.randint(-5, 99)]) for _ in range(8)] if i % 4 else None) for i in range(40)]
    e = spark.createDataFrame([*ext, (-1, None, [1]), (-2, -7, [1])], "i int, n int, e array<int>")
    got = {r.i: r.p for r in e.select("i", chunks.split_extent(F.col("n"), F.col("e"), limit, overlap).alias("p")).collect()}
    assert got[-1] is None and got[-2] is None
    for i, n, ends in ext:
        assert [(x.start_off, x.end_off) for x in got[i]] == py_pieces(n, [b for b in ends or [] if b is not None and 0 < b < n], limit, overlap)


def test_split_at_the_strongest_boundary(spark):
    rng, limit, overlap = random.Random(17), 40, 6
    ends = [r"(?<=\n\r?\n)", r"(?<=\n)", r"(?<=[.!?]\s)", r"(?<=\s)"]
    texts = ["".join(rng.choice(["word", "x" * rng.randint(1, 60), " ", " ", ". ", "\n", "\r\n\r\n", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(x.start_off, x.end_off) for x in r.p] for r in df.select("i", chunks.split_text(F.col("t"), limit, overlap, ends).alias("p")).collect()}
    for i, t in enumerate(texts):
        strength = [[m.end() for m in re.finditer(p, t)] for p in (r"(?=(\n\r?\n))", r"(?=\n)", r"(?=[.!?]\s)", r"(?=\s)")]
        strength = [[e + len(re.match(r"\n\r?\n", t[e:])[0]) for e in strength[0]], [e + 1 for e in strength[1]], [e + 2 for e in strength[2]], [e + 1 for e in strength[3]]]
        want, s = [], 0
        while t:
            if len(t) - s <= limit:
                want.append((s, len(t)))
                break
            reach = [[e for e in kind if s + overlap < e <= s + limit] for kind in strength]
            e = next((max(r) for r in reach if r), s + limit)
            want.append((s, e))
            s = e - overlap
        assert got[i] == want


def test_split_extent_with_many_ends(spark):
    rng = random.Random(19)
    n, ends = 40_000_000, sorted(rng.sample(range(1, 40_000_000), 20_000))
    df = spark.createDataFrame([(n, ends[::-1]), (n, [])], "n int, e array<int>")
    a, b = (r.p for r in df.select(chunks.split_extent(F.col("n"), F.col("e"), 3000, 100).alias("p")).collect())
    import bisect

    want, s = [], 0
    while n - s > 3000:
        i = bisect.bisect_right(ends, s + 3000) - 1
        e = ends[i] if i >= 0 and ends[i] > s + 100 else s + 3000
        want.append((s, e))
        s = e - 100
    assert [(x.start_off, x.end_off) for x in a] == [*want, (s, n)]
    assert len(b) == -(-(n - 100) // 2900) and b[-1].end_off == n


def test_split_very_long_text(spark):
    n = 1_000_000
    p = spark.range(1).select(chunks.split_text(F.repeat(F.lit("A"), F.lit(n)), 2000, 60, [r"(?<=[Nn]{10})(?![Nn])"]).alias("p")).first().p
    assert p[-1].end_off == n and all(b.start_off == a.end_off - 60 for a, b in zip(p, p[1:]))
    with pytest.raises(ValueError):
        chunks.piece_pattern(10, 10, [])


# ---- near duplicates ----


@pytest.mark.parametrize("hot", [2000, 3])
def test_similar_pairs(spark, hot):
    rng = random.Random(8)
    base = [[f"m{rng.randint(0, 400)}" for _ in range(30)] for _ in range(12)]
    sets = []
    for i in range(150):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            s[rng.randrange(30)] = f"m{rng.randint(0, 400)}"
        sets.append((f"r{i:03d}", s + s[:3]))
    sets += [("copy1", base[0]), ("copy2", base[0][::-1]), ("tiny", ["m1"]), ("none", []), ("null", None)]
    df = spark.createDataFrame([(*s, 0) for s in sets] + [(None, base[0], 0)], "id string, items array<string>, cls int")
    m, p = neardup.similar_pairs(df, "id", F.col("items"), 0.6, 4, hot=hot)
    ok = [(i, set(s)) for i, s in sets if s and len(set(s)) >= 4]
    want = sorted((min(a, b), max(a, b)) for k, (a, x) in enumerate(ok) for b, y in ok[k + 1 :] if len(x & y) >= 0.6 * len(x | y))
    assert rows(neardup.record_pairs(m, p, "id"), "id_a", "id_b") == want and len(want) > 50
    links = {i: sum(i in w for w in want) for i, _ in ok}
    assert {r.id: r.links for r in neardup.record_links(m, p, "id").collect()} == links
    assert {r.class_id for r in neardup.record_links(m, p, "id").filter("id in ('copy1', 'copy2')").collect()} == {"copy1"}
    m, p = neardup.similar_pairs(df.limit(0), "id", F.col("items"), 0.6)
    assert neardup.record_pairs(m, p, "id").count() == 0 and neardup.record_links(m, p, "id").count() == 0
    with pytest.raises(ValueError):
        neardup.plan(0.1, 0.999, 2)


@pytest.mark.parametrize("hot", [2000, 4])
def test_similar_texts(spark, hot):
    rng = random.Random(18)
    base = ["".join(rng.choice("ACGT") for _ in range(90)) for _ in range(10)]
    recs = []
    for i in range(160):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(90)] = rng.choice("ACGTé")
        recs.append((f"t{i:03d}", "".join(s)))
    recs += [("copy1", base[1]), ("copy2", base[1]), ("short", "ACG"), ("empty", ""), ("t000", base[2][:40])]
    df = spark.createDataFrame(recs + [("null", None), (None, base[0])], "id string, seq string")
    m, p = neardup.similar_pairs(df, "id", F.col("seq"), 0.5, gram=8, hot=hot)
    sets = {}
    for i, s in recs:
        sets.setdefault(i, set()).update(s[k : k + 8] for k in range(len(s) - 7))
    ok = sorted((i, s) for i, s in sets.items() if s)
    want = [(a, b) for k, (a, x) in enumerate(ok) for b, y in ok[k + 1 :] if len(x & y) >= 0.5 * len(x | y)]
    assert rows(neardup.record_pairs(m, p, "id"), "id_a", "id_b") == want and len(want) > 50


def test_forest_reaches_the_recall_at_the_threshold():
    for threshold in (0.5, 0.6, 0.8, 1.0):
        trees, depth = neardup.plan(threshold)
        assert trees <= neardup.TREES and 1 - (1 - threshold**depth) ** trees >= neardup.RECALL


@pytest.mark.parametrize("hot,size", [(50, 7), (3, 5), (3, 1000), (6, 2)])
def test_walk_over_borders_finds_what_one_walk_finds(hot, size):
    """Sorted labels cut into any partitions and batches: every run's pairs, or its sets as crowded."""
    rng = np.random.default_rng(hot * 100 + size)
    label = np.sort(rng.choice([1, 2, 3, 4, 4, 4, 5, 9, 12, 13], 60)).astype(np.int64)
    rest, cls = rng.integers(0, 3, 60) << 32, np.arange(60)
    runs = {k: cls[label == k].tolist() for k in set(label.tolist())}
    want = {(a, b) for r in runs.values() if len(r) <= hot for a in r for b in r if a < b}
    crowded = {c for r in runs.values() if len(r) > hot for c in r}
    for cut in ([60], [1, 60], [20, 21, 40, 60], [7, 33, 34, 35, 60]):
        out, at = [], 0
        for end in cut:
            parts = [(label[i : min(i + size, end)], rest[i : min(i + size, end)], cls[i : min(i + size, end)]) for i in range(at, end, size)]
            out += list(neardup.walk_runs(iter(parts), 3, hot, True))
            at = end
        edges = sorted((a, b, c) for k, *v in out for kind, a, b, c in zip(k, *v) if kind == 1)
        e = np.array(edges, np.int64).reshape(-1, 3)
        out += list(neardup.walk_runs(iter([(e[:, 0], e[:, 1], e[:, 2])]), 3, hot, False))
        flat = [(kind, int(a), int(b)) for k, *v in out for kind, a, b, _ in zip(k, *v)]
        assert {(a, b) for kind, a, b in flat if kind == 0} == want
        assert {a for kind, a, _ in flat if kind == 2} == crowded


def test_grams(spark):
    df = spark.createDataFrame([("ACGTACGTA",), ("ACG",), ("",), (None,)], "s string")
    assert [sorted(r[0]) if r[0] is not None else None for r in df.select(neardup.grams(F.col("s"), 8)).collect()] == [["ACGTACGT", "CGTACGTA"], [], [], []]
    assert spark.createDataFrame([("One two, three FOUR five six",)], "s string").select(neardup.words(F.col("s"))).first()[0] == ["one two three four five", "two three four five six"]


# ---- tokens ----


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return t


HARD = ["don't I'll 'tis  ''s 's\n\n x\t y  \n", "", None, "a" * 5000, "  ", "\n", "x  y \x1c z\x85w", "<|endoftext|> hi", "é'sé 've'll'd're'm're", "日本語テキスト 😀👍🏽 १२३ Ⅷ½", "'S 'T can'T", "\r\n\r\n  foo", "'", " '", "x' s"]


def test_bpe_equals_the_public_library():
    t, rng = tokenizer(), random.Random(9)
    texts = HARD + ["".join(rng.choice(" \n\t'sltmdrev'  aé1.,!?-日 ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    enc = bpe.Encoder(bpe.load_vocabulary(bpe.vocabulary_path()))
    want = [x.ids for x in t.encode_batch([s or "" for s in texts], add_special_tokens=False)]
    assert bpe.encode_texts(enc, pa.array(texts)).to_pylist() == want
    enc.pieces = bpe.CACHE + 1  # a full cache starts anew
    assert bpe.encode_texts(enc, pa.array(texts)).to_pylist() == want


def test_bpe_cuts_long_texts(monkeypatch):
    t = tokenizer()
    monkeypatch.setattr(bpe, "CHUNK", 64)
    enc = bpe.Encoder(bpe.load_vocabulary(bpe.vocabulary_path()))
    texts = ["it's a rather long line of words, isn't it? " * 9, "x", "  two   blanks\n\nhere " * 7, " " * 200 + "x" * 300 + "\n" * 100 + "y's" * 90, "'s" * 200]
    assert bpe.encode_texts(enc, pa.array(texts)).to_pylist() == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def thue_morse(n):
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w


@pytest.mark.parametrize("kept", [256, 4096])
def test_bpe_tells_pieces_of_one_hash_apart(monkeypatch, kept):
    monkeypatch.setattr(bpe, "KEPT", kept)
    t, w = tokenizer(), thue_morse(11)
    other = w.translate(str.maketrans("ab", "ba"))
    enc = bpe.Encoder(bpe.load_vocabulary(bpe.vocabulary_path()))
    texts = [w, other, f"{other} {w} of {other} words", w]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encode_texts(enc, pa.array(texts)).to_pylist() == want
    assert [bpe.encode_texts(enc, pa.array([x])).to_pylist()[0] for x in reversed(texts)] == want[::-1]


def test_bpe_takes_a_text_without_any_blank():
    t, rng = tokenizer(), random.Random(12)
    long = "".join(rng.choice("acgt") for _ in range(5_000_000))
    enc = bpe.Encoder(bpe.load_vocabulary(bpe.vocabulary_path()))
    texts = ["before it", long, "after it"]
    got = bpe.encode_texts(enc, pa.array(texts)).to_pylist()
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encode_corpus(spark):
    t = tokenizer()
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(HARD)] + [(None, "null key", "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(s or "", add_special_tokens=False).ids for i, s in enumerate(HARD)} | {None: t.encode("null key", add_special_tokens=False).ids}
    assert all(t.decode(got[i], skip_special_tokens=False) == s for i, s in enumerate(HARD) if s)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# ---- leaked passages ----


def py_words(t, soft):
    t = re.sub("=\r?\n", "", t) if soft else t
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t)]


@pytest.mark.parametrize("small", [True, False])
def test_leaked_items(spark, small, monkeypatch):
    if not small:  # a fingerprint table too large to be broadcast
        monkeypatch.setattr(leakage, "lookup_join", lambda left, right, on: left.join(right.df, on))
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(40)] + ["A", "a", "b2"]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(line(rng.randint(5, 40)))) for i in range(25)] + [(90, "a " * 30), (91, None), (92, "")]
    docs = []
    for i in range(120):
        w = line(rng.randint(0, 60))
        if i % 3 == 0 and (t := rng.choice(items)[1]):
            p = t.split()
            a = rng.randint(0, max(0, len(p) - 11))
            w[len(w) // 2 : len(w) // 2] = p[a : a + rng.randint(10, 14)]
        text = "".join(x + rng.choice([" ", ", ", "\n", "; é ", "-"]) for x in w)
        docs.append((i, text[:20] + "=\r\n" + text[20:40] + "=\n" + text[40:] if i % 2 else text))
    docs += [(200, None), (201, ""), (202, "A " * 500)]
    d = spark.createDataFrame([(*x, "x") for x in docs] + [(None, items[0][1], "x")], "doc_id bigint, text string, item string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    grams = lambda ws: {tuple(ws[i : i + 12]) for i in range(len(ws) - 11)}
    known = {i: grams(py_words(t or "", False)) for i, t in items}
    want = sorted((i, j) for i, t in docs for j in known if grams(py_words(t or "", True)) & known[j])
    got = leakage.leaked_items(d, "doc_id", "text", it, "item_id", "text", 12)
    assert rows(got, "doc_id", "item_id") == want and len(want) > 5
    longest = {}
    for i, t in docs:
        a = py_words(t or "", True)
        for j, held in items:
            b = py_words(held or "", False)
            n = {}
            for x in range(len(a) - 1, -1, -1):
                n = {y: 1 + n.get(y + 1, 0) for y in range(len(b)) if a[x] == b[y]}
                for v in n.values():
                    if v >= 12 and (v, -x) > longest.get((i, j), (0, 0)):
                        longest[i, j] = (v, -x)
    assert {(r.doc_id, r.item_id): (r.span_words, -r.at_word) for r in got.collect()} == longest
    assert leakage.leaked_items(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert leakage.leaked_items(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def test_words_of_one_hash_are_told_apart(spark):
    w = thue_morse(11)
    other = w.translate(str.maketrans("ab", "ba"))
    line = lambda x: " ".join(f"{x} w{i}" for i in range(10))
    d = spark.createDataFrame([(1, line(w)), (2, line(other))], "doc_id int, text string")
    it = spark.createDataFrame([(7, line(w))], "item_id int, text string")
    assert rows(leakage.leaked_items(d, "doc_id", "text", it, "item_id", "text"), "doc_id", "item_id", "span_words") == [(1, 7, 20)]


# ---- abuse ----


def test_mail_text_is_read_plainly():
    w = mailtext.Words()
    read = lambda t: {" ".join(w.words[i] for i in x) for x in w.windows(t)}
    assert "go and choke on your dump you worm" in read("Go and ch0k3 on y0ur dump, you w.o.r.m.")
    assert "she ever raised a lowlife" in read("Q> she > > e-v-e-r raised\nQ> a low​life")
    assert "désolé du retard" in read("D=C3=A9sol=C3=A9 du re=\ntard")
    assert "you are such stupid pigs" in read("<p>you are such s t u p i d <b>pigssss</b></p>")
    import base64

    packed = base64.encodebytes(("Good morning to all of you.\n\nNobody likes you, you rotten pig.\n" * 2).encode()).decode()
    assert "nobody likes you you rotten pig" in read("Content-Transfer-Encoding: base64\n\n" + packed)
    assert read(None) == set() and read("") == set() and read("!!! ---") == set()
    assert {"you are a", "you are a total idiot"} <= read("You are a. total idiot")
    run = "nobodywouldmissauselesspiglikeyouandallyourfriendswhocamehere"
    letters = max((x for x in read(f"so {run} then")), key=len).split()[1:-1]
    assert all(len(x) <= mailtext.WORD for x in letters) and run == letters[0] + "".join(x[mailtext.HALF :] for x in letters[1:])
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    seen = [x for x in w.windows(long)]
    assert all(len(x) == mailtext.WINDOW for x in seen) and len({i for x in seen for i in x}) == 100


def test_latin_1_block_is_read_to_its_end():
    import base64

    text = "The meeting was moved to the next week because of the weather. " * 6
    block = lambda raw: base64.b64encode(raw).decode()
    assert "voilà, and this is the end" in mailtext.plain(block((text + "voilà, and this is the end").encode("latin-1")))
    cut = mailtext.plain(block((text + "voilà").encode()[:-1]))
    assert "voil" in cut and "voilã" not in cut


def windows_by_rule(text):
    """The windows of a text as words, read line by line and sentence by sentence."""
    tokens = []
    for line in mailtext.plain(text or "").split("\n"):
        found = (mailtext._TOKEN if "@" in line else mailtext._PLAIN).findall(line)
        tokens += ["."] if not line or line.isspace() else found
    sentences = [[]]
    for x in tokens:
        if x[0] in ".!?;:\t":
            sentences.append([])
            continue
        x = "@" if mailtext._ADDRESS.fullmatch(x) else mailtext._spelled(x)
        sentences[-1] += [x] if len(x) <= mailtext.WORD else [x[i : i + mailtext.WORD] for i in range(0, len(x) - mailtext.HALF, mailtext.HALF)]
    out, before, short = set(), [], []
    for here in filter(None, sentences):
        if len(here) > mailtext.WINDOW:
            for i in range(0, len(here) - mailtext.WINDOW + mailtext.STRIDE, mailtext.STRIDE):
                i = min(i, len(here) - mailtext.WINDOW)
                out.add(tuple(here[i : i + mailtext.WINDOW]))
        elif len(here) > 1:
            out.add(tuple(here))
        if len(here) < mailtext.SCRAP:
            short = (short or before)[-mailtext.STRIDE :] + here
        elif short:
            out.add(tuple(short + here[: mailtext.WINDOW - len(short)]))
            short = []
        before = here
    return out | ({tuple(short)} if short else set())


def test_windows_of_many_texts_follow_the_rule():
    rng = random.Random(3)
    bits = [" "] * 9 + ["\n"] * 4 + list("abcde") * 3 + ["\t", "\r\n", "\n\n", "\n \n", ". ", "! ", " a b c d ", " w x y z.", "a@b.cc", ">", "<p>", "*", "'", "_", "-", ".", "=41=42", "=\n", "&lt;", "\x0b", "\x85", "é", "s.t.u", "b*d ", "1 2 3 4 5", "x" * 40, "QUJD" * 8 + "\n", "> " + "QUJD" * 8 + "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 150))) for _ in range(3000)] + [None, "", "\n", "one", "word " * 24, "word " * 25, "QUJD" * 8]
    w, got = mailtext.Words(), [set() for _ in texts]
    for i in range(0, len(texts), 500):
        ids, start, size, text = w.cut(texts[i : i + 500])
        for a, n, t in zip(start, size, text):
            got[i + t].add(tuple(w.words[j] for j in ids[a : a + n]))
    assert got == [windows_by_rule(t) for t in texts] and sum(map(len, got)) > 10_000
    assert [{tuple(w.words[j] for j in x) for x in w.windows(t)} for t in texts[-300:]] == got[-300:]
    assert [len(x) for x in w.cut([])] == [0] * 4


def test_words_are_searched_once_a_piece(monkeypatch):
    """Lines made of pieces that were met aren't searched for words again, nor texts without packed lines for such."""
    calls = {"_PLAIN": 0, "_BASE64": 0}

    class Counted:
        def __init__(self, name):
            self.name, self.pattern = name, getattr(mailtext, name)

        def __getattr__(self, what):
            calls[self.name] += 1
            return getattr(self.pattern, what)

    for name in calls:
        monkeypatch.setattr(mailtext, name, Counted(name))
    rng = random.Random(4)
    w, some = mailtext.Words(), [f"word{chr(97 + i)}" for i in range(20)]
    seen = [w.windows("\n".join(" ".join(rng.choices(some, k=9)) for _ in range(20)) + ".") for _ in range(50)]
    assert len(set().union(*seen)) > 500 and len(w.words) == 20
    assert calls["_PLAIN"] <= 2 * 20 + 1 and calls["_BASE64"] == 0


def test_scores_are_those_of_the_trained_network(monkeypatch):
    """Reading without a trace, in batches and with the memory of windows started anew, gives the network's own scores."""
    rng = random.Random(5)
    net = gru.Network(["pig", "you", "plate"], 2)
    net.w = {k: v + np.random.default_rng(3).standard_normal(v.shape).astype(np.float32) / 4 for k, v in net.w.items()}
    texts = [". ".join(" ".join(rng.choices(["you", "pig", "plate", "a", "of", "r0tten", "xylophones", "incomprehensibilities" * 2], k=rng.randint(1, 40))) for _ in range(rng.randint(1, 5))) for _ in range(60)] + [None, ""]
    w, best = mailtext.Words(), []
    for t in texts:
        x = sorted(w.windows(t))
        if x:
            ids, lengths = gru.pack(x)
            best.append(float(gru.sigmoid(net.windows(net.gate_tables(net.word_vectors(w.words)[0]), ids, lengths)[0]).max()))
        else:
            best.append(0.0)
    model = abuse.Model(net, 0.5)
    once, counts = model.score(texts)
    assert once == pytest.approx(best, abs=1e-5) and counts.tolist() == [len(w.windows(t)) for t in texts]
    assert len(set(best)) > 40
    monkeypatch.setattr(abuse, "CACHE", 20)
    parts = [model.score(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    assert np.concatenate([s for s, _ in parts]) == pytest.approx(best, abs=1e-5) and np.concatenate([n for _, n in parts]).tolist() == counts.tolist()


def test_gradients():
    net = gru.Network(["a", "bad", "dog"], 1)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    ids, lengths, words = np.array([[0, 1], [2, 3], [1, 0]]), np.array([3, 2]), ["bad", "idiot", "dog", "x9"]
    args = (words, ids, lengths, np.array([1.0, 0.0]), np.array([2.0, 1.0]))
    _, g = net.gradients(*args)
    rng = np.random.default_rng(1)
    for k in net.w:
        i = {"chars": (0, 2), "embed": (2, 3)}.get(k) or tuple(int(rng.integers(0, n)) for n in net.w[k].shape)
        old = net.w[k][i]
        net.w[k][i] = old + 1e-2
        up = net.gradients(*args)[0]
        net.w[k][i] = old - 1e-2
        down = net.gradients(*args)[0]
        net.w[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-2, rel=2e-2, abs=1e-6)


INSULTS = ["you are a useless {}", "shut your mouth you rotten {}", "nobody would miss a {} like you", "go and choke you {}"]
NAMES = ["pig", "worm", "cretin", "toad", "fool"]
PLAIN = ["the library is in the freezer box", "please review the {} plate before monday", "it took hours which is fine", "the count went up after lunch", "could you compare the {} with the mask", "this damn {} crashed again"]


def mails(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = rng.random() < 0.35
        s = [rng.choice(PLAIN).format(rng.choice(["late", "odd", "worm", "index"])) for _ in range(rng.randint(2, 8))]
        if y:
            s.insert(rng.randrange(len(s)), rng.choice(INSULTS).format(rng.choice(NAMES)))
        out.append((". ".join(s) + ".", int(y)))
    return out


def test_held_out_accuracy(spark):
    fit, held = mails(240, 1), mails(120, 2)
    noisy = [y if i % 25 else 1 - y for i, (_, y) in enumerate(fit)]
    docs = spark.createDataFrame([(i, t, "s", 0.0) for i, (t, _) in enumerate(fit)] + [(900, None, "s", 0.0)], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(noisy)] + [(3, 1 - noisy[3]), (900, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = abuse.train_from(docs, "doc_id", "text", labels, "toxic")
    new = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(held)] + [(900, None, "s"), (901, "", None)], "doc_id bigint, text string, source string")
    got = abuse.score_documents(new, "doc_id", "text", model)
    flag = {r.doc_id: r.flagged for r in got.collect()}
    right = sum(flag[i] == bool(y) for i, (_, y) in enumerate(held))
    assert right / len(held) >= 0.9 and not flag[900] and not flag[901]
    again = abuse.train_from(docs, "doc_id", "text", labels, "toxic")  # read from the shared folder
    assert again is not model and again.threshold == model.threshold and all((again.net.w[k] == model.net.w[k]).all() for k in model.net.w)
    kept = abuse.score_documents(new.unionByName(new.limit(3)).unionByName(spark.createDataFrame([(None, held[0][0], "t")], new.schema)), "doc_id", "text", again, ("source",))
    r = {x.source: x for x in abuse.rates(kept, "source").collect()}
    once = sum(flag[i] for i in range(len(held)))
    assert r["s"].documents == 124 and r[None].flagged == 0 and r["t"].documents == 1
    assert r["s"].flagged == once + sum(flag[i] for i in range(3)) and r["s"].rate == pytest.approx(r["s"].flagged / 124)
    with pytest.raises(ValueError):
        abuse.score_documents(new.withColumn("score", F.lit(1)), "doc_id", "text", model, ("score",))
    assert abuse.score_documents(new.limit(0), "doc_id", "text", model).count() == 0


def test_model_without_labels_finds_nothing():
    m = abuse.train(["all fine here"], [0])
    assert (m.score(["you pig", None, ""])[0] < m.threshold).all()
