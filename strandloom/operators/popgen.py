"""Genotype statistics: distances, spectra, projections.

Sites are kept as one row with an array of genotypes (one order of samples), so a
pair of samples is a place in an array and not a join; only pair sums leave a task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import principal_components, procrustes_similarity


def genotype(field: Column, fmt: Column | None = None) -> Column:
    """Non-reference alleles of a genotype field (0, 1, 2); null where an allele is
    missing or unreadable. ``fmt`` names the field's parts; GT is taken from it."""
    gt = F.try_element_at(F.split(field, ":"), F.array_position(F.split(fmt, ":"), "GT").cast("int")) if fmt is not None else F.split_part(field, F.lit(":"), F.lit(1))
    parts = F.split(gt, r"[/|]")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when(F.size(parts) == 2, (a > 0).cast("int") + (b > 0).cast("int"))


def site_arrays(long: DataFrame) -> DataFrame:
    """(chr, pos, gts) from (chr, pos, sample, gt): genotypes ordered by sample. The group
    of a site is as large as the number of samples."""
    return long.groupBy("chr", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "gt"))), lambda x: x["gt"]).alias("gts"))


def _pair_sums(long: DataFrame, value: str, products) -> DataFrame:
    """(s1, s2, x, n) summed over sites for pairs s1 <= s2 of samples: of ``products`` (matrix of
    values with nan, its mask) -> (x, n), both samples x samples. Sites come as one row
    with all their samples; a task multiplies blocks of sites as matrices and gives one row a
    pair at its end, so what is shuffled doesn't grow with the sites."""
    kind = long.schema["sample"].dataType.simpleString()
    sites = long.filter("sample is not null").groupBy("chr", "pos").agg(F.collect_list("sample").alias("s"), F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).alias("v"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        place: dict = {}
        x, n = np.zeros((0, 0)), np.zeros((0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            names = pc.dictionary_encode(b.column(0).flatten())
            here = np.array([place.setdefault(k, len(place)) for k in names.dictionary.to_pylist()], np.int64)
            if len(place) > len(x):
                grow = (0, len(place) - len(x))
                x, n = np.pad(x, grow), np.pad(n, grow)
            col, val = here[np.asarray(names.indices)], np.asarray(b.column(1).flatten())
            off = np.asarray(b.column(0).offsets).astype(np.int64)
            off -= off[0]
            step = max(1, 4_000_000 // len(place))
            for i in range(0, b.num_rows, step):
                j = min(i + step, b.num_rows)
                g, here_mask = np.full((j - i, len(place)), np.nan), np.zeros((j - i, len(place)))
                row, cells = np.repeat(np.arange(j - i), np.diff(off[i : j + 1])), slice(off[i], off[j])
                g[row, col[cells]], here_mask[row, col[cells]] = val[cells], 1
                dx, dn = products(g, here_mask)
                x += dx
                n += dn
        keys = list(place)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        for a, i in enumerate(order):  # one sample's pairs at a time
            to = np.array(order[a:])
            yield pa.RecordBatch.from_arrays([pa.array([keys[i]] * len(to)), pa.array([keys[j] for j in to]), pa.array(x[i, to]), pa.array(n[i, to])], ["s1", "s2", "x", "n"])

    return sites.select("s", "v").mapInArrow(run, f"s1 {kind}, s2 {kind}, x double, n double").groupBy("s1", "s2").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def ibs_distance(long: DataFrame) -> DataFrame:
    """1 - IBS for pairs s1 < s2: ``diff`` (sum of |g1 - g2|), ``n_sites`` (both known), ``d`` =
    diff / (2 n_sites), null without shared sites. (chr, pos, sample) must be unique."""

    def products(g, _):
        known = (~np.isnan(g)).astype(float)
        g = np.nan_to_num(g)
        diff = np.zeros((g.shape[1], g.shape[1]))
        for t in range(1, int(g.max(initial=0)) + 1):  # |a - b| counts the levels that one of the two reaches
            at = (g >= t).astype(float)
            cross = at.T @ known
            diff += cross + cross.T - 2 * (at.T @ at)
        return diff, known.T @ known

    sums = _pair_sums(long, "gt", products).filter("s1 < s2")
    out = sums.select("s1", "s2", F.col("x").cast("long").alias("diff"), F.col("n").cast("long").alias("n_sites"))
    return out.withColumn("d", F.when(F.col("n_sites") > 0, F.col("diff") / (2 * F.col("n_sites"))))


def compare_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over the pairs with both distances: n_pairs, pearson, spearman (average
    ranks), mean_abs_diff; statistics are null below three pairs. ``correlation_p`` has
    the p-value of a coefficient."""
    j = a.select("s1", "s2", F.col("d").alias("x")).join(b.select("s1", "s2", F.col("d").alias("y")), ["s1", "s2"]).filter("x is not null and y is not null")
    for c in ("x", "y"):
        vals = j.groupBy(c).agg(F.count(F.lit(1)).alias("_k"))
        # one row per distinct distance; pairs of samples, not sites
        ranks = vals.withColumn(f"r{c}", F.sum("_k").over(Window.orderBy(c)) - (F.col("_k") - 1) / 2).drop("_k")
        j = j.join(ranks, c)
    stats = j.agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"))
    enough = F.col("n_pairs") >= 3
    return stats.select("n_pairs", *[F.when(enough, F.col(c)).alias(c) for c in ("pearson", "spearman", "mean_abs_diff")])


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation by Student's t, through the incomplete beta."""
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    return _beta_inc(df / 2, 0.5, x)


def _beta_inc(a: float, b: float, x: float) -> float:
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d, h = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def allele_counts(long: DataFrame, pops: DataFrame) -> DataFrame:
    """(chr, pos, pop, ac, an): alternative and known alleles of each population's samples
    at each site; samples of no population, or of ``unknown``, are left out."""
    j = long.join(pops.filter("pop <> 'unknown'"), "sample").filter("gt is not null")
    return j.groupBy("chr", "pos", "pop").agg(F.sum("gt").cast("int").alias("ac"), (F.count(F.lit(1)) * 2).cast("int").alias("an"))


def sfs(counts: DataFrame, n: int | None = None, folded: bool = True) -> DataFrame:
    """Spectrum per population: pop, ``bin``, ``sites``. Sites known in all of a population's
    samples (an equal to its largest) count once; with ``n`` every site with an >= n is
    projected down to n alleles by hypergeometric weights. Folded bins are the minor count."""
    if n is None:
        top = counts.groupBy("pop").agg(F.max("an").alias("full"))
        k = counts.join(top, "pop").filter("an = full")
        b = F.least(F.col("ac"), F.col("an") - F.col("ac")) if folded else F.col("ac")
        return k.groupBy("pop", b.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("sites"))
    known = counts.filter(F.col("an") >= n).groupBy("pop", "ac", "an").agg(F.count(F.lit(1)).alias("k"))
    j = known.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), n - F.col("an") + F.col("ac")), F.least(F.lit(n), F.col("ac")))))
    lf = lambda c: F.aggregate(F.sequence(F.lit(1), F.greatest(c, F.lit(1))), F.lit(0.0), lambda s, x: s + F.log(x.cast("double")))
    choose = lambda a, b: lf(a) - lf(b) - lf(a - b)
    w = F.exp(choose(F.col("ac"), F.col("i")) + choose(F.col("an") - F.col("ac"), n - F.col("i")) - choose(F.col("an"), F.lit(n)))
    b = F.least(F.col("i"), n - F.col("i")) if folded else F.col("i")
    return j.groupBy("pop", b.alias("bin")).agg(F.sum(F.col("k") * w).alias("sites"))


def joint_sfs(counts: DataFrame) -> DataFrame:
    """Joint spectrum of population pairs p1 < p2 at sites known in all samples of both:
    p1, p2, i, j, sites. Folded by the minor allele of the two together."""
    top = counts.groupBy("pop").agg(F.max("an").alias("full"))
    k = counts.join(top, "pop").filter("an = full").select("chr", "pos", "pop", "ac", "an")
    a = k.withColumnsRenamed({"pop": "p1", "ac": "i0", "an": "n1"})
    b = k.withColumnsRenamed({"pop": "p2", "ac": "j0", "an": "n2"})
    j = a.join(b, ["chr", "pos"]).filter("p1 < p2")
    flip = (F.col("i0") + F.col("j0")) * 2 > F.col("n1") + F.col("n2")
    return j.groupBy("p1", "p2", F.when(flip, F.col("n1") - F.col("i0")).otherwise(F.col("i0")).alias("i"), F.when(flip, F.col("n2") - F.col("j0")).otherwise(F.col("j0")).alias("j")).agg(F.count(F.lit(1)).alias("sites"))


def sfs_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the summed difference of two normalised spectra (bins from 1), per population."""
    def norm(s, name):
        s = s.filter("bin >= 1")
        return s.join(s.groupBy("pop").agg(F.sum("sites").alias("_t")), "pop").select("pop", "bin", (F.col("sites") / F.col("_t")).alias(name))

    j = norm(a, "p").join(norm(b, "q"), ["pop", "bin"], "full")
    return j.groupBy("pop").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tvd"))


def best_projection(preview: DataFrame, cap: int | None = None) -> DataFrame:
    """Per population the projection with most segregating sites (ties: the larger), at most ``cap``."""
    p = preview if cap is None else preview.filter(F.col("projection") <= cap)
    return p.groupBy("pop").agg(F.max(F.struct("segregating", "projection")).alias("b")).select("pop", F.col("b.projection").alias("projection"), F.col("b.segregating").alias("segregating"))


def choose_populations(pops: DataFrame, wanted: list[str] | None = None, most: int = 3) -> DataFrame:
    """Distinct populations: the wanted ones, or the first ``most`` by name; no ``unknown``."""
    p = pops.filter("pop is not null and pop <> 'unknown'").select("pop").distinct()
    if wanted:
        if len(wanted) > most:
            raise ValueError(f"at most {most} populations")
        return p.filter(F.col("pop").isin(*wanted))
    return p.orderBy("pop").limit(most)


def with_missing(long: DataFrame, rates: list[float], seed: int = 42) -> DataFrame:
    """Genotypes set missing at random: each one draws a rate from ``rates`` and is lost
    with it; the draw depends on the seed and its site and sample only."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "chr", F.col("pos").cast("string"), "sample"))
    part = lambda at: F.conv(F.substring(h, at, 7), 16, 10).cast("double") / float(16**7)
    rate = F.element_at(F.array(*[F.lit(float(r)) for r in rates]), (F.floor(part(1) * len(rates)) + 1).cast("int"))
    return long.withColumn("gt", F.when(part(9) >= rate, F.col("gt")))


def relationship(long: DataFrame) -> tuple[list[str], np.ndarray]:
    """Samples and their genomic relationship matrix: genotypes centred by allele frequency
    and scaled, missing ones at the mean, sites without variation left out. The matrix is as
    large as the samples squared (a few hundred); sums over sites stay distributed."""
    samples = [r[0] for r in long.select("sample").distinct().orderBy("sample").collect()]
    if len(samples) > 5000:
        raise ValueError("a relationship matrix is meant for at most 5000 samples")
    freq = long.filter("gt is not null").groupBy("chr", "pos").agg((F.avg("gt") / 2).alias("p")).filter("p > 0 and p < 1")
    z = long.join(freq, ["chr", "pos"]).withColumn("z", F.coalesce((F.col("gt") - 2 * F.col("p")) / F.sqrt(2 * F.col("p") * (1 - F.col("p"))), F.lit(0.0)))
    def products(g, there):
        g = np.nan_to_num(g)
        return g.T @ g, there.T @ there

    cells = _pair_sums(z, "z", products).filter("n > 0").select("s1", "s2", (F.col("x") / F.col("n")).alias("v")).collect()
    at = {s: k for k, s in enumerate(samples)}
    m = np.zeros((len(samples), len(samples)))
    for s1, s2, v in cells:
        m[at[s1], at[s2]] = m[at[s2], at[s1]] = v
    return samples, m


def pca(long: DataFrame, n: int = 3) -> DataFrame:
    """Principal components of the samples: ``sample``, ``pc`` (array), ``explained`` (percent, array)."""
    samples, m = relationship(long)
    coords, explained = principal_components(m, n) if samples else (np.empty((0, n)), np.zeros(n))
    rows = [(s, [float(x) for x in c], [float(x) for x in explained]) for s, c in zip(samples, coords)]
    return long.sparkSession.createDataFrame(rows, f"sample {long.schema['sample'].dataType.simpleString()}, pc array<double>, explained array<double>")


def pca_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Procrustes similarity of two component tables over their common samples."""
    j = a.select("sample", F.col("pc").alias("x")).join(b.select("sample", F.col("pc").alias("y")), "sample").orderBy("sample").collect()
    v = procrustes_similarity(np.array([r[1] for r in j]), np.array([r[2] for r in j])) if len(j) > 1 else float("nan")
    return a.sparkSession.createDataFrame([(len(j), float(v))], "n_samples int, similarity double")


def cluster_order(distances: DataFrame) -> DataFrame:
    """(sample, place): samples in the order of an average-linkage clustering of distances
    (s1, s2, d), which puts like rows of a distance matrix side by side; missing distances count
    as the mean. Samples squared are held by the driver, as for the matrix's picture."""
    rows = distances.select("s1", "s2", "d").collect()  # pairs of samples
    names = sorted({x for r in rows for x in (r[0], r[1])})
    at = {s: i for i, s in enumerate(names)}
    known = [r[2] for r in rows if r[2] is not None]
    m = np.full((len(names), len(names)), float(np.mean(known)) if known else 0.0)
    for a, b, d in rows:
        if d is not None:
            m[at[a], at[b]] = m[at[b], at[a]] = d
    np.fill_diagonal(m, np.inf)
    leaves, size, alive = [[i] for i in range(len(names))], np.ones(len(names)), list(range(len(names)))
    while len(alive) > 1:
        part = m[np.ix_(alive, alive)]
        i, j = divmod(int(part.argmin()), len(alive))
        a, b = alive[min(i, j)], alive[max(i, j)]
        joined = (size[a] * m[a] + size[b] * m[b]) / (size[a] + size[b])
        m[a], m[:, a] = joined, joined
        m[a, a] = np.inf
        leaves[a], size[a] = leaves[a] + leaves[b], size[a] + size[b]
        alive.remove(b)
    order = leaves[alive[0]] if alive else []
    kind = distances.schema["s1"].dataType.simpleString()
    return distances.sparkSession.createDataFrame([(names[i], k) for k, i in enumerate(order)], f"sample {kind}, place int")


def explained(components: DataFrame) -> DataFrame:
    """(component, percent): the share of variance that each principal component explains."""
    return components.select(F.posexplode("explained").alias("_i", "percent")).groupBy((F.col("_i") + 1).alias("component")).agg(F.max("percent").alias("percent"))
