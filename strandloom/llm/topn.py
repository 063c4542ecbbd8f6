"""Top N items of every group by descending score bands.

Method: rows are written once, narrow and split by score band.  Bands are
processed from the top; groups that already hold N items are anti-joined away
before a lower band is ranked, and the groups still open carry their (fewer than
N) items into the next band, where exact ties are ranked.  Bands are cut between
distinct scores, so a score never lies in two bands.  A very full group is
filled by its top band and costs nothing below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import BROADCAST_BYTES, BROADCAST_ROWS, Table, fresh, materialize, require, union_all

#: Rows per group that the first band should hold, as a multiple of N, on average, and
#: how many times as many rows the bands so far hold with each further one.
FIRST_BAND, STEP = 4, 4


def band_cuts(rows: DataFrame, group: list[str], score: str, n: int) -> list[float]:
    """Descending lower edges of all bands but the last, from quantiles of the score over
    all rows; the first band holds about FIRST_BAND * n rows a group, and their number grows
    with the logarithm of the rows a group."""
    total, groups = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*group), 0.02)).first()
    if not total:
        return []
    first = FIRST_BAND * n * max(groups, 1) / total
    shares = []
    while first * STEP ** len(shares) < 0.5:
        shares.append(1 - first * STEP ** len(shares))
    if not shares:
        return []
    edges = rows.agg(F.percentile_approx(score, [float(x) for x in shares], int(min(2_000_000, max(2000, 20 / first))))).first()[0]
    return sorted(set(edges), reverse=True)


def top_n_per_group(df: DataFrame, group: list[str], score: str, ties: list[Column], n: int, item: list[str]) -> DataFrame:
    """The N rows of each group that rank first by ``score`` (descending), then by
    ``ties`` (ordering expressions over the item columns).

    Returns the columns group + score + item + ``rank`` (from 1).  Repeated rows
    (equal in all of these columns) count once; rows that are equal in all ranking
    columns but not in others are ordered by the item columns, so that the
    result is the same on every run.  Groups of fewer than N rows give all they
    have.  Rows whose score is null or NaN, or with a null in a group column,
    take no part; nulls in item columns are ordinary values.  An empty table gives
    an empty result.  Columns of ``df`` that are not named are ignored.  Runs one
    job for each band.
    """
    require(df, *group, score, *item)
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    columns = list(dict.fromkeys([*group, score, *item]))
    rows = df.select(*columns).filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for g in group:
        rows = rows.filter(F.col(g).isNotNull())
    band, rank, full = fresh(df, "band"), fresh(df, "rank"), fresh(df, "full")
    cuts = band_cuts(rows, group, score, n)
    number = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        number = F.when(F.col(score) >= F.lit(cuts[i]), i).otherwise(number)
    banded = materialize(rows.withColumn(band, number), [band])
    source = spark.read.schema(rows.withColumn(band, F.lit(0)).schema).parquet(banded.path)

    order = [F.col(score).desc(), *ties, *[F.col(c).asc_nulls_last() for c in item]]
    w = Window.partitionBy(*group).orderBy(*order)
    done: list[Table] = []
    for i in range(len(cuts) + 1):
        here = source.filter(F.col(band) == i).drop(band)
        if done:
            filled = union_all([t.df.filter(full).select(*group) for t in done])
            if sum(t.bytes() for t in done) <= BROADCAST_BYTES and sum(t.rows() for t in done) <= BROADCAST_ROWS:
                filled = F.broadcast(filled)
            here = here.join(filled, group, "left_anti").unionByName(done[-1].df.filter(~F.col(full)).select(*columns))
        # repeated rows are equal in the whole order, so a dense rank counts them once: no shuffle before the one by group
        ranked = here.withColumn(rank, F.dense_rank().over(w)).filter(F.col(rank) <= n).distinct()
        done.append(materialize(ranked.withColumn(full, F.max(rank).over(Window.partitionBy(*group)) >= n)))
    banded.drop()
    out = union_all([t.df.filter(full) for t in done] + [done[-1].df.filter(~F.col(full))])
    return out.drop(full)
