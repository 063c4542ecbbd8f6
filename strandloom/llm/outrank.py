"""One ranking from several differently scaled scores: outranking net flow.

Method: for every score, an item's positive flow is the number of items of its
group that it beats and its negative flow the number that beat it (the usual
preference function on ranks, so a score's range has no weight).  Both are exact
and come from prefix sums over the sorted distinct values, not from pairs: a
histogram of the values is pre-aggregated, range-partitioned, summed inside each
partition, and shifted by the totals of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import fresh, lookup_join, materialize, require


def outranking_flows(df: DataFrame, group: str, item: str, scores: dict[str, float]) -> DataFrame:
    """Flows of every item within its group, over scores where **smaller is better**.

    ``scores`` maps score columns to weights.  Returns group, item, ``beats``
    and ``beaten`` (weighted sums over the scores of the items strictly worse
    and strictly better: positive and negative flow, not divided by the group's
    size less one), ``net_flow`` = beats - beaten, ``net_share`` = net_flow over what
    beating all others in all scores would give (-1 to 1; null for a group of one), and
    ``places`` = beaten + the sum of weights (the sum of competition ranks where weights are 1).

    Rows with a null group or item, or with a score that is null or NaN, take no
    part.  Repeated rows count once.  Equal scores beat each other in neither
    direction.  Empty tables give an empty result; other columns are ignored.
    Runs two jobs.
    """
    require(df, group, item, *scores)
    names = list(scores)
    rows = df.select(group, item, *[F.col(c).cast("double").alias(c) for c in names])
    for c in [group, item]:
        rows = rows.filter(F.col(c).isNotNull())
    for c in names:
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(c))
    items = materialize(rows.distinct())
    better, worse, val, met = (fresh(df, x) for x in ("_better", "_worse", "_value", "_metric"))
    flat = items.df.select(group, F.posexplode(F.array(*names)).alias(met, val))
    ranks = materialize(prefix_counts(flat.groupBy(group, met, val).agg(F.count(F.lit(1)).alias("n")), [group, met], val, "n", better, worse))
    out = items.df
    plus, minus = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(names):
        side = ranks_of(ranks, met, i, {val: c, better: f"{better}_{i}", worse: f"{worse}_{i}"})
        out = lookup_join(out, side, [group, c])
        plus, minus = plus + F.col(f"{worse}_{i}") * float(scores[c]), minus + F.col(f"{better}_{i}") * float(scores[c])
    size = fresh(df, "_size")
    out = lookup_join(out, materialize(items.df.groupBy(group).agg(F.count(F.lit(1)).alias(size))), [group])
    weight = float(sum(scores.values()))
    share = F.when(F.col(size) > 1, (plus - minus) / (weight * (F.col(size) - 1)))
    return out.select(group, item, *names, plus.alias("beats"), minus.alias("beaten"), (plus - minus).alias("net_flow"), share.alias("net_share"), (minus + weight).alias("places"))


class ranks_of:
    """One metric's part of the rank table, as a lookup side."""

    def __init__(self, table, metric: str, i: int, rename: dict[str, str]):
        self.df = table.df.filter(F.col(metric) == i).drop(metric).withColumnsRenamed(rename)
        self.bytes, self.rows = table.bytes, table.rows


def prefix_counts(hist: DataFrame, group: list[str], value: str, n: str, below: str, above: str) -> DataFrame:
    """For each row of a histogram (group, value, n): how many counted items of
    the group have a smaller and a greater value. Distributed prefix sum: no task
    holds more than one range partition, however large the group."""
    part = fresh(hist, "_part")
    parts = max(1, int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(hist.repartitionByRange(parts, *group, value).withColumn(part, F.spark_partition_id()))
    # (group, partition) totals: a partition holds a contiguous range, so there are at most partitions + groups rows
    sums = cut.df.groupBy(*group, part).agg(F.sum(n).alias("_sum"))
    over = Window.partitionBy(*group)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_sum").over(over)).drop("_sum")
    local = F.sum(n).over(Window.partitionBy(*group, part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    out = cut.df.withColumn("_upto", local).join(sums, [*group, part])
    upto = F.col("_before") + F.col("_upto")
    return out.select(*group, value, (upto - F.col(n)).alias(below), (F.col("_all") - upto).alias(above))


def best_per_group(flows: DataFrame, group: str, item: str, n: int, by: str = "places", ascending: bool = True) -> DataFrame:
    """The N best items of each group by one of the flow columns, ties by item."""
    first = F.col(by).asc() if ascending else F.col(by).desc()
    w = Window.partitionBy(group).orderBy(first, F.col(item).asc())
    return flows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
