"""Set algebra on keyed tables; the row of the earliest table wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.withColumn("_no", F.lit(i)) for i, t in enumerate(tables)])


def combine(tables: list[DataFrame], key: list[str], how: str) -> DataFrame:
    """``intersection`` (keys in all tables), ``union``, ``difference`` (in the first only),
    ``symmetric`` (in an odd number of tables) or ``exactly_one``; one row per key, from
    the first table that has it. Repeated keys in one table count once (its smallest row)."""
    n = len(tables)
    rest = [c for c in tables[0].columns if c not in key]
    row = F.struct("_no", *rest)
    tables_in = F.size(F.collect_set("_no"))  # at most one entry per table
    g = _numbered(tables).groupBy(*key).agg(F.min(row).alias("_row"), tables_in.alias("_in"))
    tests = {
        "intersection": F.col("_in") == n,
        "union": F.lit(True),
        "difference": (F.col("_in") == 1) & (F.col("_row._no") == 0),
        "symmetric": F.col("_in") % 2 == 1,
        "exactly_one": F.col("_in") == 1,
    }
    if how not in tests:
        raise ValueError(f"how must be one of {', '.join(tests)}")
    return g.filter(tests[how]).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per ``by``: the first in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge_dedup(tables: list[tuple[str, DataFrame]], key: str = "id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Tables (name, rows of key and seq) united; an id met in an earlier table gets the
    table's name as suffix; of equal sequences the first row (table, then id) stays.
    Returns (kept: key, seq; removed: removed_id, kept_id)."""
    every = reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(i).alias("_no"), F.lit(n).alias("_name"), key, seq) for i, (n, t) in enumerate(tables)]).distinct()
    lowest = F.min("_no").over(Window.partitionBy(key))
    ids = every.withColumn("_new", F.when(F.col("_no") == lowest, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), F.col("_name"))))
    # map-side: the first row of each sequence is an aggregate, not a sort of a group
    up = ids.withColumn("_s", F.upper(seq))
    best = up.groupBy("_s").agg(F.min(F.struct("_no", key, "_new", seq)).alias("_b"))
    kept = best.select(F.col("_b._new").alias(key), F.col(f"_b.{seq}").alias(seq))
    removed = up.join(best.select("_s", F.col("_b._new").alias("kept_id")), "_s").filter(F.col("_new") != F.col("kept_id")).select(F.col("_new").alias("removed_id"), "kept_id")
    return kept, removed


def natural_merge(tables: list[DataFrame], how: str = "inner") -> DataFrame:
    """Tables folded by a join on all columns that two of them have in common."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], how), tables)


def merge_by_id(sets: list[DataFrame], key: str) -> DataFrame:
    """All rows of several sets with the same columns, one for each id: that of the first
    set that has it, the smallest row where a set has several. Null ids are left out."""
    rest = [c for c in sets[0].columns if c != key]
    every = [s.filter(F.col(key).isNotNull()).select(key, F.struct(F.lit(i).alias("_no"), *rest).alias("_row")) for i, s in enumerate(sets)]
    best = reduce(lambda a, b: a.unionByName(b), every).groupBy(key).agg(F.min("_row").alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def outer_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either of two selections with the same columns, those of both once."""
    return a.unionByName(b).distinct()
