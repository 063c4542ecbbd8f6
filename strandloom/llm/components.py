"""Consolidating pairwise matches into groups by seed-tree pruning.

Method (vertex pruning on a shrinking graph): in every round each vertex tells
its neighbours the smallest vertex it sees; a vertex that is nobody's minimum
drops out into a propagation forest, under the smallest vertex it was told, and
the vertices it was told of are linked to that smallest one in the next, smaller
graph.  When no edge is left the remaining vertices are seeds (the smallest of
their components), and seeds flow down the forest, round by round from the last.

Only edges and (vertex, minimum) pairs are ever shuffled, each pre-aggregated
with min; a vertex with a third of all edges is one key of a many-to-one join,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import Table, materialize, require, union_all


def connected_groups(edges: DataFrame, a: str, b: str, vertex: str = "id", group: str = "group_id", max_rounds: int = 60) -> DataFrame:
    """One row per vertex: ``vertex``, ``group`` (the smallest vertex linked with it).

    Rows with a null on either side are left out; a row that names one vertex
    twice keeps that vertex (alone, if nothing else links it).  Repeated and
    reversed rows change nothing.  Empty tables give an empty result.  Vertices
    compare by their type's order (strings: bytes).  Runs jobs in every round;
    rounds grow with the logarithm of the component size, and RuntimeError is
    raised beyond ``max_rounds``.
    """
    require(edges, a, b)
    clean = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    vertices = materialize(clean.select(F.explode(F.array("u", "v")).alias("u")).distinct())
    graph = materialize(_both(clean.filter("u <> v")))
    forest: list[Table] = []
    for _ in range(max_rounds):
        if graph.df.isEmpty():
            break
        told = materialize(_tell(graph.df))
        least = told.df.groupBy("u").agg(F.min("v").alias("least"), F.max(F.col("u") == F.col("v")).alias("kept"))
        least = materialize(least)
        forest.append(materialize(least.df.filter(~F.col("kept")).select("u", F.col("least").alias("parent"))))
        links = told.df.join(least.df.select("u", "least"), "u").filter("v <> least").select(F.col("least").alias("u"), "v")
        graph.drop()
        graph = materialize(_both(links))
        told.drop()
        least.drop()
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    graph.drop()
    return _flow(vertices, forest).select(F.col("u").alias(vertex), F.col("root").alias(group))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct()


def _tell(graph: DataFrame) -> DataFrame:
    """(u, v): some neighbour of u, or u itself, sees v as the smallest."""
    sees = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    to_neighbours = graph.join(sees, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_neighbours.unionByName(sees.select("u", F.col("m").alias("v"))).distinct()


def _flow(vertices: Table, forest: list[Table]) -> DataFrame:
    """Roots for all vertices: a vertex pruned in round k hangs under one that left later.
    Each round writes the roots it adds only."""
    if not forest:
        return vertices.df.withColumn("root", F.col("u"))
    pruned = union_all([t.df.select("u") for t in forest])
    known = [materialize(vertices.df.join(pruned, "u", "left_anti").withColumn("root", F.col("u")))]
    for level in reversed(forest):
        so_far = union_all([t.df for t in known]).withColumnRenamed("u", "parent")
        known.append(materialize(level.df.join(so_far, "parent").select("u", "root")))
    return union_all([t.df for t in known])
