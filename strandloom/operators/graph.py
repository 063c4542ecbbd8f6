"""Connected groups of a graph, trees of parents, and small linear algebra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, ship

#: Edges up to which one task joins the groups.
ONE_TASK = 2_000_000


def connected(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(id, group_id): the smallest vertex linked with each vertex of the edges.

    Labels are lowered to the smallest of the neighbours' labels and to the label's own
    label (halving long chains), and labels hear of lower ones, until nothing changes; each round is cut with a
    table in the shared folder. RuntimeError beyond ``max_rounds``. Up to ONE_TASK edges are
    joined in one task.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    few = materialize(e, compression="zstd")
    if few.rows() <= ONE_TASK:
        ship(edges.sparkSession)
        kind = few.df.schema["x"].dataType.simpleString()
        return few.df.coalesce(1).mapInArrow(_joined, f"id {kind}, group_id {kind}")
    e = few.df
    both = materialize(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = materialize(both.df.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("label")))
    for _ in range(max_rounds):
        near = both.df.join(labels.df.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        low = materialize(labels.df.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("low")))
        # the old label hears of the lower one too, so whole trees hook on at once
        told = low.df.groupBy(F.col("old").alias("x")).agg(F.min("low").alias("told"))
        jump = low.df.join(labels.df.select(F.col("x").alias("low"), F.col("label").alias("far")), "low", "left").join(told, "x", "left")
        new = materialize(jump.select("x", "old", F.least("low", "far", "told").alias("label")))
        low.drop()
        changed = not new.df.filter("label <> old").isEmpty()
        labels.drop()
        labels = new
        if not changed:
            both.drop()
            return labels.df.select(F.col("x").alias("id"), F.col("label").alias("group_id"))
    raise RuntimeError(f"no end after {max_rounds} rounds")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (x, y) to the smallest vertex linked with each vertex."""
    up: dict = {}

    def find(v):
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    kind = None
    for batch in batches:
        kind = batch["x"].type
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if kind is not None:
        ids = list(up)
        for i in range(0, len(ids), 100_000):
            v = ids[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind), pa.array([find(x) for x in v], kind)], ["id", "group_id"])


def descendants(tree: DataFrame, roots: DataFrame, max_depth: int = 100) -> DataFrame:
    """Ids (taxid, parent) below or equal to the root ids (taxid), loop-safe: breadth
    first, each level an equi-join on the parent."""
    known = materialize(roots.select("taxid").distinct())
    front = known
    for _ in range(max_depth):
        step = tree.select(F.col("taxid").alias("t"), F.col("parent").alias("taxid")).join(front.df, "taxid").select(F.col("t").alias("taxid")).distinct()
        front = materialize(step.join(known.df, "taxid", "left_anti"))
        if front.df.isEmpty():
            return known.df
        known = materialize(known.df.unionByName(front.df))
    raise RuntimeError(f"deeper than {max_depth} levels")


def ancestors(tree: DataFrame, max_depth: int = 100) -> DataFrame:
    """(taxid, ancestor, up): every id with each of its ancestors, itself at 0. A root is
    its own parent or has none."""
    own = tree.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("up"))
    parents = tree.filter("parent is not null and parent <> taxid").select(F.col("taxid").alias("ancestor"), "parent")
    levels = [own]
    front = own
    for i in range(1, max_depth + 1):
        step = materialize(front.join(parents, "ancestor").select("taxid", F.col("parent").alias("ancestor"), F.lit(i).alias("up")))
        if step.df.isEmpty():
            out = levels[0]
            for x in levels[1:]:
                out = out.unionByName(x)
            return out
        levels.append(step.df)
        front = step.df
    raise RuntimeError(f"deeper than {max_depth} levels, or a loop")


def principal_components(matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and percent of variance of a symmetric relationship matrix; signs are
    fixed so that each component's largest entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    big = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[big, np.arange(vectors.shape[1])] < 0, -1, 1)
    total = values.sum()
    return vectors[:, :n] * np.sqrt(values[:n]), values[:n] / total * 100 if total else np.zeros(min(n, len(values)))


def procrustes_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 - disparity of two centred, scaled point sets after the best rotation."""
    a, b = a - a.mean(0), b - b.mean(0)
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if not na or not nb:
        return float("nan")
    s = np.linalg.svd((a / na).T @ (b / nb), compute_uv=False).sum()
    return float(s * s)
