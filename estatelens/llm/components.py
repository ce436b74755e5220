"""Connected components: spanning forests inside tasks, contraction between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def spanning_edges(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Indices of edges that join what ``labels`` still holds apart; updates ``labels``.

    ``a`` and ``b`` are node indices of the edges, ``labels[i] <= i`` the smallest index that
    node i is known to be linked with. The edges returned form a forest, so at most one less
    than there are nodes, however many edges come in.
    """
    chosen: list[np.ndarray] = []
    alive = np.arange(a.size)
    while alive.size:
        la, lb = labels[a[alive]], labels[b[alive]]
        apart = la != lb
        alive, la, lb = alive[apart], la[apart], lb[apart]
        if not alive.size:
            break
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        roots, first = np.unique(high, return_index=True)
        chosen.append(alive[first])
        parent = np.arange(labels.size)
        parent[roots] = low[first]  # pointers fall strictly, so there is no cycle
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent = further
        labels[:] = parent[labels]
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``edges``; a component is named by its smallest node.

    Each round hooks every node to its smallest neighbour below it, flattens the pointers by
    doubling and contracts the edges; what remains shrinks at least by half in expectation.
    All state stays in tables of the shared folder. Loops, repeated edges and nulls are ignored.
    """
    linked = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    left = edges.where(linked).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    left = materialize(left, "edges")
    nodes = left.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while not left.isEmpty():
        hooks = left.groupBy(F.col("hi").alias("child")).agg(F.min("lo").alias("parent"))
        hooks = _flattened(materialize(hooks, "hooks"))
        labels = (
            labels.join(hooks, labels["component"] == hooks["child"], "left")
            .select("node", F.coalesce("parent", "component").alias("component"))
        )
        labels = materialize(labels, "labels")
        low = hooks.select(F.col("child").alias("lo"), F.col("parent").alias("lo_root"))
        high = hooks.select(F.col("child").alias("hi"), F.col("parent").alias("hi_root"))
        moved = left.join(low, "lo", "left").join(high, "hi", "left").select(
            F.coalesce("lo_root", "lo").alias("x"), F.coalesce("hi_root", "hi").alias("y")
        )
        left = moved.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
        left = materialize(left, "edges")
    return labels


def _flattened(hooks: DataFrame) -> DataFrame:
    """Point every child at the end of its chain of parents."""
    while True:
        up = hooks.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
        if hooks.join(up, "parent", "left_semi").isEmpty():
            return hooks
        hooks = materialize(
            hooks.join(up, "parent", "left").select("child", F.coalesce("next", "parent").alias("parent")), "hooks"
        )
