"""Connected components of large edge lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import keep


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that connect the same nodes: each node but the least of a component with that least one."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node that the edges (a, b; 64-bit numbers) connect it with.

    Each round a node follows the neighbour that a digest of the round ranks
    first, and that one's, and the edges are drawn anew between the nodes so
    reached, until none is left. By a new order each round a share of the nodes
    goes, whatever the graph: following the least would shorten a chain of
    ascending nodes by two. Then each round's steps are followed by those of the
    later ones, which are ever fewer. Rounds are written to the shared folder;
    the driver learns only whether edges are left. A node with many neighbours
    meets them as partial minima.
    """
    # Both ways from one row: a union of the edges with themselves would make them twice.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    left = keep(edges.filter("a <> b").select(ways.alias("_way")).select("_way.a", "_way.b").distinct(), "edges")
    rounds = []
    while left.limit(1).count():
        rank = lambda name: F.xxhash64(name, F.lit(len(rounds)))
        first = left.groupBy("a").agg(F.min_by("b", rank("b")).alias("_b"))
        near = first.select(F.col("a").alias("node"), F.when(rank("_b") < rank("a"), F.col("_b")).otherwise(F.col("a")).alias("up"))
        roots = keep(near.join(near.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"), "roots")
        rounds.append(roots)
        end = lambda name: rounds[-1].select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
        drawn = left.join(end("a"), "a").join(end("b"), "b").filter("_a <> _b")
        left = keep(drawn.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("a").alias("label"))
    last = rounds.pop()
    while rounds:
        later = last.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        last = rounds.pop().join(later, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    found = keep(last, "roots")
    return found.join(found.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label")
