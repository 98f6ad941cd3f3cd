"""Connected components of an edge table, without collecting it.

Edges are first reduced inside partitions: a union-find over at most
``PARTITION_EDGES`` edges gives one (node, smallest node) row per node. When the
edges fill more than one such partition, large-star / small-star rounds over the
whole table (Kiveris et al., "Connected Components in MapReduce and Beyond")
follow until nothing changes. Hubs are handled by aggregation and joins that AQE
can split, never by gathering a node's neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import cut

PARTITION_EDGES = 500_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), sorted, and the smallest node of each one's component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows > 2 * PARTITION_EDGES:
            held = [_star(held)]
            rows = len(held[0])
    if held:
        yield _star(held)


def _star(frames: list[pd.DataFrame]) -> pd.DataFrame:
    edges = pd.concat(frames)
    node, low = smallest_reachable(edges["a"].to_numpy(), edges["b"].to_numpy())
    return pd.DataFrame({"a": node, "b": low})[node != low]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, partition_edges: int = PARTITION_EDGES) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b; longs) not the smallest of its component.

    Nodes that are their component's smallest, and nodes without edges, have no
    row; callers coalesce to the node itself. Self-loops and repeated edges are
    harmless; an empty table gives an empty result.
    """
    edges = cut(edges.select("a", "b").distinct())
    parts = max(1, -(-edges.count() // partition_edges))
    stars = cut(edges.repartition(parts).mapInPandas(_reduce, "a long, b long"))
    if parts > 1:
        before = None
        while True:
            stars = cut(_small_star(_large_star(stars)))
            now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
