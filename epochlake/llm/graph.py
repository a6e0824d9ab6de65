"""Connected components by joins and aggregations, for graphs of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, persist


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return join_hot(both.filter("b > a"), least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x <> y").select(F.col("y").alias("a"), F.col("x").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return linked.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order, and for each the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            return nodes, nodes[least]
        # the larger root hangs on the smaller one, then every node on its root
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]


def components(edges: DataFrame, most_rounds: int = 60, driver_edges: int = 0) -> DataFrame:
    """(node, component) for every node of edges(a, b), component being the smallest node that it reaches.

    Up to `driver_edges` distinct edges are united by the driver, which saves dozens of small shuffles. More go by alternate
    large-star and small-star rounds (Kiveris et al. 2014): the number of edges never grows, and the rounds grow with the
    logarithm of the size of the largest component. Every round is written to the shared folder. A node with very many
    neighbours is joined by a broadcast. Null ends, loops and repeated edges are dropped; nodes without an edge don't appear.
    Raises if `most_rounds` don't suffice.
    """
    now = persist(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if driver_edges and now.count() <= driver_edges:
        both = now.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
        found = united(both["a"].to_numpy(), both["b"].to_numpy())
        table = pa.table({"node": pa.array(found[0], pa.int64()), "component": pa.array(found[1], pa.int64())})
        return edges.sparkSession.createDataFrame(table, "node long, component long")
    seen = None
    for _ in range(most_rounds):
        now = persist(_small_star(_large_star(now)))
        # every node hangs on exactly one smaller node that hangs on none: nothing can change any more
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
