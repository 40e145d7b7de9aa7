"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a map-side combined minimum per node and a join of the edges with it; both sides of the
join are scans of shared tables, so a node with very many neighbours is a skewed partition that
adaptive execution splits. No node, edge or label visits the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import released as persisted


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over undirected ``links`` (``a``, ``b``, each once): everybody's minimum becomes the new neighbour."""
    if large:
        seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    least = persisted(least, "stars")
    joined = seen.join(least, F.col("a") == F.col("node"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")))
    return persisted(out.where("a <> b").distinct(), "links")


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (long columns ``a``, ``b``): root is its component's least node."""
    links = persisted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(links)
    while True:
        links = _star(_star(links, True), False)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select("root").distinct().select(F.col("root").alias("node"), "root"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all nodes but the roots of the graph with edges ``a[k]``-``b[k]``; roots are least nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
