"""Connected components of an undirected link table, as Spark joins.

Large-star / small-star contraction (Kiveris et al., "Connected Components in
MapReduce and Beyond"): every round sends each node's larger neighbours to its
smallest one, then its smaller neighbours to its smallest one. The table stays
a table of pairs throughout; no node list, component or link reaches the driver,
only the two numbers of the convergence test.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_written, written


def spanning_forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (i, j): fewer links than nodes, the same components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _signature(links: DataFrame) -> tuple:
    # order-free fingerprint of the link set; decimals cannot overflow
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    # links point downwards (u > v)
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node that has a link: columns ``node``, ``component``.

    ``component`` is the smallest node reachable. Links may repeat, run either
    way or join a node to itself (ignored); links with a null end are ignored.
    Nodes without links do not appear; an empty table gives an empty table.
    """
    links = (links.where(f"{a} is not null and {b} is not null and {a} <> {b}")
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    links = written(links, "links")
    seen = _signature(links)
    while seen[0]:
        step = written(_small_star(_large_star(links)), "links")
        now = _signature(step)
        drop_written(links)
        links = step
        if now == seen:
            break
        seen = now
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
