"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a partial aggregation (smallest neighbour of a node) and one equi-join, so a node with very many links is
pre-aggregated before the shuffle and its join partition can be split by adaptive execution. Nothing is collected but two
numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for every node that has a link to another.

    Nulls, self links and repeated links are ignored; an empty table gives an empty result.
    """
    edges = work.cut(links.select("a", "b").filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = edges.agg(mark.alias("m")).first()["m"]
    if before[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        step = _small_star(_large_star(edges).distinct()).filter("a <> b").distinct()
        nxt = work.cut(step, "stars")
        after = nxt.agg(mark.alias("m")).first()["m"]
        work.drop(edges)
        edges = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    low = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = low.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return low.select(F.col("a").alias("node"), "component").unionByName(roots)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links a-b that connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(i)
    return a[keep], b[keep]
