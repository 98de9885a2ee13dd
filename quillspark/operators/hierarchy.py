"""Hierarchies given as (child, parent) rows: depth below the root and cycles, in rounds logarithmic in the depth.

Pointers double: each node knows an ancestor and its distance, and each round takes the ancestor's ancestor. A pointer ends at a root
or at a junction, a node with several parents; one that never ends runs into a ring. Junctions, which sound data does not have, form
a graph of their own, on which depths and cycles are worked out; marks of cycles then go back along the stored jumps. All rounds are
joins of stored tables; only numbers of rows reach the driver. A round goes over the nodes that are not at an end, so there are as
many rounds over large tables as the depth has binary digits; rings take more, over their own nodes and those that lead to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.sources.tables import stored

#: Rows up to which a table of nodes is broadcast.
FEW = 100_000


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows, to be broadcast if they are few."""
    return F.broadcast(df) if rows <= FEW else df


def jumps(single: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame, int]:
    """single(node, up): one parent a node -> (ended: node, parent, top, dist; jumps by round: node, up; lost: node, parent, up of the
    nodes that lead to rings of such nodes, up all of the ring; their number).

    Round k holds the 2**k-th ancestors of all nodes that are not at an end before. A round writes what it moves, and no node again
    that has ended. One that ends none says that the rest runs in rings, as above a node at any depth there is one at half of it.
    """
    pointers = lambda df, up, over: df.select("node", F.col(up).alias("next"), F.col("dist").alias("more"), F.lit(over).alias("over"))
    live = single.select("node", F.col("up").alias("parent"), "up", F.lit(1).cast("long").alias("dist"))
    rounds, done, n, new = [live], [], None, 1
    while n is None or (n and (new or 1 << (len(rounds) - 1) < n)):
        at = reduce(DataFrame.unionByName, [pointers(live, "up", False), *([pointers(x, "top", True) for x in done] if new else [])])
        if n is not None and n <= FEW:
            at = at.join(F.broadcast(live.select(F.col("up").alias("node")).distinct()), "node", "left_semi")
        step = live.join(at.withColumnRenamed("node", "up"), "up", "left")
        step = step.select("node", "parent", F.coalesce("next", "up").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.coalesce("over", F.lit(True)).alias("over"))
        step = stored(step, "jumps")
        new, n = step.agg(F.count_if("over"), F.count_if(~F.col("over"))).first()
        if new:
            done.append(step.filter("over").select("node", "parent", F.col("up").alias("top"), "dist"))
        live = step.filter("not over").select("node", "parent", "up", "dist")
        rounds.append(live)
    ended = reduce(DataFrame.unionByName, done) if done else live.select("node", "parent", F.col("up").alias("top"), "dist").limit(0)
    # what has not ended after as many steps as there are such nodes stands in its ring, on all nodes of it
    return ended, rounds, live.select("node", "parent", "up"), n


def _marked(start: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """The nodes of start(node) and all above them up to the end of their pointer."""
    out = start.distinct()
    for r in rounds:
        out = stored(out.unionByName(r.join(out, "node", "left_semi").select(F.col("up").alias("node"))).distinct(), "marks")
    return out


def _trimmed(e: DataFrame) -> DataFrame:
    """e(a, b) without the links that no cycle can hold: those from a node that nothing leads to, or to one that leads nowhere."""
    before = e.count()
    while before:
        e = stored(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "core")
        now = e.count()
        if now == before:
            break
        before = now
    return e


def _spread(e: DataFrame, label: DataFrame) -> DataFrame:
    """label(node, c): the largest label that reaches each node along e(a, b)."""
    mark = lambda df: df.agg(F.sum(F.xxhash64("node", "c").cast("decimal(38,0)"))).first()[0]
    before = mark(label)
    while True:
        come = e.join(label.select(F.col("node").alias("a"), "c"), "a").select(F.col("b").alias("node"), "c")
        label = stored(label.unionByName(come).groupBy("node").agg(F.max("c").alias("c")), "labels")
        now = mark(label)
        if now == before:
            return label
        before = now


def on_cycles(e: DataFrame) -> DataFrame:
    """The links of e(a, b) that lie on a cycle: labels spread forwards, and back from where they came."""
    rest, found = _trimmed(stored(e.select("a", "b").distinct(), "core")), None
    while _some(rest):
        nodes = rest.select(F.col("a").alias("node")).distinct()
        color = _spread(rest, stored(nodes.select("node", F.col("node").alias("c")), "labels"))
        same = rest.join(color.select(F.col("node").alias("a"), F.col("c").alias("c_a")), "a").join(color.select(F.col("node").alias("b"), "c"), "b").filter("c_a = c").select("a", "b", "c")
        same = stored(same, "same")
        back = stored(color.filter("node = c"), "back")
        while True:
            more = stored(same.join(back.select(F.col("node").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct().join(back, ["node", "c"], "left_anti"), "back")
            if not _some(more):
                break
            back = stored(back.unionByName(more), "back")
        held = same.join(back.select(F.col("node").alias("a"), "c"), ["a", "c"], "left_semi").join(back.select(F.col("node").alias("b"), "c"), ["b", "c"], "left_semi").select("a", "b")
        found = held if found is None else found.unionByName(held)
        gone = back.select("node")
        rest = _trimmed(stored(rest.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "core"))
    return stored(found, "cycles") if found is not None else e.select("a", "b").limit(0)


def depths(e: DataFrame) -> DataFrame:
    """e(child, parent) -> child, parent, depth, cyclic.

    depth: steps from the nearest root down to the child by this parent, null where no root leads to it; cyclic: whether the link
    lies on a cycle. Rows with a null are dropped, repeated rows count once; no rows give none.
    """
    own = e.select("child", "parent").filter("child is not null and parent is not null").repartition("child").distinct()
    own = stored(own.withColumn("parents", F.count("*").over(W.partitionBy("child"))), "hierarchy")
    ended, rounds, lost, n_lost = jumps(own.filter("parents = 1").select(F.col("child").alias("node"), F.col("parent").alias("up")))
    ring = lost.select(F.col("up").alias("node")).distinct()
    depth, none = F.col("dist"), F.lit(None).cast("long")
    links = stored(own.filter("parents > 1").select("child", "parent"), "junction-links")
    n_links, more = links.count(), None
    if n_links:
        above = links.select(F.col("parent").alias("node")).distinct()
        end = ended.join(_few(above, n_links), "node", "left_semi").select(F.col("node").alias("parent"), "top", "dist")
        via = links.join(end, "parent", "left")  # a parent that is a root, a junction or on the way to a ring has no end of its own
        links = stored(via.select("child", "parent", F.coalesce("top", "parent").alias("top"), (F.coalesce("dist", F.lit(0)) + 1).alias("w")), "junction-links")
        junction = stored(links.select(F.col("child").alias("node")).distinct(), "junctions")
        known = _relaxed(links, junction.unionByName(lost.select("node")))
        held = on_cycles(links.select(F.col("child").alias("a"), F.col("top").alias("b")))
        inner = stored(links.join(held.toDF("child", "top"), ["child", "top"], "left_semi").select("child", "parent"), "junction-cycles")
        ring = ring.unionByName(_marked(inner.select(F.col("parent").alias("node")), rounds)).distinct()
        told = links.join(known.select(F.col("node").alias("top"), "d"), "top", "left").join(inner.withColumn("cyclic", F.lit(True)), ["child", "parent"], "left")
        more = told.select("child", "parent", (F.col("d") + F.col("w")).alias("depth"), "cyclic")
        ends = junction.join(known, "node", "left").select(F.col("node").alias("top"), "d", F.lit(True).alias("joined"))
        ended = ended.join(_few(ends, n_links), "top", "left")  # every other end is a root
        depth = F.when(F.col("joined"), F.col("d") + F.col("dist")).otherwise(F.col("dist"))
    out = ended.select(F.col("node").alias("child"), "parent", depth.alias("depth"))
    out = out.unionByName(lost.select(F.col("node").alias("child"), "parent", none.alias("depth")))
    if n_lost or n_links:
        ring = stored(ring, "cycles")
        out = out.join(_few(ring.select(F.col("node").alias("child"), F.lit(True).alias("cyclic")), ring.count()), "child", "left")
    else:
        out = out.withColumn("cyclic", F.lit(False))
    out = out if more is None else out.unionByName(more)
    return out.select("child", "parent", F.col("depth").cast("int").alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def _relaxed(links: DataFrame, inside: DataFrame) -> DataFrame:
    """(node, d) of the junctions and roots that links(child, top, w) hold, the nearest root first; of what is inside(node), none is a root."""
    roots = links.select(F.col("top").alias("node")).distinct().join(inside, "node", "left_anti").select("node", F.lit(0).cast("long").alias("d"))
    known = stored(roots, "junction-depths")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum("d")).first())
    before = mark(known)
    while before[0]:
        come = links.join(known.withColumnRenamed("node", "top"), "top").select(F.col("child").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        known = stored(known.unionByName(come).groupBy("node").agg(F.min("d").alias("d")), "junction-depths")
        now = mark(known)
        if now == before:
            break
        before = now
    return known
