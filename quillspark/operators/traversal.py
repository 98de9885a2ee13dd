"""Breadth-first traversal of a typed graph from many starts at once.

A superstep joins the frontier with the edges and writes the nodes that no start has met before; the next one reads what was written,
so a step's plan is the same at any depth. A small frontier is broadcast to the edges, whose scan keeps only edges of the types asked
for; a larger one meets them by shuffle, salted so that a node with very many edges is dealt to several tasks.

Of many starts the walks are a product of starts and nodes. A leaf, a node that one other node alone is linked with, has one shortest
path from each start, by that node, and none leads on from it. So leaves are neither sought nor stored: they are joined with the found
nodes when these are read, and what is grouped, compared and written are the nodes with several neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import new_folder, stored

#: Rows of a frontier up to which it is broadcast, and tasks that share the edges of a node beyond.
BROADCAST_FRONTIER, SALTS = 200_000, 8
#: Starts beyond which leaves are told apart, and parts into which their links are dealt, as each meets many starts.
MANY_STARTS, LEAF_PARTS = 64, 96
_FOUND = "start string, id string, first_type string, path array<string>"


def both_ways(e: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, type) as steps (a, b, type), those of each edge in either direction."""
    ways = F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))
    return e.select("type", F.inline(ways)).select("a", "b", "type")


def _step(steps: DataFrame, frontier: DataFrame, rows: int, *more: str) -> DataFrame:
    if rows <= BROADCAST_FRONTIER:
        met = steps.join(F.broadcast(frontier.withColumnRenamed("id", "a")), "a")
    else:
        salted = steps.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        met = salted.join(frontier.withColumnRenamed("id", "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["a", "salt"])
    return met.select("start", F.col("b").alias("id"), F.coalesce("first_type", "type").alias("first_type"), F.concat("path", F.array("b")).alias("path"), *more)


def traverse(e: DataFrame, starts: DataFrame, depth: int, types: tuple[str, ...] = (), directed: bool = False) -> DataFrame:
    """e(from_id, to_id, type), starts(id) -> start, id, distance, first_type, path of all nodes at most ``depth`` steps away.

    types: edges that may be walked, all of them by default. Of several shortest paths the least is given, with the type of its first
    edge. A start is at distance 0 from itself whether the graph has it or not.
    """
    spark = e.sparkSession
    if types:
        e = e.filter(F.col("type").isin(list(types)))
    steps = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type") if directed else both_ways(e)
    steps = steps.filter("a <> b")  # nothing is reached on the spot, or by a link without an end
    folder = new_folder(spark, "walk")
    first = starts.select("id").filter("id is not null").distinct()
    first.select(F.col("id").alias("start"), "id", F.lit(None).cast("string").alias("first_type"), F.array("id").alias("path")).write.parquet(f"{folder}/distance=0")
    leaves = None
    if depth and spark.read.schema(_FOUND).parquet(f"{folder}/distance=0").count() > MANY_STARTS:
        steps, leaves = _parted(steps, directed)
    for d in range(1, depth + 1):
        frontier = spark.read.schema(_FOUND).parquet(f"{folder}/distance={d - 1}")
        rows = frontier.count()
        if not rows:
            break
        come = _step(steps, frontier, rows).groupBy("start", "id").agg(F.min(F.struct("path", "first_type")).alias("x"))
        met = spark.read.schema(_FOUND).parquet(*[f"{folder}/distance={k}" for k in range(max(0, d - 2) if not directed else 0, d)])
        new = come.join(met.select("start", "id"), ["start", "id"], "left_anti")  # undirected steps reach the last two distances only
        new.select("start", "id", "x.first_type", "x.path").write.parquet(f"{folder}/distance={d}")
    found = spark.read.schema(f"{_FOUND}, distance int").parquet(folder).select("start", "id", "distance", "first_type", "path")
    if leaves is None:
        return found
    inner = found.filter(F.col("distance") < depth)
    rows = inner.count()
    last = _step(leaves, inner.select(*found.columns), rows, "distance").filter("id <> start")
    return found.unionByName(last.select("start", "id", (F.col("distance") + 1).alias("distance"), "first_type", "path"))


def _parted(steps: DataFrame, directed: bool) -> tuple[DataFrame, DataFrame]:
    """(steps to nodes with several neighbours, those to leaves: one a leaf, of its least type), stored."""
    near = steps.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("other"), F.min(F.struct("type"))["type"].alias("type"))
    leaf = near.filter("a = other").select("a", "b", "type")
    if directed:  # nothing may lead on
        leaf = leaf.join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("a", "b", "type")
    leaf = stored(leaf, "leaves")
    return stored(steps.join(leaf.select("b"), "b", "left_anti").select("a", "b", "type"), "steps"), leaf.repartition(LEAF_PARTS)


def within(e: DataFrame, start: DataFrame, depth: int, types: tuple[str, ...] = ()) -> DataFrame:
    """start(id) -> id, distance from the nearest start of all nodes at most ``depth`` undirected steps away."""
    e = e if "type" in e.columns else e.withColumn("type", F.lit(None).cast("string"))
    return traverse(e, start, depth, types).groupBy("id").agg(F.min("distance").alias("distance"))


def inner_edges(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids(id)."""
    few = ids.select("id").distinct()
    small = few.limit(BROADCAST_FRONTIER + 1).count() <= BROADCAST_FRONTIER
    for end in ("from_id", "to_id"):
        side = few.withColumnRenamed("id", end)
        e = e.join(F.broadcast(side) if small else side, end, "left_semi")
    return e
