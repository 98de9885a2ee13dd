"""Merkle manifest of a dataset: a root over groups of ordered leaves, a proof for every leaf, and its check.

Leaves are sorted by group and order over range partitions and cut into indexed partitions of at most ``CHUNK`` rows, so a group that
holds a third of all rows is many of them. Counts of the partitions, summed up per group, give each its first index. Then

* each partition runs a mountain-range stack over its leaves: a node waits at its height until the run of its parent is whole, then
  a carry in base ``FANOUT`` makes the parent, and so on upwards. Nodes whose run began or ends in another partition are its open
  peaks: some four a height, whatever the partition's size;
* open peaks of all partitions meet in aligned blocks of ``FANOUT ** SPAN`` leaves, which complete every run below that height; the
  one node that a block leaves goes into the next round, so rounds are the logarithm of the largest group to a base of millions;
* the last run of a height may be short, even a single node; it is hashed as it is, without padding.

The roots of the groups, ordered by group, are the leaves of a second tree of the same make. A proof needs the siblings along a
leaf's path: those within its partition are made again there, those outside (bounded by the height) come by a join with the open peaks.
Text is read once and leaves the scan as a digest; no leaf, node or proof passes through the driver.

Defined cases: null values are hashed as ``-``; a null group comes first and is a group of its own, null orders come first; of equal
orders the smaller leaf comes first; equal rows are leaves of their own with the same answer; a null doc_id is never tampered with in
the query; an empty table gives an empty result; extra columns are not part of a leaf, and only those asked for are carried along.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import work

#: Children of a node, leaves of an indexed partition, and heights that a round of merging completes.
FANOUT, CHUNK, SPAN = 3, 8192, 13
_NODE = "gid long, n long, h int, j long, digest string, open boolean"


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and the value, ``-`` for null."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(part, fields)), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(n: int, fanout: int = FANOUT) -> list[int]:
    """Nodes at each height over n leaves, from the leaves up to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def mountains(leaves: list[str], first: int, n: int) -> tuple[list[dict[int, str]], list[tuple[int, int]]]:
    """(nodes, peaks) of a stretch of a group's leaves from index ``first``: digests by index at each height, and the places (height,
    index) of nodes whose parent is not whole in the stretch."""
    wide = widths(n)
    nodes: list[dict[int, str]] = [{} for _ in wide]
    waiting: list[list[str]] = [[] for _ in wide]
    peaks: list[tuple[int, int]] = []
    for i, leaf in enumerate(leaves, first):
        h, j, digest = 0, i, leaf
        while True:
            nodes[h][j] = digest
            if wide[h] == 1:
                peaks.append((h, j))
                break
            run = waiting[h]
            run.append(digest)
            if j % FANOUT != FANOUT - 1 and j != wide[h] - 1:
                break
            begun, waiting[h] = j - len(run) + 1, []
            if begun % FANOUT:  # the run began before the stretch
                peaks.extend((h, k) for k in range(begun, j + 1))
                break
            h, j, digest = h + 1, j // FANOUT, _hash(run)
    for h, run in enumerate(waiting):
        if run:
            last = max(nodes[h])
            peaks.extend((h, k) for k in range(last - len(run) + 1, last + 1))
    return nodes, peaks


def _records(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["gid", "n", "h", "j", "digest", "open"])


@dataclass
class Tree:
    """rows: chunk, mid (order), leaf and the carried columns; runs: a row a group and chunk; nodes: all records; roots: gid, digest."""

    rows: DataFrame
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def tree(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> Tree:
    """The trees of all groups of ``leaves``; columns besides group, order and leaf are carried along."""
    spark = leaves.sparkSession
    parts = max(1, min(work.tasks(spark), -(-leaves.count() // CHUNK)))
    by = [group, *[c for c in order if c != group], *([leaf] if leaf not in order else [])]
    ranged = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("mid", F.monotonically_increasing_id())
    chunk = F.shiftright("mid", 33) * (1 << 20) + F.floor(F.col("mid").bitwiseAND((1 << 33) - 1) / CHUNK)
    rows = work.cut(ranged.withColumn("chunk", chunk.cast("long")), "merkle-leaves")
    runs = rows.groupBy(F.col(group).alias("grp"), "chunk").agg(F.min("mid").alias("head"), F.count("*").alias("size"))
    w = W.partitionBy("grp")
    before = F.coalesce(F.sum("size").over(w.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = work.cut(runs.select("grp", "chunk", "head", "size", before.alias("first"), F.sum("size").over(w).alias("n"), F.min("head").over(w).alias("gid")), "merkle-runs")

    def stack(own: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for r, mine in _stretches(own, known):
            nodes, peaks = mountains(mine.column("leaf").to_pylist(), r["first"], r["n"])
            high = set(peaks)
            out += [(r["gid"], r["n"], h, j, d, (h, j) in high) for h, level in enumerate(nodes) for j, d in level.items() if h or (h, j) in high]
        return _records(out)

    slim = rows.select("chunk", "mid", F.col(leaf).alias("leaf"))
    nodes = work.cut(slim.groupBy("chunk").cogroup(runs.select("chunk", "head", "size", "first", "n", "gid").groupBy("chunk")).applyInArrow(stack, _NODE), "merkle-nodes")
    largest = runs.agg(F.max("n")).first()[0] or 0
    made, top = _merge(nodes.filter("open"), len(widths(largest)) - 1)
    return Tree(rows, runs, nodes.unionByName(made) if made is not None else nodes, top.select("gid", "digest"))


def _stretches(own: pa.Table, known: pa.Table):
    """The runs of a chunk with their leaves in order."""
    own, at = own.sort_by("mid"), 0
    for r in known.sort_by("head").to_pylist():
        yield r, own.slice(at, r["size"])
        at += r["size"]


def _merge(peaks: DataFrame, height: int) -> tuple[DataFrame | None, DataFrame]:
    """(nodes made, roots): open peaks are merged in aligned blocks, ``SPAN`` heights a round."""
    made, m = None, 0
    while m < height:
        m += SPAN
        upto = m

        def carry(own: pa.Table) -> pa.Table:
            gid, n = own.column("gid")[0].as_py(), own.column("n")[0].as_py()
            wide = widths(n)
            levels: list[dict[int, str]] = [{} for _ in wide]
            for h, j, d in zip(*(own.column(c).to_pylist() for c in ("h", "j", "digest")), strict=True):
                levels[h][j] = d
            out = []
            for h, level in enumerate(levels[: min(upto, len(wide) - 1)]):
                for p in sorted({j // FANOUT for j in level}):
                    kids = range(p * FANOUT, min((p + 1) * FANOUT, wide[h]))
                    levels[h + 1][p] = _hash([level[k] for k in kids])
                    out.append((gid, n, h + 1, p, levels[h + 1][p], h + 1 == upto or wide[h + 1] == 1))
            brought = {(h, j) for h, j in zip(own.column("h").to_pylist(), own.column("j").to_pylist(), strict=True)}
            out += [(gid, n, h, j, levels[h][j], None) for h, j in brought if h >= upto or wide[h] == 1]
            return _records(out)

        apart = f"CAST(power({FANOUT}, abs(h - {m})) AS BIGINT)"
        block = F.expr(f"CASE WHEN h < {m} THEN j DIV {apart} ELSE j * {apart} END")
        step = work.cut(peaks.withColumn("block", block).groupBy("gid", "block").applyInArrow(carry, _NODE), "merkle-merged")
        fresh = step.filter("open is not null").withColumn("open", F.lit(True))  # the others were there before and wait for a later round
        made = fresh if made is None else made.unionByName(fresh)
        peaks = step.filter("open is null or open")
    return made, peaks


def _outside(first: int, size: int, n: int) -> list[tuple[int, int]]:
    """Places of the siblings that paths from a stretch need and that it does not make itself."""
    out, wide, last = [], widths(n), first + size - 1
    for h in range(len(wide) - 1):
        reach = FANOUT**h
        for p in {first // (reach * FANOUT), last // (reach * FANOUT)}:
            for j in range(p * FANOUT, min((p + 1) * FANOUT, wide[h])):
                if j * reach < first or min((j + 1) * reach, n) - 1 > last:
                    out.append((h, j))
    return out


_PATH = "array<struct<left:string,right:string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def paths(t: Tree, carried: dict[str, str], upper: DataFrame | None = None) -> DataFrame:
    """Carried columns of each leaf (name: type) with ``path``: for each height the siblings to the left and to the right, joined.

    upper(gid, top array of the same kind, subroot, root) lengthens the paths of a group and adds its values.
    """
    def ask(batches):
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            out = []
            for i in range(b.num_rows):
                r = {c: v[i] for c, v in cols.items()}
                out += [(r["chunk"], r["head"], r["size"], r["first"], r["n"], r["gid"], h, j) for h, j in [(-1, -1), *_outside(r["first"], r["size"], r["n"])]]
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            names = ["chunk", "head", "size", "first", "n", "gid", "h", "j"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names)

    asked = t.runs.select("chunk", "head", "size", "first", "n", "gid").mapInArrow(ask, "chunk long, head long, size long, first long, n long, gid long, h int, j long")
    known = asked.join(t.nodes.filter("open").select("gid", "h", "j", "digest"), ["gid", "h", "j"], "left")
    if upper is None:
        upper = t.roots.select("gid", F.array().cast(_PATH).alias("top"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    heads = upper.select("gid", F.lit(-1).alias("h"), "top", "subroot", "root")  # once a run, not with every sibling
    known = known.join(heads, ["gid", "h"], "left").select("chunk", "head", "size", "first", "n", "gid", "h", "j", "digest", "top", "subroot", "root")
    own = [f"c{i}" for i in range(len(carried))]

    def prove(leaves: pa.Table, needs: pa.Table) -> pa.Table:
        rest: dict[int, list] = {}
        heads = []
        for x in needs.to_pylist():
            if x["h"] < 0:
                heads.append(x)
            else:
                rest.setdefault(x["head"], []).append(x)
        leaves, at, tables = leaves.sort_by("mid"), 0, []
        for r in sorted(heads, key=lambda x: x["head"]):
            mine = leaves.slice(at, r["size"])
            at += r["size"]
            nodes, _ = mountains(mine.column("leaf").to_pylist(), r["first"], r["n"])
            for x in rest.get(r["head"], ()):
                nodes[x["h"]][x["j"]] = x["digest"]
            tables.append(_proofs(mine, own, nodes, r))
        return pa.concat_tables(tables)

    fields = ", ".join(f"{x} {k}" for x, k in zip(own, carried.values(), strict=True))
    rows = t.rows.select("chunk", "mid", "leaf", *[F.col(c).alias(x) for c, x in zip(carried, own, strict=True)])
    out = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(prove, f"{fields}, subroot string, root string, path {_PATH}")
    return out.toDF(*carried, "subroot", "root", "path")


def _proofs(mine: pa.Table, own: list[str], nodes: list[dict[int, str]], r: dict) -> pa.Table:
    wide = widths(r["n"])
    sides: list[dict[int, tuple[str, str]]] = []
    for h, level in enumerate(nodes[: len(wide) - 1]):
        at: dict[int, tuple[str, str]] = {}
        for j in range(r["first"] // FANOUT**h, (r["first"] + r["size"] - 1) // FANOUT**h + 1):
            p = j - j % FANOUT
            at[j] = ("".join(level[k] for k in range(p, j)), "".join(level[k] for k in range(j + 1, min(p + FANOUT, wide[h]))))
        sides.append(at)
    top = [(x["left"], x["right"]) for x in r["top"] or ()]
    left, right, ends = [], [], [0]
    for i in range(r["first"], r["first"] + r["size"]):
        for at in sides:
            a, b = at[i]
            left.append(a)
            right.append(b)
            i //= FANOUT
        left += [a for a, _ in top]
        right += [b for _, b in top]
        ends.append(len(left))
    path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
    n = r["size"]
    cols = [mine.column(x) for x in own] + [pa.array([r["subroot"]] * n, pa.string()), pa.array([r["root"]] * n, pa.string()), path.cast(_PATH_ARROW)]
    return pa.table(cols, names=[*own, "subroot", "root", "path"])


@dataclass
class Manifest:
    """The trees of the groups, the tree over their roots, and what each group passes down: gid, top, subroot, root."""

    groups: Tree
    over: Tree
    upper: DataFrame


def manifest(leaves: DataFrame, group: str = "source", order: tuple[str, ...] = ("doc_id",)) -> Manifest:
    """leaves(group, order, leaf, ..): a digest a row, see ``leaf_digest``; further columns are carried to the proofs."""
    groups = tree(work.cut(leaves, "merkle-digests"), group, list(order))
    names = groups.runs.select("gid", "grp").distinct()
    roots = work.cut(groups.roots.join(names, "gid").select("gid", "grp", F.col("digest").alias("leaf"), F.lit(0).alias("all")), "merkle-roots")
    over = tree(roots, "all", ["grp"])
    above = paths(over, {"gid": "long", "leaf": "string"}).select("gid", F.col("path").alias("top"), F.col("leaf").alias("subroot"), "root")
    return Manifest(groups, over, work.cut(above, "merkle-upper"))


def proofs(m: Manifest, carried: dict[str, str]) -> DataFrame:
    """Carried columns (name: type) of every leaf, with subroot, root and path."""
    return paths(m.groups, carried, m.upper)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, upwards and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def audit(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path: every
    document is proved, one half of them after their line ends were deleted (those whose doc_id has an even crc32)."""
    text = F.col("text")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(even & F.contains(text, F.lit("\n")), leaf_digest(*others, F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest(*others, text).alias("leaf"), tampered.alias("seen"))
    p = proofs(manifest(leaves), {"doc_id": "long", "leaf": "string", "seen": "string"})
    p = p.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("path")))
    return p.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path")
