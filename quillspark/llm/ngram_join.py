"""Exact Jaccard self-join of documents on word shingles, by adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle), held as 64-bit hashes.
All sets are sorted in one global order, rare shingles first, by a count sketch of fixed size over the whole corpus. Two sets of
similarity t or more overlap in t (m + n) / (1 + t) shingles, so the first ``l`` that they share lie among the first
``m - ceil(2 t m / (1 + t)) + l`` of the smaller one (its short prefix) and the first ``n - ceil(t n) + l`` of the larger (its long
one). Each document picks its own ``l``: longer prefixes cost more postings but let fewer candidates through, both estimated from
the sketch. A pair needs ``min(l, l')`` shared prefix shingles, and as many as its overlap takes beyond the longer of the two
remainders, before it is verified on the whole sets.

Only what components need is verified, and no group emits its pairs: equal sets collapse into classes first; within a posting
list one hub meets the others, and the links found merge components. Lists that still span several components are met as groups,
those with the same member of smallest hash together (lists of mostly equal members have it in common; a group never reaches beyond
the sets that share a shingle with that member). A group is cut by size of set into blocks of bounded length. A task gets two
blocks and counts the shared prefix shingles of all their pairs at once; sets of pairs that share enough come together once more,
whole, to be verified, and a task returns a spanning forest of the links. So every pair of different components that shares a list
is met, and every candidate passes the same test of prefixes.

Text is read once for classes and sketch, once for prefixes, and once for the whole sets of each step's candidates; it is never
shuffled.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a null doc_id is returned with a null
component and links with nothing; repeated rows fall into one class; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import work
from .components import components, forest

WORDS, SIMILARITY = 5, 80
#: Cells of the count sketch (4 bytes each, fixed) and of one piece of it on the way.
CELLS, PIECE = 1 << 20, 1 << 12
#: Longest ``l`` that a document may pick.
MAX_L = 4
#: Tokens or shingles of a block (a task compares two blocks) and columns of an incidence product.
BLOCK, COLUMNS = 1 << 17, 1 << 12
#: Documents that a list is expected to hold before it is dealt to several tasks, so many in each.
HOT = 1 << 12
#: Bits of the filters that keep texts of candidates and of the first of equal texts: eight each within these bounds (8 MB at most).
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26

_M = np.uint64(0x9FB21C651E98DF25)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    out = h[:n].copy()
    for j in range(1, words):
        out *= _M
        out += h[j : n + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """One pass: (doc_id, n, digest) for each document and, at the end of a task, pieces of its sketch (piece, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "digest", "piece", "cells"]
        sketch, held, n_held = np.zeros(CELLS, np.int64), [], 0
        for b in batches:
            n, digest = [], []
            for text in b.column(1):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                held.append(_cells(s))
                n_held += len(s)
                if n_held > CELLS:
                    sketch += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, n_held = [], 0
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=CELLS)
        if sketch.any():
            cells = [zlib.compress(x.tobytes(), 1) for x in sketch.astype("<i4").reshape(-1, PIECE)]
            k = len(cells)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(cells, pa.binary())], names)

    return docs.mapInArrow(work.task(run), "doc_id long, n long, digest binary, piece int, cells binary")


def _sketch(survey: DataFrame) -> np.ndarray:
    """Sum of all tasks' sketches, in two levels so that no group grows with the number of tasks alone."""

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(PIECE, np.int64)
        for x in map(zlib.decompress, pdf["cells"]):
            total += np.frombuffer(x, "<i4" if len(x) == 4 * PIECE else "<i8")
        return pd.DataFrame({"piece": [key[0]], "cells": [zlib.compress(total.tobytes(), 1)]})

    parts = survey.filter("piece is not null").select("piece", "cells", F.floor(F.rand(5) * 16).cast("int").alias("salt"))
    once = parts.groupBy("piece", "salt").applyInPandas(add, "piece int, cells binary")
    out = np.zeros(CELLS, np.int64)
    for r in once.groupBy("piece").applyInPandas(add, "piece int, cells binary").collect():  # CELLS * 8 bytes in all
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(r["cells"]), "<i8")
    return out


def prefix(s: np.ndarray, seen: np.ndarray, similarity: int = SIMILARITY) -> tuple[np.ndarray, int, int, np.ndarray]:
    """The long prefix of a set, the length of its short one, its ``l``, and how often others are expected to hold the shingles of the
    prefix, rare ones first. seen: that number for each shingle of the set."""
    n = len(s)
    order = np.lexsort((s, seen))
    need = -(-similarity * n // 100)
    cost = np.cumsum(seen[order])
    l_ = np.arange(1, min(MAX_L, need) + 1)
    postings = cost[n - need + l_ - 1].astype(float)  # read for this prefix; at most postings / l candidates come of them
    pick = int(l_[np.argmin(postings + (4 + n / 64) * postings / l_)])
    own = order[: n - need + pick]
    return s[own], min(n, n - -(-2 * similarity * n // (100 + similarity)) + pick), pick, seen[own]


def _prefixes(docs: DataFrame, reps: DataFrame, given: Broadcast, words: int, similarity: int) -> DataFrame:
    """(doc_id, n, k, l, prefix, hot) of the sets of reps(doc_id), and of those others that its bit filter lets through."""
    bits, place = _filter_of(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, field = given.value, bits.value
        for b in batches:
            ids, ns, ks, ls, parts, hot = [], [], [], [], [], []
            at = b.column(2).to_numpy()
            rows = np.flatnonzero((field[at >> 6] >> (at & 63)) & 1).tolist()
            for i in rows:
                doc = b.column(0)[i].as_py()
                s = shingles(b.column(1)[i].as_py(), words)
                if len(s):
                    p, k, l_, often = prefix(s, seen[_cells(s)], similarity)
                    hot.append((1 + often[np.searchsorted(often, HOT) :] // HOT).tolist())
                    ids.append(doc)
                    ns.append(len(s))
                    ks.append(k)
                    ls.append(l_)
                    parts.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(ks, pa.int32()), pa.array(ls, pa.int32()), _lists(parts), pa.array(hot, pa.list_(pa.int32()))], ["doc_id", "n", "k", "l", "prefix", "hot"])

    near = docs.filter("doc_id is not null").select("doc_id", "text", place.alias("place"))
    return near.mapInArrow(work.task(run), "doc_id long, n long, k int, l int, prefix array<long>, hot array<int>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _filter_of(ids: DataFrame) -> tuple[Broadcast, Column]:
    """(bits, place): a bit filter of bounded size of ids(doc_id), and the place of a doc_id in it."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, 8 * ids.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(F.floor(place / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toPandas()  # bits / 64 rows at most
    field = np.zeros(bits // 64, np.int64)
    field[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(field), place


def _prefixes_of(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, n, k, l, prefix) of the documents in ids(doc_id) and of those others that a bit filter of bounded size lets through,
    stored: what is joined is shuffled, and most documents are in no pair."""
    given, place = _filter_of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = given.value
        for b in batches:
            at = b.column(5).to_numpy()
            yield b.select(range(5)).filter(pa.array(((field[at >> 6] >> (at & 63)) & 1).astype(bool)))

    near = prefixes.select("doc_id", "n", "k", "l", "prefix", place.alias("place"))
    return work.cut(near.mapInArrow(work.task(run), "doc_id long, n long, k int, l int, prefix array<long>"), "near-prefixes")


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ids(doc_id), stored. A bit filter of bounded size spares the other texts the work,
    an exact join follows."""
    given, place = _filter_of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = given.value
        for b in batches:
            at = b.column(2).to_numpy()
            rows = np.flatnonzero((field[at >> 6] >> (at & 63)) & 1)
            at = b.column(0).to_pylist()
            keep, sets, held = [], [], 0
            for i in rows.tolist():
                keep.append(at[i])
                sets.append(shingles(b.column(1)[i].as_py(), words))
                held += len(sets[-1])
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), _lists(sets)], ["doc_id", "shingles"])
                    keep, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), _lists(sets)], ["doc_id", "shingles"])

    near = docs.filter("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInArrow(work.task(run), "doc_id long, shingles array<long>")
    return work.cut(near.join(ids, "doc_id", "left_semi"), "candidate-sets")


def _verify(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Those of pairs(a, b), a the smaller set, that link: enough shared prefix shingles first, the whole sets after."""
    one = prefixes.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), F.col("l").alias("l_a"), F.slice("prefix", F.lit(1), F.col("k")).alias("p_a"))
    two = prefixes.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("l").alias("l_b"), F.col("prefix").alias("p_b"))
    shared = F.size(F.array_intersect("p_a", "p_b"))
    rest = F.greatest(F.col("n_a") - F.col("k_a"), F.col("n_b") - F.size("p_b"))
    enough = (shared >= F.least("l_a", "l_b")) & ((shared + rest) * (100 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity)
    near = work.cut(pairs.join(one, "a").join(two, "b").filter(enough).select("a", "b"), "candidates")
    if _empty(near):
        return near
    ids = work.cut(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidate-ids")
    sets = _sets_of(docs, ids, words)
    both = near.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    links = both.select("a", "b", shared.alias("i"), (F.size("s_a") + F.size("s_b") - shared).alias("u")).filter(F.col("i") * 100 >= F.col("u") * similarity)
    out = work.cut(links.select("a", "b"), "verified")
    work.drop(near, ids, sets)
    return out


def _empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def _overlaps(one: list[np.ndarray], two: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two, by products of incidence matrices of bounded width."""
    both = np.concatenate([*one, *two])
    token, at = np.unique(both, return_inverse=True)
    first = sum(map(len, one))
    held = np.bincount(at[:first], minlength=len(token)).astype(bool) & np.bincount(at[first:], minlength=len(token)).astype(bool)
    rank = np.cumsum(held) - 1  # what one side holds alone is in no intersection
    sides = []
    for part, cut in ((one, at[:first]), (two, at[first:])):
        row, in_both = np.repeat(np.arange(len(part)), [len(x) for x in part]), held[cut]
        row, col = row[in_both], rank[cut][in_both]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order]))
    out = np.zeros((len(one), len(two)), np.float32)
    for start in range(0, int(held.sum()), columns):
        m = []
        for (row, col), n in zip(sides, out.shape, strict=True):
            lo, hi = np.searchsorted(col, [start, start + columns])
            m.append(np.zeros((n, columns), np.float32))
            m[-1][row[lo:hi], col[lo:hi] - start] = 1
        out += m[0] @ m[1].T
    return out.astype(np.int64)


class _Block:
    """Rows of a block: sets with the tokens of open lists that they hold, those of the short prefix first."""

    def __init__(self, rows, similarity: int):
        self.ids, self.of, self.n, self.k, self.l = (rows[c].to_numpy(np.int64) for c in ("doc_id", "component", "n", "k", "l"))
        self.held = self.n - -(-similarity * self.n // 100) + self.l
        self.long = [np.asarray(x, np.int64) for x in rows["tokens"]]
        self.short = [x[:m] for x, m in zip(self.long, rows["shorts"], strict=True)]
        self.sets = [np.asarray(x, np.int64) for x in rows["shingles"]] if "shingles" in rows else []

    def __len__(self) -> int:
        return len(self.ids)


def _candidates(one: _Block, two: _Block, similarity: int) -> np.ndarray:
    """Which pairs share enough prefix shingles to be verified: as many as the less demanding of both asks for, and as their overlap
    takes beyond the longer of the two remainders. The smaller set of a pair gives its short prefix, the larger its long one."""
    n_a, n_b = one.n[:, None], two.n[None, :]
    smaller = (n_a < n_b) | ((n_a == n_b) & (one.ids[:, None] < two.ids[None, :]))
    shared = np.where(smaller, _overlaps(one.short, two.long), _overlaps(one.long, two.short))
    rest = np.where(smaller, np.maximum(n_a - one.k[:, None], n_b - two.held[None, :]), np.maximum(n_a - one.held[:, None], n_b - two.k[None, :]))
    fits = (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * similarity) & (one.of[:, None] != two.of[None, :])
    enough = shared >= np.minimum(one.l[:, None], two.l[None, :])
    return fits & enough & ((shared + rest) * (100 + similarity) >= (n_a + n_b) * similarity)


def _cells_of(members: DataFrame, weight: str, similarity: int) -> DataFrame:
    """members(group, doc_id, n, .., weight) -> the same with r1, i1, r2, i2, left: the cells in which each meets others, two blocks a
    cell.

    Sets link only if their sizes are within the similarity, so a group is cut into ranges of size first (whole bands, joined while
    they weigh less than ``BLOCK``) and meets neighbours only; a range of more is dealt out to blocks by hash.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(similarity, 99)))
    own = members.withColumn("band", band)
    by = W.partitionBy("group")
    bands = own.groupBy("group", "band").agg(F.sum(weight).alias("t"))  # some tens a group
    before = F.coalesce(F.sum("t").over(by.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = bands.withColumn("range", F.floor(before / BLOCK))
    ranges = bands.groupBy("group", "range").agg(F.ceil(F.sum("t") / BLOCK).cast("int").alias("blocks"))
    order = by.orderBy("range")
    for name, at in (("prev", F.lag), ("next", F.lead)):
        ranges = ranges.withColumn(name, at(F.struct("range", "blocks")).over(order))
    own = own.join(bands.select("group", "band", "range"), ["group", "band"]).join(ranges, ["group", "range"])
    own = own.withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cell = lambda r1, i1, r2, i2, left: F.struct(r1.alias("r1"), i1.alias("i1"), r2.alias("r2"), i2.alias("i2"), left.alias("left"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    r, none = F.col("range"), F.array().cast("array<struct<r1:bigint,i1:int,r2:bigint,i2:int,left:boolean>>")
    same = F.transform(count(F.col("blocks")), lambda o: cell(r, F.least(F.col("i"), o), r, F.greatest(F.col("i"), o), F.col("i") <= o))
    up = F.when(F.col("next").isNotNull(), F.transform(count(F.col("next.blocks")), lambda o: cell(r, F.col("i"), F.col("next.range"), o, F.lit(True))))
    down = F.when(F.col("prev").isNotNull(), F.transform(count(F.col("prev.blocks")), lambda o: cell(F.col("prev.range"), o, r, F.col("i"), F.lit(False))))
    return own.select(*members.columns, F.inline(F.concat(same, F.coalesce(up, none), F.coalesce(down, none))))


def _sides(key: tuple, rows, similarity: int) -> tuple[_Block, _Block, np.ndarray, np.ndarray]:
    """Both blocks of a cell and the candidates among their pairs."""
    left = rows["left"].to_numpy(bool)
    alone = key[1:3] == key[3:5]
    one = _Block(rows[left], similarity)
    two = one if alone else _Block(rows[~left], similarity)
    if not len(one) or not len(two):
        return one, two, np.empty(0, int), np.empty(0, int)
    x, y = np.nonzero(_candidates(one, two, similarity))
    return (one, two, x[x < y], y[x < y]) if alone else (one, two, x, y)


def _in_groups(left: DataFrame, lengths: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links between different components among the sets of open lists, stored. lengths: doc_id, k, l.

    Lists whose members are mostly the same have the same member of smallest hash and are met as one group. Members bring the
    tokens of their open lists first; the whole sets are fetched for those only that some other one is a candidate for.
    """
    first = left.groupBy("token").agg(F.max("parts").alias("parts"), F.min(F.struct(F.xxhash64("doc.doc_id").alias("h"), F.col("doc.doc_id").alias("group"))).alias("x"))
    groups = _by_token(left, first.select("token", "parts", "x.group")).select("doc.doc_id", "group").distinct()
    tokens = F.sort_array(F.collect_list(F.struct((~F.col("short")).alias("long"), "token")))
    own = left.groupBy("doc.doc_id").agg(F.first("doc.n").alias("n"), F.first("component").alias("component"), tokens.alias("t"), F.count_if("short").alias("shorts"))
    own = own.select("doc_id", "n", "component", F.col("t.token").alias("tokens"), "shorts", F.size("t").alias("weight"))
    members = work.cut(groups.join(own, "doc_id").join(lengths, "doc_id"), "members")
    by = ["group", "r1", "i1", "r2", "i2"]

    def meet(key, rows):
        import pandas as pd

        one, two, x, y = _sides(key, rows, similarity)
        ids = np.unique(np.concatenate([one.ids[x], two.ids[y]]))
        return pd.DataFrame({"group": np.full(len(ids), key[0]), "doc_id": ids})

    alive = _cells_of(members, "weight", similarity).groupBy(*by).applyInPandas(meet, "group long, doc_id long")
    alive = work.cut(alive.distinct(), "members-met")
    sets = _sets_of(docs, alive.select("doc_id").distinct(), words)
    rest = members.join(alive, ["group", "doc_id"], "left_semi")

    def verify(key, rows):
        import pandas as pd

        one, two, x, y = _sides(key, rows, similarity)
        if not len(x):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        p, q = np.unique(x), np.unique(y)
        shared = _overlaps([one.sets[i] for i in p], [two.sets[i] for i in q])[np.searchsorted(p, x), np.searchsorted(q, y)]
        good = shared * 100 >= (one.n[x] + two.n[y] - shared) * similarity
        a, b = forest(one.ids[x[good]], two.ids[y[good]])
        return pd.DataFrame({"a": a, "b": b})

    out = work.cut(_cells_of(rest, "n", similarity).join(sets, "doc_id").groupBy(*by).applyInPandas(verify, "a long, b long"), "verified")
    work.drop(members, alive, sets)
    return out


def _postings(prefixes: DataFrame, reps: DataFrame) -> DataFrame:
    """(token, salt, parts, doc, short, hub) of the lists with a hub and others, stored; hub: the smallest set that holds the shingle
    in its short prefix. Only sets behind their hub are given, and of equal sets only that of reps(doc_id).

    All postings are shuffled once, to find the shingles that several documents hold; prefixes themselves are not. A list that the
    sketch expects to be long is dealt out by ``salt`` to ``parts`` tasks; its hub is the least of those of its parts, which meets them
    again by shingle and salt.
    """
    size = F.size("prefix") - F.size("hot")  # shingles before the frequent ones
    rows = prefixes.select(F.posexplode("prefix").alias("at", "token"), "doc_id", "n", size.alias("light"), "hot", "k")
    parts = F.when(F.col("at") < F.col("light"), F.lit(1)).otherwise(F.get("hot", F.col("at") - F.col("light")))
    rows = rows.select("token", "doc_id", "n", (2 * parts + (F.col("at") < F.col("k")).cast("int")).alias("how"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("salt"))  # narrow, as all are shuffled
    own = W.partitionBy("token", "salt")
    rows = rows.repartition("token", "salt").withColumn("held", F.count("*").over(own)).filter("how > 3 or held > 1").drop("held")
    rows = rows.join(reps, "doc_id", "left_semi").select("token", "salt", F.shiftright("how", 1).alias("parts"), F.struct("n", "doc_id").alias("doc"), (F.col("how") % 2 == 1).alias("short"))
    rows = rows.repartition("token", "salt").withColumn("held", F.count("*").over(own)).withColumn("hub", F.min(F.when(F.col("short"), F.col("doc"))).over(own))
    rows = rows.filter("parts > 1 or (held > 1 and hub is not null and doc > hub)")
    near = work.cut(rows.select("token", "salt", "parts", "doc", "short", "hub"), "lists")
    lists = near.filter("parts > 1").groupBy("token").agg(F.max("parts").alias("parts"), F.min("hub").alias("hub"), F.count("*").alias("held")).filter("held > 1 and hub is not null").drop("held")
    dealt = _by_token(near.filter("parts > 1").drop("hub"), lists).filter("doc > hub")
    out = work.cut(near.filter("parts = 1").unionByName(dealt), "postings")
    work.drop(near)
    return out


def _by_token(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows(token, salt, parts, ..) with the values of lists(token, parts, ..): a long list meets them in as many tasks as it has parts."""
    return rows.join(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), ["token", "salt"])


def _open(left: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of the lists that hold a hub and span components, with the component of each."""
    left = left.select("token", "salt", "parts", "doc", "short").join(labels.select(F.col("node").alias("n_"), "component"), F.col("doc.doc_id") == F.col("n_"), "left")
    left = left.select("token", "salt", "parts", "doc", "short", F.coalesce("component", "doc.doc_id").alias("component"))
    lists = left.groupBy("token").agg(F.max("parts").alias("parts"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("short").alias("any")).filter("lo <> hi and any")
    return work.cut(_by_token(left, lists.select("token", "parts")), "postings")


def similar(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    work.small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = work.cut(_survey(docs, words), "survey")
    sets = survey.filter("piece is null").select("doc_id", "n", "digest")
    sketch = _sketch(survey)
    floor = int(sketch.mean())  # what chance puts in a cell
    given = docs.sparkSession.sparkContext.broadcast(np.maximum(sketch - floor, 0).astype(np.int32))
    classes = work.cut(sets.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    prefixes = work.cut(_prefixes(docs, reps, given, words, similarity), "prefixes")

    # In a list, sets are met in the order of their size; the smaller of a pair must hold the shingle in its short prefix.
    active = _postings(prefixes, reps)
    fits = F.col("hub.n") * 100 >= F.col("doc.n") * similarity
    met = work.cut(active.filter(fits).select(F.col("hub.doc_id").alias("a"), F.col("doc.doc_id").alias("b")).distinct(), "met")
    near = _prefixes_of(prefixes, met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    lengths = work.cut(prefixes.select("doc_id", "k", "l"), "lengths")
    work.drop(prefixes)  # most of the disk in use
    links = _verify(met, near, docs, words, similarity)
    work.drop(near)
    labels = components(links)
    left = _open(active, labels)
    work.drop(active)
    if not _empty(left):
        more = _in_groups(left, lengths, docs, words, similarity)
        if not _empty(more):
            labels = components(links.unionByName(more))
        work.drop(more)
    work.drop(lengths, met, links, left)

    label = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("label"))
    out = sets.join(label, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """docs reduced to one document a component, the one with the smallest doc_id; all columns stay."""
    first = similar(docs, words, similarity).filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("first_doc")).distinct()
    return docs.join(first, docs["doc_id"].cast("long").eqNullSafe(first["first_doc"]), "left_semi")
