"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard of a label.

Equal vectors of a label collapse into classes first (counted in partial aggregates). A label's classes are dealt to shards of at
most about ``SHARD`` vectors; each shard gets a graph. Every class is then searched for in every shard of its label, a block of
queries and a shard at a time. A beam is widened for queries whose links fill it, and for the whole block until an audit of some
of its queries against brute force passes; only a beam that has become as wide as the shard compares all of it, which is exact. The
audits are reported. Hits are verified by cosine in double precision.
A block returns each query's number of links and a spanning forest of the links it found, so a group of near copies never emits
its pairs, and components lose nothing.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or vec_id,
link with nothing and are returned as components of their own; vectors of different lengths are never compared; repeated rows
are rows of one class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .components import components, forest

COSINE = 0.98
SHARD = 16_384
#: Links of a node above the ground level and on it, beam while building, first beam of a search, queries searched together.
LINKS, GROUND_LINKS, BUILD_BEAM, BEAM, BATCH = 12, 24, 40, 32, 256
#: A beam that would have to widen to a SCANth of the shard or more becomes as wide as the shard.
SCAN = 8
#: Queries of a block that are audited, and the shares of links and of ten nearest neighbours that have to be found.
AUDIT, LINK_RECALL, NEAR_RECALL = 48, 0.999, 0.9


def _diverse(sims: np.ndarray, vectors: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (ids, -1 for none; sims to the row's node), ``keep`` that are nearer to it than to one chosen
    before, filled up with the nearest others."""
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = vectors[np.maximum(ids, 0)]
    between = np.einsum("bkd,bjd->bkj", v, v)
    n, k = ids.shape
    chosen = np.zeros((n, k), bool)
    for j in range(k):
        close = (between[:, j, :] >= sims[:, j, None]) & chosen
        chosen[:, j] = (ids[:, j] >= 0) & ~close.any(1) & (chosen.sum(1) < keep)
    rank = np.where(ids < 0, 2 * k, np.where(chosen, 0, k)) + np.arange(k)
    best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, best, 1)


class Graph:
    """Vectors of unit length in float32, in an order where upper levels are prefixes, and links by level."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> tuple[Graph, np.ndarray]:
        """The graph and the order in which it holds the given vectors."""
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        g = cls(np.ascontiguousarray(vectors[order], np.float32), [])
        counts = [int((level >= x).sum()) for x in range(level.max(initial=0) + 1)]
        g.links = [np.empty((0, 0), np.int32)] * len(counts)
        for x in range(len(counts) - 1, -1, -1):
            upper = counts[x + 1] if x + 1 < len(counts) else 0
            g._fill(x, counts[x], upper)
        return g, order

    def _fill(self, x: int, n: int, upper: int) -> None:
        width = LINKS if x else GROUND_LINKS
        self.links[x] = adj = np.full((n, width), -1, np.int32)
        i = 1
        while i < n:
            to = min(n, i + min(BATCH, i), upper if i < upper else n)
            q = self.vectors[i:to]
            start = self._descend(q, x) if i >= upper > 0 else np.zeros(len(q), np.int32)
            ids, sims = self._beam(q, start, x, BUILD_BEAM)
            own = q @ q.T
            own[np.triu_indices(len(q))] = -np.inf  # those of the batch that come before
            mate = np.where(np.isfinite(own), np.arange(i, to, dtype=np.int32), np.int32(-1))
            if len(q) > 16:
                near = np.argpartition(-own, 15, axis=1)[:, :16]
                own, mate = np.take_along_axis(own, near, 1), np.take_along_axis(mate, near, 1)
            picked = _diverse(np.concatenate([sims, own], 1), self.vectors, np.concatenate([ids, mate], 1), LINKS)
            adj[i:to, : picked.shape[1]] = picked
            self._link_back(adj, np.repeat(np.arange(i, to, dtype=np.int32), picked.shape[1]), picked.ravel())
            i = to

    def _link_back(self, adj: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        real = target >= 0
        source, target = source[real], target[real]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        wide = int(n.max(initial=0))
        new = np.full((len(nodes), wide), -1, np.int32)
        new[np.repeat(np.arange(len(nodes)), n), np.arange(len(target)) - np.repeat(first, n)] = source
        both = np.concatenate([adj[nodes], new], 1)
        width, used = adj.shape[1], (both >= 0).sum(1)
        short = used <= width
        rank = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
        adj[nodes[short]] = np.take_along_axis(both, rank, 1)[short]
        full = np.flatnonzero(~short)
        for part in np.array_split(full, max(1, len(full) * both.shape[1] // 20_000)):
            if len(part):
                c = both[part]
                sims = np.where(c >= 0, np.einsum("bkd,bd->bk", self.vectors[np.maximum(c, 0)], self.vectors[nodes[part]]), -np.inf)
                adj[nodes[part]] = _diverse(sims, self.vectors, c, width)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        at = np.zeros(len(q), np.int32)
        for x in range(len(self.links) - 1, to, -1):
            at = self._beam(q, at, x, 8)[0][:, 0]
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, x: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes of a level for each query, nearest first: ids (-1 for none) and similarities."""
        adj, b = self.links[x], len(q)
        rows = np.arange(b)
        seen = np.zeros((b, len(adj)), bool)
        seen[rows, start] = True
        ids, sims = np.full((b, width), -1, np.int32), np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)
        ids[:, 0], done[:, 0] = start, False
        sims[:, 0] = np.einsum("bd,bd->b", self.vectors[start], q)
        while len(active := np.flatnonzero(~done.all(1))):
            open_ = np.where(done[active], -np.inf, sims[active])
            step = np.argsort(-open_, axis=1)[:, :3]
            good = np.take_along_axis(open_, step, 1) > -np.inf
            done[active[:, None], step] = True
            node = np.where(good, ids[active[:, None], step], -1)
            nb = np.where((node >= 0)[:, :, None], adj[np.maximum(node, 0)], -1).reshape(len(active), -1)
            nb = np.sort(nb, axis=1)
            new = (nb >= 0) & ~seen[active[:, None], np.maximum(nb, 0)]
            new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            seen[np.broadcast_to(active[:, None], nb.shape)[new], nb[new]] = True
            s = np.full(nb.shape, -np.inf, np.float32)
            r, c = np.nonzero(new)
            s[r, c] = np.einsum("nd,nd->n", self.vectors[nb[r, c]], q[active[r]])
            all_ids, all_sims = np.concatenate([ids[active], nb], 1), np.concatenate([sims[active], s], 1)
            all_done = np.concatenate([done[active], ~new], 1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            done[active] = np.take_along_axis(all_done, top, 1) | ~np.isfinite(sims[active])
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), ids, -1).astype(np.int32), sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.vectors)
        parts = []
        for i in range(0, len(q), BATCH):
            part = q[i : i + BATCH]
            if width >= n:  # the last step of widening: all similarities
                sims = part @ self.vectors.T
                order = np.argsort(-sims, axis=1)[:, :width]
                parts.append((order.astype(np.int32), np.take_along_axis(sims, order, 1)))
            else:
                parts.append(self._beam(part, self._descend(part, 0), 0, width))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def pack(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **{f"links{i}": x for i, x in enumerate(self.links)}, **more)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        got = dict(np.load(io.BytesIO(data)))
        links = [got.pop(f"links{i}") for i in range(sum(k.startswith("links") for k in got))]
        return cls(got.pop("vectors"), links), got


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _wider(width: int, by: int, n: int) -> int:
    return n if SCAN * by * width >= n else by * width


def links_of(g: Graph, exact: np.ndarray, q: np.ndarray, cosine: float = COSINE, told: dict | None = None) -> list[np.ndarray]:
    """For each query (unit, double) the nodes with that cosine or more, by widening beams; exact: the graph's vectors in double.

    ``told`` receives what the audit of the beams that were used found: links found and there, and the beam's width.
    """
    q32, n = q.astype(np.float32), len(g.vectors)
    slack = cosine - 1e-4
    width, audit = min(BEAM, max(1, n // 2)), np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    all_sims = q32[audit] @ g.vectors.T
    while True:
        ids, sims = g.search(q32, width)
        found = [i[(s >= slack) & (i >= 0)] for i, s in zip(ids, sims, strict=True)]
        wide = width
        while wide < n and len(full := np.array([i for i, f in enumerate(found) if len(f) >= wide], int)):  # links fill the beam
            wide = _wider(wide, 4, n)
            for i, a, s in zip(full, *g.search(q32[full], wide), strict=True):
                found[i] = a[(s >= slack) & (a >= 0)]
        near = np.argsort(-all_sims, axis=1)[:, : min(10, width)]
        want = all_sims >= slack
        got = sum(int(want[j, found[i]].sum()) for j, i in enumerate(audit))
        top = np.mean([len(np.intersect1d(near[j], ids[i])) / near.shape[1] for j, i in enumerate(audit)])
        if told is not None:
            told |= {"found": got, "there": int(want.sum()), "width": width}
        if width >= n or got >= LINK_RECALL * want.sum() and top >= NEAR_RECALL:
            break
        width = _wider(width, 2, n)
    return [f[(exact[f] @ q[i]) >= cosine] for i, f in enumerate(found)]


def dedup(embeddings: DataFrame, cosine: float = COSINE, shard_size: int = SHARD) -> DataFrame:
    """embeddings(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    return audited(embeddings, cosine, shard_size)[0]


def audited(embeddings: DataFrame, cosine: float = COSINE, shard_size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The rows of ``dedup``, and for each block of queries in a shard (label, dim, block, shard) what its audit against brute force
    found: links found, links there, and the width of the beam that passed."""
    e = F.col("embedding")
    finite = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    able = finite & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keys = [F.when(able, F.xxhash64(e)).alias("h1"), F.when(able, F.xxhash64(F.lit(1), e, F.size(e))).alias("h2")]
    rows = embeddings.select("vec_id", "embedding", "label", *keys)
    classes = rows.filter("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
    classes = work.cut(classes.withColumn("dim", F.size("embedding")), "vectors")
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    dealt = work.cut(classes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")), "dealt")

    def build(key, pdf):
        raw = np.stack(pdf["embedding"].to_numpy())
        g, order = Graph.build(_unit(raw).astype(np.float32))
        data = g.pack(rep=pdf["rep"].to_numpy()[order], m=pdf["m"].to_numpy()[order], raw=raw[order])
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "graph": [data]})

    kind = dict(embeddings.dtypes)["label"]
    columns = dealt.select("label", "dim", "shard", "rep", "m", "embedding")
    graphs = work.cut(columns.groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shard int, graph binary"), "graphs")

    def query(key, left, right):
        told: dict[str, int] = {}
        if not len(left) or not len(right):
            return _rows(key, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), told)
        g, more = Graph.unpack(right["graph"].iloc[0])
        reps = left["rep"].to_numpy()
        found = links_of(g, _unit(more["raw"]), _unit(np.stack(left["embedding"].to_numpy())), cosine, told)
        found = [f[more["rep"][f] != r] for f, r in zip(found, reps, strict=True)]
        n = np.array([more["m"][f].sum() for f in found], np.int64)
        a = np.repeat(reps, [len(f) for f in found])
        b = more["rep"][np.concatenate(found)] if found else np.empty(0, np.int64)
        a, b = forest(a, b)
        hit = n > 0
        return _rows(key, np.concatenate([a, reps[hit]]), np.concatenate([b, reps[hit]]), np.concatenate([np.zeros(len(a), np.int64), n[hit]]), told)

    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    asked = dealt.select("label", "dim", F.col("shard").alias("block"), "rep", "embedding", every.alias("shard"))
    given = graphs.join(shards, ["label", "dim"]).select("label", "dim", every.alias("block"), "shard", "graph")
    by = ["label", "dim", "block", "shard"]
    out = work.cut(asked.groupBy(*by).cogroup(given.groupBy(*by)).applyInPandas(query, f"label {kind}, dim int, block int, shard int, a long, b long, n long, found long, there long, width int"), "vector-links")
    told = out.filter("width is not null").select("label", "dim", "block", "shard", "found", "there", "width")

    counts = out.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(out.filter("n = 0").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select("label", "h1", "h2", "rep", "m").join(counts, "rep", "left").join(parts, "rep", "left")
    named = named.select("label", "h1", "h2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    res = rows.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"], "left")
    own = F.coalesce("component", "vec_id")
    return res.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept")), told


def _rows(key: tuple, a: np.ndarray, b: np.ndarray, n: np.ndarray, told: dict) -> pd.DataFrame:
    """Links and counts of a block in a shard, and a row for its audit."""
    out = pd.DataFrame({"a": a, "b": b, "n": n}).astype("Int64")
    if told:
        out = pd.concat([out, pd.DataFrame([told]).astype("Int64")], ignore_index=True)
    for c in ("a", "b", "n", "found", "there", "width"):
        out[c] = out[c].astype("Int64") if c in out else pd.array([None] * len(out), "Int64")
    for name, value in zip(("label", "dim", "block", "shard"), key, strict=True):
        out[name] = value
    return out[["label", "dim", "block", "shard", "a", "b", "n", "found", "there", "width"]]
