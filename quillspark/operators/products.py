"""Scores of many queries over counted documents, as products of matrices: documents by terms, times terms by queries, a batch at a time.

Pairs of a query and a document are neither shuffled nor stored. A first pass gives each query's number of hits and the bounds of its
scores, a second the best documents by what is made of the normalised score; a task keeps a row a query and sends its best ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Constants of BM25, and queries that a batch is multiplied with at once.
K1, B, PRODUCT_QUERIES = 1.5, 0.8, 250
BOUNDS = "item_id long, n long, lo double, hi double"
BEST = "form int, item_id long, doc_id long, s double, given double, final double"

#: final(s, given, extra): normalised scores, values given for pairs (0 without) and the documents' own, as arrays that fit together.
Final = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Queries:
    """Weighted terms (item_id, term, w) in blocks of queries."""

    def __init__(self, terms, avgdl: float):
        self.avgdl, self.blocks = avgdl, []
        ids = np.unique(terms["item_id"].to_numpy(np.int64))
        for i in range(0, len(ids), PRODUCT_QUERIES):
            own = ids[i : i + PRODUCT_QUERIES]
            part = terms[terms["item_id"].isin(own)]
            words, at = np.unique(part["term"].to_numpy(object), return_inverse=True)
            self.blocks.append((own, pa.array(list(words), pa.string()), at, np.searchsorted(own, part["item_id"].to_numpy(np.int64)), part["w"].to_numpy(np.float64)))

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block the scores, a row a document (doc_id, dl, terms(term, tf) or terms(term, tf, dl)); where it shares no term, nan."""
        lists = batch.column("terms")
        held, n = lists.flatten(), batch.num_rows
        doc = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        tf = held.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
        dl = held.field("dl").to_numpy(zero_copy_only=False) if held.type.get_field_index("dl") >= 0 else batch.column("dl").to_numpy(zero_copy_only=False)[doc]
        term = held.field("term")
        for own, words, at, item, w in self.blocks:
            code = pc.index_in(term, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(code >= 0)
            f, place = tf[hit], doc[hit] * len(words) + code[hit]
            value = f * (K1 + 1) / (f + K1 * (1 - B + B * dl[hit] / self.avgdl))
            d = np.bincount(place, value, n * len(words)).reshape(n, len(words))
            weights = np.zeros((len(words), len(own)))
            np.add.at(weights, (at, item), w)
            s = d @ weights
            if (w > 0).all():
                shared = s > 0
            else:  # a weight of nothing is a hit as well
                asked = np.zeros(weights.shape, np.float32)
                asked[at, item] = 1
                shared = (d > 0).astype(np.float32) @ asked > 0
            yield own, np.where(shared, s, np.nan)


def bounds(queries: Queries):
    """For ``mapInArrow``: hits and the least and largest score of each query in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(own, np.zeros(len(own), np.int64), np.full(len(own), np.inf), np.full(len(own), -np.inf)) for own, *_ in queries.blocks]
        for b in batches:
            for (_, n, lo, hi), (_, s) in zip(made, queries.scores(b), strict=True):
                n += (~np.isnan(s)).sum(0)
                np.fmin(lo, np.fmin.reduce(s, 0, initial=np.inf), out=lo)
                np.fmax(hi, np.fmax.reduce(s, 0, initial=-np.inf), out=hi)
        for own, n, lo, hi in made:
            k = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (own, n, lo, hi)], ["item_id", "n", "lo", "hi"])

    return run


def best(queries: Queries, limits, given, k: int, finals: list[Final]):
    """For ``mapInArrow``: the k documents of each query that are best by each of ``finals``, equals by doc_id, as far as a task knows.

    limits(item_id, lo, hi) of all queries; given(item_id, doc_id, given) or None.
    """
    lo, hi = (dict(zip(limits["item_id"], limits[c], strict=True)) for c in ("lo", "hi"))
    if given is not None:
        given = given.sort_values("doc_id", kind="stable")
        asked, about, worth = (given[c].to_numpy() for c in ("item_id", "doc_id", "given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = [tuple(np.array([x.get(i, 0.0) for i in own]) for x in (lo, hi)) for own, *_ in queries.blocks]
        floor = [[np.full(len(own), -np.inf) for own, *_ in queries.blocks] for _ in finals]
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            extra = b.column("extra").to_numpy(zero_copy_only=False)[:, None] if "extra" in b.schema.names else np.zeros((len(ids), 1))
            for j, (own, s) in enumerate(queries.scores(b)):
                least, most = bound[j]
                flat = most - least <= 1e-12 * np.abs(most)  # equal, but for the order of sums
                s = np.where(flat & ~np.isnan(s), 0.0, np.round((s - least) / np.where(flat, 1.0, most - least), 6))
                c = np.zeros(s.shape)
                if given is not None:
                    order = np.argsort(ids, kind="stable")
                    at = np.searchsorted(ids[order], about)
                    known = (at < len(ids)) & np.isin(asked, own)
                    known[known] = ids[order][at[known]] == about[known]
                    c[order[at[known]], np.searchsorted(own, asked[known])] = worth[known]
                for form, final in enumerate(finals):
                    v = final(s, c, extra)
                    v = np.where(np.isnan(s), -np.inf, v)
                    if len(ids) >= k:
                        np.fmax(floor[form][j], -np.partition(-v, k - 1, axis=0)[k - 1], out=floor[form][j])
                    row, col = np.nonzero((v >= floor[form][j]) & np.isfinite(v))
                    order = np.lexsort((ids[row], -v[row, col], col))
                    row, col = row[order], col[order]
                    place = np.arange(len(col)) - np.searchsorted(col, col)
                    row, col = row[place < k], col[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), form, np.int32)), pa.array(own[col]), pa.array(ids[row]), pa.array(s[row, col]), pa.array(c[row, col]), pa.array(v[row, col])], ["form", "item_id", "doc_id", "s", "given", "final"])

    return run
