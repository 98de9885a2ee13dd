"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of at least ``min_chars`` code points count.
The index holds

* ``refs``   (key, doc_id): every document that holds the key, the exact reference table,
* ``counts`` (key, n_docs, keeper): its aggregate, where keeper is the largest doc_id,
* ``filters`` (shard, n_keys, cells): a cuckoo filter of the keys whose count has reached ``min_docs``.

Inserting documents adds references and brings the keys that reach the threshold into the filters; deleting documents removes
their references and takes the keys that fall below it out again, so that a later pass brings their lines back. Both recount the keys
that they touch and no others, and edit the filters of shards in which a key crossed the threshold. A pass probes each line in the
filter of its shard and joins only the hits with the exact counts, which removes false positives.

Keys are 128-bit digests. Shards hold about ``SHARD_KEYS`` keys. Groups handed to Python are (shard, salt) cells of about
``CELL_ROWS`` references: the salt comes from the document, so a line that a third of all documents hold is spread over all salts.

Defined cases: null or empty text is one empty line; rows with a null doc_id neither count nor lose lines, and are returned;
repeated doc_ids count as one document; an empty table gives an empty index and result; extra columns pass through ``apply``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard's filter as the index is built, and references that are probed together.
SHARD_KEYS, CELL_ROWS = 1 << 16, 200_000
#: Slots of a bucket, kicks before a filter grows, and the load it is built for.
SLOTS, MAX_KICKS, LOAD = 4, 200, 0.8


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Digest of each line's key, or None where it is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        line = line.strip()
        long = len(line) >= min_chars and (line.isascii() or len(line.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(line) if long else None)
    return out


class CuckooFilter:
    """A set of 64-bit keys with deletion: 16-bit fingerprints in buckets of four, two candidate buckets a key."""

    def __init__(self, capacity: int = 64, cells: np.ndarray | None = None, n: int = 0):
        if cells is None:
            buckets = 1
            while buckets * SLOTS * LOAD < max(1, capacity):
                buckets *= 2
            cells = np.zeros((buckets, SLOTS), np.uint16)
        self.cells, self.n = cells, n

    @classmethod
    def load(cls, data: bytes, n: int) -> CuckooFilter:
        return cls(cells=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy(), n=n)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.asarray(keys, np.uint64)
        mask = np.uint64(len(self.cells) - 1)
        print_ = (k >> np.uint64(48)).astype(np.uint16)
        print_ = np.where(print_ == 0, np.uint16(1), print_)
        one = k & mask
        return print_, one, self._other(one, print_)

    def _other(self, at, print_):
        return (np.asarray(at, np.uint64) ^ (np.asarray(print_, np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(len(self.cells) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(keys)
        return (self.cells[one] == print_[:, None]).any(1) | (self.cells[two] == print_[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if there was no room; the filter must then be rebuilt larger from the exact table."""
        for print_, one, two in zip(*self._places(keys), strict=True):
            if not self._put(int(print_), int(one), int(two)):
                return False
        return True

    def _put(self, print_: int, one: int, two: int) -> bool:
        for at in (one, two):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = print_
                self.n += 1
                return True
        at = two
        for kick in range(MAX_KICKS):
            slot = (print_ + kick) % SLOTS
            print_, self.cells[at, slot] = int(self.cells[at, slot]), print_
            at = int(self._other(at, print_))
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = print_
                self.n += 1
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are known to be in."""
        for print_, one, two in zip(*self._places(keys), strict=True):
            for at in (int(one), int(two)):
                held = np.flatnonzero(self.cells[at] == print_)
                if len(held):
                    self.cells[at, held[0]] = 0
                    self.n -= 1
                    break


def _filter_of(keys: np.ndarray) -> CuckooFilter:
    room = len(keys)
    while True:
        made = CuckooFilter(room)
        if made.insert(keys):
            return made
        room = 2 * max(room, 1)


def _halves(keys) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


@dataclass
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs(doc_id, text) -> (key, doc_id), each key once a row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, at = b.column(0).to_pylist(), [], []
            for doc, text in zip(ids, b.column(1), strict=True):
                own = {k for k in line_keys(text.as_py(), min_chars) if k}
                keys.extend(own)
                at.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at, pa.int64())], ["key", "doc_id"])

    work.small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(work.task(run), "key binary, doc_id long")


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def _filters(hot: DataFrame) -> DataFrame:
    """hot(shard, key) -> a filter for each shard."""

    def build(key, pdf):
        import pandas as pd

        f = _filter_of(_halves(pdf["key"]))
        return pd.DataFrame({"shard": [key[0]], "n_keys": [f.n], "cells": [f.cells.tobytes()]})

    return hot.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, n_keys long, cells binary")


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineIndex:
    """Index of a first batch of documents. ``shards``: as many as the keys in the filters ask for, unless given (for growth)."""
    found = references(docs, min_chars)
    # doc_ids are unique in documents; a repeated one is folded here, which costs no shuffle of its own where counts are low
    refs = work.cut(found.distinct() if _repeats(docs) else found, "line-refs")
    counts = work.cut(_counts(refs), "line-counts")
    hot = counts.filter(F.col("n_docs") >= min_docs)
    shards = shards or -(-hot.count() // SHARD_KEYS) or 1
    return LineIndex(refs, counts, work.cut(_filters(hot.select("key", _shard(shards))), "line-filters"), shards, min_chars, min_docs)


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())


def _amend(index: LineIndex, refs: DataFrame, keys: DataFrame, held: DataFrame) -> LineIndex:
    """The index over ``refs`` once ``keys`` (key) have changed; held: their references now. Filters are edited only in shards in
    which a key crossed the threshold."""
    m, again = index.min_docs, work.cut(_counts(held), "line-recounts")
    counts = work.cut(index.counts.join(keys, "key", "left_anti").unionByName(again), "line-counts")
    was = index.counts.filter(F.col("n_docs") >= m).join(keys, "key", "left_semi").select("key", F.lit(-1).alias("turn"))
    turns = was.unionByName(again.filter(F.col("n_docs") >= m).select("key", F.lit(1).alias("turn")))
    turns = turns.groupBy("key").agg(F.sum("turn").alias("turn")).filter("turn <> 0").select("key", "turn", _shard(index.shards))
    turns = work.cut(turns, "line-turns")

    def edit(key, left, right):
        import pandas as pd

        if len(left):
            f = CuckooFilter.load(left["cells"].iloc[0], int(left["n_keys"].iloc[0]))
        else:
            f = CuckooFilter(64)
        gone, come = right[right["turn"] < 0], right[right["turn"] > 0]
        if len(gone):
            f.delete(_halves(gone["key"]))
        full = bool(len(come)) and not f.insert(_halves(come["key"]))
        return pd.DataFrame({"shard": [key[0]], "n_keys": [-1 if full else f.n], "cells": [f.cells.tobytes()]})

    crossed = turns.select("shard").distinct()
    old = index.filters.select("shard", "n_keys", "cells")
    same, changed = old.join(crossed, "shard", "left_anti"), old.join(crossed, "shard", "left_semi")
    edited = work.cut(changed.groupBy("shard").cogroup(turns.groupBy("shard")).applyInPandas(edit, "shard int, n_keys long, cells binary"), "line-filters")
    full = edited.filter("n_keys < 0").select("shard")  # those without room are made anew
    hot = counts.filter(F.col("n_docs") >= m).select("key", _shard(index.shards)).join(full, "shard", "left_semi")
    filters = same.unionByName(edited.filter("n_keys >= 0")).unionByName(_filters(hot))
    return LineIndex(refs, counts, work.cut(filters, "line-filters"), index.shards, index.min_chars, m)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with more documents; a doc_id that it has already keeps its old references beside the new.

    The references are appended as a table of their own; ``compact`` makes one of many.
    """
    come = work.cut(references(docs, index.min_chars).distinct(), "line-refs")
    keys = work.cut(come.select("key").distinct(), "line-keys")
    held = work.cut(index.refs.join(keys, "key", "left_semi"), "line-held")
    new = work.cut(come.join(held, ["key", "doc_id"], "left_anti"), "line-refs")
    return _amend(index, index.refs.unionByName(new), keys, held.unionByName(new))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_ids`` (doc_id)."""
    ids = doc_ids.select("doc_id").filter("doc_id is not null").distinct()
    keys = work.cut(index.refs.join(ids, "doc_id", "left_semi").select("key").distinct(), "line-keys")
    refs = work.cut(index.refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "line-refs")
    return _amend(index, refs, keys, refs.join(keys, "key", "left_semi"))


def compact(index: LineIndex) -> LineIndex:
    """The same index with its references in one table."""
    return replace(index, refs=work.cut(index.refs, "line-refs"))


def losses(index: LineIndex) -> DataFrame:
    """(doc_id, lost_keys): the keys whose lines each document loses, filter first and exact counts after."""
    salts = max(1, -(-index.refs.count() // (CELL_ROWS * index.shards)))
    lines = index.refs.select(_shard(index.shards), "key", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    spread = index.filters.select("shard", "n_keys", "cells", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def probe(left, right):
        if not len(right):
            return left.iloc[:0][["key", "doc_id"]]
        f = CuckooFilter.load(right["cells"].iloc[0], int(right["n_keys"].iloc[0]))
        return left[f.contains(_halves(left["key"]))][["key", "doc_id"]] if len(left) else left[["key", "doc_id"]]

    hits = lines.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(probe, "key binary, doc_id long")
    exact = index.counts.filter(F.col("n_docs") >= index.min_docs).select("key", "keeper")
    return hits.join(exact, "key").filter("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("lost_keys"))


def apply(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with text reduced to the kept lines, plus n_lines and n_dropped (before and by dropping; columns of these names go)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at, n_cols, min_chars = names.index("text"), len(names), index.min_chars
    own = [f"c{i}" for i in range(n_cols)]
    lost = losses(index).select(F.col("doc_id").alias("lost_doc"), "lost_keys")
    plain = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, own, strict=True)])
    out = plain.join(lost, F.col(f"c{names.index('doc_id')}").cast("long") == F.col("lost_doc"), "left").select(*own, "lost_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, dropped = [], [], []
            for text, gone in zip(b.column(at), b.column(n_cols), strict=True):
                text, gone = text.as_py() or "", gone.as_py()
                lines = text.split("\n")
                n.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [x for x, k in zip(lines, line_keys(text, min_chars), strict=True) if k not in gone]
                    text = "\n".join(lines)
                texts.append(text)
                dropped.append(n[-1] - len(lines))
            cols = list(b.columns[:n_cols])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], [*own, "n_lines", "n_dropped"])

    fields = ", ".join(f"{x} {kinds[c]}" for c, x in zip(names, own, strict=True))
    return out.mapInArrow(work.task(run), f"{fields}, n_lines long, n_dropped long").toDF(*names, "n_lines", "n_dropped")


def digest(kept: DataFrame) -> DataFrame:
    """The digest columns of kept texts."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
