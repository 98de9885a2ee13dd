"""Substring dedup by hashing lines and runs of words: passages that an earlier document holds already are cut out, offsets retained.

Words are split at ASCII white space, A-Z case aside. Two kinds of passages are found. Runs: ``min_words`` + 1 words in a row, wherever
they stand in a line, that occur before; all of them are found, up to collisions of a 64-bit hash. Lines: whole lines that occur
before, each alone; those that follow each other form a passage if they hold more than ``min_words`` words together. The
occurrence with the smallest (doc_id, place) is kept and every other one is a repeat; a run that overlaps its first occurrence in
the same document is none. Repeats that touch or overlap in a document form one span, so short lines that many documents share stay.

Runs go by their anchor, the smallest hash of the shorter grams in the run: it depends on the run's words alone, so equal runs have
equal anchors, and neighbouring runs mostly share theirs. A first pass writes one row for each stretch of equal anchors (about one
in 15 words) with a hash of all its words. A stretch that is equal to an earlier one holds repeats only. Single runs are written, in
a second pass over the text, for the first of each kind of stretch, where an anchor has stretches of several kinds.

Counting precedes the shuffle (one row a digest and task), and the joins that find repeats are equi-joins whose skewed digests
adaptive execution can split; a document's own passages are the only group that meets in one task.

Defined cases: null and empty texts have no units; a null doc_id is left alone and keeps nothing for others; repeated rows are one
document, whose copies lose the same spans; an empty table gives an empty result; extra columns pass through ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import work

MIN_WORDS = 50


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the lines that hold a word; offsets in code points."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if words:
            out.append((at, at + len(line), len(words), xxhash.xxh3_128_digest(b" ".join(words))))
        at += len(line) + 1
    return out


def _lines(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                word = 0
                for i, (start, end, n, digest) in enumerate(units(text.as_py())):
                    for c, x in zip(cols, (doc, i, word, start, end, n, digest), strict=True):
                        c.append(x)
                    word += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "unit", "word", "start", "end", "words", "digest"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return given.mapInArrow(work.task(run), "doc_id long, unit int, word long, start long, end long, words int, digest binary")


_P = np.uint64(0x9E3779B97F4A7C15)
_powers = _inverses = np.ones(1, np.uint64)


class _Words:
    """The words of a text: hashes of any words in a row, polynomial in the hashes of the words."""

    def __init__(self, text: str | None):
        global _powers, _inverses
        self.text = text or ""
        words = self.text.encode("utf-8", "surrogatepass").lower().split()
        self.n = n = len(words)
        if len(_powers) <= n:
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]), dtype=np.uint64)
            _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)))]), dtype=np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers[:n], dtype=np.uint64)])

    def hashes(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        h = (self.sums[to] - self.sums[at]) * _inverses[at]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def anchors(self, size: int) -> np.ndarray:
        """Anchor of each run of ``size`` words, by its first word."""
        gram = (size + 1) // 2
        at = np.arange(self.n - gram + 1)
        least, wide, left = self.hashes(at, at + gram), 1, size - gram
        while left:  # the smallest of ``wide`` grams in a row, until a run is covered
            step = min(wide, left)
            least, wide, left = np.minimum(least[:-step], least[step:]), wide + step, left - step
        return least

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in code points."""
        b = np.frombuffer(self.text.encode("utf-8", "surrogatepass"), np.uint8)
        word = np.concatenate([[False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        if len(b) != len(self.text):
            edge = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[edge]
        return edge[::2], edge[1::2]


def _batch(parts: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = zip(*parts, strict=True) if parts else [()] * len(names)
    made = [np.concatenate([np.empty(0, np.int64), *c]).astype({"long": np.int64, "int": np.int32}[k]) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in made], list(names))


def _stretches(docs: DataFrame, size: int) -> DataFrame:
    """A row for each stretch of n runs of equal anchors; twice: 1 if a document has the anchor's gram more than once."""
    schema = "doc_id long, anchor long, stretch long, n int, twice int, word int, start int, end int"
    longest = size - (size + 1) // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = _Words(text.as_py())
                if words.n >= size:
                    anchor = words.anchors(size)
                    at = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
                    n = np.diff(np.append(at, len(anchor)))
                    to = at + n - 1 + size
                    _, same, often = np.unique(anchor[at], return_inverse=True, return_counts=True)
                    start, end = words.places()
                    parts.append((np.full(len(at), doc), anchor[at], words.hashes(at, to), n, (n > longest) | (often[same] > 1), at, start[at], end[to - 1]))
            yield _batch(parts, schema)

    return docs.mapInArrow(work.task(run), schema)


def _runs(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text, wanted(word, n)) -> the runs of the wanted stretches."""
    schema = "doc_id long, run long, word int, start int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words = _Words(text.as_py())
                start, end = words.places()
                at = np.unique(np.concatenate([np.arange(w["word"], w["word"] + w["n"]) for w in wanted.as_py()]))
                at = at[at + size <= words.n]
                parts.append((np.full(len(at), doc), words.hashes(at, at + size), at, start[at], end[at + size - 1]))
            yield _batch(parts, schema)

    return docs.mapInArrow(work.task(run), schema)


def _repeated_runs(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, word, to, start, end, kept_doc_id, kept_start: the runs that occur before, those of a repeated stretch in one row."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    every = work.cut(_stretches(given, size), "stretches")
    kinds = every.groupBy("anchor").agg(F.count("*").alias("k"), F.max("twice").alias("t"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi"))
    shared = kinds.filter("k > 1 or t = 1").select("anchor", F.expr("t = 1 or lo <> hi").alias("several"))
    common = work.cut(every.join(shared, "anchor").drop("twice"), "shared-stretches")
    work.drop(every)
    first = common.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "word", "start")).alias("first"))
    common = common.join(first, ["anchor", "stretch"])
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("word") - F.col("first.word") < size)  # the first one, or overlaps it
    wanted = common.filter(own & F.col("several")).groupBy("doc_id").agg(F.collect_set(F.struct("word", "n")).alias("wanted"))
    single = work.cut(_runs(given.join(wanted, "doc_id").select("doc_id", "text", "wanted"), size), "runs")
    least = single.groupBy("run").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "word", "start")).alias("kept")).filter("k > 1").drop("k")
    again = single.join(least, "run").filter(f"doc_id <> kept.doc_id or word - kept.word >= {size}")
    again = work.cut(again.select("doc_id", "word", (F.col("word") + size).alias("to"), "start", "end", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start")), "repeated-runs")
    work.drop(single)
    # a repeated stretch stays where the first of its kind is, or where that one's first run stays
    moved = again.select(F.col("doc_id").alias("f_doc"), F.col("word").alias("f_word"), F.col("kept_doc_id").alias("m_doc"), F.col("kept_start").alias("m_start")).distinct()
    far = common.filter(~own).select("doc_id", "word", (F.col("word") + F.col("n") - 1 + size).alias("to"), "start", "end", F.col("first.doc_id").alias("f_doc"), F.col("first.word").alias("f_word"), F.col("first.start").alias("f_start"))
    far = far.join(moved, ["f_doc", "f_word"], "left")
    far = far.select("doc_id", "word", "to", "start", "end", F.coalesce("m_doc", "f_doc").alias("kept_doc_id"), F.coalesce("m_start", "f_start").alias("kept_start"))
    return far.unionByName(again)


def _repeated_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, word, to, start, end, kept_doc_id, kept_start: lines in a row that each occur before."""
    lines = work.cut(_lines(docs), "lines")
    first = lines.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "unit", "start")).alias("kept")).filter("n > 1").drop("n")
    again = lines.join(first, "digest").filter("doc_id <> kept.doc_id or unit <> kept.unit")
    again = again.select("doc_id", "unit", "word", "start", "end", "words", "kept").distinct()  # repeated rows of a document
    island = F.col("unit") - F.row_number().over(W.partitionBy("doc_id").orderBy("unit", "start"))
    spans = again.withColumn("island", island).groupBy("doc_id", "island").agg(
        F.min("word").alias("word"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min_by("kept", "unit").alias("kept")
    )
    return spans.filter(F.col("words") > min_words).select(
        "doc_id", "word", (F.col("word") + F.col("words")).alias("to"), "start", "end", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start")
    )


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, end, words, kept_doc_id, kept_start: the spans to remove and where their first part stays."""
    work.small_batches(docs)
    lines, others = _repeated_lines(docs, min_words), _repeated_runs(docs, min_words + 1)
    both = lines.withColumn("kind", F.lit(0)).unionByName(others.withColumn("kind", F.lit(1)))
    w = W.partitionBy("doc_id").orderBy("word", "kind", "to")
    reach = F.max("to").over(w.rowsBetween(W.unboundedPreceding, -1))
    both = both.withColumn("new", F.when(F.col("word") <= reach, 0).otherwise(1))
    both = both.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = F.min_by(F.struct("kept_doc_id", "kept_start"), F.struct("word", "kind")).alias("kept")
    spans = both.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("word")).alias("words"), kept)
    return spans.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "words")], "kept.kept_doc_id", F.col("kept.kept_start").cast("long").alias("kept_start"))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut out of their texts; all other columns stay."""
    cuts = spans.groupBy(F.col("doc_id").alias("cut_doc")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    own = [f"c{i}" for i in range(len(docs.columns))]  # whatever names the input has
    plain = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, own, strict=True)])
    doc, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    out = plain.join(cuts, doc.cast("long") == F.col("cut_doc"), "left")
    cuts = F.col("cuts")
    at = lambda i: F.substring(text, i.cast("int"), F.lit(1))
    inside = lambda c: (c["start"] > 0) & (at(c["start"]) != "\n") & (at(c["end"] + 1) == "\n")  # noqa: E731 - what stands before keeps its line end
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"] + F.when(inside(c), 0).otherwise(1)))
    starts = F.concat(F.transform(cuts, lambda c: c["start"]), F.array((F.length(text) + 1).cast("long")))
    parts = F.zip_with(ends, starts, lambda e, s: F.substring(text, (e + 1).cast("int"), F.greatest(s - e, F.lit(0)).cast("int")))
    kept = F.rtrim(F.array_join(parts, ""), F.lit("\n"))
    made = out.withColumn("kept", F.when(cuts.isNull(), text).otherwise(kept))
    return made.select(*[F.col("kept" if c == "text" else x).alias(c) for c, x in zip(docs.columns, own, strict=True)])
