"""Filter interaction audit: what each of several quality filters removes, alone and in every order of application.

Texts are scanned as they lie in Arrow buffers: a table of 256 byte classes turns a batch into flags, whose prefix sums give each
document's words, capitals, symbols and code points as differences at its ends. Distinct words go by 64-bit hashes, mixed from
words of eight bytes, sorted within each document; neighbours of equal hash are verified byte by byte, and a document in which two
words share a hash is counted from the words themselves, so counts are exact. Texts above ``SEGMENT`` bytes are scanned in segments
that end after white space, of which only the distinct words are kept.

A document becomes a mask with one bit a filter it fails; sums by part and mask (at most 32 a part) hold all that any order of the
filters can ask for, so orders and steps are worked out on them alone. Repeated texts go by SHA-256: only the smallest doc_id of a
digest is aggregated, which combines before the shuffle, and rows meet it again by digest and doc_id, so no text is a hot key.

Defined cases: a null text is empty: no words, so it fails A and not B or C; a null lang is the part ''; rows with a null doc_id have
no labels, repeat nothing and make no text repeated; repeated rows count as documents each, and those of the smallest doc_id all stay;
a document is good or toxic if any of its labels says so; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

FILTERS = "ABCDE"
#: Limits: words, distinct words in a hundred, capitals in a hundred code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Bytes of a text that are scanned at a time.
SEGMENT = 1 << 22

_SPACE, _CAPITAL, _SYMBOL, _LATER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[list(SYMBOLS)] |= _SYMBOL
_CLASS[0x80:0xC0] |= _LATER  # a later byte of a code point
_MIX, _TAIL = np.uint64(0x9E3779B97F4A7C15), (1 << (8 * np.arange(9, dtype=object))) - 1
_TAIL = np.array([int(x) for x in _TAIL], np.uint64)


def _eight(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of words at ``at`` as numbers, with zeros beyond the ``left`` bytes of a word."""
    windows = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(padded) - 7, 8), (1, 1))
    return np.ascontiguousarray(windows[at]).view("<u8")[:, 0] & _TAIL[np.minimum(left, 8)]


def word_hashes(padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; one of at most seven bytes has a hash that no other of them has."""
    out = _eight(padded, start, size) * _MIX ^ size.astype(np.uint64)
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        h = out[more]
        out[more] = (h ^ (h >> np.uint64(29))) * _MIX + _eight(padded, start[more] + k, size[more] - k)
        k += 8
        more = more[size[more] > k]
    return out


def _same(padded: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words at a and b of the same sizes have the same bytes."""
    out, rest, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(rest):
        equal = _eight(padded, a[rest] + k, size[rest] - k) == _eight(padded, b[rest] + k, size[rest] - k)
        out[rest[~equal]] = False
        k += 8
        rest = rest[equal & (size[rest] > k)]
    return out


def _distinct(padded: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, clash): positions of one word a document and hash, and documents in which unequal words share the bits compared."""
    room = np.uint64(int(doc[-1]).bit_length() if len(doc) else 0)  # the document above as many bits of the hash as there is room for
    key = hashes >> room
    key |= doc.astype(np.uint64) << (np.uint64(64) - room) if room else np.uint64(0)
    order = np.argsort(key)
    d, h, s, n = doc[order], key[order], start[order], size[order]
    again = np.zeros(len(order), bool)
    again[1:] = h[1:] == h[:-1]
    at = np.flatnonzero(again)
    equal = n[at] == n[at - 1]
    equal[equal] = _same(padded, s[at[equal]], s[at[equal] - 1], n[at[equal]])
    return order[~again], np.unique(d[at[~equal]])


def _stretches(flags: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the words of a buffer whose documents end at ``ends``: no word goes on over an end."""
    full = np.zeros(len(flags) + 1, bool)
    full[:-1] = (flags & _SPACE) == 0
    begins = full[:-1].copy()
    begins[1:] &= ~full[:-2]
    inner = ends[ends < len(flags)]
    begins[inner] = full[inner]
    closes = full[:-1] & ~full[1:]
    closes[ends[ends > 0] - 1] = full[ends[ends > 0] - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(closes) + 1 - start


def scan(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of the texts that lie in ``data`` between ``offsets``."""
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("words", "distinct", "capitals", "symbols", "chars")}
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        part = _scan_long(data, int(offsets[i]), int(offsets[j])) if j == i + 1 else _scan(data, offsets[i : j + 1])
        for k, v in part.items():
            out[k][i:j] = v
        i = j
    return out


def _counts(flags: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    def total(bit: int, n: np.ndarray | None = None) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64 if len(flags) >> 31 else np.int32)
        np.cumsum((flags & bit).astype(bool), dtype=sums.dtype, out=sums[1:])
        return np.diff(sums[ends])

    return {"capitals": total(_CAPITAL), "symbols": total(_SYMBOL), "chars": np.diff(ends) - total(_LATER)}


def _scan(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    lo, hi = int(offsets[0]), int(offsets[-1])
    padded = np.zeros(hi - lo + 16, np.uint8)
    padded[: hi - lo] = data[lo:hi]
    ends, flags = (offsets - lo).astype(np.int64), _CLASS[padded[: hi - lo]]
    start, size = _stretches(flags, ends[1:])
    starts = np.searchsorted(start, ends)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(starts))
    first, clash = _distinct(padded, doc, start, size, word_hashes(padded, start, size))
    distinct = np.bincount(doc[first], minlength=len(ends) - 1)
    for d in clash:
        distinct[d] = len(set(padded[ends[d] : ends[d + 1]].tobytes().split()))
    return {"words": np.diff(starts), "distinct": distinct, **_counts(flags, ends)}


def _scan_long(data: np.ndarray, lo: int, hi: int) -> dict[str, np.ndarray]:
    """One text, segment by segment; words of different segments meet by their distinct ones."""
    out = {k: np.zeros(1, np.int64) for k in ("words", "capitals", "symbols", "chars")}
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, clash = lo, False
    while at < hi:
        cut = min(at + SEGMENT, hi)
        while cut < hi and not _CLASS[data[cut - 1]] & _SPACE:  # a word ends with its segment
            gap = np.flatnonzero(_CLASS[data[cut : min(cut + SEGMENT, hi)]] & _SPACE)
            cut = cut + int(gap[0]) + 1 if len(gap) else min(cut + SEGMENT, hi)
        padded = np.zeros(cut - at + 16, np.uint8)
        padded[: cut - at] = data[at:cut]
        flags, ends = _CLASS[padded[: cut - at]], np.array([0, cut - at])
        start, size = _stretches(flags, ends[1:])
        hashes = word_hashes(padded, start, size)
        first, bad = _distinct(padded, np.zeros(len(start), np.int64), start, size, hashes)
        clash |= bool(len(bad))
        seen.append((start[first] + at, size[first], hashes[first]))
        out["words"] += len(start)
        for k, v in _counts(flags, ends).items():
            out[k] += v
        at = cut
    start, size, hashes = (np.concatenate(x) for x in zip(*seen, strict=True)) if seen else [np.zeros(0, np.int64)] * 3
    order = np.argsort(hashes, kind="stable")
    distinct, known = 0, None
    for i in order.tolist():  # one row a word and segment
        word = (int(hashes[i]), data[start[i] : start[i] + size[i]].tobytes())
        if known is None or known[0] != word[0]:
            distinct += 1
        elif known[1] != word[1]:
            clash = True
        known = word
    if clash:
        distinct = len(set(data[lo:hi].tobytes().split()))
    return out | {"distinct": np.array([distinct])}


def failures(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Bits 0 to 3: which of the filters A to D fail."""
    a = counts["words"] < LEAST_WORDS
    b = 100 * counts["distinct"] < LEAST_DISTINCT * counts["words"]
    c = 100 * counts["capitals"] > MOST_CAPITALS * counts["chars"]
    return (a + 2 * b + 4 * c + 8 * (counts["symbols"] > 0)).astype(np.int32)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column as they lie in memory; null texts are empty."""
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def measure(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text) -> doc_id, part, digest, words, distinct, capitals, symbols, chars, mask (filters A to D)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    names = ["words", "distinct", "capitals", "symbols", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = scan(*_buffers(b.column(3)))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(found[k], pa.int64()) for k in names], pa.array(failures(found), pa.int32())], ["doc_id", "part", "digest", *names, "mask"])

    work.small_batches(docs)
    return rows.mapInArrow(work.task(run), f"doc_id long, part string, digest binary, {', '.join(f'{k} long' for k in names)}, mask int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of a mask, E in bit 4."""
    rows = work.cut(measure(docs).select("doc_id", "part", "digest", "mask"), "filter-masks")
    known = rows.filter("doc_id is not null").groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(0).alias("again"))
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    known = known.join(first, ["digest", "doc_id"], "left").join(flags, "doc_id", "left")
    known = known.select("part", (F.col("mask") + F.when(F.col("again").isNull(), 16).otherwise(0)).alias("mask"), "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    nameless = rows.filter("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


#: All orders of the filters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _roles() -> list[tuple]:
    """(mask, filter_order, step, kept, removed, redundant, unique) for every mask, order and step."""
    out = []
    for mask in range(1 << len(FILTERS)):
        for order in ORDERS:
            before = 0
            for step, f in enumerate(order, 1):
                bit = 1 << FILTERS.index(f)
                out.append((mask, order, step, int(not mask & (before | bit)), int(bool(mask & bit) and not mask & before), int(bool(mask & bit) and bool(mask & before)), int(mask == bit)))
                before |= bit
    return out


def interactions(found: DataFrame) -> DataFrame:
    """masks() -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The roles of a mask in every order and step are a table of fixed size, joined on the mask; a part contributes at most 32 rows.
    """
    spark = found.sparkSession
    roles = spark.createDataFrame(_roles(), "mask int, filter_order string, step int, kept int, removed int, redundant int, sole int")
    j = found.join(F.broadcast(roles), "mask")
    total = lambda n, role: F.sum(F.col(n) * F.col(role))
    steps = j.groupBy("part", "filter_order", "step").agg(total("n", "kept").alias("kept"), total("n", "removed").alias("removed"), total("n", "redundant").alias("redundant"), total("n", "sole").alias("unique_fails"), total("good", "removed").alias("good_lost"), total("toxic", "removed").alias("toxic_lost"))
    # a filter that fails m filters' documents is the first of them in one order out of m: its sum over all orders needs masks only
    fails = F.size(F.filter(F.array(*[F.lit(i) for i in range(len(FILTERS))]), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0))
    shares = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n") * F.floor(F.lit(len(ORDERS)) / fails)).otherwise(0)).alias(f) for i, f in enumerate(FILTERS)]
    shapley = found.groupBy("part").agg(*shares).select("part", F.inline(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f).alias("shapley")) for f in FILTERS])))
    out = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).join(shapley, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text), labels(doc_id, quality, toxic) -> the interactions of all orders."""
    return interactions(work.cut(masks(docs, labels), "filter-sums"))
