"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage within ``k`` edits of an item of length ``m`` shares at least ``m - q + 1 - k q`` character q-grams with it, and all of them
lie on diagonals (document position minus item position) that differ by no more than ``k``. Diagonals are dealt to overlapping bands
of twice that width, each ``k + 1`` after the last, so one band holds them all. Bands that reach the bound are verified by an
alignment confined to their diagonals.

Text is compared as UTF-8 bytes with A-Z lower-cased and white space made spaces, one for one, so offsets stay those of the text.
The edit budget of an item is ``RATE`` of its length, with q-grams of ten bytes, or of five for items of less than 40. Items of less
than 12 bytes have no budget and no use for q-grams: they are looked for as they are, where no letter or digit goes on from them.
Items are held by every task, in blocks of at most ``BLOCK_BYTES``; a larger benchmark takes one pass over the documents for each.

Defined cases: null and empty texts hold nothing; null and blank items match nothing; white space around an item is not part of it;
equal items are all reported; an empty benchmark or table gives an empty result; a null doc_id is reported as null; repeated rows
are all reported; extra columns pass through ``clean``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

RATE = 0.08
#: Length of q-grams for items of at least so many bytes and less than so many: short enough for the lemma to ask for shared ones.
CLASSES = [(10, 40, 1 << 62), (5, 12, 40)]
#: Bytes of items that are held at once, and places in items that hits of common q-grams are expanded to at a time.
BLOCK_BYTES, EXPAND = 2 << 20, 1 << 20
#: Bytes of text that are scanned together, and bits of the first filter's address.
SLICE, FIELD = 1 << 19, 22
_FOLD = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
_P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that go on a word: ASCII letters and digits, and all of other characters.
_INNER = [bytes([x]).isalnum() or x >= 128 for x in range(256)]
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class Grams:
    """Hashes of all q-grams of a byte string."""

    def __init__(self, q: int):
        self.q = q
        self.values = np.random.default_rng(13).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, b: np.ndarray) -> np.ndarray:
        n, q = len(b), self.q
        if n < q:
            return np.empty(0, np.uint64)
        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P)]), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[b] * self.powers[:n], dtype=np.uint64)])
        h = (sums[q:] - sums[:-q]) * self.inverses[: n - q + 1]
        return h ^ (h >> np.uint64(31))


def budget(m: int) -> int:
    """Edits that a passage may be away from an item of m bytes."""
    return int(RATE * m)


def align(item: bytes, region: bytes, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """Best (distance, start, end) of item in region along diagonals lo - k .. hi + k, None beyond k edits."""
    at = region.find(item, max(0, lo), max(0, hi) + len(item) + k)
    if at >= 0:
        return 0, at, at + len(item)
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8)
    low, width, one = lo - k, hi - lo + 2 * k + 1, np.int64(1) << 32
    far, steps = one * (len(item) + 1), np.arange(width, dtype=np.int64) * (np.int64(1) << 32)
    cols = low + np.arange(width, dtype=np.int64)  # ends of a prefix of region, for 0 bytes of item
    row = np.where((cols >= 0) & (cols <= len(b)), cols, far)  # distance and start in one number
    for i in range(len(a)):
        cols += 1
        inside = (cols >= 0) & (cols <= len(b))
        same = np.zeros(width, bool)
        reads = (cols >= 1) & (cols <= len(b))
        same[reads] = b[cols[reads] - 1] == a[i]
        new = row + np.where(same, 0, one)
        new[:-1] = np.minimum(new[:-1], row[1:] + one)
        new = np.minimum.accumulate(np.where(inside, new, far) - steps) + steps
        row = np.where(inside, new, far)
        if row.min() >= one * (k + 1):
            return None
    j = int(np.argmin(row))
    d, start = int(row[j] >> 32), int(row[j] & (one - 1))
    return (d, start, int(cols[j])) if d <= k else None


class _Index:
    """The q-grams of items of one class of length, and the bands that a text's q-grams fall into."""

    def __init__(self, items: list[bytes], q: int):
        self.q, self.grams, n_items = q, Grams(q), len(items)
        self.length = np.array([len(t) for t in items], np.int64)
        self.k = np.array([budget(int(m)) for m in self.length], np.int64)
        self.bound = self.length - q + 1 - self.k * q
        codes = [self.grams.of(np.frombuffer(t, np.uint8)) for t in items]
        n = np.array([len(x) for x in codes], np.int64)
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.item = np.repeat(np.arange(n_items), n)[order]
        self.place = np.concatenate([np.arange(x) for x in n])[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.field = np.zeros(1 << FIELD, bool)
        self.field[(self.code >> np.uint64(64 - FIELD)).astype(np.int64)] = True

    def regions(self, b: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, lowest and highest diagonal) of the bands with as many shared q-grams as a passage within budget has."""
        h = self.grams.of(b)
        pos = np.flatnonzero(self.field[(h >> np.uint64(64 - FIELD)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.code, h[pos]), len(self.code) - 1)
        hit = self.code[at] == h[pos]
        pos, at = pos[hit], at[hit]
        text = np.searchsorted(ends, pos, "right")
        within = pos + self.q <= ends[text]
        pos, at, text = pos[within], at[within], text[within]
        if not len(pos):
            return
        starts, n = np.concatenate([[0], ends]), self.count[at]
        to, n_items = np.cumsum(n), len(self.length)
        wide = int(((np.diff(starts).max() + self.length.max()) // (self.k + 1)).max()) + 3
        keys, seen, i = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while i < len(pos):  # as many hits at a time as have ``EXPAND`` places in items, and one at least
            j = max(i + 1, int(np.searchsorted(to, (to[i - 1] if i else 0) + EXPAND, "right")))
            m, base = n[i:j], to[i:j] - n[i:j]
            entry = np.repeat(self.first[at[i:j]] - (base - base[0]), m) + np.arange(m.sum())
            item = self.item[entry]
            diagonal = np.repeat(pos[i:j] - starts[text[i:j]], m) - self.place[entry]
            band = (diagonal + self.length[item]) // (self.k[item] + 1) + 1
            key = (np.repeat(text[i:j], m) * n_items + item) * wide + band
            new, times = np.unique(np.concatenate([key, key - 1]), return_counts=True)  # a band and the one before it hold each hit
            both, which = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, seen = both, np.bincount(which, np.concatenate([seen, times]), len(both)).astype(np.int64)
            i = j
        pair, band = keys // wide, keys % wide - 1
        item = pair % n_items
        for x in np.flatnonzero(seen >= self.bound[item]).tolist():
            i = int(item[x])
            lo = int(band[x]) * int(self.k[i] + 1) - int(self.length[i])
            yield int(pair[x] // n_items), i, lo, lo + 2 * int(self.k[i] + 1) - 1


def _whole_words(item: bytes, text: bytes) -> Iterator[tuple[int, int]]:
    """Places of item that no letter or digit goes on from."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if not (_INNER[item[0]] and at and _INNER[text[at - 1]] or _INNER[item[-1]] and end < len(text) and _INNER[text[end]]):
            yield at, end
        at = text.find(item, at + 1)


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, t.strip()) for i, t in items if t.strip()]
        self.classes = []
        for q, least, most in CLASSES:
            own = [x for x, (_, t) in enumerate(self.items) if least <= len(t) < most]
            if own:
                self.classes.append((own, _Index([self.items[x][1] for x in own], q)))
        self.short = [x for x, (_, t) in enumerate(self.items) if len(t) < CLASSES[-1][1]]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, distance) of passages within budget; texts: some megabytes together."""
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        b = np.frombuffer(b"".join(texts), np.uint8)
        out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for own, index in self.classes:
            for t, x, lo, hi in index.regions(b, ends):
                item, k = self.items[own[x]][1], int(index.k[x])
                cut = max(0, lo - k)
                region = texts[t][cut : max(0, hi + len(item) + 2 * k)]
                got = align(item, region, lo - cut, hi - cut, k)
                if got:
                    out.setdefault((t, own[x]), []).append((got[0], got[1] + cut, got[2] + cut))
        for x in self.short:
            for t, text in enumerate(texts):
                for s, e in _whole_words(self.items[x][1], text):
                    out.setdefault((t, x), []).append((0, s, e))
        found = []
        for (t, i), spans in out.items():
            kept: list[tuple[int, int, int]] = []
            for d, s, e in sorted(spans):  # of overlapping finds, the nearest
                near = kept[-1:] if d == 0 else kept  # exact ones come in order of place
                if all(e <= s2 or s >= e2 for _, s2, e2 in near):
                    kept.append((d, s, e))
            found += [(t, i, s, e, d) for d, s, e in kept]
        return sorted(found)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    t = benchmark.select("item_id", "text").filter("text is not null")
    total = t.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        part = t.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r["item_id"], fold(r["text"])) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    start, texts, held = 0, [], 0
    for i, t in enumerate(column):
        texts.append(fold(t.as_py()))
        held += len(texts[-1])
        if held > SLICE:
            yield start, texts
            start, texts, held = i + 1, [], 0
    if texts:
        yield start, texts


def _matching(docs: DataFrame, items: list) -> Callable[[], Matcher]:
    given = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES and a row's overhead
    key = ("matcher", uuid.uuid4().hex)
    return lambda: work.keep(key, lambda: Matcher(given.value))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, start, end (in code points), distance (in bytes)."""
    work.small_batches(docs)
    schema = "doc_id long, item_id long, start long, end long, distance int"
    given, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for items in _blocks(benchmark):
        matcher = _matching(docs, items)

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            m = matcher()
            for b in batches:
                rows = []
                for first, texts in _slices(b.column(1)):
                    for t, i, s, e, d in m.find(texts):
                        raw = b.column(1)[first + t].as_py().encode("utf-8", "surrogatepass")
                        chars = [len(raw[:x].decode("utf-8", "ignore")) for x in (s, e)]
                        rows.append((b.column(0)[first + t].as_py(), m.items[i][0], *chars, d))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "distance"])

        part = given.mapInArrow(work.task(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark; one pass for each block of items, no shuffle."""
    work.small_batches(docs)
    names = docs.columns
    at = names.index("text")
    for items in _blocks(benchmark):
        matcher = _matching(docs, items)

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            m = matcher()
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, texts in _slices(b.column(at)):
                    for t, *_ in m.find(texts):
                        keep[first + t] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(work.task(run), docs.schema)
    return docs
