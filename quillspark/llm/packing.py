"""Best-fit packing of tokenised documents into fixed-length sequences, after Martello-Toth dominance reduction.

Packing depends on piece lengths alone, and a histogram of at most ``capacity`` lengths holds all of them. The driver plans on
that histogram (bounded, whatever the corpus): first the dominance reduction fixes bins that an optimal packing may contain as
they are, then best-fit decreasing packs the remainder, many equal bins at a time. A plan is a list of bin patterns with
multiplicities. Pieces learn their place by their rank among pieces of their length, which is a local rank in their task plus
the task's offset for that length; no length, however frequent, meets in one task.

Defined cases: null text is empty and gives one piece that holds only the end token; an empty table gives no pieces; repeated
rows are packed each; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

CAPACITY, END_ID = 1024, 2
#: Chunks a worker keeps, and places in its table.
CACHE, SLOTS = 500_000, 1 << 20
#: Characters of text that are encoded together.
SLICE = 1 << 19
#: White space that the cutting rules do not know.
_OTHER = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class ChunkEncoder:
    """Token ids of a byte-level BPE in the JSON form of ``tokenizers``, many texts at a time.

    The vocabulary's pre-tokenizer always starts a token at a space between visible characters, at a full stop or comma after
    an ASCII letter, and around a line end between visible characters. Texts are cut there with array operations, and each chunk
    is looked up by a 64-bit hash (random byte values, polynomial in the position) in an open-addressing table of chunks whose ids
    the tokenizer gave before; a chunk's bytes are compared with the table's, so a collision of hashes is seen. Chunks met first go
    through the tokenizer together, a line end between them: its token stands alone there. Texts with other white space than space,
    line end, tab, carriage return go through the tokenizer whole, as do those with an added token of the vocabulary, and those with
    a chunk whose hash collides.
    """

    _P = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        plain, self.full = Tokenizer.from_file(path), Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        self.ids = lambda s: plain.encode_batch_fast([s], add_special_tokens=False)[0].ids  # no offsets are worked out
        with open(path, encoding="utf-8") as f:
            known = [x["content"] for x in json.load(f)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, known))) if known else None
        (self.line_end,) = self.ids("\n")
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.start, self.length = np.zeros(CACHE, np.int32), np.zeros(CACHE, np.int32)
        self.pool, self.n, self.used = np.zeros(1 << 20, np.uint32), 0, 0
        self.from_, self.size = np.zeros(CACHE, np.int32), np.zeros(CACHE, np.int32)
        self.bytes, self.held = np.zeros(1 << 20, np.uint8), 0

    def raw(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def _has_added(self, text: str) -> bool:
        return self.added is not None and self.added.search(text) is not None

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; give texts of a few megabytes together at most."""
        whole = {i for i, t in enumerate(texts) if _OTHER.search(t) or self._has_added(t)}
        data = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        b = np.frombuffer(b"".join(data), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        if not len(b):
            return [self.raw(t) for t in texts]
        cuts = self._cuts(b, first)
        if (found := self._look_up(b, cuts)) is None:
            return [self.raw(t) for t in texts]
        ids, ends, wrong = found
        whole |= set((np.searchsorted(first, cuts[wrong], "right") - 1).tolist())
        at = np.concatenate([[0], ends])[np.searchsorted(cuts, first)]
        return [self.raw(t) if i in whole else ids[at[i] : at[i + 1]] for i, t in enumerate(texts)]

    def _cuts(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where chunks start, and the end."""
        blank = b <= 32
        prev = np.concatenate([[True], blank[:-1]])
        nxt = np.concatenate([blank[1:], [True]])
        cut = (b == 32) & ~prev & ~nxt
        line = (b == 10) & ~prev & ~nxt
        cut |= line
        cut[1:] |= line[:-1]
        letter = ((b | 32) >= 97) & ((b | 32) <= 122)
        cut[1:] |= ((b[1:] == 46) | (b[1:] == 44)) & letter[:-1]
        cut[first[:-1][first[:-1] < len(b)]] = True
        return np.append(np.flatnonzero(cut), len(b))

    def _look_up(self, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of all chunks, where each chunk's end, and the chunks that the table holds other bytes for; None if they overfill it."""
        n = len(b) + 1
        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self._P)]), dtype=np.uint64)
            back = np.uint64(pow(int(self._P), -1, 1 << 64))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, back)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[b] * self.powers[: len(b)], dtype=np.uint64)])
        at, to = cuts[:-1], cuts[1:]
        h = (sums[to] - sums[at]) * self.inverses[at]
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        entry = self._find(h)
        lack = np.flatnonzero(entry < 0)
        if len(lack):
            _, one = np.unique(h[lack], return_index=True)
            if self.n + len(one) > CACHE:
                self._clear()
                lack = np.arange(len(h))
                _, one = np.unique(h, return_index=True)
                if len(one) > CACHE:
                    return None
            self._learn(b, at[lack[one]], to[lack[one]], h[lack[one]])
            entry[lack] = self._find(h[lack])
        wrong = np.flatnonzero(self.size[entry] != to - at)
        if not len(wrong):
            same = self.bytes[np.repeat(self.from_[entry] - at, to - at) + np.arange(len(b))] == b
            wrong = np.flatnonzero(~np.logical_and.reduceat(same, at))
        n_ids = self.length[entry].astype(np.int64)
        ends = np.cumsum(n_ids)
        return self.pool[np.repeat(self.start[entry] - (ends - n_ids), n_ids) + np.arange(ends[-1])], ends, wrong

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if unknown."""
        mask = np.uint64(SLOTS - 1)
        place = h & mask
        key = self.keys[place]
        out = np.where(key == h, self.slot[place], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            place[todo] = (place[todo] + np.uint64(1)) & mask
            key = self.keys[place[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.slot[place[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def _learn(self, b: np.ndarray, at: np.ndarray, to: np.ndarray, h: np.ndarray) -> None:
        data = b.tobytes()
        parts = [data[i:j].decode() for i, j in zip(at.tolist(), to.tolist(), strict=True)]
        # a chunk stands alone if what follows its first space is blank at an end or holds a line end
        odd = np.array([not (x := p[1:] if p[0] == " " else p) or x[0].isspace() or x[-1].isspace() or "\n" in x for p in parts])
        plain = np.flatnonzero(~odd)
        ids = np.array(self.ids("\n".join([parts[i] for i in plain.tolist()])), np.uint32) if len(plain) else np.zeros(0, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
        if len(plain) and len(ends) != len(plain):  # never seen: a part that holds the line end's token
            odd[:], plain = True, plain[:0]
        span = np.zeros((len(parts), 2), np.int64)
        if len(plain):
            span[plain, 0], span[plain, 1] = np.concatenate([[0], ends[:-1] + 1]), ends
        extra, base = [], len(ids)
        for i in np.flatnonzero(odd).tolist():
            extra.append(np.array(self.ids(parts[i]), np.uint32))
            span[i] = base, base + len(extra[-1])
            base += len(extra[-1])
        all_ids = np.concatenate([ids, *extra]) if extra else ids
        while self.used + len(all_ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(all_ids)] = all_ids
        k = len(parts)
        self.start[self.n : self.n + k] = self.used + span[:, 0]
        self.length[self.n : self.n + k] = span[:, 1] - span[:, 0]
        raw = b[np.repeat(at - (np.cumsum(to - at) - (to - at)), to - at) + np.arange((to - at).sum())]
        while self.held + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.held : self.held + len(raw)] = raw
        self.from_[self.n : self.n + k], self.size[self.n : self.n + k] = self.held + np.cumsum(to - at) - (to - at), to - at
        self.held += len(raw)
        entry = np.arange(self.n, self.n + k, dtype=np.int32)
        self.n, self.used = self.n + k, self.used + len(all_ids)
        mask = np.uint64(SLOTS - 1)
        place, todo = h & mask, np.arange(k)
        while len(todo):
            free = todo[self.keys[place[todo]] == 0]
            self.keys[place[free]] = h[free]  # of those that want one place, the last stays
            self.slot[place[free]] = entry[free]
            todo = todo[self.keys[place[todo]] != h[todo]]
            place[todo] = (place[todo] + np.uint64(1)) & mask


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder, kept from task to task with what it has learnt."""
    return work.keep(("encoder", path), lambda: ChunkEncoder(path))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids (little-endian uint32), lazily.

    A document longer than ``capacity`` is cut into full pieces; the first one takes what is left over.
    """
    work.small_batches(docs)
    tail = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        names = ["doc_id", "piece", "start", "length", "ids"]
        for b in batches:
            docs_, texts, held = b.column(0).to_pylist(), [], 0
            for i, text in enumerate(b.column(1)):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > SLICE or i == len(docs_) - 1:
                    rows: list[tuple] = []
                    for doc, ids in zip(docs_[i + 1 - len(texts) :], coder.encode_all(texts), strict=False):
                        n = len(ids) + 1
                        ids = np.concatenate([ids, tail]).astype("<u4").tobytes()
                        cut, start, k = n % capacity or capacity, 0, 0
                        while start < n:
                            rows.append((doc, k, start, cut - start, ids[4 * start : 4 * cut]))
                            start, cut, k = cut, cut + capacity, k + 1
                    yield _batch(rows, names)
                    texts, held = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work.task(run), "doc_id long, piece int, start long, length long, ids binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Dominance reduction on a histogram of lengths: (fixed bins with multiplicities, lengths that are left).

    A bin that holds a piece of length ``a`` and dominates every other filling with that piece is fixed: wherever an optimal
    packing has another filling, its pieces may be exchanged for the bin's without needing more bins. Such bins are

    * ``{a}`` when nothing fits beside it,
    * ``{a, b}``, b the longest that fits, when it fills the bin, or when no three others fit and no two are longer than b together,
    * ``{a, b, c}``, c the longest that fits beside a and b, when no three others fit and no two that are both longer than c do.

    Every length is tried against all that are not fixed yet, longest first, until a pass fixes nothing.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    while True:
        done = sum(k for _, k in fixed)
        for a in sorted(left, reverse=True):
            while left.get(a) and (found := _dominant(a, left, capacity)):
                k = min(left[s] // found.count(s) for s in set(found))
                fixed.append((found, k))
                for s in found:
                    left[s] -= k
                for s in set(found):
                    if not left[s]:
                        del left[s]
        if sum(k for _, k in fixed) == done:
            return fixed, left


def _dominant(a: int, left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The bin with a piece of length a that dominates all others, if there is one among those looked for."""
    r = capacity - a
    free = sorted((s, n - (s == a)) for s, n in left.items() if s <= r and n > (s == a))
    if not free:
        return (a,)
    b = free[-1][0]
    if b == r:
        return a, b
    if _smallest(free, 3) <= r:
        return None
    if _best_pair(free, r) <= b:
        return a, b
    free[-1] = (b, free[-1][1] - 1)
    others = [(s, n) for s, n in free if n]
    c = max((s for s, _ in others if s <= r - b), default=0)
    return (a, b, c) if c and _smallest([x for x in others if x[0] > c], 2) > r else None


def _smallest(free: list[tuple[int, int]], k: int) -> int:
    """Sum of the k smallest pieces, beyond any capacity if there are fewer."""
    total = 0
    for s, n in free:
        take = min(k, n)
        total, k = total + take * s, k - take
        if not k:
            return total
    return 1 << 40


def _best_pair(free: list[tuple[int, int]], r: int) -> int:
    """Longest sum of two pieces that does not exceed r, 0 if there is none."""
    i, j, best = 0, len(free) - 1, 0
    while i <= j:
        s = free[i][0] + free[j][0]
        if s > r:
            j -= 1
        else:
            if i < j or free[i][1] > 1:
                best = max(best, s)
            i += 1
    return best


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each k, long pieces that share no bin, and what the short ones of k or more need beyond them."""
    best = 0
    for k in {0, *(s for s in counts if 2 * s <= capacity)}:
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        wide = [(s, n) for s, n in counts.items() if capacity - k >= s and 2 * s > capacity]
        room = sum((capacity - s) * n for s, n in wide)
        rest = sum(s * n for s, n in counts.items() if k <= s and 2 * s <= capacity) - room
        best = max(best, alone + sum(n for _, n in wide) + max(0, -(-rest // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram; bins that look alike are filled together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by space left
    done: list[tuple[tuple[int, ...], int]] = []

    def add(held: tuple[int, ...], k: int, space: int) -> None:
        if space == 0:
            done.append((held, k))
            return
        room[space].append((held, k))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        for space in sorted(x for x in room if x >= s and room[x]):
            while n and room[space]:
                held, k = room[space].pop()
                each = space // s
                full = min(k, n // each)
                if full:
                    add(held + (s,) * each, full, space - each * s)
                n -= full * each
                k -= full
                if k and n:
                    add(held + (s,) * n, 1, space - n * s)
                    k, n = k - 1, 0
                if k:
                    room[space].append((held, k))
            if not n:
                break
        if n:
            each = capacity // s
            if n // each:
                add((s,) * each, n // each, capacity - each * s)
            if n % each:
                add((s,) * (n % each), 1, capacity - (n % each) * s)
    return done + [x for v in room.values() for x in v]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns with multiplicities that hold every piece of the histogram once."""
    fixed, left = reduce_instance(counts, capacity)
    return [x for x in fixed if x[1]] + best_fit(left, capacity)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), one for each slot of a pattern; ranks run over its bins."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for held, k in patterns:
        at = 0
        for s in held:
            out[s].append((rank[s], sequence, at))
            rank[s] += k
            at += s
        sequence += k
    return {s: np.array(v, np.int64) for s, v in out.items()}


def assign(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """placed: a stored table with a length column -> the same rows with sequence_id and offset.

    Reads the table twice: once for lengths by task, once to deal out places. Both read it in the same partitions, which
    ``cell`` (stored with each row) names; ranks within a cell follow the stored order.
    """
    hist = placed.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    table = _places(plan({r["length"]: r["n"] for r in hist}, capacity))
    kinds = placed.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    names = placed.columns
    at, cell_at = names.index("length"), names.index("base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(at).to_numpy()
            ranks = b.column(cell_at).to_numpy()
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                slots = table[int(lengths[rows[0]])]
                k = np.searchsorted(slots[:, 0], ranks[rows], "right") - 1
                seq[rows] = slots[k, 1] + ranks[rows] - slots[k, 0]
                off[rows] = slots[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return placed.mapInArrow(work.task(run), f"{kinds}, sequence_id long, offset long")


def ranked(stored: DataFrame) -> DataFrame:
    """stored(cell, nth, length, ..) -> with ``base``, the row's rank among all rows of its length.

    nth is the row's rank among rows of its length in its cell. The counts by (cell, length) are running-summed by length over
    cells in two levels, so the largest sort group is a block of cells, not a length.
    """
    count = stored.groupBy("length", "cell").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    block = F.floor(F.col("cell") / 256)
    inner = count.withColumn("block", block).withColumn("before", F.sum("n").over(W.partitionBy("length", "block").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)))
    total = count.groupBy("length", block.alias("block")).agg(F.sum("n").alias("n"))
    outer = total.select("length", "block", F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("blocks_before"))
    offsets = inner.join(outer, ["length", "block"]).select("length", "cell", (F.coalesce("before", F.lit(0)) + F.coalesce("blocks_before", F.lit(0))).alias("rank_from"))
    return stored.join(offsets, ["length", "cell"]).withColumn("base", F.col("rank_from") + F.col("nth")).drop("rank_from", "cell", "nth")


def numbered(df: DataFrame) -> DataFrame:
    """df(.., length) -> with cell (the task) and nth (rank among the task's rows of that length), in one streaming pass."""
    kinds = df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    names = df.columns
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            nth = []
            for s in b.column(at).to_pylist():
                nth.append(seen[s])
                seen[s] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([cell] * len(nth), pa.int64()), pa.array(nth, pa.int64())], [*names, "cell", "nth"])

    return df.mapInArrow(work.task(run), f"{kinds}, cell long, nth long")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces(.., length) -> the same rows with sequence_id and offset, gapless from 0 in every sequence (columns of these names go).

    The rows are written to the shared folder with their task and local rank first, so a lost executor cannot renumber them.
    """
    names = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset")]
    own = ["length" if c == "length" else f"c{i}" for i, c in enumerate(names)]  # whatever names the input has
    plain = cut_pieces.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, own, strict=True)])
    stored = work.cut(numbered(plain), "pieces")
    return assign(ranked(stored), capacity).select(*own, "sequence_id", "offset").toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed corpus itself: doc_id, piece, start, length, ids, sequence_id, offset."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)


def default_tokenizer() -> str:
    """The byte-level BPE of the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
