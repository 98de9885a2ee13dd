"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Words are runs of letters and digits and runs of other visible characters; a word that only repeats the one before it is read as a
word of its own that says so. Each has a sparse ternary index vector, drawn by its
hash. The words of the training rows have a context vector besides, learnt there: the sum of the index vectors around their
occurrences. A document is the mean of its words' index vectors beside the mean of their context vectors. A network with one
hidden layer is trained on the standardised means; a temperature fitted on training rows it did not see makes its output a
probability.

The fit uses a bounded sample of labelled rows (``TRAIN_ROWS``, those with the smallest hash of their doc_id, so the sample is the
same wherever it runs), with their whole texts, which stay where they are: counts of words, sums of contexts (integers, so in any
order) and pooled vectors are worked out in tasks, and the driver gets the vocabulary, its context vectors and a vector a row, all of
bounded size. Scoring covers every row and the whole text, in one pass without a shuffle; the model's size is fixed.

Defined cases: null and empty texts have a zero vector and are scored like any other; labels that are null or not 0 or 1 are not
learnt from, and of conflicting labels of a document 1 counts; of a repeated doc_id the text with the smallest hash is learnt from; with
no usable label or a single class, the score of every row is that class's share (0.5 with none); a null doc_id counts as held out; an
empty table gives an empty result; columns other than text are never read by a score.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work

#: Labelled rows that the fit may use, the tasks that their texts are dealt to, and of the rows how many in five are kept for the
#: temperature.
TRAIN_ROWS, TRAIN_TASKS, CALIBRATE_OF_5 = 6_000, 8, 1
#: Length of a vector, its non-zero places, words on either side that make a context, and words that have one: those that occur
#: often enough in training, the most frequent first.
DIM, NONZERO, WINDOW, VOCABULARY, LEAST = 128, 4, 2, 1 << 15, 3
#: Characters of the longest word that has a context vector, distinct words that a task counts at a time, words in a piece of sums.
LONGEST, COUNTED, PIECE = 64, 1 << 17, 512
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 64, 3e-3, 1e-4
THRESHOLD = 0.7
#: Distinct words that a worker remembers, and words of a text that are summed at a time.
CACHE, SUM = 100_000, 1 << 14
#: The word that stands for a repetition of the word before; no text holds it, as words have no blanks.
AGAIN = "same again"
_WORD = re.compile(r"\w+|[^\w\s]+")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, and runs of other visible characters, lower-cased; one that follows itself reads ``AGAIN``."""
    words = _WORD.findall((text or "").lower())
    return [AGAIN if a == b else a for a, b in zip(words, ["", *words], strict=False)]


def index_vector(word: str) -> tuple[list[int], list[int]]:
    """Places and signs of a word's sparse index vector, drawn by its hash, so no two words share one by design."""
    h, places, signs = xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass"), 11), [], []
    while len(places) < NONZERO:
        h, at = divmod(h, DIM)
        h, sign = divmod(h, 2)
        if h == 0:
            h = xxhash.xxh3_128_intdigest(f"{word} {len(places)}".encode("utf-8", "surrogatepass"), 12)
        if at not in places:
            places.append(at)
            signs.append(2 * sign - 1)
    return places, signs


class Words:
    """Numbers of words with their index vectors, remembered; the vocabulary's words come first and stay."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = vocabulary
        self.places = np.zeros((len(vocabulary) + CACHE, NONZERO), np.int16)
        self.signs = np.zeros((len(vocabulary) + CACHE, NONZERO), np.int8)
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        for word in self.vocabulary:
            self._add(word)

    def _add(self, word: str) -> int:
        if len(self.seen) >= len(self.places):
            return -1
        self.seen[word] = i = len(self.seen)
        self.places[i], self.signs[i] = index_vector(word)
        return i

    def of(self, words: list[str]) -> np.ndarray:
        """Numbers of the words; give at most ``CACHE`` at a time."""
        got = list(map(self.seen.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    x = self.seen.get(words[i])
                    got[i] = self._add(words[i]) if x is None else x
            if -1 in got:  # no room left
                self._clear()
                return self.of(words)
        return np.array(got, np.int64)


@dataclass
class Model:
    vocabulary: list[str]
    context: np.ndarray  # a row a word of the vocabulary
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def pooled(words: Words, context: np.ndarray, text: str | None) -> np.ndarray:
    """A document's vector: the mean of its words' index vectors and the mean of their context vectors."""
    every = words_of(text)
    out = np.zeros(2 * DIM)
    for i in range(0, len(every), SUM):
        own = words.of(every[i : i + SUM])
        out[:DIM] += np.bincount(words.places[own].ravel(), words.signs[own].ravel(), DIM)
        known, times = np.unique(own[own < len(context)], return_counts=True)
        out[DIM:] += times @ context[known]
    return out / max(1, len(every))


def _vocabulary(counts: Iterable[tuple[str, int]]) -> list[str]:
    return [w for w, n in sorted(counts, key=lambda x: (-x[1], x[0])) if n >= LEAST and len(w) <= LONGEST][:VOCABULARY]


def _context_sums(texts: Iterable[str | None], words: Words) -> np.ndarray:
    """For each word of the vocabulary the index vectors of all words within the window around its occurrences, summed."""
    n, size = len(words.vocabulary), len(words.places)
    out = np.zeros((n, DIM), np.int32)
    for text in texts:
        every = words_of(text)
        for part in range(0, len(every), SUM):
            own = words.of(every[part : part + SUM])
            for d in range(1, WINDOW + 1):
                for a, b in ((own[:-d], own[d:]), (own[d:], own[:-d])):
                    pairs, times = np.unique((a * size + b)[a < n], return_counts=True)
                    a, b = pairs // size, pairs % size
                    np.add.at(out, (a[:, None], words.places[b]), (words.signs[b] * times[:, None]).astype(np.int32))
    return out


def _unit(sums: np.ndarray) -> np.ndarray:
    out = sums.astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


def calibrates(doc_id: object) -> bool:
    """Whether a row is kept for the temperature."""
    return zlib.crc32(f"{doc_id} calibrates".encode()) % 5 < CALIBRATE_OF_5


def fit(texts: list[str | None], labels: np.ndarray, ids: list | None = None) -> Model:
    """Train on texts with labels 0 or 1 in one process; deterministic, and what ``train`` gives for the same rows in order of doc_id."""
    cal = np.array([calibrates(i) for i in (ids if ids is not None else range(len(texts)))], bool)
    counts: Counter[str] = Counter()
    for text, kept in zip(texts, cal, strict=True):
        if not kept:
            counts.update(words_of(text))
    words = Words(_vocabulary(counts.items()))
    context = _unit(_context_sums((t for t, kept in zip(texts, cal, strict=True) if not kept), words))
    x = np.array([pooled(words, context, t) for t in texts]).reshape(len(texts), 2 * DIM)
    return _network(words.vocabulary, context, x, np.asarray(labels), cal)


def _network(vocabulary: list[str], context: np.ndarray, x: np.ndarray, labels: np.ndarray, kept: np.ndarray, seed: int = 3) -> Model:
    """The model over pooled vectors; kept: rows that only the temperature learns from."""
    none = np.zeros(0)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Model([], np.zeros((0, DIM), np.float32), none, none, none, none, none, 0.0, 1.0, share)
    rng = np.random.default_rng(seed)
    cal, train = np.flatnonzero(kept), np.flatnonzero(~kept)
    train, cal = (train if len(train) else cal), (cal if len(cal) else train)
    y = labels.astype(float)
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-6
    xs = (x - mean) / scale
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            h = np.tanh(xs[rows] @ w[0] + w[1])
            err = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -60, 60))) - y[rows]) / len(rows)
            back = err[:, None] * w[2] * (1 - h * h)
            step += 1
            for i, g in enumerate((xs[rows].T @ back + DECAY * w[0], back.sum(0), h.T @ err + DECAY * w[2], err.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    z = np.tanh(xs[cal] @ w[0] + w[1]) @ w[2] + w[3]
    heats = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.logaddexp(0, np.where(y[cal] > 0, -z, z) / t).mean() for t in heats]
    return Model(vocabulary, context, mean, scale, w[0], w[1], w[2], float(w[3][0]), float(heats[int(np.argmin(loss))]))


def _word_counts(rows: DataFrame) -> DataFrame:
    """rows(text) -> word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for b in batches:
            for text in b.column(0):
                every = words_of(text.as_py())
                for i in range(0, len(every), SUM):
                    counts.update(x for x in every[i : i + SUM] if len(x) <= LONGEST)
                    if len(counts) > COUNTED:
                        yield out()
        yield out()

    return rows.select("text").mapInArrow(work.task(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def _contexts(rows: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """Context vectors of the vocabulary from rows(text): tasks' sums come in pieces and are added up before they reach the driver."""
    given, key, n = rows.sparkSession.sparkContext.broadcast(vocabulary), ("contexts", uuid.uuid4().hex), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = work.keep(key, lambda: Words(given.value))
        sums = np.zeros((n, DIM), np.int32)
        for b in batches:
            sums += _context_sums((t.as_py() for t in b.column(0)), words)
        parts = [sums[i : i + PIECE].tobytes() for i in range(0, n, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["piece", "sums"])

    def add(k, pdf):
        import pandas as pd

        return pd.DataFrame({"piece": [k[0]], "sums": [sum(np.frombuffer(x, np.int32) for x in pdf["sums"]).tobytes()]})  # a row a task

    out = np.zeros((n, DIM), np.int32)
    for r in rows.select("text").mapInArrow(work.task(run), "piece int, sums binary").groupBy("piece").applyInPandas(add, "piece int, sums binary").collect():  # VOCABULARY * DIM numbers in all
        part = np.frombuffer(r["sums"], np.int32).reshape(-1, DIM)
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(part)] = part
    return _unit(out)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out, with their whole texts."""
    work.small_batches(docs)
    y = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    y = y.filter(~held_out(F.col("doc_id"))).select("doc_id", "quality", F.xxhash64("doc_id").alias("turn")).orderBy("turn", "doc_id").limit(max_rows).drop("turn")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")  # max_rows rows of y
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("x"))  # repeated doc_ids
    rows = work.cut(one.repartition(min(TRAIN_TASKS, work.tasks(docs.sparkSession)), "doc_id").select("doc_id", "x.text", "x.quality"), "quality-rows")
    kept = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(" calibrates")).cast("binary")) % 5 < CALIBRATE_OF_5
    learn = rows.filter(~kept)
    counts = _word_counts(learn).filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    vocabulary = _vocabulary((r["word"], r["n"]) for r in counts)
    context = _contexts(learn, vocabulary) if vocabulary else np.zeros((0, DIM), np.float32)
    given, key = docs.sparkSession.sparkContext.broadcast((vocabulary, context)), ("pooled", uuid.uuid4().hex)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = work.keep(key, lambda: Words(given.value[0]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([pooled(words, given.value[1], t.as_py()).tobytes() for t in b.column(2)], pa.binary())], ["doc_id", "quality", "x"])

    got = rows.select("doc_id", "quality", "text").mapInArrow(work.task(pool), f"doc_id long, quality {dict(rows.dtypes)['quality']}, x binary").toPandas()  # max_rows vectors of a fixed length
    got = got.sort_values("doc_id", kind="stable")
    x = np.array([np.frombuffer(v) for v in got["x"]]).reshape(len(got), 2 * DIM)
    model = _network(vocabulary, context, x, got["quality"].to_numpy(int), np.array([calibrates(i) for i in got["doc_id"]], bool))
    work.drop(rows)
    work.tidy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added (columns of these names go)."""
    work.small_batches(docs)
    given, key = docs.sparkSession.sparkContext.broadcast(model), ("quality", uuid.uuid4().hex)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = [f"c{i}" for i in range(len(names))]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = work.keep(key, lambda: (given.value, Words(given.value.vocabulary)))
        for b in batches:
            x = np.array([pooled(words, m.context, t.as_py()) for t in b.column(at)]).reshape(b.num_rows, -1)
            s = m.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], [*own, "score", "predicted"])

    fields = ", ".join(f"{x} {kinds[c]}" for c, x in zip(names, own, strict=True))
    plain = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(names, own, strict=True)])
    return plain.mapInArrow(work.task(run), f"{fields}, score double, predicted int").toDF(*names, "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs -> doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
