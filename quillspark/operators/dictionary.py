"""All terms of a dictionary in all texts at once, by an Aho-Corasick automaton: one pass over a text whatever the number of terms.

The terms are collected in parts of a checked size; each part is broadcast and built into an automaton once a worker, and texts are
passed over once a part. Only ids, terms and places leave the pass, so a text is neither shuffled nor paired with terms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of terms that go into one automaton (some tens of bytes each).
PART_CHARS = 4_000_000

_built: dict = {}


def _automaton(key: str, terms: list[str]):
    """The automaton of this worker for a part; it keeps one at a time."""
    if key not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            made.add_word(t, (i, len(t)))
        made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]


def find_terms(texts: DataFrame, keys: list[str], text: Column, dictionary: DataFrame) -> DataFrame:
    """texts with its columns ``keys``, dictionary(term) -> keys, term, first, n: each term that occurs in ``text`` with its first place
    (0-based, in characters) and the number of its places, overlapping ones included.

    Case matters: lower both sides to ignore it. Null texts and null or empty terms have no hits; repeated terms count once.
    """
    spark = texts.sparkSession
    terms = dictionary.select("term").filter("term is not null and term <> ''").distinct()
    chars = terms.agg(F.sum(F.length("term") + 1)).first()[0]
    if not chars:
        return texts.select(*keys).limit(0).select("*", F.lit("").alias("term"), F.lit(0).alias("first"), F.lit(0).alias("n"))
    parts = -(-chars // PART_CHARS)
    fields = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in keys], "term string, first int, n int"])
    rows = texts.select(*keys, text.alias("_text")).filter("_text is not null")
    out = None
    for p in range(parts):
        own = [r["term"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == p).collect()]
        if own:
            found = rows.mapInArrow(_finder(spark.sparkContext.broadcast(own), len(keys)), schema)
            out = found if out is None else out.unionByName(found)
    return out


def _finder(given, n_keys: int):
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        for b in batches:
            terms = given.value
            machine = _automaton(key, terms)
            row, term, first, count = [], [], [], []
            for i, text in enumerate(b.column(n_keys).to_pylist()):
                seen: dict[int, list[int]] = {}
                for end, (t, size) in machine.iter(text):
                    if t in seen:
                        seen[t][1] += 1
                    else:
                        seen[t] = [end + 1 - size, 1]
                row += [i] * len(seen)
                term += [terms[t] for t in seen]
                first += [x[0] for x in seen.values()]
                count += [x[1] for x in seen.values()]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:n_keys]], pa.array(term, pa.string()), pa.array(first, pa.int32()), pa.array(count, pa.int32())], [*b.schema.names[:n_keys], "term", "first", "n"])

    return run
