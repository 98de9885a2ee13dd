"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only. A text is its lower-cased runs of letters and digits; its shingles are five of them in a row. A window is
``WINDOW`` shingles in a row (a template of fewer is one window); windows start at every shingle. Each window has ``BANDS`` minima,
under as many hash orders, one row a band. Two windows that share the share j of their shingles meet in some band with probability
1 - (1 - j) ** BANDS, 0.998 for j = 0.8, and equal windows meet with certainty.

Shingles that no template holds can be no common minimum, so a text is reduced to those that some template may hold first: a Bloom
filter of the templates' shingles is tried where the text is read. Of the windows of what is left, those that share a band with a
template's window name a place at which the template may stand. The place is verified exactly: the share of the template's distinct
shingles that the document holds in the region around must reach ``CONTAINED``. A template that is contained to that share keeps
a window untouched: an edit inside it costs at least four of its shingles, so one of n shingles has at most n / 20 of them, and
between two of these there are runs of eight on average; below n = 20 only its ends can be lost.

Defined cases: null and empty texts, and those of fewer than five words, hold no license; a null doc_id is reported as null;
repeated rows are all reported; equal templates of one license count once; templates that are null or of fewer than five words match
nothing; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .license_texts import TEMPLATES

WORDS, WINDOW, BANDS = 5, 4, 4
CONTAINED = 0.8
#: Words of 64 bits of the filter of template shingles, and bits that a shingle sets.
FILTER_WORDS, PROBES = 1 << 13, 3
#: Rows of a table made of the templates up to which it may be broadcast: some tens of bytes each and a row's overhead.
BROADCAST_ROWS = 100_000


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often a lambda below reads it."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the shingles in order, empty for fewer than five words."""

    def made(w: Column) -> Column:
        n = F.size(w) - (WORDS - 1)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))

    hashed = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w))
    return _let(hashed, made)


def _bits(shingle: Column) -> list[tuple[Column, Column]]:
    """Word and bit of the filter for each probe of a shingle."""
    size = FILTER_WORDS.bit_length() - 1
    part = lambda i: F.shiftrightunsigned(shingle, i * (size + 6))
    return [(part(i).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int"), F.shiftrightunsigned(part(i), size).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]


def build_filter(shingles: DataFrame) -> list[int]:
    """shingles(x) -> the filter's words: bits or-ed by word in one aggregation, ``FILTER_WORDS`` rows at most."""
    bits = shingles.select(F.inline(F.array(*[F.struct(w.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), b).alias("b")) for w, b in _bits(F.col("x"))])))
    out = [0] * FILTER_WORDS
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[r["w"]] = r["b"]
    return out


def minima_of(window: Column) -> Column:
    """(band, low) of a window, an array of shingles: the smallest in each band's hash order."""

    def lowest(band: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(F.lit(band), x)))

    return F.array(*[F.struct(F.lit(b).alias("band"), lowest(b).alias("low")) for b in range(BANDS)])


def template_windows(shingles: Column) -> Column:
    """(at, minima) of a template's windows."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - WINDOW, F.lit(0)))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), minima_of(F.slice(shingles, i + 1, F.lit(WINDOW))).alias("minima")))


def text_windows(hits: Column) -> Column:
    """(at, minima) of the windows that start at a shingle of hits, (at, x) in order."""

    def window(e: Column, k: Column) -> Column:
        near = F.filter(F.slice(hits, k + 1, F.lit(WINDOW)), lambda y: y["at"] < e["at"] + WINDOW)
        return F.struct(e["at"].alias("at"), minima_of(F.transform(near, lambda y: y["x"])).alias("minima"))

    return F.transform(hits, window)


def templates_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(templates, "license string, template string")


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """docs(doc_id, text), templates(license, template) -> doc_id, license, first_word, n_places, containment.

    One row for each license that a document holds: the first word (counted from 0) of a verified place that a template's shingles
    hold, how many places were verified, and the largest containment found.
    """
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    t = templates.filter("license is not null").select("license", shingles_of(words_of(F.col("template"))).alias("h")).filter(F.size("h") > 0).distinct()
    t = work.cut(t.select(F.xxhash64("license", "h").alias("t"), "license", "h", F.size(F.array_distinct("h")).alias("n"), F.size("h").alias("long")), "templates")
    held = t.select("t", "license", "n", "long", F.explode(F.array_distinct("h")).alias("x"))
    n_held = held.count()
    bloom = F.split(F.lit(",".join(map(str, build_filter(held.select("x").distinct())))), ",").cast("array<long>")  # folded to a constant

    def may_hold(x: Column) -> Column:
        found = [F.getbit(F.get(bloom, w), b) == 1 for w, b in _bits(x)]
        return found[0] & found[1] & found[2]

    every = F.transform(shingles_of(words_of(F.col("text"))), lambda x, i: F.struct(i.alias("at"), x.alias("x")))
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(every, lambda e: may_hold(e["x"])).alias("hits"))
    d = work.cut(d.filter(F.size("hits") > 0), "license-hits")

    windows = t.select("t", "n", "long", F.inline(template_windows(F.col("h")))).select("t", "n", "long", F.col("at").alias("t_at"), F.inline("minima"))
    probes = d.select("row", F.inline(text_windows(F.col("hits")))).select("row", "at", F.inline("minima"))
    met = probes.join(small(windows, BANDS * n_held), ["band", "low"])

    # What a place holds is found by an equi-join on cells as long as its region, so a text that repeats a notice costs its length.
    slack = F.ceil(F.col("long") * (1 - CONTAINED)).cast("int") + WINDOW
    cell = lambda at: F.floor(at / (F.col("long") + 2 * slack))
    start = F.col("at") - F.col("t_at")
    place = met.select("row", "t", (start - slack).alias("lo"), (start + F.col("long") + slack).alias("hi"), "n", cell(start - slack).alias("c1"), cell(start + F.col("long") + slack).alias("c2")).distinct()
    place = place.select("row", "t", "n", "lo", "hi", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("cell"))
    own = d.select("row", F.inline("hits")).join(small(held, n_held), "x").select("row", "t", "at", "x", cell(F.col("at")).alias("cell"))
    found = place.join(own, ["row", "t", "cell"]).filter("at between lo and hi").groupBy("row", "t", "n", "lo").agg(F.count_distinct("x").alias("k"), F.min("at").alias("first"))
    good = found.filter(F.col("k") >= CONTAINED * F.col("n")).join(small(t.select("t", "license"), n_held), "t")
    good = good.groupBy("row", "license").agg(F.min("first").alias("first_word"), F.count("*").alias("n_places"), F.round(F.max(F.col("k") / F.col("n")), 6).alias("containment"))
    return good.join(d.select("row", "doc_id"), "row").select("doc_id", "license", "first_word", "n_places", "containment")
