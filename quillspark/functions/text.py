"""Column functions over text that several operators share. Letters are Unicode: ``[\\p{L}\\p{N}_]`` in both engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def tokens(text: Column, longer_than: int = 2) -> Column:
    return F.filter(words(text), lambda w: F.length(w) > longer_than)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def counted(ts: Column) -> Column:
    """The distinct terms of an array with their counts: runs of the sorted array."""
    def runs(x: Column) -> Column:
        n = F.size(x)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        ends = lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(n))
        made = F.transform(F.array(starts), lambda s: F.zip_with(s, ends(s), lambda i, j: F.struct(F.get(x, i).alias("term"), (j - i).alias("tf"))))
        return F.when(n > 0, F.get(made, F.lit(0))).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))

    return F.get(F.transform(F.array(F.sort_array(ts)), runs), F.lit(0))
