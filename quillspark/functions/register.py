"""Functions for SQL users: scalar functions as SQL expressions, chunkers and extractors as table functions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Name, parameters and body of the SQL functions; each is inlined by Catalyst, no Python runs.
SCALARS = {
    "ql_tokens": ("text STRING", r"filter(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1), w -> length(w) > 2)"),
    "ql_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "if(size(array_union(a, b)) > 0, size(array_intersect(a, b)) / size(array_union(a, b)), 0.0D)"),
    "ql_cosine": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))), 0D)"),
    "ql_semantic_hash": ("text STRING", r"substring(md5(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_\\s]', '')), 1, 16)"),
}


#: Kinds of entities with their patterns, for Python's ``re``.
ENTITY_KINDS = {
    "percent": r"[0-9]+(?:[.,][0-9]+)? *(?:%|percent|процент[а-я]*)", "money": r"[0-9]+(?:[.,][0-9]+)? *(?:thousand|million|billion|тыс\.?|млн|млрд)? *(?:usd|dollars?|euros?|eur|руб[а-я]*)",
    "temporal": r"[0-9]+ *(?:days?|weeks?|months?|years?|дн[а-я]*|месяц[а-я]*|лет|год[а-я]*)", "article": r"(?:article|section|ст\.|стать[а-я]*) *[0-9]+(?:\.[0-9]+)*", "law": r"[0-9]+-фз",
}


class Entities:
    """Table function over a table with a text column: its other columns, then kind, value, start and end of every entity.

    ``SELECT * FROM ql_entities(TABLE(SELECT doc_id, text FROM docs), 'text')``; a third argument names the kinds that are wanted. The
    schema follows the table's; PARTITION BY groups the rows, which makes no difference to what is found.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, kinds: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(..)")
        names = [f.name for f in rows.dataType.fields]
        if text.value not in names:
            raise ValueError(f"no column {text.value!r} among {names}")
        wanted = [k.strip() for k in kinds.value.split(",")] if kinds is not None else list(ENTITY_KINDS)
        if set(wanted) - set(ENTITY_KINDS):
            raise ValueError(f"kinds are {', '.join(ENTITY_KINDS)}")
        taken = [f for f in rows.dataType.fields if f.name != text.value and f.name not in ("kind", "value", "start", "end")]
        schema = StructType([*taken, StructField("kind", StringType()), StructField("value", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
        return AnalyzeResult(schema)

    def eval(self, row, text: str, kinds: str | None = None):
        low = (row[text] or "").lower()
        rest = [row[n] for n in row.__fields__ if n != text and n not in ("kind", "value", "start", "end")]
        wanted = [k.strip() for k in kinds.split(",")] if kinds else ENTITY_KINDS
        for m in sorted(((m.start(), m.end(), k, m[0]) for k in wanted for m in re.finditer(ENTITY_KINDS[k], low)), key=lambda x: x[:3]):
            yield *rest, m[2], m[3], m[0], m[1]


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; gives their names."""
    for name, (parameters, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")

    from quillspark.plans.chunking import cascade, recursive_split

    spark.udtf.register("ql_entities", udtf(Entities))

    class Recursive:
        def eval(self, text: str, size: int, overlap: int):
            for i, piece in enumerate(recursive_split(text or "", size, overlap)):
                yield i, piece

    class Cascade:
        def eval(self, text: str):
            yield from cascade(text or "")

    spark.udtf.register("ql_recursive_chunks", udtf(Recursive, returnType="chunk_index int, text string"))
    spark.udtf.register("ql_structure", udtf(Cascade, returnType="level string, path string, start long, end long"))
    return [*SCALARS, "ql_recursive_chunks", "ql_structure", "ql_entities"]
