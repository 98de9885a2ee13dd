"""Entity extraction: patterns are parameters; values come from regular expressions of the engine, positions from piece lengths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicons
from quillspark.functions.text import tokens
from quillspark.plans.chunking import per_document
from quillspark.plans.joins import ENTITIES, entities
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, table

PATTERNS = {"percent": r"[0-9]+(?:[.,][0-9]+)? ?%", "number": r"[0-9]{5,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "version": r"[0-9]+\.[0-9]+"}
_N = r"([0-9]+(?:[.,][0-9]+)?)"
#: Kinds of numerical constraints, matched on lower case; group 1 is the number, and a magnitude may follow it.
VALUES = {
    "percent": _N + r" *(?:%|percent)", "money": _N + r" *(?:thousand|million|billion)? *(?:usd|eur|dollars?|euros?)", "temporal": _N + r" *(?:days?|weeks?|months?|years?)",
    "quantity": _N + r" *(?:thousand|million|billion)? *(?:items?|pages?|words?|members?|copies)", "number": r"([0-9]{5,})",
}
_SCALE = lexicons.MAGNITUDES["generic"]


@query("ner_01_values", "WITH v AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, '{p}' AS p, unnest(regexp_extract_all(lower(text), '{p}')) AS value FROM documents" for k, p in VALUES.items()) + f") SELECT doc_id, kind, value, CAST(replace(regexp_extract(value, '{_N}', 1), ',', '.') AS DOUBLE) * CASE " + " ".join(f"WHEN contains(value, '{w}') THEN {x}" for w, x in _SCALE.items()) + " ELSE 1 END AS normalized FROM v")
def values(spark, sf) -> DataFrame:
    """All values of all kinds from one scan, with their number brought to units."""
    text = F.lower("text")
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), 0), _as(k)) for k, p in VALUES.items()])
    v = table(spark, sf, "documents").select("doc_id", F.inline(found))
    scale = F.lit(1.0)
    for word, x in reversed(_SCALE.items()):
        scale = F.when(F.contains("value", F.lit(word)), x).otherwise(scale)
    return v.withColumn("normalized", F.replace(F.regexp_extract("value", _N, 1), F.lit(","), F.lit(".")).cast("double") * scale)


def _as(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def modality(text: Column, pack: str = "generic") -> Column:
    """The first class of the pack whose words occur, else the first class of all."""
    low, rules = F.lower(text), lexicons.MODALITY[pack]
    return F.coalesce(*[F.when(low.rlike(p), n) for n, p in rules], F.lit(rules[0][0]))


MODALITY = lexicons.MODALITY["generic"]
_MODALITY = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{n}'" for n, p in MODALITY) + " ELSE 'mandatory' END"


@query("ner_01_positions", f"WITH {ENTITIES}, c AS (SELECT e.doc_id, nth, pos, value, substr(text, greatest(pos - 100, 0) + 1, least(pos, 100) + length(value) + 100) AS context FROM ents e JOIN documents d ON e.doc_id = d.doc_id) SELECT *, {_MODALITY.replace('{0}', 'context')} AS modality FROM c")
def positions(spark, sf) -> DataFrame:
    """Numbers with position, the hundred characters on either side, and the modality that these express."""
    d = table(spark, sf, "documents")
    e = entities(d).join(d.select("doc_id", "text"), "doc_id")
    p = F.col("pos")
    e = e.select("doc_id", "nth", "pos", "value", F.substring("text", F.greatest(p - 100, F.lit(0)) + 1, F.least(p, F.lit(100)) + F.length("value") + 100).alias("context"))
    return e.withColumn("modality", modality(F.col("context")))


_REF, _LAW = r"(?:article|section|version) +([0-9]+)(?:[.]([0-9]+))?(?:[.]([0-9]+))?", r"public +license, +version +([0-9]+)"


@query("ner_02_references", f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_REF}')) AS ref FROM documents), l AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_LAW}')) AS ref FROM documents) SELECT doc_id, 'article' AS kind, ref, " + ", ".join(f"nullif(regexp_extract(ref, '{_REF}', {i}), '') AS {n}" for i, n in ((1, "article"), (2, "part"), (3, "point"))) + f" FROM m UNION ALL SELECT doc_id, 'law', ref, regexp_extract(ref, '{_LAW}', 1), NULL, NULL FROM l")
def references(spark, sf) -> DataFrame:
    """References with one, two or three groups (article, part, point), and references to laws by number."""
    text = F.lower("text")
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), 0), _ref_as(k)) for k, p in (("article", _REF), ("law", _LAW))])
    m = table(spark, sf, "documents").select("doc_id", F.inline(found))
    group = lambda i: F.nullif(F.regexp_extract("ref", _REF, i), F.lit(""))
    law = F.col("kind") == "law"
    return m.select("doc_id", "kind", "ref", F.when(law, F.regexp_extract("ref", _LAW, 1)).otherwise(group(1)).alias("article"), *[F.when(~law, group(i)).alias(n) for i, n in ((2, "part"), (3, "point"))])


def _ref_as(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("ref"))


def numbered(text: Column, kind: str, pack: str = "generic") -> Column:
    """Numbers of the articles or laws that a text refers to, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(lexicons.REFERENCES[pack][kind]), 1)


@query("ner_03_modality", f"WITH {CHUNKS} SELECT doc_id, chunk_index, {_MODALITY.replace('{0}', 'text')} AS modality FROM chunks")
def modality_query(spark, sf) -> DataFrame:
    return chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", modality(F.col("text")).alias("modality"))


@query("ner_04_attach", f"WITH {ENTITIES}, c AS (SELECT e.doc_id, nth, value, substr(text, greatest(pos - 100, 0) + 1, least(pos, 100) + length(value) + 100) AS context FROM ents e JOIN documents d ON e.doc_id = d.doc_id) SELECT doc_id, nth, nullif(regexp_extract(context, '[Vv]ersion ([0-9]+)', 1), '') AS article FROM c")
def attach(spark, sf) -> DataFrame:
    """The reference in an entity's context, if there is one."""
    found = F.nullif(F.regexp_extract("context", "[Vv]ersion ([0-9]+)", 1), F.lit(""))
    return positions(spark, sf).select("doc_id", "nth", found.alias("article"))


def suppress_overlaps(text: str, patterns: list[str]) -> list[tuple]:
    """Matches of ordered patterns; one that overlaps an earlier pattern's is dropped."""
    taken: list[tuple[int, int]] = []
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                out.append((k, m.start(), m.end(), m.group()))
    return sorted(out, key=lambda x: x[1])


@query("ner_05_no_overlap")
def no_overlap(spark, sf) -> DataFrame:
    order = [PATTERNS["ip"], r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]+\.[0-9]+\.[0-9]+", PATTERNS["version"], PATTERNS["percent"], r"[0-9]+ *(?:usd|eur|days?|years?)", r"[0-9]+"]
    return per_document(table(spark, sf, "documents"), lambda t: suppress_overlaps(t, order), "doc_id long, pattern int, start long, end long, value string")


@query("ner_06_rules", r"WITH s AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[.,;]+'), lambda x: trim(x)), lambda x: length(x) > 5) AS ps, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 8))) AS ks FROM benchmark) SELECT item_id, array_to_string(list_filter(ps, lambda x: regexp_matches(x, '^(if|when|the) ')), ' | ') AS conditions, array_to_string(list_filter(ps, lambda x: regexp_matches(x, '^(then|and|th)')), ' | ') AS consequences, array_to_string(list_filter(ps, lambda x: regexp_matches(x, '^(unless|except|but|of) ')), ' | ') AS exceptions, array_to_string(ks, ' ') AS keywords, len(ps) AS n FROM s")
def rules(spark, sf) -> DataFrame:
    """Conditions, consequences and exceptions of a rule: clauses longer than five characters by how they begin; and its long words."""
    ps = F.filter(F.transform(F.split(F.lower("text"), "[.,;]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    b = table(spark, sf, "benchmark").select("item_id", ps.alias("ps"), F.array_sort(F.array_distinct(tokens(F.col("text"), 8))).alias("ks"))
    kinds = {"conditions": "^(if|when|the) ", "consequences": "^(then|and|th)", "exceptions": "^(unless|except|but|of) "}
    return b.select("item_id", *[_clauses(p).alias(n) for n, p in kinds.items()], F.array_join("ks", " ").alias("keywords"), F.size("ps").cast("long").alias("n"))


def _clauses(pattern: str) -> Column:
    return F.array_join(F.filter("ps", lambda x: x.rlike(pattern)), " | ")


#: Verbs that join a term to its definition, longer ones first, and the characters of context that are kept.
DEFINING = ["is defined as", "is understood as", "is called", "is known as", "is referred to as", "is meant by", "is considered", "is recognised as", "is", "are defined as", "are called", "are", "means", "denotes", "refers to", "stands for", "includes", "consists of", "represents"]
_DEF = r"([\p{L}]+) (" + "|".join(DEFINING) + r") ([^.\n]{1,400})"


@query("ner_07_definitions", f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_DEF}')) AS m FROM documents), d AS (SELECT doc_id, lower(regexp_extract(m, '{_DEF}', 1)) AS term, regexp_extract(m, '{_DEF}', 2) AS form, regexp_extract(m, '{_DEF}', 3) AS def FROM m) SELECT term, max(doc_id) AS doc_id, arg_max(form, (doc_id, def, form)) AS form, arg_max(def, (doc_id, def, form)) AS definition FROM d GROUP BY term")
def definitions(spark, sf) -> DataFrame:
    """Terms with the form and the context of their definition, merged by lower case, the last one winning."""
    m = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_DEF), 0)).alias("m"))
    d = m.select("doc_id", F.lower(F.regexp_extract("m", _DEF, 1)).alias("term"), F.regexp_extract("m", _DEF, 2).alias("form"), F.regexp_extract("m", _DEF, 3).alias("def"))
    best = F.max(F.struct("doc_id", "def", "form")).alias("b")
    return d.groupBy("term").agg(best).select("term", "b.doc_id", "b.form", F.col("b.def").alias("definition"))
