"""Chunkers: one document to many chunks. Column expressions where positions allow it, Python where state is carried along."""

from __future__ import annotations

import re
from bisect import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.lexicons import LEVELS
from quillspark.functions.text import r6, tokens
from quillspark.operators.hierarchy import depths
from quillspark.plans.joins import WINDOWS, fixed_windows
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, small_batches, table


#: Rows and characters that a task gives back at once.
ROWS, CHARS = 5_000, 2_000_000


def per_document(docs: DataFrame, split, schema: str) -> DataFrame:
    """split(text) -> rows, run on small Arrow batches and given back in parts; a document is never divided between tasks."""
    fields = [c.split() for c in schema.split(", ")]

    def run(batches):
        import ctypes

        import pyarrow as pa

        types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        made = pa.schema([(name, types[kind]) for name, kind in fields])

        def part(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), made.types, strict=True)], schema=made)

        rows, held = [], 0
        for b in batches:
            for d, t in zip(b.column(0), b.column(1), strict=True):
                for r in split(t.as_py() or ""):
                    rows.append((d.as_py(), *r))
                    held += sum(len(x) for x in r if isinstance(x, str))
                    if len(rows) >= ROWS or held >= CHARS:
                        yield part(rows)
                        rows, held = [], 0
        if rows:
            yield part(rows)
        rows = None
        pa.default_memory_pool().release_unused()
        try:  # freed memory goes back to the system
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def recursive_split(text: str, size: int = 1000, overlap: int = 200, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest mark that will do, each starting with the end of the one before."""
    mark = next(m for m in marks if m == "" or m in text)
    finer = marks[marks.index(mark) + 1 :]
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        joined = mark.join(run).strip()
        if joined:
            out.append(joined)

    for part in text.split(mark) if mark else list(text):
        if len(part) > size and finer:
            flush()
            run.clear()
            out.extend(recursive_split(part, size, overlap, finer))
            continue
        if run and sum(map(len, run)) + len(mark) * len(run) + len(part) > size:
            flush()
            while run and (sum(map(len, run)) + len(mark) * (len(run) - 1) > overlap or sum(map(len, run)) + len(mark) * len(run) + len(part) > size):
                run.pop(0)
        run.append(part)
    flush()
    return out


@query("chk_01_recursive")
def recursive(spark, sf) -> DataFrame:
    return per_document(table(spark, sf, "documents"), lambda t: [(i, x) for i, x in enumerate(recursive_split(t))], "doc_id long, chunk_index int, text string")


@query("chk_02_header_split", r"WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS ls FROM documents), l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM p), h AS (SELECT *, sum(CASE WHEN length(line) BETWEEN 1 AND 59 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l) SELECT doc_id, CAST(part AS BIGINT) AS part, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM h GROUP BY doc_id, part")
def header_split(spark, sf) -> DataFrame:
    """A chunk runs from one header line to the next."""
    l_ = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    part = F.sum(F.when(F.length("line").between(1, 59), 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("i"))
    return l_.withColumn("part", part).groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def cascade(text: str, pack: str = "generic") -> list[tuple]:
    """(level, path, start, end) of every piece: a header opens a piece that ends at the next header of its level or above."""
    levels = LEVELS[pack]
    heads = sorted({(m.start(), k) for k, (_, p) in enumerate(levels) for m in re.finditer(p, text)})
    out, path = [], [0] * len(levels)
    ends, following = [], [len(text)] * len(levels)
    for at, k in reversed(heads):
        ends.append(min(following[: k + 1]))
        following[k] = at
    for (at, k), end in zip(heads, reversed(ends), strict=True):
        path[k] += 1
        path[k + 1 :] = [0] * (len(levels) - k - 1)
        out.append((levels[k][0], ".".join(map(str, path[: k + 1])), at, end))
    return out or ([("document", "0", 0, len(text))] if text else [])


@query("chk_03_cascade")
def cascade_query(spark, sf) -> DataFrame:
    return per_document(table(spark, sf, "documents"), cascade, "doc_id long, level string, path string, start long, end long")


#: Constraints with their patterns, concepts with their terms, and endings of abstract nouns: a generic pack.
CONSTRAINTS = {
    "percent": r"(?:not more than |at least |less than |more than )?[0-9]+(?:[.,][0-9]+)? ?(?:%|percent)", "period": r"(?:not more than |at least |within )?[0-9]+ (?:days?|weeks?|months?|years?)",
    "amount": r"(?:not more than |at least )?[0-9]+(?:[.,][0-9]+)? (?:usd|euros?|dollars?)",
}
CONCEPT_TERMS = {"licensing": ["license", "copyright"], "warranty": ["warranty", "without any"], "publication": ["public", "publish"], "contact": ["@", "http"]}
_NOUNS = r"([a-z]{2,}(?:tion|ment|ness|ship|ance|ence|ity))(?:[^a-z]|$)"
_LEVELS = "CASE WHEN regexp_matches(t, 'must|shall') THEN 'mandatory' WHEN regexp_matches(t, 'may not') THEN 'prohibited' ELSE 'none' END"
_FOUND = " || ".join(f"list_transform(regexp_extract_all(t, '{p}'), lambda x: '{k}:' || x)" for k, p in CONSTRAINTS.items())
_HELD = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in CONCEPT_TERMS.items())


@query("chk_04_enrichment", rf"""WITH {CHUNKS}, l AS (SELECT doc_id, chunk_index, lower(text) AS t FROM chunks),
e AS (SELECT doc_id, chunk_index, {_LEVELS} AS modality, len(regexp_extract_all(t, '[0-9]+')) AS refs, {_FOUND} AS constraints, list_filter([{_HELD}], lambda c: c IS NOT NULL) AS concepts,
  regexp_extract_all(t, '{_NOUNS}', 1) AS nouns, list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 3) AS ws FROM l),
k AS (SELECT *, list_transform(list_filter(list_transform(nouns, lambda w, i: CASE WHEN list_position(nouns, w) = i THEN w END), lambda w: w IS NOT NULL)[1:10], lambda w: w) AS terms, list_filter(list_transform(ws, lambda w, i: CASE WHEN list_position(ws, w) = i THEN w END), lambda w: w IS NOT NULL) AS own FROM e)
SELECT doc_id, chunk_index, modality, refs, array_to_string(constraints, ';') AS constraints, array_to_string(concepts, ';') AS concepts, array_to_string(terms, ';') AS key_terms,
  array_to_string((concepts || terms || list_filter(own, lambda w: NOT list_contains(terms, w) AND NOT list_contains(concepts, w)))[1:15], ';') AS keywords,
  round(least(2, 1 + CASE WHEN modality <> 'none' THEN 0.5 ELSE 0 END + CASE WHEN len(constraints) > 0 THEN 0.3 ELSE 0 END + 0.2 * refs), 6)::DOUBLE AS importance FROM k""")
def enrichment(spark, sf) -> DataFrame:
    """What a chunk is about, in one projection: modality, numerical constraints by kind with their operator, concepts, at most ten key
    terms, keywords to search by (concepts and key terms first), references, and importance: 1, with 0.5 and 0.3 for modality and
    constraints and 0.2 a reference, at most 2."""
    t = F.col("t")
    modality = F.when(t.rlike("must|shall"), "mandatory").when(t.rlike("may not"), "prohibited").otherwise("none")
    found = F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), 0), _prefixed(k)) for k, p in CONSTRAINTS.items()])
    concepts = F.array_compact(F.array(*[F.when(_any_of(t, ws), k) for k, ws in CONCEPT_TERMS.items()]))
    e = chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", F.lower("text").alias("t")).select(
        "doc_id", "chunk_index", modality.alias("modality"), F.regexp_count(t, F.lit("[0-9]+")).cast("long").alias("refs"), found.alias("found"), concepts.alias("held"),
        F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(_NOUNS), 1)), 1, 10).alias("terms"), F.array_distinct(tokens(t, 3)).alias("own"),
    )
    imp = F.least(F.lit(2.0), 1 + F.when(F.col("modality") != "none", 0.5).otherwise(0.0) + F.when(F.size("found") > 0, 0.3).otherwise(0.0) + 0.2 * F.col("refs"))
    rest = F.filter("own", lambda w: ~F.array_contains("terms", w) & ~F.array_contains("held", w))
    joined = lambda c, name: F.array_join(c, ";").alias(name)
    return e.select("doc_id", "chunk_index", "modality", "refs", joined("found", "constraints"), joined("held", "concepts"), joined("terms", "key_terms"), joined(F.slice(F.concat("held", "terms", rest), 1, 15), "keywords"), r6(imp).alias("importance"))


def _prefixed(kind: str):
    return lambda v: F.concat(F.lit(f"{kind}:"), v)


def _any_of(text: Column, words: list[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def sized(text: str, least: int = 100, best: int = 1000, most: int = 2000) -> list[tuple]:
    """Lines as segments; too long ones fall to sentences, clauses, words; short ones join the one before."""
    parts: list[str] = []
    for line in filter(str.strip, text.split("\n")):
        for p in [line] if len(line) <= most else _by_size(line, best):
            if parts and (len(p) < least or len(parts[-1]) < least) and len(parts[-1]) + len(p) < best:
                parts[-1] += "\n" + p
            else:
                parts.append(p)
    return [(i, p, len(p)) for i, p in enumerate(parts)]


def _by_size(text: str, size: int) -> list[str]:
    for pattern in (r"(?<=[.!?])\s+", r"(?<=[;,])\s+", r"\s+"):
        bits = re.split(pattern, text)
        if max(map(len, bits)) <= size:
            break
    out = [""]
    for b in bits:
        if out[-1] and len(out[-1]) + 1 + len(b) > size:
            out.append("")
        out[-1] = f"{out[-1]} {b}".strip()
    return out


def structure_map(text: str, longest: int = 60) -> list[tuple[int, str]]:
    """(position, header) of the short lines of a text, which head what follows."""
    out, at = [], 0
    for line in text.split("\n"):
        if 0 < len(line.strip()) and len(line) < longest:
            out.append((at, line.strip()))
        at += len(line) + 1
    return out


def structured(text: str, least: int = 100, best: int = 1000, most: int = 2000) -> list[tuple]:
    """(index, text, length, header): sized chunks with the last header of the structure map that stands at or before their start."""
    heads, out, seen = structure_map(text), [], 0
    solid, before, at = [], 0, 0
    for p, h in heads:
        before, at = before + len("".join(text[at:p].split())), p
        solid.append((before, h))
    starts = [p for p, _ in solid]
    for i, p, n in sized(text, least, best, most):  # chunks keep all visible characters, so these tell where one starts
        k = bisect(starts, seen) - 1
        out.append((i, p, n, solid[k][1] if k >= 0 else None))
        seen += len("".join(p.split()))
    return out


@query("chk_05_line_structure")
def line_structure(spark, sf) -> DataFrame:
    """Chunks by lines within limits of size, each under the header that the structure map gives."""
    return per_document(table(spark, sf, "documents"), structured, "doc_id long, chunk_index int, text string, n long, header string")


@query("chk_06_segments")
def segments(spark, sf) -> DataFrame:
    """The line-structure chunks with their neighbours, and whether they go on under the same header, as relations."""
    c = per_document(table(spark, sf, "documents"), lambda t: [(i, n, h) for i, _, n, h in structured(t)], "doc_id long, chunk_index int, n long, header string")
    w = W.partitionBy("doc_id").orderBy("chunk_index")
    goes_on = F.coalesce(F.col("header").eqNullSafe(F.lag("header").over(w)) & F.lag("chunk_index").over(w).isNotNull(), F.lit(False))
    return c.select("doc_id", "chunk_index", "n", F.lag("chunk_index").over(w).alias("previous"), F.lead("chunk_index").over(w).alias("next"), goes_on.alias("goes_on"))


def tagged(text: str) -> list[tuple]:
    """(index, text, length, overview, tags, importance): sized chunks headed by the last short line before them."""
    head, out = "", []
    for i, p, n in sized(text, 80, 800, 1200):
        first = p.split("\n")[0]
        head = first if len(first) < 60 else head
        low = p.lower()
        found = {"number": bool(re.search("[0-9]", p)), "modal": bool(re.search("must|shall|may not", low)), "license": "license" in low, "list": any(x.lstrip().startswith(("-", "*")) for x in p.split("\n"))}
        tags = ",".join(k for k, x in found.items() if x)
        worth = min(2.0, 1 + 0.5 * found["modal"] + 0.3 * found["license"] + 0.2 * found["number"])
        overview = re.split(r"(?<=[.!?])\s", p.strip(), maxsplit=1)[0][:100]
        out.append((i, f"{head}\n{p}" if head and first != head else p, n, overview, tags, round(worth, 6)))
    return out


@query("chk_07_article_aware")
def article_aware(spark, sf) -> DataFrame:
    """Sized chunks under the last header, with an overview, tags and importance."""
    return per_document(table(spark, sf, "documents"), tagged, "doc_id long, chunk_index int, text string, n long, overview string, tags string, importance double")


@query("chk_08_rechunk")
def rechunk(spark, sf) -> DataFrame:
    """Chunks above 500 characters that hold a number are chunked again; the others stay."""

    def again(text: str):
        for i, p, n, *_ in tagged(text):
            yield from sized(p, 50, 400, 500) if len(p) > 500 and re.search("[0-9]", p) else [(i, p, n)]

    return per_document(table(spark, sf, "documents"), again, "doc_id long, chunk_index int, text string, n long")


#: Names of the levels below a root.
LEVEL_MAP = {1: "chapter", 2: "article", 3: "part"}


_LEVEL = "CASE depth " + " ".join(f"WHEN {d} THEN '{n}'" for d, n in LEVEL_MAP.items()) + " END"


#: Links that no table holds: a ring, and a ring below a root.
RINGS = [("X1", "X2"), ("X2", "X3"), ("X3", "X1"), ("X4", "X1"), ("Y1", "R0"), ("Y2", "Y1"), ("Y1", "Y2")]


@query("chk_09_hierarchy", f"""WITH RECURSIVE e(child, parent) AS (SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'O' || o_orderkey, coalesce('O' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'C' || o_custkey) FROM orders UNION ALL VALUES {", ".join(map(str, RINGS))}),
h(node, d) AS (SELECT DISTINCT parent, 0 FROM e WHERE starts_with(parent, 'R') UNION SELECT e.child, h.d + 1 FROM e JOIN h ON e.parent = h.node WHERE h.d < 100), m AS (SELECT node, min(d) AS d FROM h GROUP BY node),
r(a, b) AS (SELECT child, parent FROM e WHERE child[1] IN ('X', 'Y') UNION SELECT r.a, e.parent FROM r JOIN e ON e.child = r.b), k AS (SELECT parent, count(*) - 1 AS siblings FROM e GROUP BY parent),
f AS (SELECT e.child, e.parent, CAST(d + 1 AS INT) AS depth, r.a IS NOT NULL AS cyclic, siblings FROM e LEFT JOIN m ON e.parent = m.node LEFT JOIN r ON r.a = e.parent AND r.b = e.child LEFT JOIN k ON k.parent = e.parent) SELECT *, {_LEVEL} AS level FROM f""")
def hierarchy(spark, sf) -> DataFrame:
    """Depth, level and number of siblings of every node by each of its parents, and whether the link lies on a cycle.

    Orders hang on the one before of their customer, which makes long chains; rings are put in.
    """
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("child"), F.coalesce(F.concat(F.lit("O"), before), F.concat(F.lit("C"), "o_custkey")).alias("parent"))
    e = n.unionByName(c).unionByName(o).unionByName(spark.createDataFrame(RINGS, "child string, parent string"))
    level = F.create_map(*[F.lit(x) for kv in LEVEL_MAP.items() for x in kv])[F.col("depth")]
    found = depths(e)
    family = found.groupBy("parent").agg((F.count("*") - 1).alias("siblings"))
    return found.join(family, "parent").select("child", "parent", "depth", "cyclic", "siblings", level.alias("level"))


def zones(text: str, margin: int = 20) -> list[tuple[int, int]]:
    """What must not be cut: numbers with some characters around, joined where they touch."""
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"[0-9]+", text):
        lo, hi = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def boundaries(text: str, size: int = 1000, window: int = 200) -> list[tuple]:
    """(nth, position, kind, quality): cuts near every ``size`` characters at the best mark in the window that no protected zone
    covers, less half a point for each window's distance; without one, behind the zone or at the next blank."""
    worth = {"\n": 1.0, ".": 0.9, "!": 0.9, "?": 0.9, ";": 0.6, ",": 0.4, " ": 0.2}
    kept = zones(text)
    starts = [a for a, _ in kept]

    def zone_of(p: int) -> tuple[int, int] | None:
        i = bisect(starts, p) - 1
        return kept[i] if i >= 0 and kept[i][0] <= p <= kept[i][1] else None

    out, at = [], 0
    while len(text) - at > size:
        goal = at + size
        marks = [p for p in range(max(at + 1, goal - window), min(len(text), goal + window)) if text[p - 1] in worth and not zone_of(p)]
        if marks:
            cut = max(marks, key=lambda p: (worth[text[p - 1]] - 0.5 * abs(p - goal) / window, -p))
            kind = "natural"
        else:
            inside = zone_of(goal)
            cut = inside[1] + 1 if inside else next((i + 1 for i in range(goal, min(goal + 100, len(text))) if text[i] in " \n"), goal)
            kind = "forced"
        if cut >= len(text):
            break
        out.append((len(out), cut, kind, round(worth.get(text[cut - 1], 0) - 0.5 * abs(cut - goal) / window, 6)))
        at = cut
    return out


@query("chk_10_boundaries")
def boundaries_query(spark, sf) -> DataFrame:
    return per_document(table(spark, sf, "documents"), boundaries, "doc_id long, nth int, position long, kind string, quality double")


@query("chk_11_priority", rf"WITH {CHUNKS}, n AS (SELECT doc_id, chunk_index, len(regexp_extract_all(text, '[0-9]+')) AS a, len(regexp_extract_all(text, '@')) AS b FROM chunks), c AS (SELECT *, least(1, 0.3 * a + 0.2 * b) AS crit FROM n) SELECT doc_id, chunk_index, CASE WHEN a + b >= 3 THEN 'high' WHEN a + b >= 1 THEN 'medium' ELSE 'low' END AS priority, round(crit, 6)::DOUBLE AS criticality, round(1 + crit * 0.5, 2)::DOUBLE AS boost FROM c")
def priority(spark, sf) -> DataFrame:
    a, b = F.regexp_count("text", F.lit("[0-9]+")), F.regexp_count("text", F.lit("@"))
    crit = F.least(F.lit(1.0), 0.3 * a + 0.2 * b)
    level = F.when(a + b >= 3, "high").when(a + b >= 1, "medium").otherwise("low")
    return chunks(table(spark, sf, "documents")).select("doc_id", "chunk_index", level.alias("priority"), r6(crit).alias("criticality"), F.round(1 + crit * 0.5, 2).alias("boost"))


@query("chk_12_fixed_windows", f"WITH {WINDOWS} SELECT w.doc_id, k AS chunk_index, substr(text, lo + 1, hi - lo) AS chunk FROM win w JOIN documents d ON w.doc_id = d.doc_id")
def fixed(spark, sf, size: int = 1000) -> DataFrame:
    n = F.ceil(F.length("text") / size).cast("int")
    d = table(spark, sf, "documents").filter(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return d.select("doc_id", "chunk_index", F.substring("text", F.col("chunk_index") * size + 1, F.lit(size)).alias("chunk"))


@query("chk_13_articles", f"WITH {CHUNKS}, h AS (SELECT doc_id, chunk_index, text, length(text) < 60 AS head, CASE WHEN length(text) < 25 THEN text END AS chapter FROM chunks), p AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS article, last_value(chapter IGNORE NULLS) OVER w AS under FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT doc_id, CAST(article AS BIGINT) AS article, max(CASE WHEN head THEN under END) AS chapter, max(CASE WHEN head THEN text END) AS title, coalesce(string_agg(CASE WHEN NOT head THEN text END, chr(10) ORDER BY chunk_index), '') AS body FROM p WHERE article > 0 GROUP BY doc_id, article")
def articles(spark, sf) -> DataFrame:
    """Articles with chapter, title and body: lines gather under the last header, and headers under the last very short line."""
    head = F.length("text") < 60
    w = W.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, 0)
    p = chunks(table(spark, sf, "documents")).withColumn("head", head).withColumn("article", F.sum(F.col("head").cast("int")).over(w))
    p = p.withColumn("under", F.last(F.when(F.length("text") < 25, F.col("text")), ignorenulls=True).over(w)).filter("article > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("chunk_index", "text")))), lambda x: x["text"]), "\n")
    return p.groupBy("doc_id", "article").agg(F.max(F.when(F.col("head"), F.col("under"))).alias("chapter"), F.max(F.when(F.col("head"), F.col("text"))).alias("title"), body.alias("body"))
