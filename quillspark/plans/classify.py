"""Rule-based classifiers: rule tables are expressions of fixed size, ties go to the rule listed first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import r6, tokens
from quillspark.registry import query
from quillspark.sources.tables import table

KINDS = {"license": ["license", "licensed", "version"], "english": ["the", "and", "with"], "german": ["der", "und", "mit"], "spanish": ["los", "que", "del"], "french": ["les", "des", "avec"]}


def keyword_scores(text: Column, rules: dict[str, list[str]]) -> Column:
    """(score, -ordinal, name) of the best rule: the share of its keywords that occur."""
    low = F.lower(text)
    scored = [F.struct(r6(sum((F.contains(low, F.lit(k)).cast("int") for k in ks[1:]), F.contains(low, F.lit(ks[0])).cast("int")) / len(ks)).alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, ks) in enumerate(rules.items())]
    return F.array_max(F.array(*scored))


def _sql_scores(rules: dict[str, list[str]], text: str = "text") -> str:
    one = ["struct_pack(score := round((" + " + ".join(f"CAST(contains(lower({text}), '{k}') AS INT)" for k in ks) + f") / {len(ks)}.0::DOUBLE, 6), o := {-i}, name := '{name}')" for i, (name, ks) in enumerate(rules.items())]
    return f"list_max([{', '.join(one)}])"


#: Keywords of the kinds of documents as patterns; one that stands in the text as it is written counts more than a match of another form.
KIND_PATTERNS = {"license": ["license", "licen[cs]ed", "version [0-9]", "public"], "english": ["the ", " an?d ", "with"], "german": ["der ", " un?d ", "d[ae]s "], "spanish": ["los ", "qu[ei] ", "del "], "french": ["les ", "d[eu]s ", "avec"]}
LITERAL, BY_PATTERN = 1.0, 0.7


@query("cls_01_document_type", f"""WITH s AS (SELECT doc_id, unnest([{", ".join("struct_pack(name := '" + name + f"', o := {i}, score := round((" + " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN 1.0::DOUBLE WHEN regexp_matches(lower(text), '{p}') THEN 0.7::DOUBLE ELSE 0 END" for p in ps) + f") / {len(ps)}, 6))" for i, (name, ps) in enumerate(KIND_PATTERNS.items()))}]) AS x FROM documents)
SELECT doc_id, CASE WHEN x.score > 0 THEN x.name ELSE 'other' END AS kind, x.score AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x.score DESC, x.o) = 1""")
def document_type(spark, sf) -> DataFrame:
    """The kind whose keywords are hit most: 1 for one that stands there as written, 0.7 for one that only matches, over their number."""
    low = F.lower("text")
    scored = []
    for i, (name, ps) in enumerate(KIND_PATTERNS.items()):
        hits = [F.when(F.contains(low, F.lit(p)), LITERAL).when(low.rlike(p), BY_PATTERN).otherwise(0.0) for p in ps]
        scored.append(F.struct(r6(sum(hits[1:], hits[0]) / len(ps)).alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("name")))
    b = table(spark, sf, "documents").select("doc_id", F.array_max(F.array(*scored)).alias("b"))
    return b.select("doc_id", F.when(F.col("b.score") > 0, F.col("b.name")).otherwise("other").alias("kind"), F.col("b.score").alias("score"))


@query("cls_02_domain", f"WITH b AS (SELECT item_id, {_sql_scores(KINDS)} AS b FROM benchmark) SELECT item_id, CASE WHEN b.score > 0 THEN b.name ELSE 'general' END AS domain, b.score AS score FROM b")
def domain(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", keyword_scores(F.col("text"), KINDS).alias("b"))
    return b.select("item_id", F.when(F.col("b.score") > 0, F.col("b.name")).otherwise("general").alias("domain"), F.col("b.score").alias("score"))


_MARKS = ["license", "version", "public", "work", "general"]


@query("cls_03_is_legal", "WITH h AS (SELECT doc_id, (" + " + ".join(f"CAST(contains(lower(text), '{m}') AS INT)" for m in _MARKS) + ") AS n FROM documents) SELECT doc_id, round(least(n / 5.0::DOUBLE, 1), 6) AS confidence, least(n / 5.0::DOUBLE, 1) > 0.2 AS legal FROM h")
def is_legal(spark, sf) -> DataFrame:
    low = F.lower("text")
    c = F.least(sum((low.contains(m).cast("int") for m in _MARKS[1:]), low.contains(_MARKS[0]).cast("int")) / 5.0, F.lit(1.0))
    return table(spark, sf, "documents").select("doc_id", r6(c).alias("confidence"), (c > 0.2).alias("legal"))


@query("cls_04_context_type", "WITH p AS (SELECT doc_id, strpos(lower(text), 'license') AS p, lower(text) AS t FROM documents), c AS (SELECT doc_id, p, substr(t, greatest(p - 100, 1), 207) AS c FROM p WHERE p > 0) SELECT doc_id, CASE WHEN contains(c, 'apache') THEN 'apache' WHEN contains(c, 'general public') THEN 'gpl' ELSE 'other' END AS kind, (CASE WHEN contains(c, 'apache') THEN 0.9 WHEN contains(c, 'general public') THEN 0.8 ELSE 0.3 END)::DOUBLE AS confidence FROM c")
def context_type(spark, sf) -> DataFrame:
    p = F.locate("license", F.lower("text"))
    c = table(spark, sf, "documents").select("doc_id", p.alias("p"), F.substring(F.lower("text"), F.greatest(p - 100, F.lit(1)), F.lit(207)).alias("c")).filter("p > 0")
    a, g = F.contains("c", F.lit("apache")), F.contains("c", F.lit("general public"))
    return c.select("doc_id", F.when(a, "apache").when(g, "gpl").otherwise("other").alias("kind"), F.when(a, 0.9).when(g, 0.8).otherwise(0.3).alias("confidence"))


QUERY_TYPES = {"definition": "(is|was|are) ", "procedure": "(to|from|with) ", "numeric": "[0-9]+", "comparison": "(or|and) "}


def type_hits(text: Column, rules: dict[str, str]) -> Column:
    """(hits, -ordinal, name) of the pattern that occurs most often."""
    low = F.lower(text)
    return F.array_max(F.array(*[F.struct(F.regexp_count(low, F.lit(p)).cast("long").alias("hits"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, (n, p) in enumerate(rules.items())]))


_HITS = "list_max([" + ", ".join(f"struct_pack(hits := len(regexp_extract_all(lower(text), '{p}')), o := {-i}, name := '{n}')" for i, (n, p) in enumerate(QUERY_TYPES.items())) + "])"
_TYPED = f"b AS (SELECT item_id, text, {_HITS} AS b FROM benchmark)"


def typed(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", "text", type_hits(F.col("text"), QUERY_TYPES).alias("b"))


@query("cls_05_query_type", f"WITH {_TYPED} SELECT item_id, CASE WHEN b.hits > 0 THEN b.name ELSE 'general' END AS type, b.hits AS hits FROM b")
def query_type(spark, sf) -> DataFrame:
    return typed(spark, sf).select("item_id", F.when(F.col("b.hits") > 0, F.col("b.name")).otherwise("general").alias("type"), F.col("b.hits").alias("hits"))


@query("cls_06_query_scores", rf"WITH {_TYPED}, s AS (SELECT item_id, b.hits AS h, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS n, len(regexp_extract_all(text, '[,;]')) AS c FROM b) SELECT item_id, round(least(0.5 + 0.1 * h, 1), 6)::DOUBLE AS confidence, round(least(n / 50.0::DOUBLE + 0.1 * c, 1), 6)::DOUBLE AS complexity, round(greatest(0, 1 - n / 20.0::DOUBLE), 6)::DOUBLE AS ambiguity FROM s")
def query_scores(spark, sf) -> DataFrame:
    n, c = F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")), F.regexp_count("text", F.lit("[,;]"))
    return typed(spark, sf).select(
        "item_id", r6(F.least(0.5 + 0.1 * F.col("b.hits"), F.lit(1.0))).alias("confidence"),
        r6(F.least(n / 50.0 + 0.1 * c, F.lit(1.0))).alias("complexity"), r6(F.greatest(F.lit(0.0), 1 - n / 20.0)).alias("ambiguity"),
    )


#: What a type of query asks of a chunk, as filters and as factors of its rank, and what numbers or definitions in the query add to
#: both; fixed values.
FILTERS = {"numeric": ["has_numerical_constraints"], "definition": ["has_definitions"], "procedure": ["has_procedure_steps"], "authority": ["has_authority_modals"]}
BOOSTS = {
    "numeric": {"numerical_constraints": 2.0, "chunk_priority_critical": 1.5}, "definition": {"definitions": 2.0, "chunk_priority_critical": 1.3}, "procedure": {"procedure_steps": 1.8, "chunk_priority_high": 1.2},
    "authority": {"authority_modals": 1.7, "chunk_priority_high": 1.2}, "reference": {"document_references": 1.5},
}
BY_NUMBERS = [("filter", "numerical_priority", None), ("boost", "exact_numerical_match", 2.5), ("boost", "partial_numerical_match", 1.5), ("boost", "constraint_match", 2.0)]
BY_DEFINITIONS = [("filter", "definition_priority", None), ("boost", "definition_match", 1.8)]
_NUMBER, _DEFINITION = "[0-9]", " (means|is called|hereinafter) "
_BY_TYPE = [(t, "filter", f, None) for t, fs in FILTERS.items() for f in fs] + [(t, "boost", f, v) for t, fs in BOOSTS.items() for f, v in fs.items()]


def query_rules(text: Column, kind: Column) -> Column:
    """Filters and boosts (rule, field, value) that a query of a type brings with it; the rules are part of the expression."""
    row = lambda r, f, v: F.struct(F.lit(r).alias("rule"), F.lit(f).alias("field"), F.lit(v).cast("double").alias("value"))
    low, none = F.lower(text), F.array().cast("array<struct<rule:string,field:string,value:double>>")
    own = [F.when(kind == t, F.array(*[row(*x[1:]) for x in _BY_TYPE if x[0] == t])) for t in dict.fromkeys(x[0] for x in _BY_TYPE)]
    more = [F.when(low.rlike(p), F.array(*[row(*x) for x in rules])).otherwise(none) for p, rules in ((_NUMBER, BY_NUMBERS), (_DEFINITION, BY_DEFINITIONS))]
    return F.concat(F.coalesce(*own, none), *more)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else f"{x}::DOUBLE" if isinstance(x, float) else f"'{x}'" for x in r) + ")" for r in rows)


@query("cls_07_boosts", f"""WITH {_TYPED}, r(type, rule, field, value) AS (VALUES {_values(_BY_TYPE)}), m(p, rule, field, value) AS (VALUES {_values([(_NUMBER, *x) for x in BY_NUMBERS] + [(_DEFINITION, *x) for x in BY_DEFINITIONS])})
SELECT item_id, rule, field, value FROM b JOIN r ON b.b.name = r.type AND b.b.hits > 0 UNION ALL SELECT item_id, rule, field, value FROM b JOIN m ON regexp_matches(lower(text), p)""")
def boosts(spark, sf) -> DataFrame:
    """Filters and boosts of each query by its type, its numbers and its definitions."""
    kind = F.when(F.col("b.hits") > 0, F.col("b.name"))
    return typed(spark, sf).select("item_id", F.inline(query_rules(F.col("text"), kind)))


#: Words of each intent (the one with most hits wins, the first of equals), of levels of difficulty beyond the number of words, of
#: expertise, and of small talk: a generic pack.
INTENTS = {
    "norm": ["which rule", "which law", "article", "where is it written"], "procedure": ["how", "steps", "order of", "procedure"], "comparison": ["difference", "compare", " than ", "versus"],
    "responsibility": ["penalty", "liable", "fine", "responsib"], "definition": ["what is", "define", "meaning", "notion"], "calculation": ["calculate", "how much", "percent", "formula"],
    "conflict": ["contradict", "conflict", "inconsisten", "versus the law"],
}
HARD, EXPERT, INFORMED = ["compare", "conflict", "analy"], ["case law", "doctrine", "interpretation", "collision"], ["article", "code", "license", "version", "public"]
CASUAL = r"^(hi|hello|good (day|morning|evening))|how are you|what is new|thank|bye|who are you|your name"


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words) + ")"


_BEST = "greatest(" + ", ".join(_hits(w) for w in INTENTS.values()) + ")"


@query("cls_08_intent", rf"""WITH m AS (SELECT conv_id, turn, lower(text) AS t, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS n FROM conversations WHERE role = 'user'),
h AS (SELECT *, {_BEST} AS best, regexp_matches(t, '{CASUAL}') OR n <= 3 AND {_hits(INFORMED)} = 0 AS casual FROM m)
SELECT conv_id, turn, CASE WHEN casual THEN 'chat' WHEN best = 0 THEN 'general' {" ".join(f"WHEN {_hits(w)} = best THEN '{k}'" for k, w in INTENTS.items())} END AS intent,
CASE WHEN n >= 40 OR {_hits(HARD)} > 1 THEN 'expert' WHEN n >= 15 OR {_hits(HARD)} = 1 THEN 'complex' WHEN n >= 5 THEN 'medium' ELSE 'simple' END AS complexity,
CASE WHEN {_hits(EXPERT)} > 0 THEN 'expert' WHEN {_hits(INFORMED)} > 0 THEN 'intermediate' ELSE 'beginner' END AS expertise FROM h""")
def intent(spark, sf) -> DataFrame:
    """Intent by hits of its words, difficulty by length and hard words, expertise by terms; small talk first."""
    t, n = F.lower("text"), F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+"))
    hits = lambda ws: F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w)))
    best = F.greatest(*[hits(w) for w in INTENTS.values()])
    casual = t.rlike(CASUAL) | ((n <= 3) & (hits(INFORMED) == 0))
    kind = F.when(casual, "chat").when(best == 0, "general")
    for k, w in INTENTS.items():
        kind = kind.when(hits(w) == best, k)
    level = F.when((n >= 40) | (hits(HARD) > 1), "expert").when((n >= 15) | (hits(HARD) == 1), "complex").when(n >= 5, "medium").otherwise("simple")
    skill = F.when(hits(EXPERT) > 0, "expert").when(hits(INFORMED) > 0, "intermediate").otherwise("beginner")
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", kind.alias("intent"), level.alias("complexity"), skill.alias("expertise"))


@query("cls_09_search_mode", "WITH m AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN 'numeric' WHEN contains(lower(text), 'table') THEN 'table' WHEN contains(text, '?') THEN 'question' ELSE 'general' END AS kind FROM conversations) SELECT conv_id, turn, kind, CASE kind WHEN 'numeric' THEN 'numerical' WHEN 'table' THEN 'structured' WHEN 'question' THEN 'balanced' ELSE 'recall' END AS mode FROM m")
def search_mode(spark, sf) -> DataFrame:
    t = F.col("text")
    kind = F.when(t.rlike("[0-9]"), "numeric").when(F.lower(t).contains("table"), "table").when(t.contains("?"), "question").otherwise("general")
    m = table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"))
    k = F.col("kind")
    return m.withColumn("mode", F.when(k == "numeric", "numerical").when(k == "table", "structured").when(k == "question", "balanced").otherwise("recall"))


@query("cls_10_strategy", "SELECT item_id, CASE WHEN length(text) < 120 THEN 'direct' WHEN regexp_matches(text, '[0-9]') THEN 'numeric' ELSE 'multi_step' END AS strategy, CASE WHEN length(text) < 120 THEN '1-3' ELSE '1-10' END AS articles FROM benchmark")
def strategy(spark, sf) -> DataFrame:
    short = F.length("text") < 120
    return table(spark, sf, "benchmark").select("item_id", F.when(short, "direct").when(F.col("text").rlike("[0-9]"), "numeric").otherwise("multi_step").alias("strategy"), F.when(short, "1-3").otherwise("1-10").alias("articles"))


_IMPORTANCE = "CASE WHEN regexp_matches(lower(text), 'license|version') THEN 'critical' WHEN contains(text, '?') THEN 'high' WHEN role = 'assistant' AND length(text) > 200 THEN 'medium' ELSE 'low' END"


def message_importance(text: Column, role: Column) -> Column:
    return F.when(F.lower(text).rlike("license|version"), "critical").when(text.contains("?"), "high").when((role == "assistant") & (F.length(text) > 200), "medium").otherwise("low")


@query("cls_11_importance", f"SELECT conv_id, turn, {_IMPORTANCE} AS importance FROM conversations")
def importance(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", message_importance(F.col("text"), F.col("role")).alias("importance"))


@query("cls_12_expertise", f"WITH s AS (SELECT conv_id, avg(CASE {_IMPORTANCE} WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS m FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, round(m, 6) AS score, CASE WHEN m >= 2 THEN 'expert' WHEN m >= 1 THEN 'advanced' WHEN m > 0 THEN 'basic' ELSE 'novice' END AS level FROM s")
def expertise(spark, sf) -> DataFrame:
    i = message_importance(F.col("text"), F.col("role"))
    m = table(spark, sf, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.avg(F.when(i == "critical", 3).when(i == "high", 2).when(i == "medium", 1).otherwise(0)).alias("m"))
    return m.select("conv_id", r6("m").alias("score"), F.when(F.col("m") >= 2, "expert").when(F.col("m") >= 1, "advanced").when(F.col("m") > 0, "basic").otherwise("novice").alias("level"))


@query("cls_13_file_type", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.html') THEN 'html' WHEN contains(url, '/feed') OR contains(url, 'source=feed') THEN 'feed' WHEN contains(substr(lower(html), 1, 1000), '<!doctype') THEN 'page' ELSE 'fragment' END AS kind FROM pages")
def file_type(spark, sf) -> DataFrame:
    u = F.col("url")
    kind = F.when(u.rlike(r"\.html"), "html").when(u.contains("/feed") | u.contains("source=feed"), "feed").when(F.substring(F.lower("html"), 1, 1000).contains("<!doctype"), "page").otherwise("fragment")
    return table(spark, sf, "pages").select("page_id", kind.alias("kind"))
