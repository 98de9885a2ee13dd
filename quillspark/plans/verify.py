"""Verification of answers against sources, and quality of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import r6, tokens, words
from quillspark.plans.joins import _OVERLAP, _best
from quillspark.plans.relational import sentences
from quillspark.registry import query
from quillspark.sources.tables import table

_KW = r"list_slice(list_distinct(list_filter(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3)), 1, 50)"


@query("ver_01_citations", r"""WITH p AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3))) AS kw, lower(d.text) AS src, (item_id % 5) / 4.0::DOUBLE AS cited FROM benchmark b JOIN documents d ON b.item_id = d.doc_id),
m AS (SELECT item_id, cited, len(list_filter(list_slice(kw, 1, 50), lambda w: contains(src, w))) / greatest(len(list_slice(kw, 1, 50)), 1)::DOUBLE AS hit FROM p)
SELECT item_id, cited >= 0.5 AS valid, round(hit, 6) AS content_match, round(0.35 * cited + 0.5 * hit + CASE WHEN cited >= 0.5 AND hit > 0.5 THEN 0.15 ELSE 0 END, 6)::DOUBLE AS confidence FROM m""")
def citations(spark, sf) -> DataFrame:
    """Valid with half of the citations there; content match is the share of up to fifty keywords in the source."""
    kw = F.slice(F.array_sort(F.array_distinct(tokens(F.col("text"), 3))), 1, 50)
    b = table(spark, sf, "benchmark").select("item_id", kw.alias("kw"), ((F.col("item_id") % 5) / 4.0).alias("cited"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("src"))
    hit = F.size(F.filter("kw", lambda w: F.contains(F.col("src"), w))) / F.greatest(F.size("kw"), F.lit(1))
    m = b.join(d, "item_id").select("item_id", "cited", hit.alias("hit"))
    extra = F.when((F.col("cited") >= 0.5) & (F.col("hit") > 0.5), 0.15).otherwise(0.0)
    return m.select("item_id", (F.col("cited") >= 0.5).alias("valid"), r6("hit").alias("content_match"), r6(0.35 * F.col("cited") + 0.5 * F.col("hit") + extra).alias("confidence"))


@query("ver_02_confidence", f"WITH {_OVERLAP}, c AS (SELECT item_id, 0.25 * CAST(overlap > 0.3 AS INT) + 0.35 * overlap + 0.25 * (item_id % 4) / 3.0::DOUBLE + 0.15 AS s FROM b WHERE r = 1) SELECT item_id, round(s, 6)::DOUBLE AS confidence, CASE WHEN s >= 0.7 THEN 'accept' WHEN s >= 0.4 THEN 'review' ELSE 'reject' END AS advice FROM c")
def confidence(spark, sf) -> DataFrame:
    """Citation, claim, consistency and marker factors by .25/.35/.25/.15, with bands."""
    s = 0.25 * (F.col("overlap") > 0.3).cast("int") + 0.35 * F.col("overlap") + 0.25 * (F.col("item_id") % 4) / 3.0 + 0.15
    c = _best(spark, sf).select("item_id", s.alias("s"))
    return c.select("item_id", r6("s").alias("confidence"), F.when(F.col("s") >= 0.7, "accept").when(F.col("s") >= 0.4, "review").otherwise("reject").alias("advice"))


@query("ver_03_statements", r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(list_slice(string_split(text, '.'), 1, 5), lambda x: trim(x)), lambda x: length(x) > 10) AS ss FROM conversations WHERE role = 'assistant'),
x AS (SELECT conv_id, turn, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM s), d AS (SELECT doc_id // 3 AS conv_id, lower(text) AS t FROM documents),
j AS (SELECT x.conv_id, turn, CAST(i AS INT) AS nth, count(*) FILTER (len(list_filter(list_slice(string_split(lower(s), ' '), 1, 3), lambda w: contains(t, w))) > 0) AS supporting FROM x JOIN d ON d.conv_id = x.conv_id GROUP BY ALL)
SELECT *, CASE WHEN supporting > 0 THEN 'verified' ELSE 'unverified' END AS status, (CASE WHEN supporting > 0 THEN 0.9 ELSE 0.3 END)::DOUBLE AS confidence FROM j""")
def statements(spark, sf) -> DataFrame:
    """How many of the first three results (three documents a conversation stand for them) hold any of the first three words of each
    of the first five sentences of more than ten characters."""
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    ss = F.filter(F.transform(F.slice(F.split("text", r"\."), 1, 5), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    s = c.select("conv_id", "turn", F.posexplode(ss).alias("nth", "s"))
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).alias("conv_id"), F.lower("text").alias("t"))
    hit = F.exists(F.slice(F.split(F.lower("s"), " "), 1, 3), lambda w: F.contains(F.col("t"), w))
    j = s.join(d, "conv_id").groupBy("conv_id", "turn", "nth").agg(F.count_if(hit).alias("supporting"))
    good = F.col("supporting") > 0
    return j.select("*", F.when(good, "verified").otherwise("unverified").alias("status"), F.when(good, 0.9).otherwise(0.3).alias("confidence"))


@query("ver_04_critique", "SELECT conv_id, turn, concat_ws(',', CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN turn % 3 = 0 THEN 'no_sources' END, CASE WHEN NOT contains(lower(text), 'article') THEN 'no_article' END) AS flags FROM conversations WHERE role = 'assistant'")
def critique(spark, sf) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.length(F.trim("text")) == 0, "empty"), F.when(F.col("turn") % 3 == 0, "no_sources"), F.when(~F.contains(F.lower("text"), F.lit("article")), "no_article")))
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.array_join(flags, ",").alias("flags"))


@query("ver_05_definition_check", "SELECT source, CASE WHEN bool_or(contains(lower(text), 'license')) FILTER (r <= 5) THEN 0.7 ELSE 0.2 END::DOUBLE AS confidence FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY source")
def definition_check(spark, sf, term: str = "license") -> DataFrame:
    """0.7 if the term is in one of the first five results of a group, else 0.2."""
    from pyspark.sql import Window as W

    d = table(spark, sf, "documents").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).filter("r <= 5")
    return d.groupBy("source").agg(F.when(F.bool_or(F.contains(F.lower("text"), F.lit(term))), 0.7).otherwise(0.2).alias("confidence"))


@query("ver_06_slide_quality", "SELECT page_id, round((least(length(html) / 2000.0::DOUBLE, 1) + least(len(regexp_extract_all(html, 'href=')) / 10.0::DOUBLE, 1) + CAST(contains(html, '<title>') AS INT) + CAST(contains(html, '<p') AS INT)) / 4, 6) AS quality FROM pages")
def slide_quality(spark, sf) -> DataFrame:
    """Mean of element, relation, summary and structure scores."""
    parts = F.array(F.least(F.length("html") / 2000.0, F.lit(1.0)), F.least(F.regexp_count("html", F.lit("href=")) / 10.0, F.lit(1.0)), F.contains("html", F.lit("<title>")).cast("double"), F.contains("html", F.lit("<p")).cast("double"))
    return table(spark, sf, "pages").select("page_id", r6(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 4).alias("quality"))


#: Categories of the validation with what breaks them and how much it takes: critical .3, high .15, medium .05, low .02.
CATEGORIES = {
    "factual": ("NOT regexp_matches(t, '[0-9]')", 0.3), "legal": ("NOT regexp_matches(lower(t), 'license|version|public')", 0.15), "logical": ("regexp_matches(lower(t), 'always') AND regexp_matches(lower(t), 'never')", 0.15),
    "complete": ("length(t) < 200", 0.05), "relevant": ("overlap < 0.3", 0.05), "adapted": ("length(t) > 1500", 0.02), "formal": ("NOT regexp_matches(t, '^[A-Z]')", 0.02), "safe": ("regexp_matches(lower(t), 'https?://|password')", 0.3),
}


@query("ver_07_validation", r"""WITH q AS (SELECT conv_id, turn, role, text AS t, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3)) AS ws, coalesce(lag(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3))) OVER (PARTITION BY conv_id ORDER BY turn), []) AS asked FROM conversations),
o AS (SELECT conv_id, turn, t, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, ws)) / len(asked)::DOUBLE ELSE 1 END AS overlap FROM q WHERE role = 'assistant'),
i AS (SELECT conv_id, turn, unnest([""" + ", ".join(f"CASE WHEN {test} THEN {{'c': '{n}', 'w': {w}::DOUBLE}} END" for n, (test, w) in CATEGORIES.items()) + """]) AS x FROM o)
SELECT conv_id, turn, string_agg(x.c, ',' ORDER BY x.c) AS issues, round(greatest(0, 1 - sum(x.w)), 6)::DOUBLE AS score, CASE WHEN 1 - sum(x.w) >= 0.9 THEN 'excellent' WHEN 1 - sum(x.w) >= 0.75 THEN 'good' WHEN 1 - sum(x.w) >= 0.6 THEN 'acceptable' ELSE 'poor' END AS grade FROM i WHERE x IS NOT NULL GROUP BY conv_id, turn""")
def validation(spark, sf) -> DataFrame:
    """Issues of each response in eight categories, with the score that they leave and its grade."""
    ws = F.array_distinct(tokens(F.col("text"), 3))
    asked = F.coalesce(F.lag(ws).over(W.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("t"), ws.alias("ws"), asked.alias("asked")).filter("role = 'assistant'")
    c = c.withColumn("overlap", F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", "ws")) / F.size("asked")).otherwise(1.0))
    found = [F.when(F.expr(test.replace("regexp_matches", "regexp_like")), F.struct(F.lit(n).alias("c"), F.lit(w).alias("w"))) for n, (test, w) in CATEGORIES.items()]
    c = c.select("conv_id", "turn", F.array_compact(F.array(*found)).alias("f")).filter(F.size("f") > 0)
    score = F.round(1 - F.aggregate("f", F.lit(0.0), lambda a, x: a + x["w"]), 6)
    grade = F.when(score >= 0.9, "excellent").when(score >= 0.75, "good").when(score >= 0.6, "acceptable").otherwise("poor")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(F.transform("f", lambda x: x["c"])), ",").alias("issues"), F.greatest(F.lit(0.0), score).alias("score"), grade.alias("grade"))


@query("ver_08_self_critique", "SELECT user_id, round(sum(value / 100 * (1 + event_id % 3)) / sum(1 + event_id % 3) * CASE WHEN count(*) FILTER (value < 1) > 0 THEN 0.8 ELSE 1 END, 6) AS confidence FROM events GROUP BY user_id")
def self_critique(spark, sf) -> DataFrame:
    """Weighted mean of critique scores, multiplied by a penalty if one is very low."""
    w = 1 + F.col("event_id") % 3
    penalty = F.when(F.count_if(F.col("value") < 1) > 0, 0.8).otherwise(1.0)
    return table(spark, sf, "events").groupBy("user_id").agg(r6(F.sum(F.col("value") / 100 * w) / F.sum(w) * penalty).alias("confidence"))
