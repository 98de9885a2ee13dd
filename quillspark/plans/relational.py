"""Scans, filters and top-k over documents, chunks and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, new_folder, table


@query("src_10_newest_first", "SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY doc_id DESC) AS position FROM documents ORDER BY doc_id DESC LIMIT 100")
def newest_first(spark, sf, k: int = 100) -> DataFrame:
    """The k newest documents (highest id), with their position: sorting is a top-k, never a global sort."""
    top = table(spark, sf, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("doc_id")).limit(k)
    return top.withColumn("position", F.row_number().over(W.orderBy(F.desc("doc_id"))))


@query("src_11_full_scan", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def full_scan(spark, sf) -> DataFrame:
    """The whole collection; Spark splits the scan, so there are no pages."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("src_12_ordered_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS ordinal FROM chunks")
def ordered_chunks(spark, sf) -> DataFrame:
    c = chunks(table(spark, sf, "documents"))
    return c.select("doc_id", "chunk_index", "text", F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")).alias("ordinal"))


def allowed(url: Column, hosts: list[str]) -> Column:
    """The url's host is one of the hosts or a subdomain of one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))


@query(
    "src_13_web_results",
    r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, html FROM pages),
l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(https?://[^"]+)"', 1)) AS link FROM p WHERE host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org'))
SELECT p.page_id, p.host, (SELECT count(*) FROM l WHERE l.page_id = p.page_id) AS n_links FROM p WHERE host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org')""",
)
def web_results(spark, sf) -> DataFrame:
    """Pages of allow-listed hosts, with the number of links that they hold."""
    p = table(spark, sf, "pages").filter(allowed(F.col("url"), ["example.com", "example.org"]))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    links = F.size(F.regexp_extract_all("html", F.lit('href="(https?://[^"]+)"'), 1))
    return p.select("page_id", host.alias("host"), links.cast("long").alias("n_links"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a sorted listing with the total and whether more follow."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))  # one row


@query(
    "flt_01_document_list",
    """WITH f AS (SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source ILIKE '%SRC1%')
SELECT doc_id, lang, source, (SELECT count(*) FROM f) AS total, 60 < (SELECT count(*) FROM f) AS has_more FROM f ORDER BY doc_id DESC LIMIT 50 OFFSET 10""",
)
def document_list(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").filter((F.col("lang") == "en") & F.col("source").ilike("%SRC1%"))
    return page(d, [F.desc("doc_id")], 10, 50)


def nearest_to_one(spark, sf, vec_id: int = 0) -> DataFrame:
    """Cosine of every vector to one of them: vec_id, label, similarity."""
    from quillspark.functions.text import cosine

    e = table(spark, sf, "embeddings")
    q = e.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")).limit(1)
    return e.join(F.broadcast(q)).select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


NEAREST = "s AS (SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(
    "flt_02_similarity_threshold",
    f"""WITH {NEAREST} SELECT s.vec_id, round(1 - similarity, 6) AS distance, similarity, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS snippet
FROM s JOIN documents d ON s.vec_id = d.doc_id WHERE similarity >= 0.3""",
)
def similarity_threshold(spark, sf, least: float = 0.3, longest: int = 80) -> DataFrame:
    """Hits whose similarity (1 - distance) reaches the threshold, with their text cut at a maximum length."""
    s = nearest_to_one(spark, sf).filter(F.col("similarity") >= least)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    cut = F.when(F.length("text") > longest, F.concat(F.substring("text", 1, longest), F.lit("..."))).otherwise(F.col("text"))
    return s.join(d, "vec_id").select("vec_id", F.round(1 - F.col("similarity"), 6).alias("distance"), "similarity", cut.alias("snippet"))


@query("flt_03_result_filter", f"WITH {NEAREST} SELECT vec_id, label, similarity FROM s WHERE label IN (1, 3, 5) AND similarity >= 0.1")
def result_filter(spark, sf, labels=(1, 3, 5), least: float = 0.1) -> DataFrame:
    return nearest_to_one(spark, sf).filter(F.col("label").isin(*labels) & (F.col("similarity") >= least))


def filter_or_all(df: DataFrame, test: Column) -> DataFrame:
    """Rows that pass; all rows if none does. One flag row is joined, so no row count crosses to the driver."""
    any_ = df.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("_any"))
    return df.join(F.broadcast(any_)).filter(test | ~F.col("_any")).drop("_any")


@query("flt_04_filter_or_all", "SELECT doc_id, source FROM documents WHERE source = 'src3' OR NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src3')")
def source_filter(spark, sf) -> DataFrame:
    return filter_or_all(table(spark, sf, "documents").select("doc_id", "source"), F.col("source") == "src3")


@query("flt_04_filter_or_all_miss", "SELECT doc_id, source FROM documents")
def source_filter_miss(spark, sf) -> DataFrame:
    return filter_or_all(table(spark, sf, "documents").select("doc_id", "source"), F.col("source") == "no such source")


#: Least score by mode, and further gates on the entity score.
GATES = {"precision": 0.7, "balanced": 0.5, "recall": 0.3, "numerical": 0.6}


def quality_gate(df: DataFrame, mode: Column) -> DataFrame:
    """df(score, entity_score, has_numeric): rows that pass their mode's gates."""
    least = F.coalesce(*[F.when(mode == m, F.lit(v)) for m, v in GATES.items()])
    extra = F.when(mode == "precision", F.col("entity_score") >= 0.4).when(mode == "numerical", (F.col("entity_score") >= 0.3) | F.col("has_numeric")).otherwise(True)
    return df.filter((F.col("score") >= least) & extra)


_SCORES = "x AS (SELECT doc_id, (doc_id % 97) / 97.0 AS score, (doc_id % 31) / 31.0 AS entity_score, regexp_matches(text, '[0-9]') AS has_numeric, ['precision', 'balanced', 'recall', 'numerical'][1 + doc_id % 4] AS mode FROM documents)"


def scored_documents(spark, sf) -> DataFrame:
    """Deterministic stand-in scores for operators that take them from a model."""
    d = F.col("doc_id")
    mode = F.element_at(F.array(*map(F.lit, GATES)), (d % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", ((d % 97) / 97.0).alias("score"), ((d % 31) / 31.0).alias("entity_score"), F.col("text").rlike("[0-9]").alias("has_numeric"), mode.alias("mode"))


@query(
    "flt_05_quality_gate",
    f"""WITH {_SCORES} SELECT doc_id, mode, round(score, 6) AS score FROM x WHERE score >= CASE mode WHEN 'precision' THEN 0.7 WHEN 'balanced' THEN 0.5 WHEN 'recall' THEN 0.3 ELSE 0.6 END
AND CASE mode WHEN 'precision' THEN entity_score >= 0.4 WHEN 'numerical' THEN entity_score >= 0.3 OR has_numeric ELSE true END""",
)
def quality_gate_query(spark, sf) -> DataFrame:
    return quality_gate(scored_documents(spark, sf), F.col("mode")).select("doc_id", "mode", F.round("score", 6).alias("score"))


def grade_gate(df: DataFrame, group: str, keep: int = 3) -> DataFrame:
    """df(group, ordinal, text, score, has_article): graded results by group; if none passes the first ``keep`` stay, flagged."""
    good = (F.length("text") >= 180) | (F.col("score") >= 0.45) | F.col("has_article")
    w = W.partitionBy(group)
    g = df.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("n_good", F.sum(F.col("good").cast("int")).over(w))
    g = g.withColumn("rank", F.row_number().over(w.orderBy("ordinal")))
    flag = F.when(F.col("n_good") == 0, "none_passed").when(F.col("n_good") < 2, "few_passed").otherwise("ok")
    return g.filter(F.col("good") | ((F.col("n_good") == 0) & (F.col("rank") <= keep))).withColumn("flag", flag).drop("rank", "n_good", "good")


@query(
    "flt_06_grade_gate",
    f"""WITH {CHUNKS}, g AS (SELECT doc_id, chunk_index, text, (length(text) >= 180 OR (chunk_index % 11) / 11.0 >= 0.45 OR contains(text, '§')) AS good FROM chunks),
n AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY doc_id) AS n_good, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS r FROM g)
SELECT doc_id, chunk_index, CASE WHEN n_good = 0 THEN 'none_passed' WHEN n_good < 2 THEN 'few_passed' ELSE 'ok' END AS flag FROM n WHERE good OR (n_good = 0 AND r <= 3)""",
)
def grade_gate_query(spark, sf) -> DataFrame:
    c = chunks(table(spark, sf, "documents")).withColumn("score", (F.col("chunk_index") % 11) / 11.0).withColumn("has_article", F.col("text").contains("§"))
    return grade_gate(c.withColumn("ordinal", F.col("chunk_index")), "doc_id").select("doc_id", "chunk_index", "flag")


@query(
    "flt_07_citation_filter",
    f"""WITH {CHUNKS}, c AS (SELECT doc_id, chunk_index, CAST(doc_id % 10 AS VARCHAR) AS article, text, contains(text, CAST(doc_id % 10 AS VARCHAR)) AS cited FROM chunks),
a AS (SELECT *, bool_or(cited) OVER (PARTITION BY doc_id) AS any_cited FROM c) SELECT doc_id, chunk_index, article, cited FROM a WHERE cited OR NOT any_cited""",
)
def citation_filter(spark, sf) -> DataFrame:
    """Chunks that cite the article of their metadata; all chunks of a document in which none does."""
    c = chunks(table(spark, sf, "documents")).withColumn("article", (F.col("doc_id") % 10).cast("string"))
    c = c.withColumn("cited", F.col("text").contains(F.col("article")))
    c = c.withColumn("any_cited", F.bool_or("cited").over(W.partitionBy("doc_id")))
    return c.filter(F.col("cited") | ~F.col("any_cited")).select("doc_id", "chunk_index", "article", "cited")


@query(
    "flt_08_user_filter",
    """SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE 'active' END AS status FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AND (contains(lower(c_name), '11') OR contains(CAST(c_custkey AS VARCHAR), '11'))""",
)
def user_filter(spark, sf) -> DataFrame:
    """Users by a set of permissions, a status, and a search over several columns."""
    status = F.when(F.col("c_acctbal") < 0, "blocked").otherwise("active")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", status.alias("status"))
    found = F.lower("c_name").contains("11") | F.col("c_custkey").cast("string").contains("11")
    return c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("status") == "active") & found)


@query("flt_10_history_search", "SELECT conv_id, turn, text FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 10")
def history_search(spark, sf, what: str = "the", k: int = 10) -> DataFrame:
    c = table(spark, sf, "conversations").filter(F.lower("text").contains(what))
    return c.orderBy(F.desc("conv_id"), F.desc("turn")).limit(k).select("conv_id", "turn", "text")


#: Marks that make a text look like a notice or regulation when enough of them occur.
INDICATORS = ["license", "version", "public", "work", "under", "the", "of", "and", "general", "der", "die", "des", "los", "que", "de"]


@query("flt_11_document_predicate", "SELECT doc_id, (" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in INDICATORS) + ") AS hits FROM documents WHERE source = 'src7' OR (" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in INDICATORS) + ") >= 3")
def document_predicate(spark, sf, least: int = 3) -> DataFrame:
    """A shortcut by source, else enough indicators in the text."""
    hits = sum((F.lower("text").contains(w).cast("int") for w in INDICATORS[1:]), F.lower("text").contains(INDICATORS[0]).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", "source", hits.alias("hits"))
    return d.filter((F.col("source") == "src7") | (F.col("hits") >= least)).select("doc_id", "hits")


def moderation(text: Column, forbidden: list[str], longest: int = 4000) -> Column:
    """Severity of a message; a later rule overwrites an earlier one."""
    high = text.rlike(r"https?://") | text.rlike(r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b") | text.rlike(r"[0-9]{10,}")
    bad = F.exists(F.array(*map(F.lit, forbidden)), lambda w: F.contains(F.lower(text), w))
    long_ = (F.length(text) > longest) | text.rlike(r"(.)\1{10,}")
    return F.when(long_, "medium").when(high, "high").when(bad, "medium").otherwise("none")


@query("flt_12_moderation")
def moderation_query(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", moderation(F.col("text"), ["trash", "loser"]).alias("severity"))


@query(
    "flt_13_title_repair",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'Title ' || doc_id END AS title, text FROM documents),
r AS (SELECT doc_id, CASE WHEN coalesce(title, '') = '' THEN substr(text, 1, 50) ELSE title END AS title FROM t)
SELECT doc_id, CASE WHEN length(title) < 10 THEN 'Document ' || doc_id ELSE title END AS title FROM r""",
)
def title_repair(spark, sf) -> DataFrame:
    """Missing titles become the text's first 50 characters, short ones a synthetic title."""
    d = F.col("doc_id")
    title = F.when(d % 3 == 0, F.lit(None)).when(d % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("Title "), d))
    t = table(spark, sf, "documents").select("doc_id", "text", title.alias("title"))
    t = t.withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", F.substring("text", 1, 50)).otherwise(F.col("title")))
    return t.select("doc_id", F.when(F.length("title") < 10, F.concat(F.lit("Document "), d)).otherwise(F.col("title")).alias("title"))


@query("flt_14_search_text", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(url), ''), '') AS search_text FROM pages")
def search_text(spark, sf) -> DataFrame:
    """The first of several fields that holds text, empty if none does."""
    fields = [F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("url")]
    return table(spark, sf, "pages").select("page_id", F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields], F.lit("")).alias("search_text"))


def rank_all(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row among those of equal ``by``, in a total ``order``; no group, however large, meets in one task.

    Rows are dealt out by range and sorted, stored in the shared folder with their part, and numbered there; a part's ranks start
    behind those of the parts before it.
    """
    path = new_folder(df.sparkSession, "ranked")
    spread = df.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id())
    spread.write.parquet(path)
    stored = df.sparkSession.read.schema(spread.schema).parquet(path)
    counts = stored.groupBy("part_", *by).agg(F.count("*").alias("n_"))  # a row a part and group
    before = F.coalesce(F.sum("n_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part_", *by, before.alias("before_"))
    own = stored.withColumn("nth_", F.row_number().over(W.partitionBy("part_", *by).orderBy(*order)))
    return own.join(offsets, ["part_", *by]).withColumn(name, (F.col("nth_") + F.col("before_")).cast("int")).select(*df.columns, name)


@query("top_02_sort_by_type", f"WITH {_SCORES} SELECT doc_id, mode, row_number() OVER (PARTITION BY mode ORDER BY CASE WHEN mode = 'numerical' THEN entity_score WHEN mode = 'precision' THEN CAST(has_numeric AS INT) ELSE score END DESC, score DESC, doc_id) AS rank FROM x")
def sort_by_type(spark, sf) -> DataFrame:
    """Results ranked by the keys of their query type: numbers by entity score, definitions by having one, the rest by score."""
    first = F.when(F.col("mode") == "numerical", F.col("entity_score")).when(F.col("mode") == "precision", F.col("has_numeric").cast("double")).otherwise(F.col("score"))
    d = scored_documents(spark, sf).select("doc_id", "mode", first.alias("first"), "score")
    return rank_all(d, ["mode"], [F.desc("first"), F.desc("score"), F.asc("doc_id")]).select("doc_id", "mode", "rank")


@query("top_03_capped_candidates", f"WITH {NEAREST}, c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS r FROM s) SELECT vec_id, label, similarity FROM c WHERE r <= 50 ORDER BY similarity DESC, vec_id LIMIT 5")
def capped_candidates(spark, sf, k: int = 5) -> DataFrame:
    """Best candidates of each label up to min(10 k, 50), then the best k of all."""
    s = nearest_to_one(spark, sf)
    c = s.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))).filter(F.col("r") <= min(10 * k, 50))
    return c.orderBy(F.desc("similarity"), "vec_id").limit(k).select("vec_id", "label", "similarity")


@query("top_04_importance", "SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 2 WHEN role = 'system' THEN 1 ELSE 0 END AS importance FROM conversations ORDER BY 3 DESC, turn DESC, conv_id LIMIT 10")
def importance(spark, sf, k: int = 10) -> DataFrame:
    c = table(spark, sf, "conversations")
    level = F.when(F.col("text").contains("?"), 2).when(F.col("role") == "system", 1).otherwise(0)
    return c.select("conv_id", "turn", level.alias("importance")).orderBy(F.desc("importance"), F.desc("turn"), "conv_id").limit(k)


@query("top_05_priority_pop", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events) WHERE r = 1")
def priority_pop(spark, sf) -> DataFrame:
    """Next task of each queue: highest priority, ties by the member as text, descending."""
    order = F.struct("value", F.col("event_id").cast("string").alias("m"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", order).alias("event_id"))


def sentence_score(sentence: Column, terms: list[str]) -> Column:
    """2 for each term, 1 for a digit, 1 for 50 to 300 characters, -1 below 30 or above 500."""
    n = F.length(sentence)
    hits = sum((F.contains(F.lower(sentence), F.lit(t)).cast("int") * 2 for t in terms[1:]), F.contains(F.lower(sentence), F.lit(terms[0])).cast("int") * 2)
    return hits + sentence.rlike("[0-9]").cast("int") + n.between(50, 300).cast("int") - ((n < 30) | (n > 500)).cast("int")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


SENTENCES = "s AS (SELECT doc_id, CAST(i AS INT) AS pos, s AS sentence FROM (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ss FROM documents)))"
TERMS = ["license", "with", "there"]


@query(
    "top_06_key_sentences",
    f"""WITH {SENTENCES}, k AS (SELECT *, 2 * (CAST(contains(lower(sentence), 'license') AS INT) + CAST(contains(lower(sentence), 'with') AS INT) + CAST(contains(lower(sentence), 'there') AS INT)) + CAST(regexp_matches(sentence, '[0-9]') AS INT)
 + CAST(length(sentence) BETWEEN 50 AND 300 AS INT) - CAST(length(sentence) < 30 OR length(sentence) > 500 AS INT) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM k) SELECT doc_id, pos, score, rank FROM r WHERE rank <= 3""",
)
def key_sentences(spark, sf, n: int = 3) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("score", sentence_score(F.col("sentence"), TERMS))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))).filter(F.col("rank") <= n).select("doc_id", "pos", "score", "rank")
