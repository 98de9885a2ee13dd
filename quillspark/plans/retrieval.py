"""Retrieval: inverted index, BM25, vector top-k, hybrid and rank fusion, reranking, answers.

Searches go by the stored index of ``operators.search_index``; ``bm25`` ranks documents that have none. Queries meet documents and
vectors in blocks of a bounded number, as products of matrices. Rankings are top-k or per-query windows with the document id as last key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.stemmer import russian_stem
from quillspark.functions.text import counted, jaccard, r6, tokens
from quillspark.operators import search_index
from quillspark.operators.search_index import BROADCAST_TERMS, FLOOR, K1, B
from quillspark.plans.relational import NEAREST, TERMS, nearest_to_one, sentence_score, sentences
from quillspark.plans.scalars import query_variants
from quillspark.registry import query
from quillspark.sources.tables import spread, stored, table

_TOK = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 2)"


#: Queries that are scored against all vectors in one pass.
BLOCK_QUERIES = 1_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: doc_id, dl, terms(term, tf), a row a document; terms: term, df, and under a null term n documents and their mean
    length). One pass over the texts each."""
    t = spread(docs.select("doc_id", "text")).select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    rows = t.select("doc_id", F.size("ts").alias("dl"), counted(F.col("ts")).alias("terms"))
    every = rows.select(F.explode(F.concat(F.transform("terms", lambda x: F.struct(x["term"].alias("term"), F.lit(0).alias("dl"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("dl").alias("dl"))))).alias("x"))
    return rows, every.groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """docs(doc_id, text), queries(item_id, text) -> item_id, doc_id, score. Okapi: repeated query terms count repeatedly, negative
    idf becomes a share of the mean idf over all terms."""
    rows, terms = index(docs)
    q = queries.select("item_id", F.explode(counted(tokens(F.col("text")))).alias("x")).select("item_id", "x.term", F.col("x.tf").alias("qn"))
    stats = terms.filter("term is null").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    idf = terms.filter("term is not null").join(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean"))
    wanted = idf.join(bounded(q, BROADCAST_TERMS), "term").join(F.broadcast(mean)).select("item_id", "term", "qn", "avgdl", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    hit = rows.select("doc_id", "dl", F.inline("terms")).join(bounded(wanted, BROADCAST_TERMS), "term")
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("item_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25_sql(source: str) -> str:
    """The same in DuckDB over queries source(item_id, text), to be put after WITH: norm(item_id, doc_id, s)."""
    return f"""tk AS (SELECT doc_id, {_TOK} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk),
tx AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tk), tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM tx GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ri AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, st), mi AS (SELECT avg(raw) AS mean FROM ri), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM ri, mi),
qx AS (SELECT item_id, unnest({_TOK}) AS term FROM {source}), qt AS (SELECT item_id, term, count(*) AS qn FROM qx GROUP BY ALL),
bm AS (SELECT item_id, doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.8 + 0.8 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY item_id, doc_id),
norm AS (SELECT item_id, doc_id, round(CASE WHEN max(score) OVER (PARTITION BY item_id) = min(score) OVER (PARTITION BY item_id) THEN 0 ELSE (score - min(score) OVER (PARTITION BY item_id)) / (max(score) OVER (PARTITION BY item_id) - min(score) OVER (PARTITION BY item_id)) END, 6) AS s FROM bm)"""


BM25 = bm25_sql("benchmark")


def normalized(scores: DataFrame) -> DataFrame:
    """Scores of each query brought to 0..1 (zeros if all are equal), by aggregated bounds."""
    b = scores.groupBy("item_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    s = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return scores.join(b, "item_id").select("item_id", "doc_id", r6(s).alias("s"))


def top(df: DataFrame, k: int, score: str = "s") -> DataFrame:
    """The best k of each query with their rank; a partial limit keeps k rows a query and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc(score), "doc_id"))).filter(F.col("rank") <= k)


def index_of(spark, sf) -> search_index.Index:
    """The kept index of the documents."""
    return search_index.kept(spark, sf, table(spark, sf, "documents"))


def _best(spark, sf, k: int) -> DataFrame:
    """item_id, doc_id, s, rank of the k best documents of each item."""
    return index_of(spark, sf).best(table(spark, sf, "benchmark"), k).select("item_id", "doc_id", "s", "rank")


@query("ret_01_bm25", f"WITH {BM25} SELECT doc_id, s AS score, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM norm WHERE item_id = 0 QUALIFY rank <= 10")
def bm25_query(spark, sf) -> DataFrame:
    best = index_of(spark, sf).best(table(spark, sf, "benchmark").filter("item_id = 0"), 10)
    return best.select("doc_id", F.col("s").alias("score"), "rank")


@query("ret_02_knn", f"WITH {NEAREST} SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s ORDER BY similarity DESC, vec_id LIMIT 10")
def knn(spark, sf, k: int = 10) -> DataFrame:
    """Exact nearest neighbours of one vector: one scan, a top-k, no sort of all rows."""
    best = nearest_to_one(spark, sf).orderBy(F.desc("similarity"), "vec_id").limit(k)
    return best.select("vec_id", "similarity", F.row_number().over(W.orderBy(F.desc("similarity"), "vec_id")).alias("rank"))


_HYBRID = f"""{BM25}, v AS (SELECT b.item_id, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS c FROM embeddings e JOIN (SELECT item_id FROM benchmark) b ON true JOIN embeddings q ON q.vec_id = b.item_id),
vt AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) <= 50), hy AS (SELECT n.item_id, n.doc_id, n.s, coalesce(vt.c, 0) AS c, round(0.5 * n.s + 0.5 * coalesce(vt.c, 0), 8) AS h FROM norm n LEFT JOIN vt ON n.item_id = vt.item_id AND n.doc_id = vt.doc_id)"""


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries(item_id, q), vectors(vec_id, embedding) -> item_id, doc_id, c, rank: the k nearest vectors of each query.

    Queries go to the tasks in blocks of at most ``BLOCK_QUERIES``, a scan of the vectors each, as one product of matrices a batch.
    """
    blocks = -(-queries.count() // BLOCK_QUERIES) or 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for i in range(blocks):
        got = queries.filter(block == i).select("item_id", "q").filter("q is not null").toPandas()
        s = top(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("embedding is not null").mapInArrow(_products(got, k), "item_id long, doc_id long, c double"), k, "c")
        out = s if out is None else out.unionByName(s)
    return out


def _products(queries, k: int):
    """Cosines of a batch of vectors with all queries at once; a batch gives its best k of each, with all that equal the last of them."""
    import numpy as np
    import pyarrow as pa

    def unit(rows) -> np.ndarray:
        m = np.array([np.asarray(x, np.float64) for x in rows]).reshape(len(rows), -1)
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)

    ids, q = queries["item_id"].to_numpy(np.int64), unit(list(queries["q"]))

    def run(batches):
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            c = np.round(unit(b.column(1).to_pylist()) @ q.T, 6)
            c = np.where(np.isnan(c), -np.inf, c)
            last = -np.partition(-c, min(k, len(c)) - 1, axis=0)[min(k, len(c)) - 1]
            row, col = np.nonzero((c >= last) & np.isfinite(c))
            yield pa.RecordBatch.from_arrays([pa.array(ids[col]), pa.array(b.column(0).to_numpy()[row]), pa.array(c[row, col])], ["item_id", "doc_id", "c"])

    return run


def vector_candidates(spark, sf, k: int = 50) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = table(spark, sf, "benchmark").select("item_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")), "item_id")
    return nearest(q, e, k).drop("rank")


def hybrid(spark, sf, k: int, w: float = 0.5) -> DataFrame:
    """item_id, doc_id, s, c, h, rank of the k documents of each item that are best by both scores."""
    def blend(s, c, _):
        import numpy as np

        return np.round(w * s + (1 - w) * c, 8)

    v = vector_candidates(spark, sf).select("item_id", "doc_id", F.col("c").alias("given"))
    best = index_of(spark, sf).best(table(spark, sf, "benchmark"), k, (blend,), given=v)
    return best.select("item_id", "doc_id", "s", F.col("given").alias("c"), F.col("final").alias("h"), "rank")


@query("ret_03_hybrid", f"WITH {_HYBRID} SELECT item_id, doc_id, s, c, h, row_number() OVER (PARTITION BY item_id ORDER BY h DESC, doc_id) AS rank FROM hy QUALIFY rank <= 5")
def hybrid_query(spark, sf) -> DataFrame:
    return hybrid(spark, sf, 5)


@query("top_01_hybrid", f"WITH {_HYBRID} SELECT item_id, doc_id, h, row_number() OVER (PARTITION BY item_id ORDER BY h DESC, doc_id) AS rank FROM hy QUALIFY rank <= 10")
def top_hybrid(spark, sf, k: int = 10) -> DataFrame:
    """The best k of each query by the hybrid score, equals in the order of the corpus."""
    return hybrid(spark, sf, k).select("item_id", "doc_id", "h", "rank")


#: Endings that a stem goes without, a generic pack.
ENDINGS = "(ingly|edly|ing|ed|ies|es|ly|s)$"
_STEMS = f"list_transform({_TOK}, lambda w: regexp_replace(w, '{ENDINGS}', ''))"


@query("ret_04_text_rank", f"""WITH tk AS (SELECT doc_id, {_STEMS} AS ts FROM documents), q AS (SELECT item_id, unnest(list_distinct({_STEMS})) AS term FROM benchmark), d AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM tk),
s AS (SELECT item_id, doc_id, round(count(*) / (1 + ln(1 + n)), 6) AS rank FROM d JOIN q USING (term) GROUP BY item_id, doc_id, n) SELECT item_id, doc_id, rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, doc_id) <= 10""")
def text_rank(spark, sf, k: int = 10) -> DataFrame:
    """Frequency of the query's stems over one plus the log of the length, the best ten of each query. Russian words have their
    Snowball stems, others drop common endings."""
    stems = lambda c: F.transform(tokens(c), lambda w: F.when(w.rlike("[а-яё]"), russian_stem(w)).otherwise(F.regexp_replace(w, ENDINGS, "")))
    q = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(stems(F.col("text")))).alias("term"))
    d = table(spark, sf, "documents").select("doc_id", stems(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("n"), F.inline(counted(F.col("ts"))))
    s = d.join(bounded(q, BROADCAST_TERMS), "term").groupBy("item_id", "doc_id", "n").agg(F.sum("tf").alias("tf"))
    return top(s.select("item_id", "doc_id", r6(F.col("tf") / (1 + F.log(1.0 + F.col("n")))).alias("s")), k).select("item_id", "doc_id", F.col("s").alias("rank"))


#: The query of the feature scan and factors of a chunk's priority, fixed values; languages stand for priorities.
SCAN_QUERY, PRIORITY = ["gnu", "general", "public", "license"], {"en": 1.3, "de": 1.2, "fr": 1.0}
_PHRASES = [" ".join(SCAN_QUERY[i : i + 3]) for i in range(len(SCAN_QUERY) - 2)]


@query("ret_05_feature_scan", rf"""WITH f AS (SELECT doc_id, lang, list_distinct({_TOK}) AS ws, {SCAN_QUERY} AS q, {" + ".join(f"CAST(contains(lower(text), '{x}') AS INT)" for x in _PHRASES)} AS phrases, regexp_matches(text, '[0-9]') AS e, length(text) AS n FROM documents),
s AS (SELECT doc_id, lang, least(len(list_intersect(ws, q)) / len(list_distinct(list_concat(ws, q)))::DOUBLE + 0.2 * phrases, 1) AS sem, e, n FROM f)
SELECT doc_id, round((0.35 * sem + 0.25 * CAST(e AS INT) + 0.15 * CAST(n > 500 AS INT) + 0.10 * least(n / 10000.0::DOUBLE, 1) + 0.08 * 0.5) * CASE lang WHEN 'en' THEN 1.3 WHEN 'de' THEN 1.2 WHEN 'fr' THEN 1.0 ELSE 0.9 END, 6)::DOUBLE AS score FROM s""")
def feature_scan(spark, sf) -> DataFrame:
    """A weighted sum of features in one projection: semantic overlap lifted by each phrase of three query words that occurs,
    entities, context, authority, recency; the sum times the factor of the chunk's priority."""
    q, text, n = F.array(*map(F.lit, SCAN_QUERY)), F.col("text"), F.length("text")
    phrases = sum((F.contains(F.lower(text), F.lit(x)).cast("int") for x in _PHRASES[1:]), F.contains(F.lower(text), F.lit(_PHRASES[0])).cast("int"))
    sem = F.least(jaccard(tokens(text), q) + 0.2 * phrases, F.lit(1.0))
    s = 0.35 * sem + 0.25 * text.rlike("[0-9]").cast("int") + 0.15 * (n > 500).cast("int") + 0.10 * F.least(n / 10000.0, F.lit(1.0)) + 0.08 * 0.5
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("lang")], F.lit(0.9))
    return table(spark, sf, "documents").select("doc_id", r6(s * factor).alias("score"))


#: Bonuses of the multi-strategy search, fixed values: by branch, by rank of the document's type, and by age in days.
BRANCH = {"exact": 0.20, "semantic": 0.10, "contextual": 0.05, "terms": 0.03}
RANKS, AGES = {"en": 0.15, "de": 0.10, "fr": 0.05}, [(30, 0.15), (90, 0.10), (365, 0.05), (1825, 0.02)]
INTENT = ["license", "version", "public", "released"]


@query("ret_06_multi_strategy", f"""WITH {BM25}, un AS (SELECT item_id, doc_id, s, 0.10 AS b FROM norm UNION ALL SELECT item_id, doc_id, 0.95, 0.20 FROM benchmark JOIN documents ON item_id = doc_id UNION ALL SELECT item_id, doc_id, round(s * 0.9, 6), 0.03 FROM norm
  UNION ALL SELECT b.item_id, n.doc_id, n.s, 0.05 FROM benchmark b JOIN norm n ON n.item_id = b.item_id - 1),
m AS (SELECT item_id, doc_id, max(s + b) AS s FROM un GROUP BY ALL),
w AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0.15 WHEN 'de' THEN 0.10 WHEN 'fr' THEN 0.05 ELSE 0 END + CASE WHEN n_chars % 4000 < 30 THEN 0.15 WHEN n_chars % 4000 < 90 THEN 0.10 WHEN n_chars % 4000 < 365 THEN 0.05 WHEN n_chars % 4000 < 1825 THEN 0.02 ELSE 0 END
  + least(0.05 * ({" + ".join(f"CAST(contains(lower(text), '{x}') AS INT)" for x in INTENT)}), 0.2) + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.10 ELSE 0 END AS bonus FROM documents)
SELECT item_id, doc_id, round(least(m.s + bonus, 1)::DOUBLE, 6) AS score FROM m JOIN w USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def multi_strategy(spark, sf) -> DataFrame:
    """Branches for meaning, exact id, the question before (the context) and synonyms, each with its bonus; the best of each
    document, lifted by the rank of its type (language stands for it), its age in days (from n_chars), words of the intent and
    numbers, capped at 1."""
    rank, age = F.lit(0.0), F.lit(0.0)
    for lang, x in RANKS.items():
        rank = F.when(F.col("lang") == lang, x).otherwise(rank)
    for days, x in reversed(AGES):
        age = F.when(F.col("n_chars") % 4000 < days, x).otherwise(age)
    words = F.size(F.filter(F.array(*map(F.lit, INTENT)), lambda w: F.contains(F.lower("text"), w)))
    bonus = rank + age + F.least(0.05 * words, F.lit(0.2)) + F.when(F.col("text").rlike("[0-9]"), 0.10).otherwise(0.0)
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    lifted = d.select("doc_id", bonus.alias("extra"))

    def semantic(s, _, extra):
        import numpy as np

        u = np.fmax(s + BRANCH["semantic"], np.round(s * 0.9, 6) + BRANCH["terms"])
        return np.round(np.fmin(u + extra, 1.0), 6)

    def contextual(s, _, extra):
        import numpy as np

        return np.round(np.fmin(s + BRANCH["contextual"] + extra, 1.0), 6)

    # the best ten of the maximum are among the best ten of each branch
    found = index_of(spark, sf).best(b, 10, (semantic, contextual), lifted)
    item = F.col("item_id") + F.col("form")  # the context of an item is the one before
    found = found.select(item.alias("item_id"), "doc_id", F.col("final").alias("score")).join(F.broadcast(b.select("item_id").distinct()), "item_id", "left_semi")
    exact = lifted.join(b.select(F.col("item_id").alias("doc_id"), "item_id"), "doc_id").select("item_id", "doc_id", r6(F.least(0.95 + BRANCH["exact"] + F.col("extra"), F.lit(1.0))).alias("score"))
    return top(found.unionByName(exact).groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), 10, "score").drop("rank")


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """lists(item_id, doc_id, list, rank) -> item_id, doc_id, rrf, appearances."""
    return lists.groupBy("item_id", "doc_id").agg(r6(F.sum(1.0 / (k + F.col("rank")))).alias("rrf"), F.count("*").alias("appearances"))


_LISTS = f"""{_HYBRID}, ls AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM norm QUALIFY rank <= 20 UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS rank FROM vt QUALIFY rank <= 20),
fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, count(*) AS appearances FROM ls GROUP BY ALL)"""


def _lists(spark, sf, k: int = 20) -> DataFrame:
    a = _best(spark, sf, k).select("item_id", "doc_id", "rank")
    return a.unionByName(top(vector_candidates(spark, sf), k, "c").select("item_id", "doc_id", "rank"))


@query("ret_07_rrf", f"WITH {_LISTS} SELECT * FROM fu")
def rrf_query(spark, sf) -> DataFrame:
    return rrf(_lists(spark, sf))


_VARIANTS = """q0 AS (SELECT item_id, lower(trim(text)) AS q FROM benchmark), qs AS (SELECT item_id * 10 AS item_id, q AS text FROM q0 UNION ALL SELECT item_id * 10 + 1, q || ' in law' FROM q0
UNION ALL SELECT item_id * 10 + 2, CASE WHEN starts_with(q, 'the') THEN 'what is ' || q ELSE 'explain ' || q END FROM q0 WHERE starts_with(q, 'the') OR starts_with(q, 'a'))"""


@query("ret_08_fusion_search", f"""WITH {_VARIANTS}, {bm25_sql('qs')}, ls AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM norm QUALIFY rank <= 20),
fu AS (SELECT item_id // 10 AS item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf FROM ls GROUP BY ALL) SELECT item_id, doc_id, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS rank FROM fu QUALIFY rank <= 10""")
def fusion_search(spark, sf, k: int = 10, variants: int = 3) -> DataFrame:
    """The first three forms of each query are searched for twice as many hits as asked for, without a threshold, and their ranks fused."""
    v = query_variants(spark, sf).filter(F.col("n") < variants)
    lists = index_of(spark, sf).best(v.select((F.col("item_id") * 10 + F.col("n")).alias("item_id"), F.col("variant").alias("text")), 2 * k)
    fused = rrf(lists.select(F.floor(F.col("item_id") / 10).alias("item_id"), "doc_id", "rank"))
    return top(fused, k, "rrf").select("item_id", "doc_id", "rrf", "rank")


@query("jn_22_multi_query", f"WITH {BM25} SELECT item_id, count(*) AS candidates, max(s) AS best FROM norm GROUP BY item_id")
def multi_query(spark, sf) -> DataFrame:
    """All queries against the corpus in one pass; the best of scores brought to 0..1 is 1, unless all are equal."""
    best = F.when(F.col("hi") - F.col("lo") <= 1e-12 * F.abs("hi"), 0.0).otherwise(1.0)
    return index_of(spark, sf).hits(table(spark, sf, "benchmark")).select("item_id", F.col("n").alias("candidates"), best.alias("best"))


@query("ret_09_expansion", "SELECT item_id, concat_ws(' | ', text, lower(text), substr(text, 1, 40)) AS query FROM benchmark")
def expansion(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws(" | ", "text", F.lower("text"), F.substring("text", 1, 40)).alias("query"))


def rerank(candidates: DataFrame, scorer=None, k: int = 5, weight: float = 0.6, longest: int = 4000) -> DataFrame:
    """candidates(item_id, doc_id, query, text, s): the logit of a scorer through a sigmoid, blended with the first score.

    scorer(query, text) -> logit as a Column; without one, word overlap stands in for a cross-encoder. The text is what a scorer
    sees; its cut is the model's input limit.
    """
    q, t = F.col("query"), F.substring("text", 1, longest)
    logit = scorer(q, t) if scorer else 4 * jaccard(tokens(q), tokens(t)) - 2
    s = weight / (1 + F.exp(-logit)) + (1 - weight) * F.col("s")
    return top(candidates.select("item_id", "doc_id", r6(s).alias("score")), k, "score")


_SET = _TOK.replace("text", "{0}")


@query("ret_10_rerank", f"""WITH {BM25}, c AS (SELECT item_id, doc_id, s FROM norm QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 20),
j AS (SELECT c.item_id, c.doc_id, s, {_SET.replace('{0}', 'b.text')} AS q, {_SET.replace('{0}', 'substr(d.text, 1, 4000)')} AS t FROM c JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
k AS (SELECT item_id, doc_id, round(0.6 / (1 + exp(-(4 * (len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t)))::DOUBLE) - 2))) + 0.4 * s, 6) AS score FROM j) SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM k QUALIFY rank <= 5""")
def rerank_query(spark, sf) -> DataFrame:
    c = _best(spark, sf, 20).drop("rank")
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"))
    c = stored(c.join(b, "item_id"), "best")
    return rerank(table(spark, sf, "documents").select("doc_id", "text").join(bounded(c, BROADCAST_TERMS), "doc_id"))


@query("ret_11_no_rerank", f"WITH {BM25} SELECT item_id, doc_id, s AS score, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM norm QUALIFY rank <= 5")
def no_rerank(spark, sf) -> DataFrame:
    return _best(spark, sf, 5).withColumnRenamed("s", "score")


#: Gates on the similarity and on the boosted score, fixed values.
SEMANTIC_GATE, FINAL_GATE = 0.6, 0.4


@query("ret_12_graph_boost", f"WITH {NEAREST}, r AS (SELECT vec_id, least(1, similarity + 0.5 * 0.1 * (vec_id % 4)) AS f FROM s WHERE similarity >= 0.6) SELECT vec_id, round(f, 6)::DOUBLE AS final FROM r WHERE f >= 0.4 ORDER BY 2 DESC, vec_id LIMIT 10")
def graph_boost(spark, sf) -> DataFrame:
    """Similarity lifted by half the graph boost, gated before and after, best ten."""
    s = nearest_to_one(spark, sf).filter(F.col("similarity") >= SEMANTIC_GATE)
    f = F.least(F.lit(1.0), F.col("similarity") + 0.5 * 0.1 * (F.col("vec_id") % 4))
    return s.select("vec_id", r6(f).alias("final")).filter(F.col("final") >= FINAL_GATE).orderBy(F.desc("final"), "vec_id").limit(10)


#: The two key sentences of a text in DuckDB.
_KEY = """list_transform(list_sort(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), lambda x, i: {'a': -(2 * (CAST(contains(lower(x), 'license') AS INT) + CAST(contains(lower(x), 'with') AS INT) + CAST(contains(lower(x), 'there') AS INT)) + CAST(regexp_matches(x, '[0-9]') AS INT) + CAST(length(x) BETWEEN 50 AND 300 AS INT) - CAST(length(x) < 30 OR length(x) > 500 AS INT)), 'i': i, 's': x}))[1:2], lambda e: e.s)"""


def key_sentences_of(text: Column, n: int = 2) -> Column:
    """The n sentences of highest score in their order of rank, joined."""
    scored = F.transform(sentences(text), lambda x, i: F.struct((-sentence_score(x, TERMS)).alias("a"), i.alias("i"), x.alias("s")))
    return F.array_join(F.transform(F.slice(F.array_sort(scored), 1, n), lambda e: e["s"]), ". ")


@query("ret_13_post_process", f"WITH {BM25}, p AS (SELECT item_id, doc_id, round(least(1, s + CASE WHEN d.n_chars > 1000 THEN 0.1 WHEN d.n_chars > 500 THEN 0.02 ELSE 0 END), 6)::DOUBLE AS final, 'source ' || source AS ref FROM norm JOIN documents d USING (doc_id)), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) <= 5) SELECT item_id, b.doc_id, final, ref, array_to_string({_KEY}, '. ') AS key_sentences FROM b JOIN documents d ON b.doc_id = d.doc_id")
def post_process(spark, sf) -> DataFrame:
    """The score with the bonus of recency (length stands for it) capped at 1, a reference and two key sentences, ranked anew."""
    d = table(spark, sf, "documents")
    bonus = F.when(F.col("n_chars") > 1000, 0.1).when(F.col("n_chars") > 500, 0.02).otherwise(0.0)

    def lifted(s, _, extra):
        import numpy as np

        return np.round(np.fmin(1.0, s + extra), 6)

    best = stored(index_of(spark, sf).best(table(spark, sf, "benchmark"), 5, (lifted,), d.select("doc_id", bonus.alias("extra"))).select("item_id", "doc_id", "final"), "best")
    texts = d.join(bounded(best, BROADCAST_TERMS), "doc_id")
    return texts.select("item_id", "doc_id", "final", F.concat(F.lit("source "), "source").alias("ref"), key_sentences_of(F.col("text")).alias("key_sentences"))


@query("ret_14_type_bonus", "SELECT page_id, (CASE WHEN contains(html, '<table') THEN 0.03 WHEN contains(html, '<img') THEN 0.02 ELSE 0.01 END + CASE WHEN page_id % 5 = 0 THEN 0.05 ELSE 0 END)::DOUBLE AS bonus FROM pages")
def type_bonus(spark, sf) -> DataFrame:
    kind = F.when(F.contains("html", F.lit("<table")), 0.03).when(F.contains("html", F.lit("<img")), 0.02).otherwise(0.01)
    return table(spark, sf, "pages").select("page_id", F.round(kind + F.when(F.col("page_id") % 5 == 0, 0.05).otherwise(0.0), 2).alias("bonus"))


@query("ret_15_answer", f"""WITH {BM25}, c AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM norm QUALIFY rank <= 5),
t AS (SELECT c.item_id, c.rank, text, array_to_string({_KEY}, '. ') AS s FROM c JOIN documents USING (doc_id)), u AS (SELECT item_id, min(rank) AS rank, s FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY rank) AS n FROM t) WHERE n = 1 GROUP BY item_id, text, s),
v AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS r, first_value(s) OVER (PARTITION BY item_id ORDER BY rank) AS best FROM u)
SELECT item_id, string_agg(s, chr(10) ORDER BY r) AS answer FROM v WHERE r = 1 OR r <= 3 AND s <> '' AND s <> best GROUP BY item_id""")
def answer(spark, sf) -> DataFrame:
    """Of the five best texts the distinct ones with two key sentences each: those of the best, and of the next two where they differ."""
    met = table(spark, sf, "documents").join(bounded(stored(_best(spark, sf, 5), "best"), BROADCAST_TERMS), "doc_id")
    c = met.select("item_id", "rank", F.xxhash64("text").alias("text"), key_sentences_of(F.col("text")).alias("key"))
    t = c.groupBy("item_id", "text").agg(F.min_by(F.struct("rank", F.col("key").alias("s")), "rank").alias("x")).groupBy("item_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # five at most
    best = F.get("xs", F.lit(0))["s"]
    more = F.filter(F.transform(F.slice("xs", 2, 2), lambda x: x["s"]), lambda s: (s != "") & (s != best))
    return t.select("item_id", F.array_join(F.concat(F.array(best), more), "\n").alias("answer"))


#: Forms of a question for a term's definition.
DEFINITION_FORMS = ["{} means is definition", "what is {}", "{} hereinafter", '"{}"', "the notion {}"]
_TERM = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 5)[1]"


@query("ret_16_definition_lookup", f"""WITH t0 AS (SELECT item_id, {_TERM} AS term FROM benchmark), qs AS ({" UNION ALL ".join(f"SELECT item_id * 10 + {i} AS item_id, '{f.replace('{}', chr(39) + ' || term || ' + chr(39))}' AS text FROM t0 WHERE term IS NOT NULL" for i, f in enumerate(DEFINITION_FORMS))}),
{bm25_sql('qs')}, ls AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) <= 20), m AS (SELECT item_id // 10 AS item_id, doc_id, max(s) AS score FROM ls GROUP BY ALL)
SELECT item_id, doc_id, score FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 15""")
def definition_lookup(spark, sf, k: int = 20) -> DataFrame:
    """A term (the first long word of an item) is asked for in five forms; of twenty hits each, a document's best score counts, and
    the best fifteen stay."""
    term = F.get(tokens(F.col("text"), 5), F.lit(0))
    forms = [F.concat(F.lit(x), F.col("term"), F.lit(y)) for x, y in (f.split("{}") for f in DEFINITION_FORMS)]
    q = table(spark, sf, "benchmark").select("item_id", term.alias("term")).filter("term is not null")
    q = q.select("item_id", F.posexplode(F.array(*forms)).alias("n", "text")).select((F.col("item_id") * 10 + F.col("n")).alias("item_id"), "text")
    lists = index_of(spark, sf).best(q, k)
    best = lists.groupBy(F.floor(F.col("item_id") / 10).alias("item_id"), "doc_id").agg(F.max("s").alias("score"))
    return top(best, 15, "score").drop("rank")


@query("ret_17_query_repair", "SELECT item_id, concat_ws(' ', text, CASE WHEN length(text) < 150 THEN 'in detail' END, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'with numbers' END) AS query FROM benchmark")
def query_repair(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws(" ", "text", F.when(F.length("text") < 150, "in detail"), F.when(~F.col("text").rlike("[0-9]"), "with numbers")).alias("query"))


#: Thresholds that are tried, in hundredths; fixed values.
THRESHOLDS = [50, 55, 60, 65, 70, 75, 80, 85, 90]


@query("ret_18_threshold", f"WITH {NEAREST}, t AS (SELECT unnest({THRESHOLDS}) / 100.0::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (similarity >= threshold) AS n FROM t, s GROUP BY threshold) SELECT threshold, n FROM c ORDER BY abs(n - 5), threshold LIMIT 1")
def threshold(spark, sf, expected: int = 5) -> DataFrame:
    """Of nine thresholds the one whose number of hits is nearest to the expected, the lowest of equals; counted in one scan."""
    s = nearest_to_one(spark, sf).agg(*[F.count_if(F.col("similarity") >= i / 100).alias(f"n{i}") for i in THRESHOLDS])
    t = s.select(F.inline(F.array(*[F.struct(F.lit(i / 100).alias("threshold"), F.col(f"n{i}").alias("n")) for i in THRESHOLDS])))
    return t.orderBy(F.abs(F.col("n") - expected), "threshold").limit(1)
