"""Aggregations over documents, users, graph, conversations and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import r6, tokens, words
from quillspark.operators import periods, search_index
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, table

AS_OF = "2024-01-31 00:00:00"


@query("agg_01_storage_totals", "SELECT count(*) AS n, sum(n_chars) AS total, round(avg(n_chars), 6) AS mean FROM documents")
def storage_totals(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), r6(F.avg("n_chars")).alias("mean"))


@query("agg_02_chunk_length", f"WITH {CHUNKS} SELECT count(*) AS n, round(avg(length(text)), 6) AS mean FROM chunks")
def chunk_length(spark, sf) -> DataFrame:
    return chunks(table(spark, sf, "documents")).agg(F.count("*").alias("n"), r6(F.avg(F.length("text"))).alias("mean"))


@query("agg_03_by_type", "SELECT lang, count(*) AS n, sum(n_chars) AS total FROM documents GROUP BY lang")
def by_type(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


@query("agg_04_distinct_documents", f"WITH {CHUNKS} SELECT count(DISTINCT doc_id) AS n FROM chunks")
def distinct_documents(spark, sf) -> DataFrame:
    return chunks(table(spark, sf, "documents")).agg(F.count_distinct("doc_id").alias("n"))


@query("agg_05_storage_megabytes", "SELECT round(coalesce(sum(length(text)), 0) / 1048576.0, 2) AS mb FROM documents")
def storage_megabytes(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").agg(F.round(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 1048576.0, 2).alias("mb"))


@query("agg_06_recent", f"SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{AS_OF}'")
def recent(spark, sf, as_of: str = AS_OF) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return table(spark, sf, "events").filter((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") < now)).agg(F.count("*").alias("n"))


@query(
    "agg_07_user_stats",
    f"""WITH u AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id)
SELECT count(*) AS total, count(*) FILTER (n > 1) AS active, count(*) FILTER (first_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS new_30d, count(*) FILTER (last_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS active_today FROM u""",
)
def user_stats(spark, sf, as_of: str = AS_OF) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    u = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n"))
    return u.agg(
        F.count("*").alias("total"), F.count_if(F.col("n") > 1).alias("active"),
        F.count_if(F.col("a") >= now - F.expr("INTERVAL 30 DAYS")).alias("new_30d"), F.count_if(F.col("z") >= now - F.expr("INTERVAL 1 DAY")).alias("active_today"),
    )


@query("agg_07_permission_histogram", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def permission_histogram(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("users"))


@query("agg_07_weekly_users", """WITH u AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), d AS (SELECT DISTINCT CAST(day + CAST(k AS INT) AS DATE) AS day FROM u, range(7) r(k) WHERE day + CAST(k AS INT) <= (SELECT max(day) FROM u)),
c AS (SELECT DISTINCT d.day, user_id FROM d JOIN u ON u.day BETWEEN d.day - 6 AND d.day), p AS (SELECT CAST(day + 7 AS DATE) AS day, user_id, 1 AS known FROM c)
SELECT strftime(c.day, '%Y-%m-%d') AS day, count(*) AS users, count(*) FILTER (known IS NULL) AS new_users, count(known) AS returning FROM c LEFT JOIN p ON c.day = p.day AND c.user_id = p.user_id GROUP BY c.day""")
def weekly_users(spark, sf) -> DataFrame:
    """Users of the seven days up to each day, how many of them are new against the seven before and how many return, exact at any
    number of users; sketches a day (``periods.retention``) are the cheaper form for those who can do with 5 %."""
    r = periods.returning(table(spark, sf, "events"), F.col("ts"), F.col("user_id"), 7)
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("keys").alias("users"), F.col("new_keys").alias("new_users"), "returning")


@query("agg_12_postings", r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 2) AS ts FROM documents), s AS (SELECT count(*) AS n, round(avg(len(ts)), 6) AS avgdl FROM t),
f AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t) SELECT doc_id, term, count(*) AS tf, dl, n, avgdl FROM f, s GROUP BY ALL""")
def postings(spark, sf) -> DataFrame:
    """Frequency of each term in each document with the document's length, the number of documents and their mean length: what the kept
    index holds."""
    index = search_index.kept(spark, sf, table(spark, sf, "documents"))
    n, avgdl, _ = index.statistics()
    rows = index.documents().select("doc_id", "dl", F.inline("terms"))
    return rows.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"), F.lit(n).cast("long").alias("n"), F.lit(round(avgdl, 6)).alias("avgdl"))


@query("agg_08_json_field", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


GRAPH_COUNTS = """SELECT 'node' AS kind, 'Region' AS type, count(*) AS n FROM region UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Customer', count(*) FROM customer
UNION ALL SELECT 'edge', 'CONTAINS', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) UNION ALL SELECT 'edge', 'ORDERED', count(*) FROM orders"""


@query("agg_09_graph_counts", f"WITH g AS ({GRAPH_COUNTS}) SELECT kind, type, n FROM g UNION ALL SELECT kind, 'total', sum(n)::BIGINT FROM g GROUP BY kind")
def graph_counts(spark, sf) -> DataFrame:
    """Nodes and edges by type with totals, from one rollup."""
    from quillspark.plans.graph import edges, nodes

    g = nodes(spark, sf).select(F.lit("node").alias("kind"), "type").unionByName(edges(spark, sf).select(F.lit("edge").alias("kind"), "type"))
    c = g.groupBy("kind", "type").agg(F.count("*").alias("n"))
    return c.rollup("kind", "type").agg(F.sum("n").alias("n")).filter("kind is not null").select("kind", F.coalesce("type", F.lit("total")).alias("type"), "n")


PROFILE = "SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_len, min(length(text)) AS min_len, max(length(text)) AS max_len, count(*) FILTER (coalesce(trim(text), '') = '') AS empty, count(*) FILTER (length(text) < 100) AS short, sum(length(text)) AS chars, round(100.0 * count(lang) / count(*), 6) AS lang_coverage, concat_ws(',', 'lang:' || count(lang), 'source:' || count(source), 'n_chars:' || count(n_chars)) AS metadata_keys FROM documents"


def profile(d: DataFrame) -> DataFrame:
    n = F.length("text")
    return d.agg(
        F.count("*").alias("n"), r6(F.avg(n)).alias("mean_len"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"),
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"), F.count_if(n < 100).alias("short"), F.sum(n).alias("chars"),
        r6(F.count("lang") * 100.0 / F.count("*")).alias("lang_coverage"),
        F.concat_ws(",", *[F.concat(F.lit(f"{c}:"), F.count(c).cast("string")) for c in ("lang", "source", "n_chars")]).alias("metadata_keys"),
    )


@query("agg_10_corpus_profile", PROFILE)
def corpus_profile(spark, sf) -> DataFrame:
    return profile(table(spark, sf, "documents"))


@query("agg_11_corpus_quality", f"""WITH p AS ({PROFILE}), q AS (SELECT 100 - 30.0 * empty / n - CASE WHEN 100.0 * short / n > 20 THEN 15.0 * short / n ELSE 0 END - CASE WHEN 100 - lang_coverage > 30 THEN 20 * (100 - lang_coverage) / 100 ELSE 0 END AS s FROM p)
SELECT round(s, 6) AS score, CASE WHEN s >= 80 THEN 'good' WHEN s >= 60 THEN 'fair' ELSE 'poor' END AS band FROM q""")
def corpus_quality(spark, sf) -> DataFrame:
    """100 less 30 for the empty share, 15 for the short share above a fifth, 20 for missing metadata above 30 %."""
    p = profile(table(spark, sf, "documents"))
    short, missing = F.col("short") / F.col("n"), 1 - F.col("lang_coverage") / 100
    s = 100 - 30.0 * F.col("empty") / F.col("n") - F.when(short > 0.2, 15 * short).otherwise(0) - F.when(missing > 0.3, 20 * missing).otherwise(0)
    return p.select(r6(s).alias("score"), F.when(s >= 80, "good").when(s >= 60, "fair").otherwise("poor").alias("band"))


@query("agg_12_term_stats", r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 2)) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM f GROUP BY term""")
def term_stats(spark, sf) -> DataFrame:
    """Document and collection frequency of every term; counts are combined before each shuffle."""
    t = table(spark, sf, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    f = t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return f.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query("agg_13_hierarchy_stats", """WITH c AS (SELECT 'nation' AS level, n_regionkey AS parent, 'region' AS above FROM nation UNION ALL SELECT 'customer', c_nationkey, 'nation' FROM customer UNION ALL SELECT 'region', NULL, NULL FROM region),
f AS (SELECT level, above, parent, count(*) AS k FROM c GROUP BY ALL), h AS (SELECT above, sum(k) AS children FROM f WHERE parent IS NOT NULL GROUP BY above),
g AS (SELECT level, CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (parent IS NOT NULL), 0) AS BIGINT) AS with_parent, count(parent) AS families, CAST(coalesce(sum(k * (k - 1) // 2) FILTER (parent IS NOT NULL), 0) AS BIGINT) AS sibling_pairs, round(avg(k) FILTER (parent IS NOT NULL), 6) AS mean_family FROM f GROUP BY level)

SELECT g.*, CAST(coalesce(children, 0) AS BIGINT) AS children FROM g LEFT JOIN h ON g.level = h.above""")
def hierarchy_stats(spark, sf) -> DataFrame:
    """Nodes of each level, those with a parent, families, pairs of siblings, mean size of a family, and children on the level below."""
    none = F.lit(None)
    one = table(spark, sf, "nation").select(F.lit("nation").alias("level"), F.col("n_regionkey").cast("long").alias("parent"), F.lit("region").alias("above"))
    two = table(spark, sf, "customer").select(F.lit("customer"), F.col("c_nationkey").cast("long"), F.lit("nation"))
    top = table(spark, sf, "region").select(F.lit("region"), none.cast("long"), none.cast("string"))
    f = one.union(two).union(top).groupBy("level", "above", "parent").agg(F.count("*").alias("k"))
    inside, k = F.col("parent").isNotNull(), F.col("k")
    g = f.groupBy("level").agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(inside, k)), F.lit(0)).alias("with_parent"), F.count("parent").alias("families"),
        F.coalesce(F.sum(F.when(inside, k * (k - 1) / 2)), F.lit(0)).cast("long").alias("sibling_pairs"), r6(F.avg(F.when(inside, k))).alias("mean_family"),
    )
    h = f.filter(inside).groupBy(F.col("above").alias("level")).agg(F.sum("k").alias("children"))
    return g.join(h, "level", "left").withColumn("children", F.coalesce("children", F.lit(0)))


_X = "x AS (SELECT doc_id, (doc_id % 97) / 97.0 AS score FROM documents)"


def _scores(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ((F.col("doc_id") % 97) / 97.0).alias("score"))


@query("agg_14_search_stats", f"WITH {_X} SELECT count(*) AS candidates, count(*) FILTER (score >= 0.5) AS kept, round(count(*) FILTER (score >= 0.5) / count(*)::DOUBLE, 6) AS ratio, round(avg(score) FILTER (score >= 0.5), 6) AS mean FROM x")
def search_stats(spark, sf, least: float = 0.5) -> DataFrame:
    k = F.count_if(F.col("score") >= least)
    return _scores(spark, sf).agg(F.count("*").alias("candidates"), k.alias("kept"), r6(k / F.count("*")).alias("ratio"), r6(F.avg(F.when(F.col("score") >= least, F.col("score")))).alias("mean"))


@query("agg_15_precision_recall", """WITH p AS (SELECT quality AS y, CAST(doc_id % 7 <> 0 AS INT) AS p FROM labels)
SELECT round(sum(y * p)::DOUBLE / nullif(sum(p), 0), 6) AS precision, round(sum(y * p)::DOUBLE / nullif(sum(y), 0), 6) AS recall, round(2.0 * sum(y * p) / nullif(sum(p) + sum(y), 0), 6) AS f1, round(sum(p)::DOUBLE / count(*), 6) AS high_share FROM p""")
def precision_recall(spark, sf) -> DataFrame:
    """True precision, recall and F1 against labels, and the share above threshold that is also called recall elsewhere."""
    p = table(spark, sf, "labels").select(F.col("quality").alias("y"), (F.col("doc_id") % 7 != 0).cast("int").alias("p"))
    hit, y, n = F.sum(F.col("y") * F.col("p")), F.sum("y"), F.sum("p")
    zero = F.lit(0)
    return p.agg(
        r6(F.try_divide(hit, F.nullif(n, zero))).alias("precision"), r6(F.try_divide(hit, F.nullif(y, zero))).alias("recall"),
        r6(F.try_divide(2.0 * hit, F.nullif(n + y, zero))).alias("f1"), r6(n / F.count("*")).alias("high_share"),
    )


@query("agg_16_ab_summary", """WITH r AS (SELECT event_type AS config, value / 100.0 AS rel, CAST(event_id % 5 <> 0 AS INT) AS succ, event_id % 12 AS chunks, (event_id % 10) / 10.0 AS t FROM events),
m AS (SELECT config, avg(rel) AS rel, avg(succ) AS succ, avg(chunks) AS chunks, avg(t) AS t FROM r GROUP BY config),
c AS (SELECT config, round(rel, 6) AS rel, round(succ, 6) AS succ, round(t, 6) AS t, round(0.4 * rel + 0.3 * succ + 0.2 * least(chunks / 10, 1) + 0.1 * greatest(0, 1 - t), 6) AS composite FROM m)
SELECT config, rel, succ, t, composite, rank() OVER (ORDER BY composite DESC) AS by_composite, rank() OVER (ORDER BY rel DESC) AS by_rel, rank() OVER (ORDER BY succ DESC) AS by_success, rank() OVER (ORDER BY t) AS by_speed FROM c""")
def ab_summary(spark, sf) -> DataFrame:
    """Means and composite score of each configuration, with its ranks (a window over one row a configuration)."""
    e = F.col("event_id")
    r = table(spark, sf, "events").select(F.col("event_type").alias("config"), (F.col("value") / 100.0).alias("rel"), (e % 5 != 0).cast("int").alias("succ"), (e % 12).alias("chunks"), ((e % 10) / 10.0).alias("t"))
    m = r.groupBy("config").agg(*[F.avg(c).alias(c) for c in ("rel", "succ", "chunks", "t")])
    comp = 0.4 * F.col("rel") + 0.3 * F.col("succ") + 0.2 * F.least(F.col("chunks") / 10, F.lit(1.0)) + 0.1 * F.greatest(F.lit(0.0), 1 - F.col("t"))
    c = m.select("config", r6("rel").alias("rel"), r6("succ").alias("succ"), r6("t").alias("t"), r6(comp).alias("composite"))
    ranks = {"by_composite": F.desc("composite"), "by_rel": F.desc("rel"), "by_success": F.desc("succ"), "by_speed": F.asc("t")}
    return c.select("*", *[F.rank().over(W.orderBy(by)).alias(name) for name, by in ranks.items()])


@query("agg_17_evaluation", r"""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 2)) AS kw FROM benchmark),
a AS (SELECT q.item_id, q.kw, d.text, (d.doc_id % 10) / 10.0 AS conf FROM q JOIN documents d ON d.doc_id = q.item_id),
s AS (SELECT item_id, 0.4 * len(list_filter(kw, lambda w: contains(lower(text), w))) / greatest(len(kw), 1) + 0.3 * CAST(regexp_matches(text, '[0-9]') AS INT) + 0.2 * CAST(length(text) > 0 AS INT) + 0.1 * least(conf, 1) AS score FROM a)
SELECT item_id, round(score, 6) AS score, count(*) FILTER (score >= 0.6) OVER () >= 8 AS passed FROM s""")
def evaluation(spark, sf) -> DataFrame:
    """Score of each answered question; the run passes if eight reach 0.6."""
    q = table(spark, sf, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("kw"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.lower("text").alias("low"), "text", ((F.col("doc_id") % 10) / 10.0).alias("conf"))
    a = q.join(d, "item_id")
    found = F.size(F.filter("kw", lambda w: F.contains(F.col("low"), w)))
    score = 0.4 * found / F.greatest(F.size("kw"), F.lit(1)) + 0.3 * F.col("text").rlike("[0-9]").cast("int") + 0.2 * (F.length("text") > 0).cast("int") + 0.1 * F.least(F.col("conf"), F.lit(1.0))
    s = a.select("item_id", score.alias("s"))
    passed = s.agg((F.count_if(F.col("s") >= 0.6) >= 8).alias("passed"))
    return s.join(F.broadcast(passed)).select("item_id", r6("s").alias("score"), "passed")


@query("agg_18_prompt_performance", "SELECT event_type, count(*) AS n, round(avg(value) / 100, 6) AS quality, round(avg(CAST(event_id % 5 <> 0 AS INT)), 6) AS success FROM events GROUP BY event_type HAVING count(*) >= 5 AND (avg(value) / 100 < 0.7 OR avg(CAST(event_id % 5 <> 0 AS INT)) < 0.8)")
def prompt_performance(spark, sf) -> DataFrame:
    """Types with at least five records whose mean quality is below 0.7 or success below 0.8."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.avg("value") / 100).alias("q"), F.avg((F.col("event_id") % 5 != 0).cast("int")).alias("s"))
    return g.filter("n >= 5 and (q < 0.7 or s < 0.8)").select("event_type", "n", r6("q").alias("quality"), r6("s").alias("success"))


@query("agg_19_issue_groups", "SELECT event_type AS category, NULL::BIGINT AS severity, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT NULL, event_id % 4, count(*) FROM events GROUP BY event_id % 4")
def issue_groups(spark, sf) -> DataFrame:
    """Issues by category and by severity in one pass."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("category"), (F.col("event_id") % 4).alias("severity"))
    return e.groupingSets([["category"], ["severity"]], "category", "severity").agg(F.count("*").alias("n")).select("category", "severity", "n")


#: What an issue of each severity takes from a response's score, fixed values from critical to informational.
SEVERITY = [0.30, 0.15, 0.05, 0.02, 0.0]


@query("agg_19_issue_score", "WITH i AS (SELECT event_id // 3 AS response, event_id % 5 AS severity, event_type, user_id, event_id FROM events), s AS (SELECT response, count(*) AS issues, 1.0 - sum(CASE severity WHEN 0 THEN 0.30 WHEN 1 THEN 0.15 WHEN 2 THEN 0.05 WHEN 3 THEN 0.02 ELSE 0 END) + CASE WHEN count(DISTINCT event_type) >= 4 THEN 0.05 ELSE 0 END + CASE WHEN count(DISTINCT user_id) >= 3 THEN 0.05 ELSE 0 END + CASE WHEN bool_or(event_id % 7 = 0) THEN 0.03 ELSE 0 END AS score FROM i GROUP BY response) SELECT response, issues, round(greatest(0, least(1, score))::DOUBLE, 6) AS score FROM s")
def issue_score(spark, sf) -> DataFrame:
    """Weighted score of each response (three issues in a row stand for one): less for each issue by its severity, more for four
    sections, three sources and a follow-up, between 0 and 1."""
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).alias("response"), (F.col("event_id") % 5).cast("int").alias("severity"), "event_type", "user_id", "event_id")
    taken = F.sum(F.get(F.array(*map(F.lit, SEVERITY)), F.col("severity")))
    more = F.when(F.count_distinct("event_type") >= 4, 0.05).otherwise(0.0) + F.when(F.count_distinct("user_id") >= 3, 0.05).otherwise(0.0) + F.when(F.bool_or(F.col("event_id") % 7 == 0), 0.03).otherwise(0.0)
    return e.groupBy("response").agg(F.count("*").alias("issues"), r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - taken + more))).alias("score"))


@query("agg_20_conversation_summary", r"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3)) AS concept FROM conversations),
g AS (SELECT conv_id, turn, concept, count(*) AS n FROM w GROUP BY ALL), n AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS total FROM g), c AS (SELECT conv_id, concept, sum(n) AS n, round(max(n / total::DOUBLE), 6) AS confidence FROM n GROUP BY ALL),
t AS (SELECT conv_id, string_agg(concept, ',' ORDER BY k) AS concepts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, concept) AS k FROM c) WHERE k <= 5 GROUP BY conv_id),
a AS (SELECT conv_id, substr(concept, 1, 1) AS area, sum(n) AS n FROM c GROUP BY ALL), ta AS (SELECT conv_id, string_agg(area, ',' ORDER BY k) AS areas FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, area) AS k FROM a) WHERE k <= 3 GROUP BY conv_id),
m AS (SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, round(sum(least(length(text), 100)) / sum(length(text))::DOUBLE, 6) AS ratio FROM conversations GROUP BY conv_id)
SELECT m.conv_id, first_turn, last_turn, n, ratio, areas, concepts FROM m LEFT JOIN t ON m.conv_id = t.conv_id LEFT JOIN ta ON m.conv_id = ta.conv_id""")
def conversation_summary(spark, sf, top: int = 5, top_areas: int = 3) -> DataFrame:
    """Span and compression ratio of each conversation, its largest areas (an initial stands for one), and the concepts of highest
    confidence, the share of a turn's words that a concept makes up at most."""
    c = table(spark, sf, "conversations")
    ws = c.select("conv_id", "turn", tokens(F.col("text"), 3).alias("ws"))
    n = ws.select("conv_id", "turn", F.size("ws").alias("total"), F.explode("ws").alias("concept")).groupBy("conv_id", "turn", "total", "concept").agg(F.count("*").alias("n"))
    w = n.groupBy("conv_id", "concept").agg(F.sum("n").alias("n"), r6(F.max(F.col("n") / F.col("total"))).alias("confidence"))

    def best(df: DataFrame, name: str, by, k: int) -> DataFrame:
        r = df.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(by), name))).filter(F.col("k") <= k)
        return r.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", name))), lambda x: x[name]), ",").alias(f"{name}s"))

    areas = w.groupBy("conv_id", F.substring("concept", 1, 1).alias("area")).agg(F.sum("n").alias("n"))
    length = F.length("text")
    m = c.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"), r6(F.sum(F.least(length, F.lit(100))) / F.sum(length)).alias("ratio"))
    return m.join(best(areas, "area", "n", top_areas), "conv_id", "left").join(best(w, "concept", "confidence", top), "conv_id", "left")


@query("agg_21_scan_report", "SELECT count(*) AS total, count(*) FILTER (length(html) > 0) AS ok, round(100.0 * count(*) FILTER (contains(html, '<title>')) / count(*), 6) AS success_rate FROM pages")
def scan_report(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").agg(F.count("*").alias("total"), F.count_if(F.length("html") > 0).alias("ok"), r6(100.0 * F.count_if(F.contains("html", F.lit("<title>"))) / F.count("*")).alias("success_rate"))


@query("agg_22_content_types", "SELECT CASE WHEN contains(html, '<script') THEN 'script' WHEN contains(html, '<table') THEN 'table' ELSE 'text' END AS content_type, count(*) AS n FROM pages GROUP BY 1")
def content_types(spark, sf) -> DataFrame:
    kind = F.when(F.contains("html", F.lit("<script")), "script").when(F.contains("html", F.lit("<table")), "table").otherwise("text")
    return table(spark, sf, "pages").groupBy(kind.alias("content_type")).agg(F.count("*").alias("n"))


@query("agg_23_monthly", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def monthly(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("agg_24_pass_by_category", "SELECT l.toxic AS category, count(*) AS n, count(*) FILTER (quality = 1) AS passed FROM labels l GROUP BY 1")
def pass_by_category(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").groupBy(F.col("toxic").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"))
