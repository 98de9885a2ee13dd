"""Window-shaped computations. Windows are partitioned by document, conversation or user; none sorts a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import r6
from quillspark.plans.joins import ENTITIES, entities
from quillspark.plans.relational import rank_all
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, table



def by_document():
    return W.partitionBy("doc_id").orderBy("chunk_index")


def by_user():
    return W.partitionBy("user_id").orderBy("event_id")


def by_turn():
    return W.partitionBy("conv_id").orderBy("turn")


def _chunks(spark, sf) -> DataFrame:
    return chunks(table(spark, sf, "documents"))


@query("win_01_rank", f"WITH {CHUNKS} SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, chunk_index) AS rank FROM chunks")
def rank(spark, sf) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", "chunk_index", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "chunk_index")).alias("rank"))


@query("win_02_segment_end", f"WITH {ENTITIES} SELECT e.doc_id, nth, pos AS \"start\", lead(pos, 1, CAST(length(text) AS INT)) OVER (PARTITION BY e.doc_id ORDER BY nth) AS \"end\" FROM ents e JOIN documents d ON e.doc_id = d.doc_id")
def segment_end(spark, sf) -> DataFrame:
    """A segment ends where the next match starts, the last one at the text's end."""
    d = table(spark, sf, "documents")
    e = entities(d).join(d.select("doc_id", F.length("text").alias("n")), "doc_id")
    return e.select("doc_id", "nth", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(W.partitionBy("doc_id").orderBy("nth")), "n").alias("end"))


@query("win_03_previous_parent", f"WITH {CHUNKS}, a AS (SELECT doc_id, chunk_index, nullif(length(text) % 3, 0) AS art FROM chunks), p AS (SELECT *, lag(art) OVER w AS pa, lag(chunk_index) OVER w AS pi FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)) SELECT doc_id, chunk_index, CASE WHEN pi IS NOT NULL AND art IS NOT DISTINCT FROM pa THEN pi END AS parent, CASE WHEN art = pa THEN pi END AS strict_parent FROM p")
def previous_parent(spark, sf) -> DataFrame:
    """The previous chunk is the parent if it has the same article; the strict variant asks for an article."""
    a = _chunks(spark, sf).select("doc_id", "chunk_index", F.nullif(F.length("text") % 3, F.lit(0)).alias("art"))
    p = a.withColumn("pa", F.lag("art").over(by_document())).withColumn("pi", F.lag("chunk_index").over(by_document()))
    loose = F.when(F.col("pi").isNotNull() & F.col("art").eqNullSafe(F.col("pa")), F.col("pi"))
    return p.select("doc_id", "chunk_index", loose.alias("parent"), F.when(F.col("art") == F.col("pa"), F.col("pi")).alias("strict_parent"))


@query("win_04_offsets", f"WITH {CHUNKS} SELECT doc_id, chunk_index, CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS \"start\", CAST(sum(length(text)) OVER w AS BIGINT) AS \"end\" FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def offsets(spark, sf) -> DataFrame:
    end = F.sum(F.length("text")).over(by_document().rowsBetween(W.unboundedPreceding, 0))
    return _chunks(spark, sf).select("doc_id", "chunk_index", (end - F.length("text")).alias("start"), end.alias("end"))


@query("win_05_inherit", f"""WITH {CHUNKS}, c AS (SELECT doc_id, chunk_index, CASE WHEN length(text) < 40 THEN chunk_index END AS chapter, CASE WHEN length(text) BETWEEN 40 AND 80 THEN chunk_index END AS article FROM chunks),
g AS (SELECT *, last_value(chapter IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ch FROM c)
SELECT doc_id, chunk_index, ch AS chapter, last_value(article IGNORE NULLS) OVER (PARTITION BY doc_id, ch ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS article FROM g""")
def inherit(spark, sf) -> DataFrame:
    """Current chapter and article; a new chapter resets the article."""
    n = F.length("text")
    c = _chunks(spark, sf).select("doc_id", "chunk_index", F.when(n < 40, F.col("chunk_index")).alias("c"), F.when(n.between(40, 80), F.col("chunk_index")).alias("a"))
    c = c.withColumn("chapter", F.last("c", True).over(by_document().rowsBetween(W.unboundedPreceding, 0)))
    inner = W.partitionBy("doc_id", "chapter").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, 0)
    return c.select("doc_id", "chunk_index", "chapter", F.last("a", True).over(inner).alias("article"))


@query("win_06_islands", f"WITH {ENTITIES}, f AS (SELECT *, CASE WHEN pos - lag(pos) OVER w < 200 THEN 0 ELSE 1 END AS new FROM ents WINDOW w AS (PARTITION BY doc_id ORDER BY nth)), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY nth) AS island FROM f) SELECT doc_id, CAST(island AS BIGINT) AS island, min(pos) AS \"start\", max(pos) AS \"end\", count(*) AS n FROM i GROUP BY doc_id, island")
def islands(spark, sf, gap: int = 200) -> DataFrame:
    """Entities less than 200 characters apart form a group."""
    w = W.partitionBy("doc_id").orderBy("nth")
    e = entities(table(spark, sf, "documents"))
    e = e.withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) < gap, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return e.groupBy("doc_id", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"))


def merge_intervals(df: DataFrame, within: int = 50) -> DataFrame:
    """df(doc_id, lo, hi, weight, kind): intervals at most ``within`` apart merge: greatest weight, sorted union of kinds."""
    w = W.partitionBy("doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    m = df.withColumn("new", F.when(F.col("lo") <= reach + within, 0).otherwise(1))
    m = m.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return m.groupBy("doc_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("weight").alias("weight"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query("win_07_merge_zones", f"""WITH {ENTITIES}, z AS (SELECT doc_id, greatest(pos - 30, 0) AS lo, pos + 30 AS hi, length(value) AS weight, CASE WHEN length(value) > 3 THEN 'long' ELSE 'short' END AS kind FROM ents),
r AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM z),
i AS (SELECT *, sum(CASE WHEN lo <= reach + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, CAST(island AS BIGINT) AS island, min(lo) AS lo, max(hi) AS hi, max(weight) AS weight, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM i GROUP BY doc_id, island""")
def merge_zones(spark, sf) -> DataFrame:
    e = entities(table(spark, sf, "documents"))
    z = e.select("doc_id", F.greatest(F.col("pos") - 30, F.lit(0)).alias("lo"), (F.col("pos") + 30).alias("hi"), F.length("value").alias("weight"), F.when(F.length("value") > 3, "long").otherwise("short").alias("kind"))
    return merge_intervals(z)


@query("win_08_rolling_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS mean_100 FROM events")
def rolling_mean(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(by_user().rowsBetween(-99, 0)), 9).alias("mean_100"))


@query("win_09_running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM events")
def running_mean(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(by_user().rowsBetween(W.unboundedPreceding, 0)), 9).alias("mean"))


@query("win_10_exponential_mean", "WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS vs FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(vs, lambda a, v: 0.8 * a + 0.2 * v), 6) AS ema FROM l")
def exponential_mean(spark, sf, keep: float = 0.8) -> DataFrame:
    """0.8 of the mean so far and 0.2 of the new value, from the first value on: a sum in which a value counts by its rank from the end,
    so a user's history is never one row or one task."""
    e = rank_all(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("event_id")], "r")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    old = F.pow(F.lit(keep), F.col("r") - 1)
    part = F.col("value") * F.when(F.col("r") == F.col("n"), old).otherwise((1 - keep) * old)
    return e.join(n, "user_id").groupBy("user_id").agg(r6(F.sum(part)).alias("ema"))


@query("win_11_unresolved", "WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id, turn FROM n WHERE role = 'user' AND contains(text, '?') AND (next IS NULL OR next = 'user')")
def unresolved(spark, sf) -> DataFrame:
    """Questions followed by another user turn or by the end."""
    n = table(spark, sf, "conversations").withColumn("next", F.lead("role").over(by_turn()))
    return n.filter((F.col("role") == "user") & F.contains("text", F.lit("?")) & (F.col("next").isNull() | (F.col("next") == "user"))).select("conv_id", "turn")


@query("win_12_topic_flow", """WITH t AS (SELECT conv_id, turn, length(text) % 5 AS topic FROM conversations), l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t),
d AS (SELECT *, lag(topic) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM l WHERE r <= 10), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS q FROM d WHERE before IS NULL OR before <> topic)
SELECT conv_id, turn, topic FROM k WHERE q <= 5""")
def topic_flow(spark, sf) -> DataFrame:
    """Of the last ten turns: topics without immediate repeats, the last five."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 5).cast("long").alias("topic"))
    t = t.withColumn("r", F.row_number().over(back)).filter("r <= 10").withColumn("before", F.lag("topic").over(by_turn()))
    t = t.filter("before is null or before <> topic").withColumn("q", F.row_number().over(back))
    return t.filter("q <= 5").select("conv_id", "turn", "topic")


@query("win_13_last_n", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50")
def last_n(spark, sf, n: int = 50) -> DataFrame:
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf, "events").select("user_id", "event_id", r.alias("r")).filter(F.col("r") <= n).drop("r")


@query("win_14_topic_shift", "WITH t AS (SELECT conv_id, turn, length(text) % 5 AS d FROM conversations WHERE role = 'user'), p AS (SELECT *, lag(d) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t) SELECT conv_id, turn, CASE WHEN before IS NULL THEN 'start' WHEN before = d THEN 'continue' ELSE 'shift' END AS flow FROM p")
def topic_shift(spark, sf) -> DataFrame:
    t = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.length("text") % 5).alias("d"))
    t = t.withColumn("before", F.lag("d").over(by_turn()))
    return t.select("conv_id", "turn", F.when(F.col("before").isNull(), "start").when(F.col("before") == F.col("d"), "continue").otherwise("shift").alias("flow"))


@query("win_15_overlap_context", f"WITH {CHUNKS} SELECT doc_id, chunk_index, right(lag(text) OVER w, 150) AS head, left(lead(text) OVER w, 150) AS tail FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def overlap_context(spark, sf, n: int = 150) -> DataFrame:
    """The end of the chunk before and the start of the one after."""
    before = F.lag("text").over(by_document())
    return _chunks(spark, sf).select("doc_id", "chunk_index", F.right(before, F.lit(n)).alias("head"), F.left(F.lead("text").over(by_document()), F.lit(n)).alias("tail"))


@query("win_16_minmax", "WITH b AS (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY lang) SELECT doc_id, CASE WHEN hi = lo THEN 0.0 ELSE round((n_chars - lo) / (hi - lo)::DOUBLE, 6) END AS score FROM documents JOIN b USING (lang)")
def minmax(spark, sf) -> DataFrame:
    """Scores brought to 0..1 in each group, zeros where all are equal; the bounds are aggregated, not windowed."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    b = d.groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return d.join(b, "lang").select("doc_id", F.when(F.col("hi") == F.col("lo"), 0.0).otherwise(r6((F.col("n_chars") - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias("score"))


def rate_limit(events: DataFrame, most: int = 100, seconds: float = 60.0) -> DataFrame:
    """events(user_id, event_id, ts) -> event_id, allowed: rejected requests do not count for later ones, so a user's requests
    are gone through in order."""

    def run(batches):
        import pandas as pd

        user, kept = None, []
        for pdf in batches:  # in order of user and time; what is carried along is one user's window
            out = []
            for u, t in zip(pdf["user_id"], pdf["ts"].astype("datetime64[ns]").astype("int64") / 1e9, strict=True):
                if u != user:
                    user, kept = u, []
                kept = [x for x in kept if t - x < seconds]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(t)
            yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "allowed": out})

    e = events.select("user_id", "event_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return e.mapInPandas(run, "event_id long, allowed boolean")


@query("win_17_rate_limit")
def rate_limit_query(spark, sf) -> DataFrame:
    return rate_limit(table(spark, sf, "events"), 2, 3600.0)
