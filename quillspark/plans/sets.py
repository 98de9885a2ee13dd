"""Set operations and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import r6
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, table


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; the partial window limit keeps one row a key before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


@query("set_01_combined", "SELECT doc_id AS id, lang AS kind, text FROM documents UNION ALL SELECT item_id, NULL, text FROM benchmark")
def combined(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "text")
    return d.unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("set_02_merge_results", "WITH a AS (SELECT doc_id AS id, 0 AS l, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS o FROM documents WHERE lang = 'en' QUALIFY o <= 10), b AS (SELECT doc_id AS id, 1 AS l, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS o FROM documents QUALIFY o <= 10), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l, o) AS r FROM u) SELECT id, l AS list, o AS ordinal FROM f WHERE r = 1 ORDER BY l, o LIMIT 15")
def merge_results(spark, sf, k: int = 10, most: int = 15) -> DataFrame:
    """Two ranked lists one after the other, each id kept where it comes first, at most 15."""
    order = [F.desc("n_chars"), F.col("doc_id")]

    def ranked(df: DataFrame, n: int) -> DataFrame:
        top = df.select("doc_id", "n_chars").orderBy(*order).limit(k)
        return top.select(F.col("doc_id").alias("id"), F.lit(n).alias("list"), F.row_number().over(W.orderBy(*order)).alias("ordinal"))

    d = table(spark, sf, "documents")
    both = ranked(d.filter("lang = 'en'"), 0).unionByName(ranked(d, 1))
    return first_by(both, ["id"], ["list", "ordinal"]).orderBy("list", "ordinal").limit(most)


@query("set_03_dedup_prefix", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY source, substr(text, 1, 100)")
def dedup_prefix(spark, sf) -> DataFrame:
    """The first document of each (source, first 100 characters)."""
    return table(spark, sf, "documents").groupBy("source", F.substring("text", 1, 100).alias("p")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("set_04_max_score", "SELECT user_id, max(value) AS score, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY user_id")
def max_score(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("score"), F.min_by("event_id", F.struct(-F.col("value"), "event_id")).alias("event_id"))


@query("set_05_relations", "SELECT o_custkey AS from_id, o_orderpriority AS type, max(o_totalprice) AS confidence FROM orders GROUP BY 1, 2")
def relations(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("from_id"), F.col("o_orderpriority").alias("type")).agg(F.max("o_totalprice").alias("confidence"))


@query("set_06_query_variants", "SELECT lower(trim(text)) AS variant, min(item_id) AS item_id FROM benchmark GROUP BY 1")
def query_variants(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").groupBy(F.lower(F.trim("text")).alias("variant")).agg(F.min("item_id").alias("item_id"))


@query("set_07_exact_dedup", "SELECT doc_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents")
def exact_dedup(spark, sf) -> DataFrame:
    """Each document with the first of equal content. Digests are aggregated first, so a hot text is one row a task."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.join(d.groupBy("hash").agg(F.min("doc_id").alias("kept_id")), "hash").select("doc_id", "hash", "kept_id")


@query("set_08_message_dedup", r"WITH n AS (SELECT conv_id, turn, substr(md5(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s]', '', 'g')), 1, 16) AS h FROM conversations) SELECT h AS semantic_hash, count(*) AS n, min(conv_id * 100000 + turn) AS first FROM n GROUP BY h")
def message_dedup(spark, sf) -> DataFrame:
    h = F.substring(F.md5(F.regexp_replace(F.lower(F.trim("text")), r"[^\p{L}\p{N}_\s]", "")), 1, 16)
    return table(spark, sf, "conversations").select(h.alias("semantic_hash"), (F.col("conv_id") * 100000 + F.col("turn")).alias("k")).groupBy("semantic_hash").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query("set_08_greedy_near_dedup")
def greedy_near_dedup(spark, sf, above: float = 0.75) -> DataFrame:
    """Messages kept by a greedy pass over a conversation: one that is too like a kept one goes, unless it is critical and that is
    not, which it then displaces. Order matters, so a conversation is one group."""

    def run(pdf):
        import re

        import pandas as pd

        kept: list[tuple[int, set, bool]] = []
        for r in pdf.sort_values("turn").itertuples():
            ws = set(re.findall(r"\w+", (r.text or "").lower()))
            critical = "?" in (r.text or "")
            near = next((i for i, (_, k, _) in enumerate(kept) if ws | k and len(ws & k) / len(ws | k) > above), None)
            if near is None:
                kept.append((r.turn, ws, critical))
            elif critical and not kept[near][2]:
                kept[near] = (r.turn, ws, critical)
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "turn": [k[0] for k in kept]})

    return table(spark, sf, "conversations").groupBy("conv_id").applyInPandas(run, "conv_id long, turn long")


@query("set_09_isolated", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def isolated(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("set_10_difference", "SELECT DISTINCT s_nationkey AS nation FROM supplier EXCEPT SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000")
def difference(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).distinct()
    return s.join(table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")), "nation", "left_anti")
