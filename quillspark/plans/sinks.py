"""Sinks as snapshots: upserts, deletes and merges give the new state of a table; writers put it to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.plans.graph import edges, nodes
from quillspark.plans.relational import rank_all
from quillspark.registry import query
from quillspark.sources.tables import CHUNKS, chunks, new_folder, table


def append(df: DataFrame, path: str) -> None:
    """Insert rows: one commit of Spark's writer, all or nothing."""
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of equal keys; of several new ones the last by ``version`` wins."""
    last = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("version")))).filter("_r = 1").drop("_r")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


@query("snk_01_insert_chunks", f"WITH {CHUNKS} SELECT doc_id, count(*) AS inserted FROM chunks GROUP BY doc_id")
def insert_chunks(spark, sf) -> DataFrame:
    """All chunks inserted into a table in one commit, counted by document as they are read back."""
    path = new_folder(spark, "chunks")
    append(chunks(table(spark, sf, "documents")), path)
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("inserted"))


@query("snk_02_upsert", "WITH o AS (SELECT vec_id, label, 0 AS version FROM embeddings), n AS (SELECT vec_id, label + 100 AS label, 1 AS version FROM embeddings WHERE vec_id % 3 = 0) SELECT coalesce(n.vec_id, o.vec_id) AS vec_id, coalesce(n.label, o.label) AS label, coalesce(n.version, o.version) AS version FROM o FULL JOIN n ON o.vec_id = n.vec_id")
def upsert_query(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(0).alias("version"))
    new = e.filter("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("version"))
    return upsert(e, new, ["vec_id"])


@query("snk_03_permission_upsert", "WITH a AS (SELECT user_id, event_type AS permission, event_id AS version, event_id % 2 = 0 AS granted FROM events) SELECT user_id, permission, max(version) AS version, arg_max(granted, version) AS granted FROM a GROUP BY user_id, permission")
def permission_upsert(spark, sf) -> DataFrame:
    """The latest grant or revocation of each user and permission, in partial aggregates."""
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("permission"), F.col("event_id").alias("version"), (F.col("event_id") % 2 == 0).alias("granted"))
    return e.groupBy("user_id", "permission").agg(F.max("version").alias("version"), F.max_by("granted", "version").alias("granted"))


@query("snk_04_suffix_ids", "SELECT doc_id, source || CASE WHEN r > 1 THEN '__' || (r - 1) ELSE '' END AS id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)")
def suffix_ids(spark, sf) -> DataFrame:
    """Repeated ids of a batch get __1, __2 and so on."""
    r = rank_all(table(spark, sf, "documents").select("doc_id", "source"), ["source"], [F.asc("doc_id")], "r")
    return r.select("doc_id", F.concat("source", F.when(F.col("r") > 1, F.concat(F.lit("__"), F.col("r") - 1)).otherwise("")).alias("id"))


@query("snk_05_articles_json", "SELECT source, count(*) AS articles, sum(length(text)) AS chars FROM documents GROUP BY source")
def articles_json(spark, sf) -> DataFrame:
    """JSON written to a folder for each source, and what is read back of each."""
    path = new_folder(spark, "articles")
    write_json(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path, "source")
    return spark.read.schema("doc_id long, text string, lang string, source string").json(path).groupBy("source").agg(F.count("*").alias("articles"), F.sum(F.length("text")).alias("chars"))


@query("snk_06_export", "SELECT user_id, event_id, concat_ws(',', user_id, event_id, event_type) AS line FROM events")
def export(spark, sf) -> DataFrame:
    """Events written as CSV with a header, and the lines as they are read back."""
    path = new_folder(spark, "export")
    write_csv(table(spark, sf, "events").select("user_id", "event_id", "event_type"), path)
    e = spark.read.option("header", True).schema("user_id long, event_id long, event_type string").csv(path)
    return e.select("user_id", "event_id", F.concat_ws(",", "user_id", "event_id", "event_type").alias("line"))


@query("snk_07_delete_cascade", "SELECT d.doc_id, e.vec_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_cascade(spark, sf) -> DataFrame:
    """Documents without the deleted ones, with the vectors that stay with them."""
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    d = table(spark, sf, "documents").select("doc_id").join(gone, "doc_id", "left_anti")
    return d.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, each property the last one that a version has: merging again changes nothing."""
    names = [c for c in old.columns if c not in (*keys, "version")]
    both = old.unionByName(new)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in names]
    return both.groupBy(*keys).agg(*last, F.max("version").alias("version"))


@query("snk_08_merge_graph", """WITH n AS (SELECT 'R' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, upper(n_name) FROM nation UNION ALL SELECT 'C' || c_custkey, c_name FROM customer)
SELECT 'node' AS kind, id, NULL AS to_id, name AS property FROM n UNION ALL SELECT 'CONTAINS', 'R' || n_regionkey, 'N' || n_nationkey, 'merged' FROM nation UNION ALL SELECT 'CONTAINS', 'N' || c_nationkey, 'C' || c_custkey, 'first' FROM customer""")
def merge_graph(spark, sf) -> DataFrame:
    """Nodes merged by id and edges by (from, to, type), the properties of the later source winning; some come twice."""
    n = nodes(spark, sf).select("id", "name", F.lit(0).alias("version"))
    later = n.filter(F.startswith("id", F.lit("N"))).select("id", F.upper("name").alias("name"), F.lit(1).alias("version"))
    e = edges(spark, sf).filter("type = 'CONTAINS'").select("from_id", "to_id", "type", F.lit("first").alias("property"), F.lit(0).alias("version"))
    again = e.filter(F.startswith("from_id", F.lit("R"))).select("from_id", "to_id", "type", F.lit("merged").alias("property"), F.lit(1).alias("version"))
    merged = merge(e.unionByName(e), again, ["from_id", "to_id", "type"]).select(F.col("type").alias("kind"), F.col("from_id").alias("id"), "to_id", "property")
    own = merge(n, later, ["id"]).select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("to_id"), F.col("name").alias("property"))
    return own.unionByName(merged)
