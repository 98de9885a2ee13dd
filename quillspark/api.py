"""Entry points for users: ingest files, search, list, delete, check for duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import r6
from quillspark.operators.search_index import Index
from quillspark.plans.joins import bulk_duplicates
from quillspark.plans.relational import page
from quillspark.plans.retrieval import bm25, nearest, normalized, rerank, rrf, top
from quillspark.sources.formats import read_files

MODES = ("lexical", "vector", "hybrid", "fusion", "rerank")


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` as path, text, error, hash; archives give a row for each member."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return read_files(files).withColumn("hash", F.sha2("text", 256))


def search(queries: DataFrame, docs: DataFrame, embeddings: DataFrame | None = None, mode: str = "hybrid", k: int = 10, weight: float = 0.5, scorer=None, index: Index | None = None) -> DataFrame:
    """queries(item_id, text[, vector]), docs(doc_id, text), embeddings(doc_id, embedding) -> item_id, doc_id, score, rank.

    Terms of queries are broadcast up to a counted bound, query vectors in blocks of a bounded number. ``scorer`` is a Column function of query
    and text that reranks the best four times k, such as ``functions.scorers.model_scorer`` gives. With an ``index`` of the documents
    (see ``operators.search_index``) their texts are not read but for reranking.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    lexical = normalized(index.scores(queries) if index else bm25(docs, queries)) if mode != "vector" else None
    vector = None
    if embeddings is not None and mode in ("vector", "hybrid", "fusion"):
        vectors = embeddings.select(F.col("doc_id").alias("vec_id"), "embedding")
        vector = nearest(queries.select("item_id", F.col("vector").alias("q")), vectors, 4 * k).select("item_id", "doc_id", F.col("c").alias("s"))
    if mode == "vector" or lexical is None:
        if vector is None:
            raise ValueError("mode 'vector' needs embeddings")
        scored = vector
    elif mode == "fusion" and vector is not None:
        lists = top(lexical, 4 * k).select("item_id", "doc_id", "rank").unionByName(top(vector, 4 * k).select("item_id", "doc_id", "rank"))
        scored = rrf(lists).select("item_id", "doc_id", F.col("rrf").alias("s"))
    elif mode == "hybrid" and vector is not None:
        v = vector.withColumnRenamed("s", "v")
        scored = lexical.join(v, ["item_id", "doc_id"], "left").select("item_id", "doc_id", (weight * F.col("s") + (1 - weight) * F.coalesce("v", F.lit(0.0))).alias("s"))
    elif mode == "rerank":
        c = top(lexical, 4 * k).drop("rank").join(queries.select("item_id", F.col("text").alias("query")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
        return rerank(c, scorer, k)
    else:
        scored = lexical
    return top(scored, k).select("item_id", "doc_id", F.col("s").alias("score"), "rank")


def list_documents(docs: DataFrame, test: Column | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of documents, newest first, with the total and whether more follow."""
    return page(docs if test is None else docs.filter(test), [F.desc("doc_id")], offset, limit)


def delete_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The snapshot without the documents of ids(doc_id)."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")


def check_duplicates(new: DataFrame, old: DataFrame) -> DataFrame:
    """How each new file (id, hash, name, type) is known already: by hash, by name, or not."""
    return bulk_duplicates(new, old)
