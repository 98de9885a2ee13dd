"""The corpus pipeline: five stages, each on all that the one before kept, stored as Parquet in between.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.

Defined cases: null and empty texts are scored like others, lose no line, link with nothing and hold no passage, so they stay if the
classifier accepts them and are packed as an end token; line dedup gives them back as empty text. Rows with a null doc_id stay in
stages that compare documents. Repeated rows are one document to line dedup, and one component to the join, so all of them stay.
Empty tables give an empty result. Extra columns pass through all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, line_dedup, ngram_join, packing, quality, work
from quillspark.llm.work import table


def sheltered(docs: DataFrame, taken: set[str], stage) -> DataFrame:
    """stage(docs) with the columns of docs: those named like ``taken``, which the stage makes itself, are put aside and come back."""
    aside = {c: f"_{i}_aside" for i, c in enumerate(docs.columns) if c.lower() in taken}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on labelled documents of the input table."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return sheltered(docs, {"score", "predicted"}, lambda d: quality.score(d, model).filter("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one each; a document that keeps no visible character goes with them."""
    index = line_dedup.build(docs)
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = sheltered(docs, {"n_lines", "n_dropped"}, lambda d: line_dedup.apply(d, index).filter(~emptied))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return ngram_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, each with its sequence and place."""
    cut = packing.pieces(docs, packing.default_tokenizer())
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: A trained classifier and a tokenizer stand in no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return docs
