"""The corpus tables and the views that several plans share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it comes in fewer parts than there are cores, as a small file does; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that is not taken yet, in the folder that all executors share (``spark.checkpoint.dir``); a local session without the
    setting has one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":  # local-cluster[..] has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quillspark-")
        _own[spark.sparkContext.applicationId] = shared
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: what follows starts from there and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that go to a Python worker at once; Spark's own default holds many times as much, in several copies.
ROWS, BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, once the Arrow batches of its session's Python operators are bounded to ``ROWS`` rows and ``BYTES`` bytes, if they are not smaller."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        value = conf.get(key).lower().rstrip("b")
        number = int(value.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(value[-1:], 0)
        if not 0 < number <= most:
            conf.set(key, str(most))
    return df


def chunks(docs: DataFrame) -> DataFrame:
    """Non-blank lines of each document in order: doc_id, chunk_index, text, lang, source."""
    split = docs.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("chunk_index", "text"))
    return split.filter(F.trim("text") != "").select("doc_id", "chunk_index", "text", "lang", "source")


#: The same view in DuckDB, to be put after WITH.
CHUNKS = """chunks AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, text, lang, source FROM
  (SELECT doc_id, lang, source, unnest(range(len(ls))) AS i, unnest(ls) AS text FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
  WHERE trim(text) <> '')"""
