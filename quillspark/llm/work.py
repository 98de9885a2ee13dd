"""Shared plumbing of the llm operators: where intermediate tables live and how lineage is cut.

Every table goes under ``spark.checkpoint.dir`` of the session, the one folder that all executors of a cluster share. Only a
local session may fall back to a folder of its own (tests); a cluster without the setting is an error, since a machine-local
folder would lose rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Folders of local sessions without the setting, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path  # noqa: SLF001
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_quill_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit by which operators choose salts and shards."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows and bytes of text that go to a Python worker at once; Spark's own default holds many times as much in several copies.
ROWS, BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> None:
    """Bound the Arrow batches of this session's Python operators to ``ROWS`` rows and ``BYTES`` bytes, unless they are smaller already."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _number(conf.get(key)) <= most:
            conf.set(key, str(most))


def _number(value: str) -> int:
    digits = value.lower().rstrip("bkmg")
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(value[len(digits) :][:1].lower(), 0)


#: The one large helper (a model, a table of tokens) that a Python worker keeps from task to task.
_kept: dict = {}


def keep(key: object, make: Callable[[], T]) -> T:
    """``make()``, remembered by this worker until it is asked for another key, so a worker's memory holds one helper at a time."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    return _kept[key]


def tidy() -> None:
    """Give this worker's freed memory back to the system; called at the end of a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that tidies up after its last batch."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
