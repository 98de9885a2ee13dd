"""Structured Streaming over task and user events: counters with watermarks, sliding limits and retries with state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.sources.tables import new_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's Parquet file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def counters(events: DataFrame, ttl: str = "30 days") -> DataFrame:
    """Events of each user, type and day; state older than the watermark goes."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).groupBy(F.window("ts", "1 day").alias("day"), "user_id", "event_type").agg(F.count("*").alias("n"))


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _expire(state: GroupState, last_ms: int, keep_seconds: float) -> None:
    """Let the state go once the watermark has passed the last event by so many seconds."""
    state.setTimeoutTimestamp(max(last_ms + int(keep_seconds * 1000), state.getCurrentWatermarkMs() + 1))


def sliding_limit(events: DataFrame, most: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """(event_id, allowed) as requests come in; the state of a user is the times of the requests that were let through within the
    window, and goes when the watermark has left it."""

    def run(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for t in rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9:
            kept = [x for x in kept if t - x < seconds]
            out.append(len(kept) < most)
            if out[-1]:
                kept.append(float(t))
        state.update((kept,))
        _expire(state, int(t * 1000), seconds)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "allowed": out})

    by = _timed(events, late).select("user_id", "event_id", "ts").groupBy("user_id")
    return by.applyInPandasWithState(run, "event_id long, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _in_order(batches: Iterator):
    import pandas as pd

    rows = pd.concat(list(batches))
    return rows.sort_values(["ts", *(["event_id"] if "event_id" in rows else [])], kind="stable")


def retries(events: DataFrame, most: int = 3, ttl: str = "1 hour", keep_seconds: float = 3600.0) -> DataFrame:
    """events(task, failed, ts[, event_id]) -> (task, attempts, status): a failed attempt goes back to the queue until it has failed ``most``
    times; what comes after a success or the last failure is no attempt. A task is forgotten when the watermark has passed its last event
    by ``keep_seconds``."""

    def run(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        failed, done = state.get if state.exists else (0, False)
        rows = _in_order(batches)
        for bad in rows["failed"]:
            if not done and failed < most:
                failed, done = failed + int(bad), not bad
        state.update((failed, done))
        _expire(state, int(rows["ts"].max().timestamp() * 1000), keep_seconds)
        status = "completed" if done else "failed" if failed >= most else "queued"
        yield pd.DataFrame({"task": [key[0]], "attempts": [failed + done], "status": [status]})

    return _timed(events, ttl).groupBy("task").applyInPandasWithState(run, "task long, attempts long, status string", "failed long, done boolean", "update", GroupStateTimeout.EventTimeTimeout)


def progress(events: DataFrame, late: str = "1 hour", keep_seconds: float = 3600.0) -> DataFrame:
    """events(task, event_id, ts) -> (task, last_event, updates), a row a task and batch; a task is forgotten ``keep_seconds`` after its
    last update."""

    def run(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (-1, 0)
        rows = _in_order(batches)
        last, n = max(last, int(rows["event_id"].max())), n + len(rows)
        state.update((last, n))
        _expire(state, int(rows["ts"].max().timestamp() * 1000), keep_seconds)
        yield pd.DataFrame({"task": [key[0]], "last_event": [last], "updates": [n]})

    by = _timed(events, late).select("task", "event_id", "ts").groupBy("task")
    return by.applyInPandasWithState(run, "task long, last_event long, updates long", "last long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def writer(path: str):
    """A batch writer for ``foreachBatch`` that is keyed by the batch's number: a batch that is run again takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_batches(spark: SparkSession, path: str, schema, keys: tuple[str, ...] = ()) -> DataFrame:
    """What ``writer`` has written: all rows, or with keys the row that the last batch gave for each."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = spark.read.schema(f"{fields}, batch long").parquet(path)
    if keys:
        rest = [f.name for f in schema if f.name not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
    return out.select(*[f.name for f in schema])


def drain(df: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Run a stream until its input is read, each batch going to a table in the shared folder, and read the table: all rows, or in update
    mode the last row of each key. With the path of an earlier run the stream goes on where that one ended."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # there is a table even if no batch comes
    q = df.writeStream.foreachBatch(writer(path)).outputMode(mode).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return read_batches(spark, path, df.schema, keys if mode == "update" else ())
