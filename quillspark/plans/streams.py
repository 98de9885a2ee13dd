"""Queue, cache and counter operators: the batch form in SQL, the stream over the same events where state is the point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.registry import query
from quillspark.sources.tables import table
from quillspark.streaming import task_queue, tasks

NOW = "2024-01-31 00:00:00"


@query("stm_01_retries", """WITH t AS (SELECT event_id % 500 AS task, event_id, ts, value < 40 AS failed FROM events),
r AS (SELECT *, coalesce(sum(CAST(failed AS INT)) OVER w, 0) AS bad, coalesce(sum(CAST(NOT failed AS INT)) OVER w, 0) AS good FROM t WINDOW w AS (PARTITION BY task ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT task, count(*) AS attempts, CASE WHEN bool_or(NOT failed) THEN 'completed' WHEN count(*) >= 3 THEN 'failed' ELSE 'queued' END AS status FROM r WHERE good = 0 AND bad < 3 GROUP BY task""")
def retries(spark, sf) -> DataFrame:
    e = tasks.stream_of(spark, sf).select((F.col("event_id") % 500).alias("task"), "event_id", (F.col("value") < 40).alias("failed"), "ts")
    return tasks.drain(tasks.retries(e), "retries", "update", ("task",))


@query("stm_01_queue")
def priority_queue(spark, sf) -> DataFrame:
    """Eight queues of tasks with four priorities: events add tasks, three workers a queue take, complete and fail them."""
    v = F.col("value")
    op = F.when(v < 50, "add").when(v < 75, "next").when(v < 90, "complete").otherwise("fail")
    e = tasks.stream_of(spark, sf).select((F.col("user_id") % 8).cast("string").alias("queue"), "event_id", "ts", op.alias("op"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("task"), (F.col("event_id") % 4).cast("int").alias("priority"), (F.col("event_id") % 3).cast("string").alias("worker"))
    return task_queue.run(e, "queue")


@query("stm_02_ttl", f"SELECT event_type, count(*) AS live FROM events WHERE ts + CASE event_type WHEN 'click' THEN INTERVAL 1 HOUR WHEN 'view' THEN INTERVAL 30 MINUTE ELSE INTERVAL 1 DAY END > TIMESTAMP '{NOW}' GROUP BY event_type")
def ttl(spark, sf, now: str = NOW) -> DataFrame:
    """Entries that have not run out, each kind with its own time to live."""
    life = F.when(F.col("event_type") == "click", F.expr("INTERVAL 1 HOUR")).when(F.col("event_type") == "view", F.expr("INTERVAL 30 MINUTE")).otherwise(F.expr("INTERVAL 24 HOUR"))
    return table(spark, sf, "events").filter(F.col("ts") + life > F.lit(now).cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("live"))


@query("stm_03_progress", "SELECT event_id % 500 AS task, max(event_id) AS last_event, count(*) AS updates FROM events GROUP BY 1")
def progress(spark, sf) -> DataFrame:
    """The last update of each task, from a stream whose state of a task expires."""
    e = tasks.stream_of(spark, sf).select((F.col("event_id") % 500).alias("task"), "event_id", "ts")
    return tasks.drain(tasks.progress(e), "progress", "update", ("task",))


@query("stm_04_counters", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def counters(spark, sf) -> DataFrame:
    """Counts a day, user and type in update mode, so days behind the watermark leave the state."""
    c = tasks.drain(tasks.counters(tasks.stream_of(spark, sf)), "counters", "update", ("day", "user_id", "event_type"))
    return c.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "n")


@query("stm_05_sliding_limit")
def sliding_limit(spark, sf) -> DataFrame:
    return tasks.drain(tasks.sliding_limit(tasks.stream_of(spark, sf), 2, 3600.0), "limit")


@query("stm_06_cleanup", f"SELECT event_type, count(*) AS removed FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR GROUP BY event_type")
def cleanup(spark, sf, now: str = NOW) -> DataFrame:
    old = F.col("ts") < F.lit(now).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    return table(spark, sf, "events").filter(old).groupBy("event_type").agg(F.count("*").alias("removed"))


@query("stm_07_queue_stats", "SELECT event_type AS status, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def queue_stats(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
