"""Streams over several batches: restarts, replayed batches, state that expires, and the priority queue against a plain simulation."""

import datetime
import random

from pyspark.sql import functions as F

from quillspark.streaming import task_queue, tasks

START = datetime.datetime(2024, 1, 1)


def files(spark, folder, batches, schema):
    """A stream of a batch a list of rows; more lists may be added to the folder later."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}-{len(rows)}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def after(seconds):
    return START + datetime.timedelta(seconds=seconds)


def simulated(ops, most=3):
    waiting, running, out = {}, {}, []
    for queue, event, _, op, task, priority, worker in sorted(ops, key=lambda r: (r[2], r[1])):
        wait = waiting.setdefault(queue, {})
        at = (queue, worker)
        if op == "add" and task not in wait:
            wait[task] = (priority, 0)
            out.append((queue, event, task, "pending", None, 0))
        elif op == "next" and at not in running and wait:
            best = max(wait, key=lambda t: (wait[t][0], t))
            running[at] = (best, *wait.pop(best))
            out.append((queue, event, best, "processing", worker, running[at][2] + 1))
        elif op in ("complete", "fail") and at in running:
            best, p, failed = running.pop(at)
            status = "completed" if op == "complete" else "failed" if failed + 1 >= most else "pending"
            if status == "pending":
                wait[best] = (p, failed + 1)
            out.append((queue, event, best, status, worker, failed + 1))
        elif op == "cancel" and task in wait:
            out.append((queue, event, task, "cancelled", None, wait.pop(task)[1]))
    return out


OPS = "queue string, event_id long, ts timestamp, op string, task string, priority int, worker string"


def test_queue_pops_by_priority_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    ops = [(f"q{rng.randrange(3)}", i, after(i), rng.choice(["add"] * 5 + ["next"] * 4 + ["complete", "fail", "fail", "cancel"]), f"t{rng.randrange(60):02d}", rng.randrange(3), f"w{rng.randrange(2)}") for i in range(600)]
    ops = [r for r in ops if r[3] != "add" or True]
    stream = files(spark, f"{tmp_path}/in", [ops[:200], ops[200:400]], OPS)
    task_queue.run(stream, "queue", path=f"{tmp_path}/out")
    again = files(spark, f"{tmp_path}/in", [[], [], [], ops[400:]], OPS)
    got = task_queue.run(again, "queue", path=f"{tmp_path}/out")  # a new query goes on from the state of the one before
    rows = sorted((tuple(r) for r in got.select("queue", "event_id", "task", "status", "worker", "attempt").collect()), key=lambda r: (r[1]))
    assert rows == sorted(simulated(ops), key=lambda r: r[1]) and {r[3] for r in rows} == {"pending", "processing", "completed", "failed", "cancelled"}


def test_queue_leases_and_waits_run_out(spark, tmp_path):
    ops = [[("q", 1, after(0), "add", "a", 1, None), ("q", 2, after(1), "add", "b", 0, None), ("q", 3, after(2), "next", None, None, "w")], [("z", 4, after(40_000), "add", "x", 0, None)], [("z", 5, after(400_000), "add", "y", 0, None)], [("z", 6, after(800_000), "next", None, None, "v")]]
    stream = files(spark, f"{tmp_path}/in", ops, OPS)
    got = task_queue.run(stream, "queue", path=f"{tmp_path}/out", lease_ms=3_600_000, wait_ms=86_400_000)
    rows = [tuple(r) for r in got.filter("event_id is null").select("queue", "task", "status", "attempt").collect()]
    assert ("q", "a", "pending", 1) in rows and {("q", "a", "expired", 1), ("q", "b", "expired", 0), ("z", "x", "expired", 0)} <= set(rows)
    state = spark.read.format("statestore").option("path", f"{tmp_path}/out-checkpoint").option("stateVarName", "waiting").load()
    assert state.filter("key.queue = 'q'").count() == 0


def test_a_batch_that_runs_again_writes_once(spark, tmp_path):
    df = spark.range(5).withColumn("n", F.lit(1))
    write = tasks.writer(f"{tmp_path}/t")
    for number in (0, 1, 1, 1):
        write(df, number)
    assert tasks.read_batches(spark, f"{tmp_path}/t", df.schema).count() == 10
    write(df.withColumn("n", F.lit(7)), 2)
    assert {tuple(r) for r in tasks.read_batches(spark, f"{tmp_path}/t", df.schema, ("id",)).collect()} == {(i, 7) for i in range(5)}


def test_state_of_counters_and_progress_falls(spark, tmp_path):
    day = 86_400
    rows = lambda first, days, n: [(first + i, after(d * day + i), i % 7, "view", float(i)) for d in days for i in range(n)]
    batches = [rows(0, range(10), 40), rows(1000, [60], 5), rows(2000, [61], 5)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    stream = files(spark, f"{tmp_path}/in", batches, schema)
    sizes = []
    for name, df, mode in (("counters", tasks.counters(stream), "update"), ("progress", tasks.progress(stream.withColumn("task", F.col("user_id"))), "update")):
        q = df.writeStream.foreachBatch(tasks.writer(f"{tmp_path}/{name}")).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]])
    assert max(sizes[0]) >= 70 and sizes[0][-1] <= 10  # ten days of seven users, then the last days alone
    assert max(sizes[1]) == 7 and sizes[1][-1] <= 5
    counts = tasks.read_batches(spark, f"{tmp_path}/counters", tasks.counters(stream).schema, ("day", "user_id", "event_type"))
    assert counts.agg(F.sum("n")).first()[0] == sum(map(len, batches))


def test_attempts_end_with_success_or_the_last_failure(spark, tmp_path):
    ops = [("a", "fso"), ("b", "ffff"), ("c", "ff"), ("d", "s"), ("e", "fffs")]
    rows = [(t, 10 * i + k, after(60 * k), c == "f") for i, (t, s) in enumerate(ops) for k, c in enumerate(s)]
    schema = "task string, event_id long, ts timestamp, failed boolean"
    stream = files(spark, f"{tmp_path}/in", [[r for r in rows if r[1] % 10 < 2], [r for r in rows if r[1] % 10 >= 2]], schema)
    got = tasks.drain(tasks.retries(stream.withColumn("task", F.ascii("task").cast("long"))), "r", "update", ("task",))
    assert {chr(r["task"]): (r["attempts"], r["status"]) for r in got.collect()} == {"a": (2, "completed"), "b": (3, "failed"), "c": (2, "queued"), "d": (1, "completed"), "e": (3, "failed")}


def test_registered_queue_equals_the_simulation(spark, sf):
    from quillspark import registry

    ops = []
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        op = "add" if r["value"] < 50 else "next" if r["value"] < 75 else "complete" if r["value"] < 90 else "fail"
        ops.append((str(r["user_id"] % 8), r["event_id"], r["ts"], op, f"{r['event_id']:012d}", r["event_id"] % 4, str(r["event_id"] % 3)))
    got = registry.queries()["stm_01_queue"](spark, sf).filter("event_id is not null").select("queue", "event_id", "task", "status", "worker", "attempt").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(simulated(ops), key=lambda r: r[1]) and len(got) > 500


def test_operations_of_a_queue_are_held_as_columns():
    """Half a million operations in frames out of order: sorted by time and id, in a small part of what a frame of objects takes."""
    import tracemalloc

    import pandas as pd

    n = 400_000
    frame = lambda ids: pd.DataFrame({"queue": "q", "event_id": ids, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([i // 2 for i in ids], unit="s"), "op": "add", "task": [f"{i:012d}" for i in ids], "priority": 1, "worker": None})
    frames = (frame(range(n - 1 - k, -1, -40)) for k in range(40))
    tracemalloc.start()
    at = 0
    for r in task_queue._in_time(frames):
        assert r.event_id == at and r.task == f"{at:012d}" and r.worker is None
        at += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and most < 60_000_000  # 12-digit ids alone are 61 bytes each as objects, before frames are joined and sorted
