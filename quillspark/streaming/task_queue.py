"""A priority queue of tasks as a stateful stream: tasks are popped by priority, failed ones return until they have failed too often, and
what a worker does not report on in time returns as well.

A queue is a key; its waiting and running tasks are map states, so a batch reads and writes the tasks it touches. Timers by event time
bring back tasks whose lease has run out and drop tasks that have waited for too long, after which a queue leaves no state behind.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming import tasks

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Operations that are turned into Python objects, and changes that are given back, at once.
PART = 50_000
OUT = "queue string, event_id long, task string, status string, worker string, attempt int"


class _Operation(NamedTuple):
    event_id: int
    ts: datetime
    op: str
    task: str | None
    priority: int | None
    worker: str | None


def _in_time(rows: Iterator) -> Iterator[_Operation]:
    """The operations of frames in the order of their time and id. They are held as Arrow columns, some fifty bytes each, and are
    Python objects a part at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("ns")), ("op", pa.string()), ("task", pa.string()), ("priority", pa.int32()), ("worker", pa.string())])
    held = pa.Table.from_batches([pa.RecordBatch.from_pandas(r[schema.names], schema, preserve_index=False) for r in rows], schema)
    order = pc.sort_indices(held.select(["ts", "event_id"]), sort_keys=[("ts", "ascending"), ("event_id", "ascending")])
    for at in range(0, len(order), PART):
        part = held.take(order.slice(at, PART))
        yield from map(_Operation._make, zip(*[c.to_pylist() for c in part.columns], strict=True))


class _Largest(str):
    """Text that sorts the other way round: of equal priorities the largest id is popped."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


class TaskQueue(StatefulProcessor):
    """Operations add, next, complete, fail and cancel in the order of their time. complete and fail speak of the task that the worker
    took last; an operation that has nothing to act on gives no row."""

    def __init__(self, most: int = 3, lease_ms: int = 3_600_000, wait_ms: int = 86_400_000):
        self.most, self.lease_ms, self.wait_ms = most, lease_ms, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "task string", "priority int, failed int, until long")
        self.running = handle.getMapState("running", "worker string", "task string, priority int, failed int, until long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        heap = [(-v[0], _Largest(t)) for t, v in waiting.items()]
        heapq.heapify(heap)
        running = {k[0]: tuple(v) for k, v in self.running.iterator()}
        before, held = dict(waiting), dict(running)
        out = []

        def put(task: str, priority: int, failed: int, now: int) -> None:
            waiting[task] = (priority, failed, now + self.wait_ms)
            heapq.heappush(heap, (-priority, _Largest(task)))

        for r in _in_time(rows):
            if len(out) >= PART:
                yield self._rows(key, out)
                out = []
            now = int(r.ts.timestamp() * 1000)
            if r.op == "add" and r.task not in waiting:
                put(r.task, int(r.priority), 0, now)
                out.append((r.event_id, r.task, "pending", None, 0))
            elif r.op == "next" and r.worker not in running:
                while heap and str(heap[0][1]) not in waiting:  # cancelled or dropped
                    heapq.heappop(heap)
                if heap:
                    task = str(heapq.heappop(heap)[1])
                    priority, failed, _ = waiting.pop(task)
                    running[r.worker] = (task, priority, failed, now + self.lease_ms)
                    out.append((r.event_id, task, "processing", r.worker, failed + 1))
            elif r.op in ("complete", "fail") and r.worker in running:
                task, priority, failed, _ = running.pop(r.worker)
                if r.op == "complete":
                    out.append((r.event_id, task, "completed", r.worker, failed + 1))
                elif failed + 1 >= self.most:
                    out.append((r.event_id, task, "failed", r.worker, failed + 1))
                else:
                    put(task, priority, failed + 1, now)
                    out.append((r.event_id, task, "pending", r.worker, failed + 1))
            elif r.op == "cancel" and r.task in waiting:
                _, failed, _ = waiting.pop(r.task)
                out.append((r.event_id, r.task, "cancelled", None, failed))
        self._save(self.waiting, before, waiting)
        self._save(self.running, held, running)
        self._remind([v[-1] for v in (*waiting.values(), *running.values())], timerValues)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        running = {k[0]: tuple(v) for k, v in self.running.iterator()}
        left, held, out = dict(waiting), dict(running), []
        for task, v in waiting.items():
            if v[2] <= now:
                del left[task]
                out.append((None, task, "expired", None, v[1]))
        for worker, (task, priority, failed, until) in running.items():
            if until <= now:
                del held[worker]
                if failed + 1 >= self.most:
                    out.append((None, task, "failed", worker, failed + 1))
                else:
                    left[task] = (priority, failed + 1, until + self.wait_ms)
                    out.append((None, task, "pending", worker, failed + 1))
        self._save(self.waiting, waiting, left)
        self._save(self.running, running, held)
        self._remind([v[-1] for v in (*left.values(), *held.values())], timerValues)
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _save(state, before: dict, after: dict) -> None:
        for k in before.keys() - after.keys():
            state.removeKey((k,))
        for k, v in after.items():
            if before.get(k) != v:
                state.updateValue((k,), v)

    def _remind(self, times: list[int], timer_values) -> None:
        """One timer, at the earliest time that something runs out."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(max(min(times), timer_values.getCurrentWatermarkInMs() + 1))

    @staticmethod
    def _rows(key, out: list[tuple]):
        import pandas as pd

        cols = list(zip(*out, strict=True)) if out else [()] * 5
        return pd.DataFrame({"queue": pd.Series([key[0]] * len(out), dtype=object), "event_id": pd.array(cols[0], dtype="Int64"), "task": pd.Series(cols[1], dtype=object), "status": pd.Series(cols[2], dtype=object), "worker": pd.Series(cols[3], dtype=object), "attempt": pd.array(cols[4], dtype="Int32")})


def transitions(events: DataFrame, late: str = "1 hour", **limits: int) -> DataFrame:
    """events(queue, event_id, ts, op, task, priority, worker) -> the changes of state of tasks, as they happen."""
    timed = events.withColumn("ts", events["ts"].cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("queue").transformWithStateInPandas(TaskQueue(**limits), OUT, "append", "eventTime")


def run(events: DataFrame, name: str, path: str | None = None, **limits: int) -> DataFrame:
    """The changes that a stream of operations makes until its input is read; state is kept by RocksDB, as timers and maps need."""
    conf = events.sparkSession.conf
    was = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return tasks.drain(transitions(events, **limits), name, path=path)
    finally:
        if was is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, was)
