"""Queues for a bounded number of slots, simulated for each session over its requests in order of arrival."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT_ROWS = 8192


def serve(requests: Iterable[tuple], slots: int) -> Iterator[tuple]:
    """(seq, arrive, start, finish) of requests (seq, arrive, duration, priority) in order of arrival.

    A request starts at once where a slot is free; a slot that comes free goes to the waiting request of highest priority,
    the first of ties.  A slot that comes free at the moment of an arrival is free for it, after those that wait.
    """
    busy: list[float] = []
    waiting: list[tuple] = []

    def begin(at: float, seq: int, arrive: float, duration: float) -> tuple:
        heapq.heappush(busy, at + duration)
        return seq, arrive, at, at + duration

    for seq, arrive, duration, priority in requests:
        while busy and busy[0] <= arrive:
            free = heapq.heappop(busy)
            if waiting:
                _, s, a, d = heapq.heappop(waiting)
                yield begin(free, s, a, d)
        if len(busy) < slots:
            yield begin(arrive, seq, arrive, duration)
        else:
            heapq.heappush(waiting, (-priority, seq, arrive, duration))
    while waiting:
        _, s, a, d = heapq.heappop(waiting)
        yield begin(heapq.heappop(busy), s, a, d)


def walk(df: DataFrame, key: str, order: list[str], handle: Callable[[Iterator[tuple]], Iterator[tuple]], out: str, parallel: int | None = None) -> DataFrame:
    """``handle`` over the rows of each key in order, as tuples without the key; its tuples have the columns ``out``.

    Keys are dealt to tasks by a hash and sorted inside them, which spills; a task walks its rows once, so a long key costs
    time and not memory, beyond what ``handle`` holds.
    """
    kind = df.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        source = rows(batches)
        head = next(source, None)
        while head is not None:
            session = head[0]

            def own(session: object = session) -> Iterator[tuple]:
                nonlocal head
                while head is not None and head[0] == session:
                    yield head[1:]
                    head = next(source, None)

            for one in handle(own()):
                found.append((session, *one))
                if len(found) >= _OUT_ROWS:
                    yield _batch(found)
                    found = []
        if found:
            yield _batch(found)

    dealt = df.repartition(parallel, key) if parallel else df.repartition(key)
    return dealt.sortWithinPartitions(key, *order).mapInArrow(run, f"{key} {kind}, {out}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [f"c{k}" for k in range(len(rows[0]))])


def simulate(df: DataFrame, slots: int, key: str = "session_id", parallel: int | None = None) -> DataFrame:
    """Columns key, seq, arrive, start, finish and waited for requests of (key, seq, arrive, duration, priority).

    A task holds only what runs and waits.  Durations are not negative; a null duration is 0 and a null priority the lowest;
    rows without key or arrival don't take part.  Columns with other names are ignored.
    """
    clean = df.where(F.col(key).isNotNull() & F.col("arrive").isNotNull()).select(
        key, F.col("seq").cast("long").alias("seq"), F.col("arrive").cast("double").alias("arrive"),
        F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("duration"), F.coalesce(F.col("priority").cast("double"), F.lit(-float("inf"))).alias("priority"),
    )
    served = walk(clean, key, ["arrive", "seq"], lambda own: serve(own, slots), "seq long, arrive double, start double, finish double", parallel)
    return served.withColumn("waited", F.col("start") - F.col("arrive"))
