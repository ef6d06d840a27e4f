"""Entries that live for a time after their last use, and tasks that end or time out, on streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

READS = "event_id long, key long, us long, hit boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which timers need and whose size memory does not limit."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


class Reads(StatefulProcessor):
    """Hits and misses of a key's reads, and the ends of its entries.

    The state is the last read.  A read extends the entry's life or stores it
    anew; an entry whose life is over gives a row without event_id at the time
    of its end, when the next read finds it dead or its timer finds it idle,
    whichever comes first, and exactly once.
    """

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def _until(self, us: int) -> int:
        """Milliseconds from which an entry read last at `us` is dead."""
        return (us + self.ttl) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(["us", "event_id"])
        first = last = self.last.get()[0] if self.last.exists() else None
        out = []
        for i, us in zip(own["event_id"], own["us"], strict=True):
            hit = last is not None and us - last <= self.ttl
            if last is not None and not hit:
                out.append((None, key[0], last + self.ttl, None))
            out.append((i, key[0], us, hit))
            last = us if last is None else max(last, us)
        if first is not None:
            self.handle.deleteTimer(self._until(first))
        self.last.update((last,))
        self.handle.registerTimer(self._until(last))
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            yield _frame([(None, key[0], self.last.get()[0] + self.ttl, None)])
            self.last.clear()

    def close(self) -> None:
        pass


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["event_id", "key", "us", "hit"]).astype({"event_id": "Int64", "key": "Int64", "us": "int64", "hit": "boolean"})


def expiring_reads(reads: DataFrame, ttl: int, late: str = "1 hour") -> DataFrame:
    """(event_id, key, us, hit) of a stream of reads (event_id, key, ts), and rows with a null event_id where an entry ends, `ttl` seconds after its last read.

    The state holds one number for each live key.  Start it inside rocksdb().
    """
    timed = reads.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(Reads(ttl * 1_000_000), READS, "Append", "EventTime")


def finished_tasks(starts: DataFrame, ends: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """(start_id, task, end_id, status) of streams of starts and ends (id, task, ts, and outcome of ends).

    Each end within the time allowed gives a row; a start without any gives one
    with status TIMEOUT once the watermark has passed that time, and its state goes.
    """
    a = starts.select(F.col("id").alias("start_id"), "task", F.col("ts").alias("began")).withWatermark("began", late)
    b = ends.select(F.col("id").alias("end_id"), F.col("task").alias("end_task"), F.col("ts").alias("ended"), "outcome").withWatermark("ended", late)
    near = (F.col("task") == F.col("end_task")) & (F.col("ended") >= F.col("began")) & (F.col("ended") <= F.col("began") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "leftOuter").select("start_id", "task", "end_id", F.coalesce("outcome", F.lit("TIMEOUT")).alias("status"))
