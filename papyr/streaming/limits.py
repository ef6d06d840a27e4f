"""Streaming forms of the request operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyr.operators.logs import sliding_log

OUT = "event_id long, client long, t double, accepted boolean, retry_after long"


def limited_stream(requests: DataFrame, limit: int, window: float, late: str = "1 hour") -> DataFrame:
    """The sliding-log limiter over a stream of (event_id, client, t seconds, ts timestamp).

    State is at most `limit` times per client; it ends when the watermark has
    passed the client's last request by a window, as no time in it counts then.
    Within a batch requests are taken in the order of their times; one that
    comes in a later batch is taken when it comes.
    """

    def step(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        result = list(sliding_log(iter(rows["t"]), limit, window, log))
        state.update((list(log),))
        state.setTimeoutTimestamp(max(int((rows["t"].iloc[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "client": rows["client"], "t": rows["t"], "accepted": [a for a, _, _ in result], "retry_after": [w for _, w, _ in result]})

    return requests.withWatermark("ts", late).groupBy("client").applyInPandasWithState(step, OUT, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def counted_stream(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by type and tumbling window with a watermark; an addition, the request log has no such window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
