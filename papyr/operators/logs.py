"""Operators on request, cache and metric logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sliding_log(times: Iterator[float], limit: int, window: float, log: deque | None = None) -> Iterator[tuple[bool, int, int]]:
    """(accepted, retry_after, active) of one client's request times in order; rejected requests are not logged.

    active: the accepted requests of the window so far, without this one.
    """
    log = deque() if log is None else log
    for now in times:
        while log and log[0] <= now - window:
            log.popleft()
        active = len(log)
        if active >= limit:
            yield False, int(window - (now - log[0])), active
        else:
            log.append(now)
            yield True, 0, active


def islands(requests: DataFrame, gap: float) -> DataFrame:
    """Adds _island: a client's requests (client, t) are of different islands only where none comes for `gap` or longer in between.

    Gaps are found between stretches of time of that length, of which a client
    has few however many its requests are: they are aggregated before the
    shuffle, and only they are put in order.
    """
    stretch = F.floor(F.col("t") / gap)
    spans = requests.groupBy(F.col("client").alias("_c"), stretch.alias("_s")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    w = W.partitionBy("_c").orderBy("_s")
    # the same subtraction as in the folds, so that a gap found here has emptied their state
    apart = F.coalesce(F.lag("hi").over(w) <= F.col("lo") - gap, F.lit(False)).cast("long")
    numbered = spans.withColumn("_new", apart).select("_c", "_s", F.sum("_new").over(w).alias("_island"))
    return requests.withColumn("_own", stretch).join(numbered, F.col("client").eqNullSafe(F.col("_c")) & F.col("_own").eqNullSafe(F.col("_s"))).drop("_own", "_c", "_s")


def _folded(requests: DataFrame, gap: float, order: str, begin: Callable, out: dict[str, str]) -> DataFrame:
    """Adds the columns `out` that begin() gives for the times of an island, one after another.

    Islands are dealt like keys and sorted; a task reads its rows once with the
    state of one island in memory.
    """
    schema = requests.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = object(), None
        for frame in frames:
            rows = []
            clients = frame["client"].astype(object).where(frame["client"].notna(), None)
            for c, i, now in zip(clients, frame["_island"], frame["t"], strict=True):
                if (c, i) != last:
                    last, step = (c, i), begin()
                rows.append(step(now))
            cols = zip(*rows, strict=True) if rows else [[] for _ in out]
            yield frame.drop(columns="_island").assign(**dict(zip(out, map(list, cols), strict=True)))

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{n} {k}" for n, k in out.items())])
    dealt = islands(requests, gap).select(*schema.names, "_island").repartition("client", "_island")
    return dealt.sortWithinPartitions("client", "_island", "t", order).mapInPandas(run, kinds)


def rate_limited(requests: DataFrame, limit: int, window: float, order: str = "event_id") -> DataFrame:
    """Adds accepted, retry_after and active to requests (client, t in seconds, ...).

    After a window without requests a client's log is empty, so what lies
    between such gaps is worked on apart, also of one client.
    """

    def begin() -> Callable:
        log: deque = deque()
        return lambda now: next(sliding_log(iter((now,)), limit, window, log))

    return _folded(requests, window, order, begin, {"accepted": "boolean", "retry_after": "long", "active": "long"})


class LeakyBucket:
    """Leaks `rate` requests a second and holds `burst` beside the one in service."""

    def __init__(self, rate: float, burst: int):
        self.rate, self.burst, self.level, self.last = rate, burst, 0.0, None

    def accepts(self, now: float) -> bool:
        if self.last is not None:
            self.level = max(0.0, self.level - (now - self.last) * self.rate)
        self.last = now
        fits = self.level <= self.burst
        self.level += fits
        return fits


def leaky(requests: DataFrame, rate: float, burst: int, order: str = "event_id") -> DataFrame:
    """Adds accepted to requests (client, t in seconds, ...); what lies between times in which any bucket runs dry is worked on apart."""
    dry = (burst + 1) / rate * (1 + 1e-9)  # a little more, as the leak is rounded

    def begin() -> Callable:
        bucket = LeakyBucket(rate, burst)
        return lambda now: (bucket.accepts(now),)

    return _folded(requests, dry, order, begin, {"accepted": "boolean"})


def client_id(token: Column, address: Column) -> Column:
    return F.when(token.isNotNull(), F.concat(F.lit("user:"), F.substring(token, 1, 13))).otherwise(F.concat(F.lit("ip:"), F.coalesce(address, F.lit("unknown"))))


#: Upper bounds of duration buckets; the last one holds everything.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def histogram(df: DataFrame, value: str, *by: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(by, le, cumulative, total, sum): one aggregation for all buckets, unpivoted afterwards."""
    counts = df.groupBy(*by).agg(
        *(F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)), F.count("*").alias("total"), F.sum(value).alias("sum")
    )
    rows = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds))))
    return counts.select(*by, rows.alias("b"), "total", "sum").select(*by, "b.le", "b.cumulative", "total", "sum")


# Lifetimes in seconds.
TTL_BASE, TTL_TOP = 3600, 86400


def cache_ttl(kind: Column, size: Column, base: int = TTL_BASE) -> Column:
    own = F.when(kind == "json", (F.lit(base) * 1.5).cast("long")).when(kind == "text", (F.lit(base) * 0.8).cast("long")).otherwise(F.lit(base).cast("long"))
    grown = F.when(size > 10 * 1024 * 1024, own * 2).when(size > 1024 * 1024, (own * 1.5).cast("long")).otherwise(own)
    return F.least(grown, F.lit(TTL_TOP).cast("long"))


def refreshed_hits(reads: DataFrame, ttl: float, order: str = "event_id") -> DataFrame:
    """Adds hit to reads (key, t in seconds, ...).

    Every read leaves the entry alive for `ttl` seconds, a hit by extending it
    and a miss by storing it, so only the time since the last read counts.
    """
    since = F.col("t") - F.lag("t").over(W.partitionBy("key").orderBy("t", order))
    return reads.withColumn("hit", F.coalesce(since <= ttl, F.lit(False)))


def cache_key(kind: Column, content: Column, options: Column | None = None) -> Column:
    base = F.concat_ws(":", F.lit("hwp_extract"), kind, F.sha2(content, 256))
    return base if options is None else F.when(options.isNull(), base).otherwise(F.concat_ws(":", base, F.substring(F.md5(options), 1, 8)))


def size_class(n: Column) -> Column:
    mb = 1024 * 1024
    return F.when(n < 10 * mb, "small").when(n < 100 * mb, "medium").otherwise("large")


def memory_status(mb: Column) -> Column:
    return F.when(mb > 400, "critical").when(mb > 300, "warning").otherwise("ok")


def composite_key(kind: str, options: dict[str, str], content: Column) -> Column:
    """The cache key of an extraction whose options are part of its kind."""
    return cache_key(F.lit("_".join([kind, *(f"{k}:{v}" for k, v in options.items())])), content)


def read_through(inputs: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """Inputs with `result` and `hit`: from the cache (key, result), a row for each key, where it holds the key, else computed.

    Only inputs that the cache does not hold are computed.
    """
    hits = inputs.join(cache, key).withColumn("hit", F.lit(True))
    return hits.unionByName(compute(inputs.join(cache, key, "left_anti")).withColumn("hit", F.lit(False)))


def gated(requests: DataFrame, most: int, duration: float, order: str = "event_id") -> DataFrame:
    """Adds active (accepted requests of the client still under way, each taking `duration` seconds) and rejected (`most` or more are) to (client, t, ...).

    A rejected request never runs, so it isn't active for later ones: the log
    of a sliding window, in which a request stands as long as it runs.
    """
    out = rate_limited(requests, most, duration, order)
    return out.withColumn("rejected", ~F.col("accepted")).drop("accepted", "retry_after")


def matches(key: Column, glob: str) -> Column:
    """Whether a key fits a glob of asterisks, question marks and other characters, which stand for themselves."""
    like = "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in glob)
    return key.like(like)
