"""Queries of container scans and of streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from papyr.operators.tables import new_path
from papyr.plans import catalog
from papyr.plans.inputs import table
from papyr.sources import cfb, hwp, hwpx
from papyr.streaming import limits

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark, sf_dir, build):
    """(path, content): one file for each region, made from its nations' names in order."""
    lines = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": [f"r{k}" for k in f["n_regionkey"]], "content": [build(list(x)) for x in f["names"]]})

    return lines.mapInPandas(run, "path string, content binary")


def _hwp(names: list[str]) -> bytes:
    import zlib

    body = b"".join(hwp.record(hwp.PARA_TEXT, n.encode("utf-16-le")) for n in names)
    packer = zlib.compressobj(wbits=-15)
    header = b"HWP Document File".ljust(36, b"\0") + b"\1\0\0\0"
    return cfb.build({"FileHeader": header, "BodyText/Section0": packer.compress(body) + packer.flush()})


@query("SELECT 'r' || n_regionkey AS path, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::BIGINT AS idx, n_name AS text FROM nation")
def hwp_scan(spark, sf_dir):
    return hwp.scan(_files(spark, sf_dir, _hwp)).select("path", F.col("idx").cast("long").alias("idx"), "text")


@query("SELECT 'r' || n_regionkey AS path, string_agg(n_name, chr(10) ORDER BY n_name) AS text, count(*)::BIGINT AS paragraphs FROM nation GROUP BY n_regionkey")
def hwpx_scan(spark, sf_dir):
    return hwpx.scan(_files(spark, sf_dir, lambda x: hwpx.write([x]))).select("path", "text", F.size("paragraphs").cast("long").alias("paragraphs"))


def _streamed(spark, df, name, mode="append"):
    """Rows that a stream gives until its input ends, written to and read from the shared folder."""
    at = new_path(spark, f"stream-{name}")
    stream = df.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True)
    stream = stream.format("parquet").option("path", f"{at}/out")
    stream.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _events(spark, sf_dir):
    """The events table as a stream; a file source reads a folder, so the table's files are named by a pattern."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(catalog.SQL["rate_limit_accept"])
def stream_rate_limit(spark, sf_dir):
    """The batch form of the limiter, from a stream."""
    ts = F.col("ts").cast("timestamp")
    requests = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("client"), (F.unix_micros(ts) / 1e6).alias("t"), ts.alias("ts"))
    return _streamed(spark, limits.limited_stream(requests, 2, 86400), "limit").select("event_id", "accepted")


@query("SELECT strftime(date_trunc('day', ts::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_counter(spark, sf_dir):
    """All windows; a mark behind the last event closes those still open when the input ends, so windows leave the state as they are told."""
    at = new_path(spark, "closing")
    last = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    last.select((F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(None).cast("string").alias("event_type")).write.parquet(at)
    closing = spark.readStream.schema("ts timestamp, event_type string").parquet(at)
    events = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type").union(closing)
    counts = _streamed(spark, limits.counted_stream(events), "count").where("event_type is not null")
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
