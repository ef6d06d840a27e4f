"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyr.llm.common import Tables, join_hot

#: Links of a file of a round's table, and of a task that writes one; few links need few files however many tasks a shuffle has.
LINKS_A_FILE = 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) of each component of the links a-b, roots left out."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        live = low != high
        if not live.any():
            break
        x, y = x[live], y[live]
        np.minimum.at(root, high[live], low[live])
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a task, some at a time, by the spanning stars of their components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def out():
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count >= 1_000_000:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def connected_components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) for every node of `links`(a long, b long); component is the smallest node.

    Alternates large-star and small-star steps, each an aggregation with
    map-side combine and a join, until the links are stars.  A hub, however
    many links it has, is joined where its links lie (join_hot).  Links of a
    node with itself are ignored; no links give no rows.  Every step is written
    to the shared folder.
    """
    small_files = lambda df, n: df.coalesce(max(4, n // LINKS_A_FILE))
    edges, path = tables.write(links.select("a", "b").where("a <> b").mapInArrow(_local_forests, "a long, b long"))
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("links"))
        large = join_hot(both.where("b > a"), low, "a", "links", 2 * now[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, large_path = tables.write(small_files(large, now[0]))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
        small = (
            join_hot(large, least, "a", "links", 2 * now[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        # (b, m) with b < m cannot occur: m is the smallest neighbour
        new, new_path = tables.write(small_files(small, now[0]))
        tables.drop(path)
        tables.drop(large_path)
        edges, path = new, new_path
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
