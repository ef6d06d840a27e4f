"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

1. Equal vectors form a class, which is compared once and counts as often as it
   has members.
2. A rotation is learnt on a bounded, documented sample (SAMPLE classes, those
   with the smallest hashes): principal axes of the centred rows, alternating
   sign codes and orthogonal Procrustes solutions, and last the median of each
   bit's projection as its threshold, so that every bit halves the sample.  Of
   sampled vectors that are near each other only one counts, as a plane that
   halves one tight group would part it everywhere.
3. Every class gets a BITS-bit code.  Each of TABLES tables holds one substring
   of the code; a class is entered under every key within one bit of its
   substring, so two classes meet if their substrings differ in at most two bits
   in any table.
4. Inside a bucket, codes are compared; a pair that is within CODE_RADIUS bits
   is reported by one bucket only (the first table and smallest key at which
   the two meet) and reranked with the original vectors in double precision.

A bucket with more than BUCKET members is dealt out in blocks: each member goes
to the tasks of the block pairs it takes part in, so no task holds a whole
bucket and no pair is lost.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing.  Vectors are compared with those of their own
length only; lengths other than the sample's commonest have codes by the same
planes, cut or filled up with random ones.  Rows repeated under one vec_id are
one vector (the smallest by its values); a null vec_id is an identifier of its
own that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import NULL_ID, Tables, dealt_in_blocks, id_of, join_hot, pairs_in_cells, read, runs_by_key, width
from papyr.llm.components import connected_components

BITS = 64
TABLES = 4
SAMPLE = 4096
ROUNDS = 40
#: Differing bits of 64 beyond which a retrieved pair is not reranked.
CODE_RADIUS = 17
BUCKET = 2_000
THRESHOLD = 0.9
_PIECE = BITS // TABLES
_MASK = np.uint64((1 << _PIECE) - 1)


def usable(c: str = "embedding") -> F.Column:
    """Not null, not empty, only finite components, and not all of them zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(
        (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))) & F.exists(c, lambda x: x != 0),
        F.lit(False),
    )


def leaders(x: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of x, of unit length, of which none is near an earlier one."""
    near = x @ x.T >= threshold
    left, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if left[i]:
            out.append(i)
            left &= ~near[i]
    return x[out]


def fit_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(projection, thresholds) of iterative quantisation on the rows of x, of unit length.

    A bit is set where the projection exceeds its threshold.  With fewer than
    two rows nothing can be halved and the thresholds are zero.
    """
    dim = x.shape[1]
    few = len(x) < 2
    centred = x if few else x - x.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(bits, dim)]
    rng = np.random.default_rng(0)
    if bits > dim:  # more bits than dimensions: fill up with random directions
        axes = np.concatenate((axes, np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : bits - dim] if bits - dim <= dim else rng.normal(size=(dim, bits - dim))), axis=1)
    v = centred @ axes
    rot = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        code = np.where(v @ rot >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        rot = (u @ w).T
    projection = axes @ rot
    return projection, np.zeros(bits) if few else np.median(x @ projection, axis=0)


def of_length(projection: np.ndarray, thresholds: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The planes for vectors of `dim` components: cut, or filled up with random rows; those of another length go through the origin."""
    own = len(projection)
    if dim == own:
        return projection, thresholds
    more = np.random.default_rng(1).normal(size=(max(0, dim - own), projection.shape[1])) * np.sqrt((projection**2).mean())
    return np.concatenate((projection[:dim], more)), np.zeros_like(thresholds)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def _codes(projection: np.ndarray, thresholds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                planes, least = of_length(projection, thresholds, int(dim))
                bits = _matrix(part.column("v")) @ planes >= least
                code = np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(code), pa.array(lengths[lengths == dim].astype(np.int64))], names=["id", "code", "dim"])

    return run


def _enter(usual: int):
    """(id, code, dim) under every key of every table: (bucket, id, code); vectors of another length than `usual` have buckets of their own."""
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(_PIECE, dtype=np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                ids, code, dim = (part.column(c).to_numpy() for c in ("id", "code", "dim"))
                code, other = code.view(np.uint64), (np.where(dim == usual, 0, dim).astype(np.uint64) << np.uint64(_PIECE + 8))
                keys = [(((code >> np.uint64(t * _PIECE)) & _MASK) ^ f) | np.uint64(t << _PIECE) | other for t in range(TABLES) for f in flips]
                m = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, m)), pa.array(np.tile(code.view(np.int64), m))],
                    names=["bucket", "id", "code"],
                )

    return run


def _canonical(bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether this bucket is the first of those in which codes a and b meet."""
    table, key = (bucket >> np.uint64(_PIECE)) & np.uint64(255), bucket & _MASK
    ok = np.ones(len(a), bool)
    diff = a ^ b
    for t in range(TABLES):
        d = (diff >> np.uint64(t * _PIECE)) & _MASK
        ok &= ~((table > t) & (np.bitwise_count(d) <= 2))
    d = (diff >> (table * np.uint64(_PIECE))) & _MASK
    x = (a >> (table * np.uint64(_PIECE))) & _MASK
    n = np.bitwise_count(d)
    low = d & (~d + np.uint64(1))
    # they meet at x itself if equal, at both if one bit differs, at the two midpoints if two do
    first = np.where(n == 0, x, np.where(n == 1, np.minimum(x, x ^ d), np.minimum(x ^ low, x ^ d ^ low)))
    return ok & (key == first)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell within CODE_RADIUS, each from its first bucket only."""
    near = lambda a, b: np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= CODE_RADIUS
    for t in runs_by_key(batches, "cell", 50_000):
        order, p, q = pairs_in_cells(t, "bucket", "code", near)
        bucket, ids, code = (t.column(c).to_numpy()[order] for c in ("bucket", "id", "code"))
        code = code.view(np.uint64)
        keep = _canonical(bucket[p].view(np.uint64), code[p], code[q])
        p, q = ids[p[keep]], ids[q[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])


def _rerank(threshold: float):
    """Pairs (a, b, na, nb, va, vb) whose cosine in double precision is at least `threshold`, without the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("va")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                keep = (_matrix(part.column("va")) * _matrix(part.column("vb"))).sum(1) >= threshold
                yield part.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return run


def similar_pairs(classes: DataFrame, tables: Tables, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, na, nb), a < b: classes (id, n, v) whose cosine is at least `threshold`, each pair once, with their sizes."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "a long, b long, na long, nb long")
    lengths = pa.compute.list_value_length(sample).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(lengths).argmax())
    alone = classes.where(F.size("v") != dim).isEmpty()
    planes = fit_rotation(leaders(_matrix(sample.filter(pa.array(lengths == dim))), threshold), BITS)
    codes = tables.settle(classes.select("id", "v").mapInArrow(_codes(*planes), "id long, code long, dim long"))
    entered = codes.mapInArrow(_enter(dim), "bucket long, id long, code long")
    # vectors of one length have at most TABLES * 2**16 buckets, however many they are; that bounds the broadcast
    dealt = dealt_in_blocks(entered, "bucket", "id", BUCKET, bounded=alone)
    pairs = (
        dealt.repartition(width(spark), "cell").sortWithinPartitions("cell").mapInArrow(_compare, "a long, b long")
    )
    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("v").alias("va")), "a").join(
        classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb")), "b"
    )
    return both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(_rerank(threshold), "a long, b long, na long, nb long")


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of `vectors`(vec_id, embedding, ...)."""
    tables = Tables(spark)
    plain = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    rows = vectors.select(id_of("vec_id").alias("id"), (F.col("embedding") if plain else F.col("embedding").cast("array<double>")).alias("v"))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    good = usable("v")
    own = tables.settle(rows.select("id", good.alias("good"), F.when(good, F.xxhash64("v")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "v")).alias("h2"), "v"))
    classes = tables.settle(own.where("good").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    pairs = tables.settle(similar_pairs(classes.select("id", "n", "v"), tables, threshold))
    counts = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("nb").alias("k")), F.struct(F.col("b").alias("id"), F.col("na").alias("k"))))).groupBy("id").agg(F.sum("k").alias("others"))
    joined = connected_components(pairs, tables).withColumnRenamed("node", "id")
    of_class = tables.settle(
        classes.select("h1", "h2", "id", "n").join(counts, "id", "left").join(joined, "id", "left")
        .select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    linked = join_hot(own.where("good").select("id", "h1", "h2"), of_class, ["h1", "h2"], "n", own.count()).select("id", "n_links", "component")
    every = linked.union(own.where("not good").select("id", F.lit(0).cast("long"), "id"))
    shown = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return every.select(
        shown("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), shown("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector of the embeddings table.

    Unusable vectors (see the module) have no links and are kept; rows repeated
    under one vec_id give one row; an empty table gives none.
    """
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id
      WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
c(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.vec_id, p.b FROM c JOIN p ON p.a = c.reach),
m AS (SELECT vec_id, min(reach) AS component_id FROM c GROUP BY vec_id),
l AS (SELECT a AS vec_id, count(*) AS k FROM p GROUP BY a)
SELECT m.vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept
FROM m LEFT JOIN l USING (vec_id)
"""
