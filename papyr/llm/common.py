"""What the operators of this subpackage share: inputs, shared tables, batches."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier where a number is needed; it sorts first, as nulls do.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where nothing is set and the session is local, else an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="papyr-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return base


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # the JVM may be gone when Python ends
        pass


class Tables:
    """Tables written in the shared folder to cut lineage; they outlive any executor.

    A table that nothing reads any more can be dropped early; the rest go when
    Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/papyr-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_delete, spark, self.base)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def settle(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        _delete(self.spark, path)


def share(spark: SparkSession, value) -> Callable:
    """A function that gives `value` on executors, sent once to each; objects of this subpackage go by value, as functions do."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def id_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def process_state() -> dict:
    """A dictionary that lives as long as the Python worker, for models and caches."""
    name = "_papyr_process_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


#: Bytes and rows of a batch that an executor sends to Python at once, for rows that hold texts or sets.
BATCH_BYTES, BATCH_ROWS = "4m", "1000"


@contextmanager
def small_batches(spark: SparkSession):
    """What runs inside sends rows to Python by small batches: a batch of 10,000 texts is held several times by the executor and its Python workers."""
    names = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column`, or of one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = 0
        for i in range(n):
            if i > at and total + sizes[i] > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += sizes[i]
        yield batch.slice(at, n - at)


def runs_by_key(
    batches: Iterator[pa.RecordBatch], key: str, most: int
) -> Iterator[pa.Table]:
    """Rows sorted by `key`, regathered so that no key is cut, in tables of `most` rows or more."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if count >= most:
            change = np.flatnonzero(k != held[-1].column(key)[-1].as_py())
            if len(change):
                cut = int(change[0])
                if cut:
                    held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, count = [], 0
                batch = batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, total: int, most: int = 10_000, least: int = 1_000) -> DataFrame:
    """Inner join of `rows` with `table`, which has a row for each key and the key's number of rows as `size`.

    Keys of more than total / most rows, at most `most` of them for `total` rows
    in all, are broadcast, so that the rows of a hot key need not meet in one
    task; the others are shuffled.  `rows` is read twice.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.col(size) > max(least, total // most)
    marked = rows.join(F.broadcast(table.where(hot).withColumn("_hot", F.lit(True))), keys, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(table.where(~hot), keys)
    return marked.where("_hot").drop("_hot").unionByName(rest)


def dealt_in_blocks(rows: DataFrame, key: str, member: str, size: int, bounded: bool = False) -> DataFrame:
    """`rows` with (block, x, y, cell): members of a group of over `size` go to all block pairs they take part in.

    Rows of one cell, a hash of (key, x, y), are compared with each other where
    x = y, and across the blocks x and y otherwise; so every pair of a group
    meets in one cell and no cell holds more than about 2 * size rows.
    bounded: the number of keys has a limit, so the table of large groups may
    be broadcast.
    """
    large = rows.groupBy(key).count().where(F.col("count") > size).select(key, F.ceil(F.col("count") / size).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(large) if bounded else large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return (
        dealt.withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
        .drop("blocks", "other")
        .withColumn("cell", F.xxhash64(key, "x", "y"))
    )


def pairs_in_cells(t: pa.Table, key: str, value, near: Callable, small: int = 64):
    """Index pairs (p, q) of rows of one (key, x, y) for which near(values of p, values of q).

    value: a column's name, or an array with a row of numbers for each row of `t`.

    Works through small groups together and through large ones by blocks of
    rows, so memory stays bounded.  Returns (table in group order, p, q).
    """
    import numpy as np

    k, block, x, y = (t.column(c).to_numpy() for c in (key, "block", "x", "y"))
    v = t.column(value).to_numpy() if isinstance(value, str) else value
    order = np.lexsort((block, y, x, k))
    k, v, block, x, y = (a[order] for a in (k, v, block, x, y))
    change = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    head = np.flatnonzero(np.concatenate(([True], change)))
    count = np.diff(np.concatenate((head, [len(k)])))
    ps, qs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    few = count <= small
    row = np.repeat(few, count)
    group, at = np.repeat(np.arange(len(head)), count)[row], np.flatnonzero(row)
    for step in range(1, int(count[few].max(initial=1))):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        p, q = at[i], at[i + step]
        keep = ((x[p] == y[p]) | (block[p] != block[q])) & near(v[p], v[q])
        ps.append(p[keep]), qs.append(q[keep])
    for s, n in zip(head[~few], count[~few], strict=True):
        one = x[s] == y[s]
        m = n if one else int((block[s : s + n] == x[s]).sum())
        base = s if one else s + m
        for i in range(s, s + m, 128):
            top = min(i + 128, s + m)
            p, q = np.nonzero(near(v[i:top, None], v[None, base : s + n]))
            p, q = p + i, q + base
            if one:
                p, q = p[p < q], q[p < q]
            ps.append(p), qs.append(q)
    return order, np.concatenate(ps), np.concatenate(qs)
