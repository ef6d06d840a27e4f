"""A file sink that keeps one copy of a batch however often it is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a folder of its own by its number, which a replay after a failure writes over.

    A batch's rows are told by its number alone, so nothing is compared and no
    row is read again.  Folders are made whole by the committer of the file
    format; one that was cut off is replaced by the replay.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the batches, without the number of the batch."""
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(path).drop("batch")


def chunk_stream(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, json): the chunks of each key in order as one JSON text {"chunks": [...]}."""
    chunks = F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content])
    return rows.groupBy(key).agg(F.to_json(F.struct(chunks.alias("chunks"))).alias("json"))
