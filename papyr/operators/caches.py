"""A cache of results stored in buckets of its key, so that reading through it never moves the cache."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.operators.tables import new_path


class ResultCache:
    """Results by key (key, result), one for each, in `buckets` files sorted by key, under a name of the catalog.

    A lookup deals the inputs into as many parts as the cache has buckets; the
    cache itself is read as it lies, without a shuffle.
    """

    def __init__(self, spark: SparkSession, buckets: int, name: str | None = None, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"cache_{uuid.uuid4().hex}"
        self.path = path or new_path(spark, self.name)

    def store(self, results: DataFrame) -> None:
        """Replaces what the cache holds; of several results of a key the least is kept, a null key has no place."""
        one = results.where("key is not null").groupBy("key").agg(F.min("result").alias("result"))
        writer = one.repartition(self.buckets, "key").write.mode("overwrite").format("parquet").option("path", self.path)
        writer.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, inputs: DataFrame) -> DataFrame:
        """Inputs with `result`, null where the cache does not hold the key; one join for hits and misses."""
        return inputs.join(self.table.hint("merge"), "key", "left")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
