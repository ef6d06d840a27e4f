"""Tables kept by day: deleting a day's rows touches that day's files alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.operators.tables import settle


def write_by_day(df: DataFrame, path: str, day: Column) -> None:
    """A Parquet table with a folder for each day."""
    df.withColumn("day", day).repartition("day").write.partitionBy("day").mode("overwrite").parquet(path)


def delete_rows(spark: SparkSession, path: str, gone: Column, days: Column) -> int:
    """Deletes the rows for which `gone` holds from the days for which `days` holds, and returns their number.

    Only the folders of those days that lose a row are written anew, by
    overwriting partitions dynamically; a day that loses all of its rows loses
    its folder.  Other folders keep their files.
    """
    table = spark.read.parquet(path)
    marked = settle(table.where(days).withColumn("_gone", F.coalesce(gone, F.lit(False))))
    counts = marked.groupBy("day").agg(F.count_if("_gone").alias("gone"), F.count("*").alias("n")).where("gone > 0")
    changed = counts.collect()  # a row for each day that changes
    touched = [r["day"] for r in changed]
    left = marked.where(F.col("day").isin(touched) & ~F.col("_gone")).drop("_gone")
    if any(r["gone"] < r["n"] for r in changed):
        left.repartition("day").write.option("partitionOverwriteMode", "dynamic").partitionBy("day").mode("overwrite").parquet(path)
    for r in changed:
        if r["gone"] == r["n"]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={r['day']}")
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return sum(r["gone"] for r in changed)
