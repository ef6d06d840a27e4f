"""One scan over files of several formats: a branch for each, chosen by the suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyr.functions import validate as v
from papyr.sources import hwp, hwpx


def scan(files: DataFrame) -> DataFrame:
    """(path, parser, text, error) of (path, content).

    Files in zip containers and compound files are read by their readers; any
    other suffix goes the compound way and fails there with an error row.  Page
    files come as an error row, as their text must be extracted before.
    """
    parser = v.parser_of(F.col("path"))
    part = lambda p: files.where(parser == p).select("path", "content")
    zipped = hwpx.scan(part("hwpx")).select("path", F.lit("hwpx").alias("parser"), "text", "error")
    rows = hwp.scan(part("hwp"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("idx", "text")))), lambda x: x["text"]), "\n")
    compound = rows.groupBy("path").agg(text.alias("text"), F.max("error").alias("error"))
    compound = compound.select("path", F.lit("hwp").alias("parser"), F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")
    pages = part("pdf").select("path", F.lit("pdf").alias("parser"), F.lit(None).cast("string").alias("text"), F.lit("pages must be extracted before").alias("error"))
    return zipped.unionByName(compound).unionByName(pages)


def package(paragraphs: DataFrame) -> DataFrame:
    """(path, content): a zip container for each path of (path, section, idx, text), its sections and paragraphs in order.

    A file is one value, so its paragraphs are gathered in one row.
    """
    import pandas as pd

    rows = paragraphs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("section", "idx", "text"))).alias("x"))

    def run(frames):
        for f in frames:
            content = []
            for x in f["x"]:
                parts: dict = {}
                for r in x:
                    parts.setdefault(r["section"], []).append(r["text"] or "")
                content.append(hwpx.write(list(parts.values())))
            yield pd.DataFrame({"path": f["path"], "content": content})

    return rows.mapInPandas(run, "path string, content binary")


def converted(files: DataFrame, least: int = 100) -> DataFrame:
    """(path, text, accepted) of compound files, repackaged as zip containers and read again; accepted if over `least` characters come out.

    An unreadable file has no text and is not accepted.
    """
    rows = hwp.scan(files).where("error is null")
    read = hwpx.scan(package(rows.select("path", "section", "idx", "text"))).select("path", "text")
    out = files.select("path").join(read, "path", "left")
    return out.withColumn("accepted", F.coalesce(F.length("text") > least, F.lit(False)))
