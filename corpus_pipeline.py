"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next stage's docs.  All but the
last keep the columns of documents.  A stage that ends in Python writes its rows
itself, by small batches: a batch of 10,000 whole texts is held several times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyr.llm import bpe, decontaminate, language_id, secret_scan, simhash
from papyr.llm.common import Tables, read, small_batches

#: Near-duplicate stages take shingles of five words.
SHINGLE = 5


def written(spark: SparkSession, out: DataFrame) -> DataFrame:
    with small_batches(spark):
        rows = Tables(spark).settle(out)
    # Parquet is read as nullable: columns without nulls are told as such again
    whole = [f for f in out.schema if not f.nullable and isinstance(f.dataType, (T.NumericType, T.StringType))]
    return rows.withColumns({f.name: F.coalesce(f.name, F.lit(0 if isinstance(f.dataType, T.NumericType) else "").cast(f.dataType)) for f in whole}) if whole else rows


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes the predicted one.

    The model learns from all labelled rows of the stage's input (a bounded
    sample of them); a text that is null or has no letter is rejected.
    """
    labelled = docs.where("lang is not null and text is not null")
    # names that no column of docs has, whatever columns it brings
    taken = {c.lower() for c in docs.columns}
    lang, score = (next(n for n in (f"_{k}{i or ''}" for i in range(len(taken) + 1)) if n not in taken) for k in ("lang_pred", "score"))
    found = language_id.predict(docs, language_id.train(labelled), lang, score)
    return written(spark, found.where(F.col(lang) != language_id.UNDETERMINED).withColumn("lang", F.col(lang)).select(*docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies.

    Groups are those of simhash.similar_documents over five-word shingles,
    which links texts that agree to about 0.8 or more.
    """
    return simhash.keep_representatives(spark, docs, SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced in the text and n_chars follows."""
    out = secret_scan.redact_documents(docs)
    return written(spark, out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the decoded text."""
    return written(spark, bpe.digests(docs, bpe.public_spec(spark)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encoding", encoding_stage),
]

#: Hashing and models of these stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    tables = Tables(spark)
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = tables.settle(out) if stage in (near_duplicate_stage, decontamination_stage) else out
    return docs
