"""Inputs of the queries.

The driver's tables hold no office files, Korean text, headings or lists, so
some queries run on paragraphs, tables and files made from relational columns
by one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARAGRAPHS = """
SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS idx,
  CASE CAST(o_orderkey % 17 AS INT)
    WHEN 0 THEN concat('제', CAST(o_orderkey % 9 + 1 AS VARCHAR(9)), '장 총칙')
    WHEN 1 THEN concat('제 ', CAST(o_orderkey % 9 + 1 AS VARCHAR(9)), ' 절 범위')
    WHEN 2 THEN concat(CAST(o_orderkey % 7 + 1 AS VARCHAR(9)), '. 목적 ', o_orderpriority)
    WHEN 3 THEN '가. 대상'
    WHEN 4 THEN concat('Chapter ', CAST(o_custkey AS VARCHAR(9)))
    WHEN 5 THEN 'Ⅰ. 개요'
    WHEN 6 THEN '<ⅱ> 세부 사항'
    WHEN 7 THEN concat('- item ', o_orderpriority)
    WHEN 8 THEN concat('  • 항목 ', CAST(o_orderkey AS VARCHAR(9)))
    WHEN 9 THEN concat(CAST(o_orderkey % 5 AS VARCHAR(9)), ') 항목')
    WHEN 10 THEN '  1. 들여쓰기'
    WHEN 11 THEN 'NOTICE 12'
    WHEN 12 THEN concat('문의 a.b@c.kr 02-123-4567 ₩', CAST(o_custkey AS VARCHAR(9)), ',000 2025-01-15 https://x.y/', o_orderstatus)
    WHEN 13 THEN 'ⅲ 부록'
    WHEN 14 THEN concat('-', o_orderstatus, ' 붙은 항목')
    WHEN 15 THEN '나) 둘째'
    ELSE concat('주문 ', CAST(o_orderkey AS VARCHAR(9)), ' 상태 ', o_orderstatus, ' and plain words follow here. Next sentence! ')
  END AS text
FROM {orders}
"""

#: Documents, each whole, with Korean words and noise before and behind their text.
MIXED = """
SELECT doc_id, lang, source,
  concat('한국어 문서 ', CAST(doc_id AS VARCHAR(12)), chr(9), '입니다. ①→ ', substr('ЀЖĀƀ䀀耀蠀褀贀捀', CAST(doc_id % 10 AS INT) + 1, 1),
         ' ', coalesce(text, ''), ' ', '​', '끝 ', '￹', 'ࡂ', '####!!!! ABCDEFGHIJ') AS text
FROM {documents}
"""

FILES = """
SELECT page_id, concat('file', CAST(page_id AS VARCHAR(12)), CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '.hwp' WHEN 1 THEN '.HWPX' WHEN 2 THEN '.pdf' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.Pdf' END) AS filename,
  CASE CAST(page_id % 7 AS INT) WHEN 3 THEN '' WHEN 5 THEN concat(html, ' EICAR') ELSE html END AS content,
  CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'application/x-hwp' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END AS media
FROM {pages}
"""

TABLES = """
SELECT CAST(n_regionkey AS BIGINT) AS table_id, CAST(n_nationkey AS BIGINT) AS row_id,
  concat('<', n_name, '><', CAST(n_nationkey AS VARCHAR(9)), '> <', CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END, '>') AS line
FROM {nation}
"""

USERS = "SELECT c_custkey AS id, c_name AS username, c_acctbal >= 0 AS is_active FROM {customer}"

KEYS = """
SELECT o_orderkey AS id, concat('key-', CAST(o_orderkey AS VARCHAR(12)), '-', o_orderpriority) AS key, o_custkey AS user_id,
  o_orderstatus <> 'F' AS is_active, o_orderdate AS created_at
FROM {orders}
"""

TASKS = """
SELECT event_id, user_id AS task_id, ts,
  CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
  CASE event_type WHEN 'view' THEN 'json' WHEN 'click' THEN 'text' ELSE 'markdown' END AS kind, value
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The same rows over at least three tasks a core: a scan gives a row group to one task, however much is made of its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def made(spark: SparkSession, sf_dir: str, sql: str, **keys: str) -> DataFrame:
    """The DataFrame of one of the texts above; documents, and a table that keys names, are dealt by the column given."""
    import re

    keys = {"documents": "doc_id"} | keys
    names = set(re.findall(r"\{(\w+)\}", sql))
    tables = {n: dealt(table(spark, sf_dir, n), keys[n]) if n in keys else table(spark, sf_dir, n) for n in names}
    return spark.sql(sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(12)", "STRING"), **tables)


def cte(sql: str) -> str:
    """The same for DuckDB, to stand in parentheses."""
    import re

    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql).strip() + ")"
