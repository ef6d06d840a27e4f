"""Queries of page tables, buffers, cache reads and container files that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyr.functions import charclass as cc
from papyr.functions import text as t
from papyr.operators import chains, logs
from papyr.operators import structure as s
from papyr.plans import files
from papyr.plans.inputs import table
from papyr.sources import hwpx

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, trim(regexp_replace(nfc_normalize(text || chr(101) || chr(769) || ' ' || chr(4370) || chr(4449) || chr(4523)), '[{cc.WS}]+', ' ', 'g'), ' ') AS result FROM documents")
def nfc_clean(spark, sf_dir):
    """Composed form, then white space squeezed; decomposed letters are put behind every text."""
    text = F.concat("text", F.lit("e\u0301 \u1112\u1161\u11ab"))
    return table(spark, sf_dir, "documents").select("doc_id", t.squeeze(t.composed(text)).alias("result"))


@query("SELECT p_partkey, array_to_string([trim(p_name), '', p_size::VARCHAR], '|') AS cells, 3::BIGINT AS col_count, p_brand || '=' || trim(p_name) || ',' || p_type || '=' || p_size AS by_header FROM part")
def page_table_clean(spark, sf_dir):
    """Cells of a page table stripped, null ones empty; values by header, where the header isn't empty."""
    rows = F.array(F.array("p_brand", F.lit(" "), "p_type"), F.array(F.concat(F.lit(" "), "p_name"), F.lit(None).cast("string"), F.col("p_size").cast("string")))
    cells = table(spark, sf_dir, "part").select("p_partkey", s.clean_cells(rows).alias("rows"))
    head, row = F.get("rows", F.lit(0)), F.get("rows", F.lit(1))
    named = F.filter(F.zip_with(head, row, lambda h, v: F.when(h != "", F.concat_ws("=", h, v))), lambda x: x.isNotNull())
    return cells.select("p_partkey", F.array_join(row, "|").alias("cells"), F.size(head).cast("long").alias("col_count"), F.array_join(named, ",").alias("by_header"))


@query("""SELECT conv_id, turn, length(text)::BIGINT AS text_length, len(list_filter(string_split(text || chr(10) || chr(10) || role, chr(10) || chr(10)), lambda x: trim(x) <> ''))::BIGINT AS paragraphs FROM conversations WHERE text IS NOT NULL""")
def page_sections(spark, sf_dir):
    """Text length and paragraphs of each page (a turn, with its role as a last paragraph)."""
    pages = table(spark, sf_dir, "conversations").where("text is not null").select(F.struct("conv_id", "turn").alias("page"), "role", "text")
    parts = s.split_blank(pages.select("page", F.concat_ws("\n\n", "text", "role").alias("text")), "page").groupBy("page").agg(F.count("*").alias("paragraphs"))
    lengths = pages.select("page", F.length("text").cast("long").alias("text_length"))
    return lengths.join(parts, "page").select("page.conv_id", "page.turn", "text_length", "paragraphs")


@query("SELECT n_regionkey, string_agg(CASE WHEN n_nationkey % 2 = 0 THEN '**' || n_name || '**' ELSE n_name END, chr(10) || chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def emphasis_markdown(spark, sf_dir):
    """Paragraphs as Markdown, those with an emphasised run between double stars."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("idx"), s.emphasised(F.col("n_name"), F.col("n_nationkey") % 2 == 0).alias("text")).alias("p"))
    paragraphs = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"])
    return n.groupBy("n_regionkey").agg(F.array_join(paragraphs, "\n\n").alias("markdown"))


@query("SELECT event_id, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 86400, false) AS hit FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events)")
def cache_reads(spark, sf_dir):
    """Whether a read finds its key: a hit extends the entry's life by a day, and a miss stores it."""
    reads = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return logs.refreshed_hits(reads, 86400).select("event_id", "hit")


@query("SELECT user_id AS client, count(*)::BIGINT AS requests FROM events GROUP BY user_id HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def idle_clients(spark, sf_dir):
    """Clients without a request in the last day, whose state can go."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy(F.col("user_id").alias("client")).agg(F.count("*").alias("requests"), F.max("ts").alias("last"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    return last.join(F.broadcast(now), F.expr("last <= now - INTERVAL 1 DAY")).select("client", "requests")


@query("SELECT 'r' || n_regionkey AS path, n_regionkey <> 0 AS ok, CASE WHEN n_regionkey <> 0 THEN count(*) ELSE 0 END::BIGINT AS paragraphs FROM nation GROUP BY n_regionkey")
def failing_files(spark, sf_dir):
    """A batch with a broken file: it gives a row with its error, the others their paragraphs."""
    every = files._files(spark, sf_dir, lambda x: hwpx.write([x]))
    broken = every.withColumn("content", F.when(F.col("path") == "r0", F.lit(b"PK broken")).otherwise(F.col("content")))
    return hwpx.scan(broken).select("path", F.col("error").isNull().alias("ok"), F.coalesce(F.size("paragraphs"), F.lit(0)).cast("long").alias("paragraphs"))


@query("""WITH RECURSIVE e AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, n, 0::BIGINT AS flush, text AS held FROM e WHERE n = 1 UNION ALL
SELECT e.conv_id, e.n, r.flush + (length(r.held) >= 1000)::INT, CASE WHEN length(r.held) >= 1000 THEN e.text ELSE r.held || e.text END FROM r JOIN e ON e.conv_id = r.conv_id AND e.n = r.n + 1)
SELECT conv_id, flush, arg_max(held, n) AS content FROM r GROUP BY conv_id, flush HAVING max(length(held)) > 0""")
def sized_buffer(spark, sf_dir):
    """Turns of conversations buffered to 1000 characters."""
    return chains.buffered_rows(table(spark, sf_dir, "conversations"), 1000, "conv_id", "turn")
