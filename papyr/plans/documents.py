"""Queries of whole documents: structured output, Markdown, plain text, strategies, verdicts and memoised extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from papyr.functions import bulk
from papyr.functions import charclass as cc
from papyr.functions import text as t
from papyr.functions import validate as v
from papyr.operators import documents as d
from papyr.operators import logs
from papyr.operators import structure as s
from papyr.plans.catalog import _EXT, _LIMIT, _MEDIA, _SCAN, _listed
from papyr.plans.inputs import FILES, MIXED, PARAGRAPHS, cte, dealt, made, table
from papyr.plans.structure import _HEAD, _LEVEL
from papyr.plans.text import TAG_SQL, WORD, _stat_sql, n_of, stripped, sub
from papyr.sources import cfb, hwp, hwpx

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Paragraphs of a document, numbered from 0; some hold a table.
PARAS = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INT) AS i,
  CASE WHEN idx % 23 = 5 THEN concat('<항목><값>', chr(10), '<', CAST(idx AS VARCHAR(12)), '><b> <c>') ELSE text END AS text
FROM ({PARAGRAPHS}) p
"""
#: Tables of a document: every fourth order is one of three rows, with a position or none.
CELLS = """
SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS tbl,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 5 AS INT) END AS position, CAST(r AS INT) AS r,
  CASE r WHEN 0 THEN '주문' WHEN 1 THEN CAST(o_orderkey AS VARCHAR(12)) ELSE '' END AS c1, CASE r WHEN 0 THEN '상태' ELSE o_orderstatus END AS c2
FROM {orders}, (VALUES (0), (1), (2)) x(r) WHERE o_orderkey % 4 = 0
"""
META = """
SELECT c_custkey AS doc_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS author,
  CASE WHEN c_custkey % 5 = 0 THEN '1996-01-02' END AS created_date, CAST(c_custkey % 4 AS INT) AS page_count FROM {customer}
"""


def _parts(spark, sf_dir):
    cells = made(spark, sf_dir, CELLS)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("r", "c1", "c2"))), lambda x: F.array(x["c1"], x["c2"]))
    paras = made(spark, sf_dir, PARAS)
    whole = paras.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("text"))
    meta = made(spark, sf_dir, META).join(paras.select("doc_id").distinct(), "doc_id", "left_semi")
    return paras, cells.groupBy("doc_id", "tbl", "position").agg(rows.alias("rows")), meta, whole


_MD = "'| ' || c1 || ' | ' || c2 || ' |' || CASE WHEN r = 0 THEN chr(10) || '|---|---|' ELSE '' END"
_FIELDS = (("title", "title"), ("author", "nullif(author, '')"), ("created_date", "created_date"), ("creator", "'HWP'"), ("language", "'ko'"), ("page_count", "nullif(page_count, 0)::VARCHAR"))
_PARTS = f"""WITH p AS {cte(PARAS)}, c AS {cte(CELLS)}, m AS (SELECT * FROM {cte(META)} WHERE doc_id IN (SELECT doc_id FROM p)),
g AS (SELECT doc_id, tbl, position, string_agg({_MD}, chr(10) ORDER BY r) AS md FROM c GROUP BY ALL),
l AS (SELECT *, tbl = max(tbl) OVER (PARTITION BY doc_id, position) AND position IS NOT NULL AS last FROM g)"""


def _markdown_sql(front: bool) -> str:
    head = f"""UNION ALL SELECT doc_id, 0, 0, 0, '---' || chr(10) || concat_ws(chr(10), {', '.join(f"'{k}: ' || {e}" for k, e in _FIELDS)}) || chr(10) || '---' || chr(10) FROM m""" if front else ""
    return f"""{_PARTS}, x AS (
SELECT doc_id, 1 AS a, i AS b, 0 AS c, CASE WHEN {_HEAD} THEN repeat('#', {_LEVEL}) || ' ' || text ELSE text END AS part FROM p
UNION ALL SELECT doc_id, 1, i, 2, '' FROM p UNION ALL SELECT l.doc_id, 1, position, 1, chr(10) || md FROM l JOIN p ON p.doc_id = l.doc_id AND p.i = position WHERE last
UNION ALL SELECT doc_id, 2, tbl, 0, md || chr(10) FROM l WHERE NOT last {head})
SELECT doc_id, {stripped('string_agg(part, chr(10) ORDER BY a, b, c)')} AS markdown FROM x GROUP BY doc_id"""


@query(_markdown_sql(True))
def markdown_document(spark, sf_dir):
    """Front matter of the set fields, headings, paragraphs and tables at their places."""
    paras, tables, meta, _ = _parts(spark, sf_dir)
    return d.to_markdown(paras, tables, meta)


@query(_markdown_sql(False))
def markdown_without_metadata(spark, sf_dir):
    paras, tables, _, _ = _parts(spark, sf_dir)
    return d.to_markdown(paras, tables, None)


_TEXT = f"""{_PARTS}, w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY i) AS text FROM p GROUP BY doc_id),
x AS (SELECT doc_id, 1 AS a, i AS b, 0 AS c, text FROM p UNION ALL SELECT doc_id, 2, tbl, r, c1 || ' | ' || c2 FROM c UNION ALL SELECT doc_id, 3, 0, 0, text FROM w),
t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY a, b, c) AS text FROM x WHERE text <> '' GROUP BY doc_id)"""


@query(f"{_TEXT} SELECT doc_id, text FROM t")
def plain_text_document(spark, sf_dir):
    """Paragraphs, rows of tables and the whole text."""
    paras, tables, _, whole = _parts(spark, sf_dir)
    return d.plain_text(paras, tables, whole)


_LIST = f"sum(CASE WHEN regexp_matches(text, '{cc.LIST_PREFIX}') AND NOT coalesce(before, false) THEN 1 ELSE 0 END)"


@query(f"""{_TEXT}, k AS (SELECT *, lag(regexp_matches(text, '{cc.LIST_PREFIX}')) OVER (PARTITION BY doc_id ORDER BY i) AS before, regexp_extract_all(text, '<([^<>]*)>', 1) AS cells, len(list_filter(string_split(text, chr(10)), lambda z: (length(z) - length(replace(z, '><', ''))) // 2 >= 2)) > 0 AS inner_table FROM p),
n AS (SELECT doc_id, count(*)::BIGINT AS paragraph_count, {_LIST}::BIGINT AS list_count, count_if({_HEAD})::BIGINT AS heading_count, count_if(inner_table)::BIGINT AS text_tables,
  round(avg({n_of('text', WORD)}), 6) AS avg_paragraph_length, max({n_of('text', WORD)}) AS max_paragraph_length, min({n_of('text', WORD)}) AS min_paragraph_length,
  string_agg(array_to_string({TAG_SQL}, ','), '|' ORDER BY i) AS tags FROM k GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT tbl)::BIGINT AS tables FROM c GROUP BY doc_id)
SELECT t.doc_id, {_stat_sql('t.text')}, paragraph_count, (text_tables + coalesce(tables, 0))::BIGINT AS table_count, list_count, heading_count, avg_paragraph_length, max_paragraph_length, min_paragraph_length, tags,
  title || '/' || author || '/' || coalesce(created_date, '') || '/HWP/ko/' || page_count AS metadata, (6 * coalesce(tables, 0))::BIGINT AS parsed_cells
FROM t JOIN n USING (doc_id) JOIN m USING (doc_id) LEFT JOIN q USING (doc_id)""")
def structured_document(spark, sf_dir):
    """All groups of the structured output; statistics, tags of paragraphs and metadata are shown."""
    out = d.structured(*_parts(spark, sf_dir))
    m = F.col("metadata")
    cells = F.aggregate(F.filter("tables", lambda x: x["a"] == 1), F.lit(0).cast("long"), lambda a, x: a + F.size(x["cells"]))
    return out.select(
        "doc_id", "statistics.*", F.array_join(F.transform("paragraphs", lambda p: F.array_join(p["tags"], ",")), "|").alias("tags"),
        F.concat_ws("/", m["title"], m["author"], m["created_date"], m["creator"], m["language"], m["page_count"].cast("string")).alias("metadata"), cells.alias("parsed_cells"),
    )


@query(f"{_TEXT} SELECT doc_id, {_stat_sql('t.text')}, 0::BIGINT AS paragraph_count, 0::BIGINT AS table_count, 0::BIGINT AS list_count, 0::BIGINT AS heading_count FROM t")
def structured_text_only(spark, sf_dir):
    """Without metadata and structure the counts are 0 and paragraphs have no statistics."""
    return d.structured(*_parts(spark, sf_dir), include_metadata=False, include_structure=False).select("doc_id", "statistics.*")


@query(f"""{_PARTS}, x AS (SELECT doc_id, i, string_split(text, chr(10)) AS z FROM p WHERE len(list_filter(string_split(text, chr(10)), lambda z: (length(z) - length(replace(z, '><', ''))) // 2 >= 2)) > 0)
SELECT doc_id, 0 AS source, i::BIGINT AS b, 0::BIGINT AS "table", len(list_filter(z, lambda y: contains(y, '<') AND contains(y, '>')))::BIGINT AS row_count, 3::BIGINT AS col_count, '0:' || array_to_string(list_transform(regexp_extract_all(z[2], '<([^<>]*)>', 1), lambda y: trim(y)), ',') AS cells FROM x
UNION ALL SELECT doc_id, 1, tbl, tbl, 3, 2, string_agg(r || ':' || c1 || ',' || c2, ';' ORDER BY r) FROM c GROUP BY doc_id, tbl""")
def structured_tables(spark, sf_dir):
    """Tables in paragraphs and parsed ones with their own index; the header of the first kind counts as a row but has no cells."""
    paras, tables, _, _ = _parts(spark, sf_dir)
    row = lambda i: F.array_join(F.transform(F.filter("cells", lambda c: c["row"] == i), lambda c: c["text"]), ",")
    top = F.array_max(F.transform("cells", lambda c: c["row"]))
    lines = F.transform(F.sequence(F.lit(0), top), lambda i: F.concat_ws(":", i.cast("string"), row(i)))
    return d.structured_tables(paras, tables).select(
        "doc_id", F.col("a").alias("source"), "b", "table", F.col("row_count").cast("long").alias("row_count"), F.col("col_count").cast("long").alias("col_count"), F.array_join(lines, ";").alias("cells")
    )


#: A stored preview beside a body text; some bodies are noise, short or hardly Korean.
BODIES = f"""
SELECT doc_id, idx, repeat(concat(CASE WHEN idx % 5 = 0 THEN 'ab 12. ' WHEN idx % 5 = 1 THEN '㐀㐁 ' ELSE '' END, text, ' '), CAST(idx % 40 AS INT)) AS body,
  repeat(concat('한국어 ', text, ' '), CAST(idx % 7 AS INT) * 5) AS preview FROM ({PARAGRAPHS}) p
"""


@query()
def strategy_accepted(spark, sf_dir):
    """The text accepted by length and share of Korean, of body and preview, both cleaned."""
    out = s.accepted(made(spark, sf_dir, BODIES, orders="o_orderkey"), "body", "preview")
    return out.select("doc_id", "idx", "method", F.length("text").cast("long").alias("n"), F.round("korean_ratio", 6).alias("korean_ratio"))


_LOOSE = lambda c: t.squeeze(t.strip_noise(c))


def _loose_sql(c: str) -> str:
    return stripped(sub(sub(c, f"[{cc.NOISE}]"), f"[{cc.WS}]+", " "))


@query(f"""WITH x AS (SELECT doc_id, idx, body, preview, {_loose_sql('body')} AS a, {_loose_sql('preview')} AS b FROM {cte(BODIES)}),
y AS (SELECT *, coalesce({n_of('a', f'[{cc.KOREAN}]')} / nullif({n_of('a', f'[^{cc.WS}]')}, 0), 0) AS ra, coalesce({n_of('b', f'[{cc.KOREAN}]')} / nullif({n_of('b', f'[^{cc.WS}]')}, 0), 0) AS rb FROM x),
z AS (SELECT *, CASE WHEN length(body) > 500 AND ra < 0.1 AND length(preview) > 100 AND length(b) > 50 AND rb > ra THEN 'preview' WHEN length(body) > 500 AND length(a) >= 100 THEN 'body' WHEN length(preview) > 500 AND length(b) >= 100 THEN 'preview' END AS method FROM y)
SELECT doc_id, idx, method, CASE method WHEN 'body' THEN length(a) WHEN 'preview' THEN length(b) END::BIGINT AS n, round(CASE method WHEN 'body' THEN ra WHEN 'preview' THEN rb END, 6) AS korean_ratio FROM z""")
def strategy_accepted_loosely(spark, sf_dir):
    """The same rule with a cleaner that SQL can express."""
    out = s.accepted(made(spark, sf_dir, BODIES, orders="o_orderkey"), "body", "preview", lambda c: s.rated(_LOOSE(c)))
    return out.select("doc_id", "idx", "method", F.length("text").cast("long").alias("n"), F.round("korean_ratio", 6).alias("korean_ratio"))


@query()
def section_clean(spark, sf_dir):
    """Texts as the live path cleans them: each section, then the sections joined."""
    rows = dealt(made(spark, sf_dir, BODIES, orders="o_orderkey").select("doc_id", "idx", bulk.clean(F.col("body")).alias("part")), "doc_id")
    # empty parts are left out while they are collected: a filter would be moved before the projection and clean every text again
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("idx", "part")))).alias("parts")).where(F.size("parts") > 0)
    joined = parts.select("doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("text"))
    return joined.select("doc_id", bulk.clean(F.col("text")).alias("result"))


#: First bytes of a file and, of a zip, the names in it.
HEADED = f"""
SELECT *, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'D0CF11E0A1B11AE1' WHEN 1 THEN '504B0304' WHEN 2 THEN '255044462D' ELSE '3C21' END AS head,
  CASE WHEN page_id % 8 < 4 THEN 'version.xml' ELSE 'other.xml' END AS member FROM ({FILES}) f
"""
_SHAPE = f"CASE {_EXT} WHEN '.hwp' THEN head LIKE 'D0CF11E0A1B11AE1%' WHEN '.hwpx' THEN head LIKE '504B0304%' AND member IN ('version.xml', 'Contents/content.hpf') WHEN '.pdf' THEN head LIKE '255044462D%' ELSE true END"
_FIRST = f"CASE WHEN {_EXT} NOT IN {v.EXTENSIONS} THEN 'extension' WHEN strlen(content) > {_LIMIT} THEN 'size' WHEN strlen(content) = 0 THEN 'empty' WHEN NOT ({_MEDIA}) THEN 'media' WHEN NOT {_SHAPE} THEN 'structure' WHEN {_SCAN} = 'infected' THEN 'virus' END"


@query(f"""SELECT page_id, error, error IS NULL AS valid, CASE WHEN error IS NULL OR error = 'virus' THEN concat_ws(',', CASE WHEN threats <> '' THEN 'threat' END, CASE WHEN scan = 'suspicious' THEN 'suspicious' END) ELSE '' END AS warnings,
CASE WHEN error IS NULL THEN sha256(content) END AS hash, CASE WHEN error IS NULL THEN strlen(content)::BIGINT END AS size
FROM (SELECT *, {_FIRST} AS error, {_listed(v.DANGEROUS, 'content')} AS threats, {_SCAN} AS scan FROM {cte(HEADED)})""")
def validation_full(spark, sf_dir):
    """The first failing check in order, warnings of the scans that do not fail a file, and the accepted file's hash and size."""
    members = F.array("member")
    x = v.full_verdict(F.col("filename"), F.col("content"), F.col("media"), F.col("head"), members)
    out = made(spark, sf_dir, HEADED).select("page_id", x.alias("x"))
    return out.select("page_id", "x.error", "x.valid", F.array_join("x.warnings", ",").alias("warnings"), "x.hash", "x.size")


@query(f"SELECT page_id, scan AS status, CASE WHEN scan = 'infected' THEN 'hash:' || sha256(content) || ':high' WHEN scan <> 'clean' THEN array_to_string(list_transform(string_split(found, ','), lambda p: 'pattern:' || p || ':medium'), ',') ELSE '' END AS threats FROM (SELECT page_id, content, {_SCAN} AS scan, {_listed(v.SUSPICIOUS, f'substr(content, 1, {v.SCANNED})')} AS found FROM {cte(FILES)})")
def scan_report(spark, sf_dir):
    """Status of a scan and its threats with type, name and severity; content that is missing is an error."""
    x = made(spark, sf_dir, FILES).select("page_id", v.scan_report(F.col("content")).alias("x"))
    return x.select("page_id", "x.status", F.array_join(F.transform("x.threats", lambda y: F.concat_ws(":", y["type"], y["name"], y["severity"])), ",").alias("threats"))


@query("""WITH k AS (SELECT doc_id, text, 'hwp_extract:text_preserve_formatting:false:' || sha256(text) AS key FROM documents),
c AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0)
SELECT doc_id, key, c.key IS NOT NULL AS hit, md5(CASE WHEN c.key IS NOT NULL THEN 'cached ' || k.key ELSE """ + stripped(sub("text", f"[{cc.WS}]+", " ")) + """ END) AS digest FROM k LEFT JOIN c USING (key)""")
def memoised_extract(spark, sf_dir):
    """Results from the cache, where it has the key, and computed ones of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.withColumn("key", logs.composite_key("text", {"preserve_formatting": "false"}, F.col("text")))
    cache = keyed.where("doc_id % 2 = 0").select("key", F.concat(F.lit("cached "), "key").alias("result")).distinct()
    out = logs.read_through(keyed, cache, lambda x: x.withColumn("result", t.squeeze(F.col("text"))))
    return out.select("doc_id", "key", "hit", F.md5("result").alias("digest"))


@query(f"SELECT doc_id, {sub(sub('text', r'[\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', ' '), f'[^{cc.SERVED}{cc.ALLOWED_SPACES}]')} AS result FROM {cte(MIXED)}")
def smart_filter(spark, sf_dir):
    return made(spark, sf_dir, MIXED).select("doc_id", t.smart_filter(F.col("text")).alias("result"))


@query(f"SELECT doc_id, round(coalesce({n_of('text', f'[{cc.KOREAN}{cc.LETTERS}]')} / nullif({n_of('text', f'[^{cc.WS}]')}, 0), 0), 6) AS ratio FROM (SELECT doc_id, concat(text, chr(4370), chr(4449)) AS text FROM {cte(MIXED)})")
def korean_ratio_wide(spark, sf_dir):
    """The share with single letters counted; two are put behind every text."""
    text = F.concat("text", F.lit("하"))
    return made(spark, sf_dir, MIXED).select("doc_id", F.round(t.korean_ratio(text, wide=True), 6).alias("ratio"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN md5(text) WHEN 1 THEN md5('■ no ' || lang) ELSE md5(' □■ ') END AS digest FROM documents")
def method_pick(spark, sf_dir):
    """Of several extractions of a page the first that is more than placeholder squares, else the last."""
    first = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("■■")
    second = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("■ no "), "lang")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.first_usable(first, second, F.lit(" □■ "))).alias("digest"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value / 20), 3) AS seconds, count(*)::BIGINT AS infinite FROM events GROUP BY event_type")
def histogram_totals(spark, sf_dir):
    """Sum and count of a histogram, and its last bucket, which holds everything."""
    h = logs.histogram(table(spark, sf_dir, "events").withColumn("s", F.col("value") / 20), "s", "event_type", bounds=(0.5, float("inf")))
    return h.where(F.col("le") == float("inf")).select("event_type", F.col("total").alias("n"), F.round("sum", 3).alias("seconds"), F.col("cumulative").alias("infinite"))


_DAY = "BETWEEN TIMESTAMP '1996-01-02 00:00:00' AND TIMESTAMP '1996-01-02 23:59:59.999999'"


@query(f"SELECT 'orders' AS name, count_if(o_orderdate {_DAY})::BIGINT AS deleted, count_if(NOT o_orderdate {_DAY} OR o_orderdate IS NULL)::BIGINT AS kept FROM orders UNION ALL SELECT 'lineitem', count_if(l_shipdate {_DAY})::BIGINT, count_if(NOT l_shipdate {_DAY} OR l_shipdate IS NULL)::BIGINT FROM lineitem")
def cleanup_delete(spark, sf_dir):
    """Rows of a day that go, counted before, and the tables that are left."""
    out = []
    for name, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        gone = F.coalesce(F.expr(f"{column} {_DAY}".replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), F.lit(False))
        rows = table(spark, sf_dir, name)
        left = rows.where(~gone).agg(F.count("*").alias("kept"))
        count = rows.where(gone).agg(F.count("*").alias("deleted"))
        out.append(count.join(left, F.lit(True)).select(F.lit(name).alias("name"), "deleted", "kept"))
    return out[0].union(out[1])


_GATED = "SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events"


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ({_GATED})),
r AS (SELECT user_id, event_id, n, [t] AS running, 0::BIGINT AS active FROM e WHERE n = 1 UNION ALL
SELECT user_id, event_id, n, CASE WHEN len(left_over) < 2 THEN list_append(left_over, t) ELSE left_over END, len(left_over) FROM (
  SELECT e.user_id, e.event_id, e.n, e.t, list_filter(r.running, lambda x: x > e.t - 86400) AS left_over FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, active, active >= 2 AS rejected FROM r""")
def gate_decision(spark, sf_dir):
    """Whether a request comes while two others of its client that were let in, each taking a day, are under way."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return logs.gated(e.withColumnRenamed("user_id", "client"), 2, 86400).select("event_id", "active", "rejected")


@query("SELECT c_custkey AS id, count(o_orderkey)::BIGINT AS n_jobs, coalesce(max(o_orderkey), 0)::BIGINT AS last_job FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def user_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return users.join(jobs, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_jobs"), F.coalesce("last", F.lit(0)).cast("long").alias("last_job"))


_KEY = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus <> 'F' AS active, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 365 DAY END AS expires FROM orders"


@query(f"SELECT k.id, k.active AND c_acctbal >= 0 AND (expires IS NULL OR expires >= TIMESTAMP '1997-01-01') AS valid, CASE WHEN k.active AND c_acctbal >= 0 AND (expires IS NULL OR expires >= TIMESTAMP '1997-01-01') THEN '1997-01-01' END AS last_used FROM ({_KEY}) k JOIN customer ON c_custkey = user_id")
def key_validity(spark, sf_dir):
    """Keys without an expiry never run out; a valid key's last use is set."""
    k = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS c_custkey", "o_orderstatus <> 'F' AS active", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + make_dt_interval(365) END AS expires"
    )
    valid = F.col("active") & (F.col("c_acctbal") >= 0) & (F.col("expires").isNull() | (F.col("expires") >= F.expr("TIMESTAMP_NTZ '1997-01-01'")))
    return k.join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey").select("id", valid.alias("valid"), F.when(valid, "1997-01-01").alias("last_used"))


@query("SELECT doc_id, i AS chunk, least(1000, strlen(text) - 1000 * i)::BIGINT AS bytes, round(least(1000 * (i + 1), strlen(text)) / strlen(text) * 100, 4) AS progress FROM documents, unnest(generate_series(0, (strlen(text) - 1) // 1000)) AS g(i) WHERE strlen(text) > 0")
def byte_chunks(spark, sf_dir):
    """Pieces of 1000 bytes, which may cut a character."""
    return s.byte_chunks(table(spark, sf_dir, "documents"), 1000).select("doc_id", "chunk", F.octet_length("content").cast("long").alias("bytes"), "progress")


def _book(spark, sf_dir):
    """(path, content): a file for each region, a section for each of its nations, with an emphasised paragraph, a plain one and a table."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))

    def run(frames):
        for f in frames:
            built = [hwpx.write([[(r["n_name"], True), f"no {r['n_nationkey']}", [["name", "key"], [r["n_name"], str(r["n_nationkey"])]]] for r in x]) for x in f["x"]]
            yield pd.DataFrame({"path": [f"r{k}" for k in f["n_regionkey"]], "content": built})

    return rows.mapInPandas(run, "path string, content binary")


@query("SELECT 'r' || n_regionkey AS path, 'Contents/section' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || '.xml' AS section_id, 2::BIGINT AS paragraphs, 1::BIGINT AS tables, (length(n_name) + length('no ' || n_nationkey))::BIGINT AS chars FROM nation")
def hwpx_sections(spark, sf_dir):
    x = hwpx.scan(_book(spark, sf_dir)).select("path", F.explode("sections").alias("s"))
    return x.select("path", "s.section_id", F.col("s.paragraph_count").cast("long").alias("paragraphs"), F.col("s.table_count").cast("long").alias("tables"), F.col("s.text_length").cast("long").alias("chars"))


@query("""SELECT 'r' || n_regionkey AS path, string_agg('**' || n_name || '**' || chr(10) || chr(10) || 'no ' || n_nationkey, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) || chr(10)
|| string_agg('| name' || repeat(' ', greatest(length(n_name), 4)::INT - 4) || ' | key |' || chr(10) || '| ' || repeat('-', greatest(length(n_name), 4)::INT) || ' | --- |' || chr(10) || '| ' || rpad(n_name, greatest(length(n_name), 4)::INT, ' ') || ' | ' || rpad(n_nationkey::VARCHAR, 3, ' ') || ' |', chr(10) || chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""")
def hwpx_markdown(spark, sf_dir):
    """Paragraphs, emphasised ones between double stars, and then the tables with padded cells."""
    x = hwpx.scan(_book(spark, sf_dir))
    paras = F.transform("paragraphs", lambda p: s.emphasised(p["text"], p["emphasis"]))
    tables = F.transform("tables", lambda y: s.padded_table(F.transform(y["rows"], lambda r: F.transform(r, lambda c: c["text"]))))
    return x.select("path", F.array_join(F.concat(paras, tables), "\n\n").alias("markdown"))


@query("SELECT 'r' || n_regionkey || e AS path, CASE e WHEN '.hwpx' THEN 'hwpx' WHEN '.pdf' THEN 'pdf' ELSE 'hwp' END AS parser, string_agg(n_name, chr(10) ORDER BY n_name) AS text FROM nation, (VALUES ('.hwpx'), ('.hwp'), ('.HWP')) x(e) WHERE e <> '.HWP' OR n_regionkey = 0 GROUP BY n_regionkey, e")
def scan_dispatch(spark, sf_dir):
    """Files of several formats in one scan: each branch reads its own, and the branches are united."""
    from papyr.plans import files
    from papyr.sources import scan

    one = files._files(spark, sf_dir, lambda x: hwpx.write([x])).withColumn("path", F.concat("path", F.lit(".hwpx")))
    two = files._files(spark, sf_dir, files._hwp)
    three = two.where("path = 'r0'").withColumn("path", F.lit("r0.HWP"))
    return scan.scan(one.union(two.withColumn("path", F.concat("path", F.lit(".hwp")))).union(three)).select("path", "parser", "text")




def _named(spark, sf_dir, build):
    """(path, content): a compound file for each region, built from its nations' names in order."""
    from papyr.plans import files

    return files._files(spark, sf_dir, build)


def _tagged(names: list[str]) -> bytes:
    """Records of three tags: a paragraph for each name, a memo for every second one, and one that holds no text."""
    body = b"".join(
        hwp.record(hwp.PARA_TEXT, n.encode("utf-16-le"), level=i % 3) + (hwp.record(0x5C, f"memo {n}".encode("utf-16-le")) if i % 2 else b"") + hwp.record(0x10, b"\1\0")
        for i, n in enumerate(names)
    )
    return cfb.build({"FileHeader": b"\0" * 40, "BodyText/Section0": body})


@query("""WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i FROM nation)
SELECT 'r' || n_regionkey AS path, 'HWPTAG_PARA_TEXT' AS tag_type, count(*)::BIGINT AS n, sum(length(n_name))::BIGINT AS chars, max(i % 3)::BIGINT AS top_level FROM n GROUP BY n_regionkey
UNION ALL SELECT 'r' || n_regionkey, 'HWPTAG_MEMO_LIST', count(*)::BIGINT, sum(length(n_name) + 5)::BIGINT, 0 FROM n WHERE i % 2 = 1 GROUP BY n_regionkey""")
def hwp_tags(spark, sf_dir):
    """Texts of all tags that hold text, counted by tag, with the deepest level of their records."""
    rows = hwp.scan(_named(spark, sf_dir, _tagged), tags=tuple(hwp.TEXT_TAGS))
    out = rows.groupBy("path", "tag_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("level").alias("top_level"))
    return out.withColumn("top_level", F.col("top_level").cast("long"))


@query("SELECT 'r' || n_regionkey AS path, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1)::BIGINT AS i, rtrim(repeat(n_name || ' ', 20)) AS text FROM nation")
def preview_scan(spark, sf_dir):
    """Paragraphs of the preview that compound files store."""
    build = lambda names: cfb.build({"FileHeader": b"\0" * 40, "PrvText": "\n\n \n\n".join((n + " ") * 20 for n in names).encode("utf-16-le")})
    return hwp.scan_previews(_named(spark, sf_dir, build)).select("path", F.col("i").cast("long").alias("i"), "text")


@query("SELECT c_custkey AS id, c_name AS title, 'u' || c_nationkey AS author, CASE WHEN c_custkey % 2 = 0 THEN '20250101' END AS date FROM customer")
def docinfo_fields(spark, sf_dir):
    """Title, author and date guessed from the text fields that a file stores."""
    fields = F.array(F.lit(""), F.col("c_name"), F.concat(F.lit("u"), "c_nationkey", F.lit("@x.y")), F.when(F.col("c_custkey") % 2 == 0, "20250101").otherwise("2025010"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *(c.alias(k) for k, c in hwp.docinfo(fields).items()))


@query(f"SELECT page_id, {_EXT} IN ('.hwp', '.hwpx') AS word, {_EXT} = '.pdf' AS page, CASE WHEN {_EXT} IN ('.hwp', '.hwpx') THEN 200 ELSE 415 END::BIGINT AS word_status, CASE WHEN {_EXT} = '.pdf' THEN 200 ELSE 415 END::BIGINT AS page_status FROM {cte(FILES)}")
def family_dispatch(spark, sf_dir):
    """Endpoints that take one family of suffixes refuse the others."""
    ext = v.extension(F.col("filename"))
    word, page = ext.isin(".hwp", ".hwpx"), ext == ".pdf"
    status = lambda ok: F.when(ok, 200).otherwise(415).cast("long")
    return made(spark, sf_dir, FILES).select("page_id", word.alias("word"), page.alias("page"), status(word).alias("word_status"), status(page).alias("page_status"))


_NOISY = f"[{cc.CONTROLS}{cc.SPECIALS}{cc.ZERO_WIDTH}ࡂृ]"
_READ = r"[\x{AC00}-\x{D7A3}A-Za-z\p{Nd} \n]"


@query(f"""WITH x AS (SELECT doc_id, text AS a, {sub('text', f'[{cc.NOISE}]')} AS b FROM {cte(MIXED)}),
q AS (SELECT doc_id, length(b) - length(a) AS length_diff, {n_of('b', _READ)} / length(b) * 100 - {n_of('a', _READ)} / length(a) * 100 AS qd, {n_of('b', _NOISY)} / length(b) * 100 - {n_of('a', _NOISY)} / length(a) * 100 AS nd FROM x)
SELECT doc_id, length_diff::BIGINT AS length_diff, round(qd, 6) AS quality_diff, round(nd, 6) AS noise_diff, CASE WHEN qd > 10 THEN 'significant' WHEN qd > 0 THEN 'improved' WHEN qd = 0 THEN 'same' ELSE 'decreased' END AS verdict FROM q""")
def parser_comparison(spark, sf_dir):
    """Two readings of a text by length, share of readable and of noisy characters, and a verdict."""
    a = F.col("text")
    rows = made(spark, sf_dir, MIXED).select("doc_id", a.alias("a"), t.strip_noise(a).alias("b"))
    share = lambda c, p: t._chars(F.col(c), p) / F.length(c) * 100
    q, n = share("b", _READ) - share("a", _READ), share("b", _NOISY) - share("a", _NOISY)
    verdict = F.when(q > 10, "significant").when(q > 0, "improved").when(q == 0, "same").otherwise("decreased")
    return rows.select("doc_id", (F.length("b") - F.length("a")).cast("long").alias("length_diff"), F.round(q, 6).alias("quality_diff"), F.round(n, 6).alias("noise_diff"), verdict.alias("verdict"))


@query(f"""SELECT doc_id, {n_of('text', _NOISY)} AS total_noise, round({n_of('text', _NOISY)} / length(text) * 100, 6) AS noise_ratio, round({n_of('text', f'[{cc.HANGUL}]')} / length(text) * 100, 6) AS korean_ratio,
array_to_string((regexp_extract_all(text, '[{cc.HANGUL}]+'))[1:10], ' ') AS sample FROM {cte(MIXED)}""")
def noise_analysis(spark, sf_dir):
    """Noise of all kinds, its share, that of Korean, and the first Korean words."""
    c = F.col("text")
    noise, n = t._chars(c, _NOISY), F.length(c)
    found = F.regexp_extract_all(c, F.lit(f"[{cc.HANGUL}]+"), F.lit(0))
    return made(spark, sf_dir, MIXED).select(
        "doc_id", noise.alias("total_noise"), F.round(noise / n * 100, 6).alias("noise_ratio"), F.round(t._chars(c, f"[{cc.HANGUL}]") / n * 100, 6).alias("korean_ratio"),
        F.array_join(F.slice(found, 1, 10), " ").alias("sample"),
    )


@query(f"SELECT page_id, CASE WHEN {_EXT} NOT IN {v.EXTENSIONS} THEN 400 ELSE 413 END::BIGINT AS status, CASE WHEN {_EXT} NOT IN {v.EXTENSIONS} THEN 'suffix ' || {_EXT} || ' not allowed' ELSE strlen(content) || ' bytes of 1000' END AS message, filename AS path, {_EXT} || '/' || strlen(content) AS details FROM {cte(FILES)} WHERE {_EXT} NOT IN {v.EXTENSIONS} OR strlen(content) > 1000")
def error_details(spark, sf_dir):
    """Errors with message, details and path; the first failing check counts."""
    ext, n = v.extension(F.col("filename")), F.octet_length("content")
    bad = ~ext.isin(*v.EXTENSIONS)
    kind = F.when(bad, "validation").when(n > 1000, "size")
    message = F.when(bad, F.concat(F.lit("suffix "), ext, F.lit(" not allowed"))).otherwise(F.concat(n.cast("string"), F.lit(" bytes of 1000")))
    details = F.concat_ws("/", ext, n.cast("string"))
    out = made(spark, sf_dir, FILES).select("page_id", v.error_envelope(kind, message, F.col("filename"), details).alias("e")).where("e is not null")
    return out.select("page_id", F.col("e.status").cast("long").alias("status"), "e.message", "e.path", "e.details")


@query("SELECT 'r' || n_regionkey AS path, string_agg(n_name, chr(10) ORDER BY n_name) AS text, length(string_agg(n_name, chr(10) ORDER BY n_name)) > 40 AS accepted FROM nation GROUP BY n_regionkey")
def conversion_scan(spark, sf_dir):
    """Compound files repackaged as zip containers and read again; accepted where enough text comes out."""
    from papyr.plans import files
    from papyr.sources import scan

    return scan.converted(files._files(spark, sf_dir, files._hwp), least=40)


@query("SELECT 'r' || n_regionkey AS path, 'Contents/section' || (n_nationkey % 2) || '.xml' AS section_id, sum(length(n_name))::BIGINT AS chars, count(*)::BIGINT AS paragraphs FROM nation WHERE n_regionkey > 0 GROUP BY n_regionkey, n_nationkey % 2")
def hwpx_package(spark, sf_dir):
    """Files written from rows of paragraphs, two sections each, and read again."""
    from papyr.sources import scan

    rows = table(spark, sf_dir, "nation").where("n_regionkey > 0").select(
        F.concat(F.lit("r"), "n_regionkey").alias("path"), (F.col("n_nationkey") % 2).alias("section"), F.col("n_nationkey").alias("idx"), F.col("n_name").alias("text")
    )
    x = hwpx.scan(scan.package(rows)).select("path", F.explode("sections").alias("s"))
    return x.select("path", "s.section_id", F.col("s.text_length").cast("long").alias("chars"), F.col("s.paragraph_count").cast("long").alias("paragraphs"))


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'given' WHEN parts = '' THEN NULL ELSE parts END AS text FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS parts FROM conversations GROUP BY conv_id)")
def parser_text(spark, sf_dir):
    """A parser's text if it gives any, else its paragraphs and cells."""
    own = table(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct().join(own, "conv_id", "left")
    given = F.when(F.col("conv_id") % 3 == 0, "given").otherwise("")
    return every.select("conv_id", F.coalesce(F.nullif(given, F.lit("")), F.array_join(F.transform("x", lambda y: y["text"]), "\n\n")).alias("text"))


@query("SELECT doc_id, 'hwp_extract:' || CASE doc_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'text' ELSE 'markdown' END AS kind FROM documents WHERE doc_id % 3 <> 1")
def cache_glob(spark, sf_dir):
    """What a glob leaves of a cache; an asterisk alone would leave nothing."""
    kind = F.concat(F.lit("hwp_extract:"), F.when(F.col("doc_id") % 3 == 0, "json").when(F.col("doc_id") % 3 == 1, "text").otherwise("markdown"))
    keys = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))
    return keys.where(~logs.matches(F.col("kind"), "*:te?t*"))


@query("SELECT 'r' || n_regionkey AS path, min(n_name) AS title, '한글 ' || count(*) AS author, '2025-01-0' || (n_regionkey + 1) || 'T10:20:30' AS created_date, NULL::VARCHAR AS modified_date FROM nation GROUP BY n_regionkey")
def hwp_summary(spark, sf_dir):
    """Title, author and dates of the summary that compound files store."""
    import datetime

    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("title"), F.count("*").alias("n"))

    def run(frames):
        for f in frames:
            built = [
                cfb.build({"FileHeader": b"\0" * 40, hwp.SUMMARY: hwp.summary_stream({2: title, 4: f"한글 {n}", 12: datetime.datetime(2025, 1, k + 1, 10, 20, 30)})})
                for k, title, n in zip(f["n_regionkey"], f["title"], f["n"], strict=True)
            ]
            yield pd.DataFrame({"path": [f"r{k}" for k in f["n_regionkey"]], "content": built})

    return hwp.scan_summaries(rows.mapInPandas(run, "path string, content binary")).select("path", "title", "author", "created_date", "modified_date")
