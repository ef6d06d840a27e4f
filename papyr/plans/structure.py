"""Queries of paragraph, table and output operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyr.functions import charclass as cc
from papyr.functions import text as t
from papyr.operators import chains
from papyr.operators import structure as s
from papyr.plans.inputs import MIXED, PARAGRAPHS, TABLES, cte, made, table
from papyr.plans.text import n_of, q, stripped, sub

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HEAD = f"regexp_matches({stripped('text')}, {q('|'.join(cc.HEADINGS))})"
_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN {n}" for p, n in cc.LEVELS) + f" ELSE {cc.DEFAULT_LEVEL} END"
_KIND = f"CASE WHEN regexp_matches(text, {q(rf'^제[{cc.WS}]*\p{{Nd}}+[{cc.WS}]*[장절조항]')}) THEN 'legal' WHEN regexp_matches(text, '(?i)^(chapter|section)') THEN 'academic' ELSE 'general' END"


@query(f"SELECT doc_id, idx, ({_LEVEL})::BIGINT AS level, {_KIND} AS kind FROM {cte(PARAGRAPHS)} WHERE {_HEAD}")
def heading_detect(spark, sf_dir):
    return s.headings(made(spark, sf_dir, PARAGRAPHS)).select("doc_id", "idx", F.col("level").cast("long").alias("level"), "kind")


@query(f"""SELECT doc_id, idx, CASE WHEN {_HEAD} THEN 'heading' WHEN regexp_matches(text, {q(cc.BULLET_ITEM)}) THEN 'list_item'
WHEN regexp_matches(text, {q(cc.NUMBER_ITEM)}) THEN 'numbered_list' WHEN length(text) < 50 AND upper(text) = text AND lower(text) <> text THEN 'title' ELSE 'normal' END AS type FROM {cte(PARAGRAPHS)}""")
def paragraph_type(spark, sf_dir):
    return made(spark, sf_dir, PARAGRAPHS).select("doc_id", "idx", t.paragraph_type(F.col("text")).alias("type"))


@query(f"""WITH RECURSIVE h AS (SELECT doc_id, idx, ({_LEVEL}) AS level FROM {cte(PARAGRAPHS)} WHERE {_HEAD}),
p AS (SELECT a.doc_id, a.idx, max(b.idx) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.idx < a.idx AND b.level < a.level GROUP BY a.doc_id, a.idx),
r AS (SELECT doc_id, idx, parent, parent AS up, 0 AS depth FROM p UNION ALL SELECT r.doc_id, r.idx, r.parent, p.parent, r.depth + 1 FROM r JOIN p ON p.doc_id = r.doc_id AND p.idx = r.up)
SELECT doc_id, idx, max(parent)::BIGINT AS parent, max(depth)::BIGINT AS depth FROM r GROUP BY doc_id, idx""")
def heading_parent(spark, sf_dir):
    out = s.with_parents(s.headings(made(spark, sf_dir, PARAGRAPHS)))
    return out.select("doc_id", "idx", "parent", F.col("depth").cast("long").alias("depth"))


_DEEP = f"""h AS (SELECT doc_id, idx, text, ({_LEVEL}) AS level FROM {cte(PARAGRAPHS)} WHERE {_HEAD}),
p AS (SELECT a.doc_id, a.idx, max(b.idx) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.idx < a.idx AND b.level < a.level GROUP BY a.doc_id, a.idx)"""


@query(f"""WITH {_DEEP},
n AS (SELECT h.*, parent, left(to_json({{'text': text, 'level': level, 'index': h.idx}})::VARCHAR, -1) || ',"children":[' AS open FROM h JOIN p USING (doc_id, idx)),
""" + ", ".join(f"""n{d} AS (SELECT a.doc_id, a.idx, a.parent, any_value(a.open) || coalesce(string_agg(b.json, ',' ORDER BY b.idx), '') || ']}}' AS json
FROM n a LEFT JOIN {f'n{d + 1}' if d < 6 else '(SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS idx, NULL::BIGINT AS parent, NULL::VARCHAR AS json)'} b ON b.doc_id = a.doc_id AND b.parent = a.idx GROUP BY a.doc_id, a.idx, a.parent)""" for d in range(6, 0, -1)) + """
SELECT doc_id, '[' || string_agg(json, ',' ORDER BY idx) || ']' AS tree FROM n1 WHERE parent IS NULL GROUP BY doc_id""")
def heading_tree(spark, sf_dir):
    """The headings of each document as nested JSON."""
    return s.heading_trees(s.headings(made(spark, sf_dir, PARAGRAPHS)))


_WORDS = f"len(regexp_extract_all(text, '[^{cc.WS}]+'))"


@query(f"""WITH q AS (SELECT doc_id, idx, CASE WHEN {_HEAD} THEN ({_LEVEL}) END AS level, {_WORDS} AS words FROM {cte(PARAGRAPHS)}),
e AS (SELECT a.doc_id, a.idx, any_value(a.level) AS level, min(b.idx) AS ends FROM q a LEFT JOIN q b ON b.doc_id = a.doc_id AND b.idx > a.idx AND b.level <= a.level WHERE a.level IS NOT NULL GROUP BY a.doc_id, a.idx)
SELECT e.doc_id, e.idx, any_value(e.level)::BIGINT AS level, any_value(ends) AS ends, sum(words)::BIGINT AS words
FROM e JOIN q ON q.doc_id = e.doc_id AND q.idx >= e.idx AND (ends IS NULL OR q.idx < ends) GROUP BY e.doc_id, e.idx""")
def subtree_words(spark, sf_dir):
    """Words of each heading's part of the document, up to the next heading of its level or above."""
    out = s.subtrees(made(spark, sf_dir, PARAGRAPHS), F.regexp_count("text", F.lit(f"[^{cc.WS}]+")))
    return out.select("doc_id", "idx", F.col("level").cast("long").alias("level"), F.col("end").alias("ends"), F.col("total").alias("words"))


_TYPE = f"CASE WHEN regexp_matches(text, {q(cc.NUMBER_ITEM)}) THEN 'ordered' WHEN regexp_matches(text, {q(cc.KOREAN_ITEM)}) THEN 'korean_ordered' ELSE 'unordered' END"


@query(f"""WITH m AS (SELECT *, regexp_matches(text, {q(cc.LIST_PREFIX)}) AS item FROM {cte(PARAGRAPHS)}),
i AS (SELECT *, sum(CASE WHEN item THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM m)
SELECT doc_id, min(idx) AS start_index, max(idx) AS end_index, count(*)::BIGINT AS n_items, arg_min({_TYPE}, idx) AS type,
string_agg({stripped(sub('text', cc.LIST_PREFIX))}, '|' ORDER BY idx) AS items FROM i WHERE item GROUP BY doc_id, island""")
def list_groups(spark, sf_dir):
    return s.list_groups(made(spark, sf_dir, PARAGRAPHS))


@query(f"SELECT doc_id, idx, ((length(text) - length({sub('text', f'^[{cc.WS}]+')})) // 2 + 1)::BIGINT AS level FROM {cte(PARAGRAPHS)}")
def list_levels(spark, sf_dir):
    return made(spark, sf_dir, PARAGRAPHS).select("doc_id", "idx", t.list_level(F.col("text")).alias("level"))


_JOINED = "SELECT CAST(conv_id AS BIGINT) AS doc_id, concat(text, chr(10), chr(10), ' ', role, chr(10), '1 first', chr(10), 'more', chr(10), '- second', chr(13), chr(10), '2. third') AS text FROM {conversations}"


@query(f"SELECT doc_id, count(*)::BIGINT AS n, sum(length(x))::BIGINT AS chars FROM (SELECT doc_id, {stripped('unnest(string_split(text, chr(10) || chr(10)))')} AS x FROM {cte(_JOINED)}) WHERE x <> '' GROUP BY doc_id")
def paragraph_split(spark, sf_dir):
    return s.split_blank(made(spark, sf_dir, _JOINED)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, concat(text, chr(10), chr(10), ' ', role, chr(10), '1 first', chr(10), 'more', chr(10), '- second', chr(13), chr(10), '2. third') AS text FROM conversations),
b AS (SELECT doc_id, unnest(x) AS part, generate_subscripts(x, 1) AS block FROM (SELECT doc_id, regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {q(f'{chr(10)}[{cc.WS}]*{chr(10)}')}) AS x FROM c)),
l AS (SELECT doc_id, block, unnest(x) AS text, generate_subscripts(x, 1) AS line FROM (SELECT doc_id, block, string_split(part, chr(10)) AS x FROM b)),
i AS (SELECT *, sum(CASE WHEN regexp_matches(text, {q(rf'^[{cc.WS}]*[{cc.PDF_BULLETS}][{cc.WS}]')}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY line) AS item FROM l),
j AS (SELECT doc_id, {stripped("string_agg(text, chr(10) ORDER BY line)")} AS text FROM i GROUP BY doc_id, block, item)
SELECT text, count(*)::BIGINT AS n FROM j WHERE text <> '' GROUP BY text""")
def pdf_paragraphs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr(
        "struct(conv_id, turn) AS doc_id", "concat(text, '\\n\\n ', role, '\\n1 first\\nmore\\n- second\\r\\n2. third') AS text"
    )
    return s.split_pdf(c).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT page_id, len(list_filter(string_split(html, chr(10)), lambda x: (length(x) - length(replace(x, '><', ''))) // 2 >= 2)) > 0 AS is_table FROM pages")
def table_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", s.is_table(F.col("html")).alias("is_table"))


#: Pages with a line of stray marks behind them.
_MARKED = "SELECT page_id, concat(html, chr(10), '> <a> > <b<c> >') AS text FROM {pages}"


@query(f"""WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line FROM {cte(_MARKED)}),
m AS (SELECT page_id, regexp_extract_all(line, '<[^<>]*>|>') AS m FROM l WHERE contains(line, '<') AND contains(line, '>')),
c AS (SELECT page_id, list_transform(m, lambda x, i: CASE WHEN x <> '>' THEN {stripped('substr(x, 2, length(x) - 2)')}
  ELSE coalesce({stripped("list_filter(m[1:i], lambda y: y <> '>')[-1][2:-2]")}, '') END) AS cells FROM m)
SELECT page_id, count(*)::BIGINT AS n_rows, max(len(cells))::BIGINT AS n_cols, sum(len(array_to_string(cells, '|')))::BIGINT AS chars, max(array_to_string(cells, '|')) AS last FROM c GROUP BY page_id""")
def table_marks(spark, sf_dir):
    """Rows of cells between marks of whole pages, stray marks among them."""
    rows = made(spark, sf_dir, _MARKED).select("page_id", F.explode(s.table_rows(F.col("text"))).alias("cells"))
    line = F.array_join("cells", "|")
    return rows.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).cast("long").alias("n_cols"), F.sum(F.length(line)).alias("chars"), F.max(line).alias("last"))


@query("""SELECT r_regionkey AS table_id, i AS row, h AS header, v AS cell FROM (
  SELECT r_regionkey, n_nationkey AS i, unnest(['name', 'key']) AS h, unnest([n_name, lower(n_name)]) AS v FROM region JOIN nation ON n_regionkey = r_regionkey)""")
def table_by_header(spark, sf_dir):
    """Cells by header of a table for each region: of the two columns headed key the last counts, a cell beyond the headers goes."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("<"), x["n_name"], F.lit("><"), x["n_nationkey"].cast("string"), F.lit("> <"), F.lower(x["n_name"]), F.lit("><beyond>")))
    tables = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("table_id")).agg(F.array_join(lines, "\n").alias("text"), F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    rows = tables.select("table_id", "keys", F.posexplode(s.rows_by_header(s.table_rows(F.concat(F.lit("<name><key><key>\n"), "text")))).alias("i", "cells"))
    return rows.select("table_id", F.element_at("keys", F.col("i") + 1).alias("row"), F.explode("cells").alias("header", "cell"))


@query(f"SELECT table_id, row_id, (i - 1)::BIGINT AS col, {stripped('c[i]')} AS cell, CASE WHEN row_id = 0 THEN 'header' WHEN i = 1 THEN 'row_header' ELSE 'data' END AS kind FROM (SELECT table_id, row_id, regexp_extract_all(line, '<([^<>]*)>', 1) AS c FROM {cte(TABLES)}), unnest(generate_series(1, len(c))) AS g(i)")
def table_cells(spark, sf_dir):
    rows = made(spark, sf_dir, TABLES).select("table_id", "row_id", F.posexplode(F.get(s.table_rows(F.col("line")), F.lit(0))).alias("col", "cell"))
    return rows.withColumn("kind", s.cell_kind(F.col("row_id"), F.col("col"))).withColumn("col", F.col("col").cast("long"))


def _whole(spark, sf_dir):
    """One text a table, its lines in order, with the rows as arrays."""
    lines = made(spark, sf_dir, TABLES).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "line"))).alias("x"))
    return lines.select("table_id", s.table_rows(F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("rows"))


_CELLS = f"(SELECT table_id, row_id, list_transform(regexp_extract_all(line, '<([^<>]*)>', 1), lambda x: trim(x)) AS c FROM {cte(TABLES)})"


@query(f"SELECT table_id, string_agg(CASE WHEN n = 1 THEN '| ' || array_to_string(c, ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(c)) ELSE '| ' || array_to_string(c, ' | ') || ' |' END, chr(10) ORDER BY row_id) AS markdown, 'Table with ' || count(*) || ' rows and ' || max(len(c)) || ' columns' AS summary FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_id) AS n FROM {_CELLS}) GROUP BY table_id")
def markdown_table(spark, sf_dir):
    return _whole(spark, sf_dir).select(
        "table_id", s.markdown_table(F.col("rows")).alias("markdown"),
        F.format_string("Table with %d rows and %d columns", F.size("rows"), F.array_max(F.transform("rows", lambda r: F.size(r)))).alias("summary"),
    )


@query(f"""WITH c AS (SELECT table_id, row_id, i, c[i] AS cell FROM {_CELLS}, unnest(generate_series(1, 3)) AS g(i)),
w AS (SELECT *, greatest(3, max(length(cell)) OVER (PARTITION BY table_id, i)) AS width FROM c),
r AS (SELECT table_id, row_id, '| ' || string_agg(rpad(cell, width::INT, ' '), ' | ' ORDER BY i) || ' |' AS line, '| ' || string_agg(repeat('-', width::INT), ' | ' ORDER BY i) || ' |' AS rule FROM w GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_id) AS n FROM r)
SELECT table_id, string_agg(CASE WHEN n = 1 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY row_id) AS markdown FROM n GROUP BY table_id""")
def markdown_table_padded(spark, sf_dir):
    """Cells padded to the width of their column, at least 3."""
    return _whole(spark, sf_dir).select("table_id", s.padded_table(F.col("rows")).alias("markdown"))


@query(f"SELECT table_id, row_id, map_extract(m, 'k')[1] AS last_value, len(map_keys(m))::BIGINT AS n_keys FROM (SELECT table_id, row_id, map {{'a': c[1], 'k': c[3]}} AS m FROM {_CELLS})")
def table_map_last_wins(spark, sf_dir):
    """Header to cell where a header occurs twice: the last cell wins."""
    row = F.get(s.table_rows(F.col("line")), F.lit(0))
    headers = ("a", "k", "k")
    # the last place of each header, so that no entry of the map is given twice
    places = {h: i for i, h in enumerate(headers)}
    unique = F.array(*(F.struct(F.lit(h).alias("k"), F.get(row, F.lit(i)).alias("v")) for h, i in places.items()))
    m = F.map_from_entries(unique)
    return made(spark, sf_dir, TABLES).select("table_id", "row_id", F.element_at(m, "k").alias("last_value"), F.size(m).cast("long").alias("n_keys"))


@query("""WITH p AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS paragraphs, string_agg(text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)
SELECT conv_id, paragraphs || chr(10) || chr(10) || whole AS plain, length(whole)::BIGINT AS n FROM p""")
def plain_text_join(spark, sf_dir):
    """Paragraphs and then the whole text, so that each text occurs twice."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x"))
    whole = F.array_join("x", "\n")
    return turns.select("conv_id", F.array_join(F.concat(F.filter("x", lambda x: x != ""), F.array(whole)), "\n\n").alias("plain"), F.length(whole).cast("long").alias("n"))


@query(f"""WITH h AS (SELECT doc_id, idx, text, {_HEAD} AS head, ({_LEVEL}) AS level FROM {cte(PARAGRAPHS)})
SELECT doc_id, {stripped(f"'---' || chr(10) || 'creator: HWP' || chr(10) || 'language: ko' || chr(10) || '---' || chr(10) || chr(10) || string_agg(CASE WHEN head THEN repeat('#', level) || ' ' || text ELSE text END || chr(10), chr(10) ORDER BY idx)")} AS markdown FROM h GROUP BY doc_id""")
def markdown_doc(spark, sf_dir):
    """Front matter of the metadata that is set (creator and language always are), then the paragraphs."""
    text = F.col("text")
    line = F.when(t.is_heading(text), F.concat(F.repeat(F.lit("#"), t.heading_level(text)), F.lit(" "), text)).otherwise(text)
    docs = made(spark, sf_dir, PARAGRAPHS).select("doc_id", "idx", line.alias("line")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: F.concat(x["line"], F.lit("\n"))), "\n")
    return docs.select("doc_id", t.strip(F.concat(F.lit("---\ncreator: HWP\nlanguage: ko\n---\n\n"), body)).alias("markdown"))


@query(f"SELECT doc_id, to_json({{'version': '1.0', 'text': text, 'statistics': {{'char_count': length(text), 'word_count': {n_of('text', f'[^{cc.WS}]+')}}}}})::VARCHAR AS json FROM {cte(PARAGRAPHS)}")
def json_structured(spark, sf_dir):
    """Groups of the structured output that are asked for, as JSON."""
    text = F.col("text")
    stats = F.struct(F.length(text).alias("char_count"), t.words(text).alias("word_count"))
    return made(spark, sf_dir, PARAGRAPHS).select("doc_id", F.to_json(F.struct(F.lit("1.0").alias("version"), text, stats.alias("statistics"))).alias("json"))


@query("SELECT conv_id, '{\"chunks\":[' || string_agg(turn, ',' ORDER BY turn) || ']}' AS json FROM conversations GROUP BY conv_id")
def chunk_stream_json(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("chunks"))
    return turns.select("conv_id", F.to_json(F.struct("chunks")).alias("json"))


@query("SELECT doc_id, coalesce(nullif(source, ''), '') AS title, 'HWP' AS creator, coalesce(lang, 'ko') AS language, 0::BIGINT AS page_count, '' AS author FROM documents")
def metadata_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("title"), F.lit("HWP").alias("creator"), F.coalesce("lang", F.lit("ko")).alias("language"),
        F.lit(0).cast("long").alias("page_count"), F.lit("").alias("author"),
    )


@query("SELECT conv_id, role AS section, sum(length(text))::BIGINT AS text_length, count(*)::BIGINT AS paragraph_count FROM conversations GROUP BY ALL")
def section_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("section")).agg(F.sum(F.length("text")).alias("text_length"), F.count("*").alias("paragraph_count"))


@query(f"SELECT source, count(*)::BIGINT AS kept, min(doc_id) AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, sha256({stripped('text')}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 GROUP BY source")
def section_dedup(spark, sf_dir):
    sections = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("section"), "text")
    return s.drop_repeated_sections(sections, "source").groupBy("source").agg(F.count("*").alias("kept"), F.min("section").alias("first"))


@query("SELECT doc_id, (o // 1000)::BIGINT AS chunk, o::BIGINT AS offset, md5(substr(text, o + 1, 1000)) AS digest, round(least(o + 1000, length(text)) / length(text) * 100, 4) AS progress FROM documents, unnest(generate_series(0, length(text) - 1, 1000)) AS g(o)")
def text_chunks(spark, sf_dir):
    return s.chunks(table(spark, sf_dir, "documents"), 1000).select("doc_id", "chunk", "offset", F.md5("content").alias("digest"), "progress")


@query("SELECT conv_id, turn, round(row_number() OVER w / count(*) OVER (PARTITION BY conv_id) * 100, 4) AS progress FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def page_progress(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id")
    done = F.row_number().over(w.orderBy("turn")) / F.count("*").over(w) * 100
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(done, 4).alias("progress"))


@query(r"""WITH RECURSIVE r AS (SELECT doc_id, 0::BIGINT AS chunk, text AS rest, left(text, 500) AS reach, ''::VARCHAR AS content, false AS done FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, chunk + 1, substr(rest, cut + 1), left(substr(rest, cut + 1), 500), left(rest, cut), length(rest) <= cut FROM (
  SELECT *, CASE WHEN length(rest) <= 500 THEN length(rest) WHEN contains(reach, chr(10)) THEN length(regexp_extract(reach, '(?s)^.*\n')) WHEN contains(reach, '. ') THEN length(regexp_extract(reach, '(?s)^.*\. ')) ELSE 500 END AS cut FROM r WHERE NOT done))
SELECT doc_id, chunk - 1 AS chunk, content FROM r WHERE chunk > 0""")
def boundary_chunks(spark, sf_dir):
    """Chunks of at most 500 characters that end at line ends; they join to the text."""
    return chains.boundary_chunks(table(spark, sf_dir, "documents"), 500)


@query(f"""SELECT doc_id, arg_min(method, p) AS method, arg_min(length(text), p)::BIGINT AS n FROM (
SELECT doc_id, 1 AS p, 'strict' AS method, {sub('text', f'[^{cc.KOREAN}]{{11,}}')} AS text FROM {cte(MIXED)} UNION ALL
SELECT doc_id, 2, 'noise', {sub('text', f'[{cc.NOISE}]')} FROM {cte(MIXED)} UNION ALL SELECT doc_id, 3, 'raw', text FROM {cte(MIXED)}) WHERE length(text) >= 100 GROUP BY doc_id""")
def strategy_choice(spark, sf_dir):
    text = F.col("text")
    rows = F.inline(F.array(*(F.struct(F.lit(i).alias("priority"), F.lit(m).alias("method"), f(text).alias("body")) for i, (m, f) in enumerate((("strict", t.drop_foreign_runs), ("noise", t.strip_noise), ("raw", lambda x: x))))))
    c = made(spark, sf_dir, MIXED).select("doc_id", rows).withColumnRenamed("body", "text")
    return s.best_strategy(c).select("doc_id", "method", F.length("text").cast("long").alias("n"))
