"""Whole documents from their parts: structured output, plain text and Markdown.

Parts are frames keyed by document: paragraphs (doc_id, i, text), i from 0;
tables (doc_id, tbl, position, rows), rows an array of arrays of cells; metadata
(doc_id, fields by name).  A document's output is one value, so its parts are
gathered in one row at the end; everything before works row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyr.functions import text as t
from papyr.operators import structure as s

# Metadata fields in order with their defaults; null stands for an empty text.
METADATA = {"title": "", "author": "", "subject": "", "keywords": "", "created_date": "", "modified_date": "", "creator": "HWP", "language": "ko", "page_count": 0}


def metadata(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, metadata): all fields in order, those that are missing or null by their defaults."""
    have = {c.lower() for c in fields.columns}
    own = (F.coalesce(F.col(k), F.lit(d)).alias(k) if k in have else F.lit(d).alias(k) for k, d in METADATA.items())
    return fields.select(key, F.struct(*own).alias("metadata"))


def front_matter(meta: Column) -> Column:
    """Lines of the fields that are set, between rules; null where none is."""
    lines = [F.when(F.coalesce(meta[k].cast("string"), F.lit("")).isin("", "0"), None).otherwise(F.concat(F.lit(f"{k}: "), meta[k].cast("string"))) for k in METADATA]
    own = F.array_compact(F.array(*lines))
    return F.when(F.size(own) > 0, F.concat(F.lit("---\n"), F.array_join(own, "\n"), F.lit("\n---\n")))


def _in_order(parts: DataFrame, key: str, value: str, by: str = "\n") -> Column:
    """Aggregate: the values of a document joined in the order of (a, b, c)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "c", value))), lambda x: x[value]), by)


def to_markdown(paras: DataFrame, tables: DataFrame, meta: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """(key, markdown).  A table stands behind the paragraph of its position; of several at one position the last.

    The others and those without a position follow at the end; one whose
    position has no paragraph is left out.  Without `meta` there is no front matter.
    """
    text = F.col("text")
    line = F.when(t.is_heading(text), F.concat(F.repeat(F.lit("#"), t.heading_level(text)), F.lit(" "), text)).otherwise(text)
    both = F.inline(F.array(F.struct(F.lit(0).alias("c"), line.alias("part")), F.struct(F.lit(2).alias("c"), F.lit("").alias("part"))))
    own = paras.select(key, F.lit(1).alias("a"), F.col("i").cast("long").alias("b"), both)
    last = tables.where("position is not null").groupBy(key, "position").agg(F.max("tbl").alias("tbl"), F.lit(True).alias("last"))
    shown = tables.select(key, "tbl", "position", s.markdown_table(F.col("rows")).alias("md")).join(last, [key, "position", "tbl"], "left")
    placed = shown.where("last").join(paras.select(key, F.col("i").alias("position")), [key, "position"], "left_semi")
    parts = own.union(placed.select(key, F.lit(1), F.col("position").cast("long"), F.lit(1), F.concat(F.lit("\n"), "md")))
    parts = parts.union(shown.where("last is null").select(key, F.lit(2), F.col("tbl").cast("long"), F.lit(0), F.concat("md", F.lit("\n"))))
    if meta is not None:
        front = metadata(meta, key).select(key, F.lit(0), F.lit(0).cast("long"), F.lit(0), front_matter(F.col("metadata")).alias("part")).where("part is not null")
        parts = parts.union(front)
    return parts.groupBy(key).agg(_in_order(parts, key, "part").alias("markdown")).select(key, t.strip(F.col("markdown")).alias("markdown"))


def plain_text(paras: DataFrame, tables: DataFrame, whole: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text): paragraphs, rows of tables with their cells joined, and the whole text where it is given, by empty lines; empty parts go."""
    rows = tables.select(key, F.lit(2).alias("a"), F.col("tbl").cast("long").alias("b"), F.posexplode("rows").alias("c", "cells"))
    parts = paras.select(key, F.lit(1).alias("a"), F.col("i").cast("long").alias("b"), F.lit(0).alias("c"), "text").union(
        rows.select(key, "a", "b", "c", F.array_join("cells", " | "))
    )
    if whole is not None:
        parts = parts.union(whole.select(key, F.lit(3), F.lit(0).cast("long"), F.lit(0), "text"))
    return parts.where("text <> ''").groupBy(key).agg(_in_order(parts, key, "text", "\n\n").alias("text"))


def structured_tables(paras: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table, row_count, col_count, rows, cells, summary): tables in paragraphs first, each with index 0, then parsed ones with their own.

    Of a table in a paragraph the first line is the header, which counts as a
    row but has no cells; empty rows of parsed tables count but are not shown.
    """
    flat = lambda rows, typed: F.flatten(
        F.transform(rows, lambda r, i: F.transform(r, lambda x, j: F.struct(i.alias("row"), j.alias("col"), F.coalesce(x, F.lit("None")).alias("text"), (s.cell_kind(i, j) if typed else F.lit("data")).alias("type"))))
    )
    lines = s.table_rows(F.col("text"))
    texts = paras.where(s.is_table(F.col("text"))).select(key, F.lit(0).alias("a"), F.col("i").cast("long").alias("b"), F.lit(0).cast("long").alias("table"), lines.alias("lines")).where("size(lines) > 0")
    width = lambda rows: F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    of_text = texts.select(
        key, "a", "b", "table", F.size("lines").alias("row_count"), width(F.col("lines")).alias("col_count"),
        F.slice("lines", F.lit(2), F.size("lines")).alias("rows"), flat(F.slice("lines", F.lit(2), F.size("lines")), False).alias("cells"), F.lit(None).cast("string").alias("summary"),
    )
    full = F.filter("rows", lambda r: F.size(r) > 0)
    summary = F.format_string("Table with %d rows and %d columns", F.size("rows"), width(F.col("rows")))
    parsed = tables.select(key, F.lit(1).alias("a"), F.col("tbl").cast("long").alias("b"), F.col("tbl").cast("long").alias("table"), F.size("rows").alias("row_count"), width(F.col("rows")).alias("col_count"), full.alias("rows"), flat(F.col("rows"), True).alias("cells"), summary.alias("summary"))
    return of_text.union(parsed)


def structured(
    paras: DataFrame, tables: DataFrame, meta: DataFrame, whole: DataFrame | None = None, include_metadata: bool = True, include_structure: bool = True,
    include_statistics: bool = True, key: str = "doc_id",
) -> DataFrame:
    """(key, metadata, paragraphs, tables, lists, headings, text, statistics): the groups asked for; statistics count what is there.

    The text holds paragraphs, table rows and the whole text, so it repeats
    what stands in both, and so do its statistics.
    """
    text = F.col("text")
    out = metadata(meta, key) if include_metadata else meta.select(key)
    out = out.join(plain_text(paras, tables, whole, key), key, "left").withColumn("text", F.coalesce("text", F.lit("")))
    if include_structure:
        n = F.size("paragraphs")
        rows = paras.select(key, F.struct(F.col("i").alias("index"), "text", t.paragraph_type(text).alias("type"), F.length("text").alias("char_count"), t.words(text).alias("word_count"), t.tags(text).alias("tags")).alias("x"))
        found = structured_tables(paras, tables, key).select(key, F.struct("a", "b", "table", "row_count", "col_count", "rows", "cells", "summary").alias("x"))
        lists = s.list_groups(paras.withColumnRenamed("i", "idx"), key).select(key, F.struct("start_index", "end_index", "type", "n_items", "items").alias("x"))
        heads = s.with_parents(s.headings(paras.withColumnRenamed("i", "idx"), key), key).select(key, F.struct("idx", "text", "level", "kind", "parent", "depth").alias("x"))
        for name, frame in (("paragraphs", rows), ("tables", found), ("lists", lists), ("headings", heads)):
            kind = frame.schema["x"].dataType.simpleString()
            out = out.join(frame.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.expr("array()").cast(f"array<{kind}>")))
    if include_statistics:
        counts = {c: F.size(g) if include_structure else F.lit(0) for c, g in (("paragraph_count", "paragraphs"), ("table_count", "tables"), ("list_count", "lists"), ("heading_count", "headings"))}
        stats = t.text_statistics(text) | {k: c.cast("long") for k, c in counts.items()}
        if include_structure:
            own = F.transform("paragraphs", lambda p: p["word_count"])
            stats |= {
                "avg_paragraph_length": F.round(F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x) / F.nullif(n, F.lit(0)), 6),
                "max_paragraph_length": F.array_max(own), "min_paragraph_length": F.array_min(own),
            }
        out = out.withColumn("statistics", F.struct(*(c.alias(k) for k, c in stats.items())))
    return out
