"""Operators on paragraphs in order: splitting, heading trees, lists, chunks.

All windows are partitioned by document and need one pass in order.  Only where
a result is one text (the items of a list, the lines of a paragraph) are its
rows gathered into an array, never those of a whole document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyr.functions import bulk
from papyr.functions import charclass as cc
from papyr.functions import text as t


def split_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("idx", "text"))


def split_blank(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs between empty lines, stripped; empty ones go and keep their number."""
    return df.select(key, F.posexplode(F.split(text, "\n\n")).alias("idx", "text")).withColumn("text", t.strip(F.col("text"))).where("text <> ''")


def split_pdf(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs of page text: (key, block, item, text); a line that begins like a list item begins a new one.

    Blocks lie between blank lines; a block without list items is one
    paragraph.  Items are islands: the running count of their first lines.
    """
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    blocks = df.select(key, F.posexplode(F.split(plain, f"\n[{cc.WS}]*\n")).alias("block", "part"))
    lines = blocks.select(key, "block", F.posexplode(F.split("part", "\n")).alias("line", "text"))
    starts = F.col("text").rlike(rf"^[{cc.WS}]*[{cc.PDF_BULLETS}][{cc.WS}]").cast("int")
    w = W.partitionBy(key, "block").orderBy("line")
    items = lines.withColumn("item", F.sum(starts).over(w))
    joined = items.groupBy(key, "block", "item").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return joined.withColumn("text", t.strip(F.col("text"))).where("text <> ''")


def headings(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, text, level, kind) of heading paragraphs."""
    text = F.col("text")
    return paras.where(t.is_heading(text)).select(key, "idx", "text", t.heading_level(text).alias("level"), t.heading_kind(text).alias("kind"))


def with_parents(heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds parent (idx of the nearest earlier heading of a smaller level) and depth (its number of ancestors).

    Levels are 1 to 6, so the last heading of each level so far is all the
    state that the tree needs: a running window instead of a stack.
    """
    w = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("idx")), ignorenulls=True).over(w) for k in range(1, 6)}
    out = heads.select("*", *(c.alias(f"_l{k}") for k, c in last.items()))
    own = {k: F.when(F.col("level") > k, F.col(f"_l{k}")) for k in last}
    parent = F.greatest(*own.values())
    # an ancestor's level holds a later heading than every smaller level
    depth = F.lit(0)
    for k in own:
        record = own[k].isNotNull()
        for j in range(1, k):
            record &= F.coalesce(own[k] > own[j], F.lit(True))
        depth = depth + record.cast("int")
    return out.withColumn("parent", parent).withColumn("depth", depth).drop(*(f"_l{k}" for k in last))


def heading_trees(heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tree): the headings of a document as JSON, each with text, level, index and its children, nested as with_parents has them.

    In document order a heading either opens its parent's children or follows a
    sibling, which only its own depth and that before it tell.  So each heading
    writes its part of the text by itself and the parts are joined: one window
    and one aggregation for trees of any depth.
    """
    w = W.partitionBy(key).orderBy("idx")
    deep = with_parents(heads, key)
    before = F.coalesce(F.lag("depth").over(w), F.lit(-1))
    node = F.to_json(F.struct("text", "level", F.col("idx").alias("index")))
    opened = F.concat(F.substring(node, F.lit(1), F.length(node) - 1), F.lit(',"children":['))
    # so many nodes end before this one: all from the depth before down to its own
    ended = before - F.col("depth") + 1
    part = F.concat(F.repeat(F.lit("]}"), ended), F.when(F.col("depth") <= before, ",").otherwise(""), opened)
    parts = deep.select(key, "idx", "depth", part.alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "part"))), lambda x: x["part"]), "")
    out = parts.groupBy(key).agg(whole.alias("body"), F.max_by("depth", "idx").alias("last"))
    return out.select(key, F.concat(F.lit("["), "body", F.repeat(F.lit("]}"), F.col("last") + 1), F.lit("]")).alias("tree"))


def subtrees(paras: DataFrame, value: Column, key: str = "doc_id") -> DataFrame:
    """(key, idx, level, end, total): for each heading the index at which its part of the document ends, or null, and the sum of `value` over that part.

    The part reaches to the next heading of its level or a smaller one.  Running
    sums label it as an interval, so no heading is joined with its paragraphs.
    """
    up = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(key).orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
    level = F.when(t.is_heading(F.col("text")), t.heading_level(F.col("text")))
    sums = paras.select(key, "idx", level.alias("level"), value.cast("long").alias("_own")).withColumn("_sum", F.sum("_own").over(up)).withColumn("_before", F.col("_sum") - F.col("_own"))
    ends = {k: F.last(F.when(F.col("level") <= k, F.struct("idx", "_before")), ignorenulls=True).over(down) for k in range(1, 7)}
    marked = sums.select("*", F.max("_sum").over(W.partitionBy(key)).alias("_all"), *(c.alias(f"_e{k}") for k, c in ends.items())).where("level is not null")
    end = F.coalesce(*(F.when(F.col("level") == k, F.col(f"_e{k}")) for k in ends))
    return marked.select(key, "idx", "level", end["idx"].alias("end"), (F.coalesce(end["_before"], "_all") - F.col("_before")).alias("total"))


def list_groups(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start_index, end_index, n_items, type, items): runs of consecutive list items.

    Consecutive items share the number of other paragraphs before them.
    """
    item = F.col("text").rlike(cc.LIST_PREFIX)
    w = W.partitionBy(key).orderBy("idx")
    marked = paras.select(key, "idx", "text", item.alias("item"), F.sum((~item).cast("int")).over(w).alias("island"), F.row_number().over(w).alias("pos"))
    body = t.strip(F.regexp_replace("text", cc.LIST_PREFIX, ""))
    rows = marked.where("item").select(key, "island", "idx", "text", body.alias("body"))
    return (
        rows.groupBy(key, "island").agg(
            F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), F.count("*").alias("n_items"),
            F.min_by(t.list_type(F.col("text")), "idx").alias("type"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "body"))), lambda x: x["body"]), "|").alias("items"),
        ).drop("island")
    )


def drop_repeated_sections(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of equal section texts of each document, compared by a hash of the stripped text.

    An aggregation with map-side combine, so a text that most sections have is
    one row of each task.
    """
    rest = [c for c in sections.columns if c not in (key, "section")]
    first = F.min_by(F.struct(*rest), "section").alias("_first")
    return sections.groupBy(key, F.sha2(t.strip(F.col("text")), 256).alias("_hash")).agg(F.min("section").alias("section"), first).select(key, "section", "_first.*")


def chunks(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, offset, content, progress): pieces of `size` characters and the share done in percent."""
    n = F.length(text)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))))
    out = df.select(key, text, at.alias("offset"))
    end = F.least(F.col("offset") + size, F.length(text))
    return out.select(
        key, F.floor(F.col("offset") / size).cast("long").alias("chunk"), F.col("offset").cast("long").alias("offset"),
        F.substring(text, F.col("offset") + 1, F.lit(size)).alias("content"), F.round(end / F.length(text) * 100, 4).alias("progress"),
    )


def byte_chunks(df: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, content binary, progress): pieces of `size` bytes of the UTF-8 form, which may cut a character."""
    n = F.octet_length(text)
    out = df.select(key, F.col(text).cast("binary").alias("_raw"), n.alias("_n"), F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size)))).alias("chunk"))
    end = F.least((F.col("chunk") + 1) * size, F.col("_n"))
    return out.select(key, "chunk", F.substring("_raw", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("content"), F.round(end / F.col("_n") * 100, 4).alias("progress"))


def table_rows(c: Column) -> Column:
    """Array of rows of cells of a text with <cell> marks: of each line with < and >, what stands between them.

    A < within a cell begins it anew; a > without < gives the cell before it once more, or an empty one.
    """
    lines = F.filter(F.split(c, "\n"), lambda x: x.contains("<") & x.contains(">"))
    stray = lambda m: m == ">"
    cell = lambda m: t.strip(F.substring(m, F.lit(2), F.length(m) - 2))

    def cells(marks: Column) -> Column:
        known = F.transform(marks, lambda m: F.when(~stray(m), cell(m)))
        filled = F.transform(marks, lambda m, i: F.when(~stray(m), cell(m)).otherwise(F.coalesce(F.try_element_at(F.array_compact(F.slice(known, F.lit(1), i + 1)), F.lit(-1)), F.lit(""))))
        return F.when(F.exists(marks, stray), filled).otherwise(known)

    return F.transform(lines, lambda x: t.once(F.regexp_extract_all(x, F.lit("<[^<>]*>|>"), F.lit(0)), cells))


def rows_by_header(rows: Column) -> Column:
    """The rows behind the first one as maps from the first one's cells; of equal headers the last counts, cells beyond the headers go."""

    def one(row: Column, headers: Column) -> Column:
        n = F.least(F.size(row), F.size(headers))
        pairs = F.arrays_zip(F.slice(headers, F.lit(1), n).alias("h"), F.slice(row, F.lit(1), n).alias("v"))
        names = F.array_distinct(F.slice(headers, F.lit(1), n))
        return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["h"] == k), -1)["v"]))

    named = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: one(r, F.get(rows, F.lit(0))))
    return F.filter(named, lambda m: F.size(m) > 0)


def is_table(c: Column) -> Column:
    return F.exists(F.split(c, "\n"), lambda x: F.regexp_count(x, F.lit("><")) >= 2)


def clean_cells(rows: Column) -> Column:
    """Rows of cells stripped of white space; a null cell is empty."""
    return F.transform(rows, lambda r: F.transform(r, lambda x: t.strip(F.coalesce(x, F.lit("")))))


def emphasised(c: Column, strong: Column) -> Column:
    return F.when(strong, F.concat(F.lit("**"), c, F.lit("**"))).otherwise(c)


def cell_kind(row: Column, col: Column) -> Column:
    return F.when(row == 0, "header").when(col == 0, "row_header").otherwise("data")


def markdown_table(rows: Column) -> Column:
    """| a | b | lines; the first row is the header, nothing is padded."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, F.lit(0)))))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n")


def best_strategy(candidates: DataFrame, least: int = 100, key: str = "doc_id") -> DataFrame:
    """Of the candidates (key, priority, method, text) of a document the first whose text is long enough."""
    w = W.partitionBy(key).orderBy("priority")
    return candidates.where(F.length("text") >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def padded_table(rows: Column) -> Column:
    """The same with cells padded to the width of their column, at least 3."""
    n = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    widths = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.length(cell(r, i))))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w, i: F.rpad(cell(r, i), w, " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0)))), F.array(rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n")


# Characters a strategy must yield, what must be left when cleaned, and the same for the preview; the share of Korean below which the preview is tried.
ENOUGH, LEFT, PREVIEW, PREVIEW_LEFT, KOREAN = 500, 100, 100, 50, 0.10


def rated(c: Column) -> Column:
    """(text, ratio) of a text that is cleaned already."""
    return t.once(c, lambda x: F.struct(x.alias("text"), t.korean_ratio(x).alias("ratio")))


def accepted(rows: DataFrame, body: str, preview: str, clean: Callable[[Column], Column] = bulk.rated) -> DataFrame:
    """Adds method, text and korean_ratio of a body text and a stored preview, null where neither is accepted, and leaves those two out.

    The body's text is taken if it is long enough before and after cleaning; one
    with hardly any Korean gives way to a preview with more.  A text is cleaned
    only where the rule asks for it: a body that is long enough, and a preview
    that the body's text may give way to.  clean: the cleaned text and its share
    of Korean, as `rated` gives them.
    """
    pick = lambda m, c: F.struct(F.lit(m).alias("method"), c["text"].alias("text"), c["ratio"].alias("korean_ratio"))
    cleaned = lambda asked, c: F.when(asked, clean(F.when(asked, F.col(c))))
    own, other, size = F.col("_own"), F.col("_other"), F.length(preview)
    long = F.coalesce(F.length(body) > ENOUGH, F.lit(False))
    foreign, enough = long & (own["ratio"] < KOREAN), F.coalesce(long & (F.length(own["text"]) >= LEFT), F.lit(False))
    asked = F.coalesce((foreign & (size > PREVIEW)) | (~enough & (size > ENOUGH)), F.lit(False))
    both = rows.withColumn("_own", cleaned(long, body)).withColumn("_other", cleaned(asked, preview))
    choice = (
        F.when(foreign & (size > PREVIEW) & (F.length(other["text"]) > PREVIEW_LEFT) & (other["ratio"] > own["ratio"]), pick("preview", other))
        .when(enough, pick("body", own))
        .when((size > ENOUGH) & (F.length(other["text"]) >= LEFT), pick("preview", other))
    )
    return both.select(*(c for c in rows.columns if c not in (body, preview)), choice.alias("_x")).select("*", "_x.*").drop("_x")
