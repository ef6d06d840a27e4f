"""Cuts that depend on the cut before: running totals, next-cut functions and pointer doubling.

A buffer that is emptied when it is full is a fold over rows in order.  Here
each place knows the next cut from there, whatever came before; the places that
are really reached from the first one are found in a logarithmic number of
joins.  No step needs the rows of one key in one task but the last, which
gathers a buffer of bounded size.  Within one text, which is one row, the same
kind of cut is a fold over an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyr.functions.text import once
from papyr.operators.tables import settle


def _joined(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """The columns of `a` and those of `b` but `names`, where the columns `names` are equal, nulls too."""
    own = b.withColumnsRenamed({n: f"_b{i}" for i, n in enumerate(names)})
    cond = F.col(names[0]).eqNullSafe(F.col("_b0"))
    for i, n in enumerate(names[1:], 1):
        cond &= F.col(n) == F.col(f"_b{i}")
    return a.join(own, cond, how).drop(*(f"_b{i}" for i in range(len(names))))


def running_total(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows of the key up to this one; (key, order) tells rows apart.

    Rows are dealt by ranges of (key, order), so a key of many rows lies in
    many tasks; each range is summed by itself and gets the sum of the ranges
    of its key before it, of which there are at most as many as tasks.
    """
    dealt = settle(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    own = dealt.withColumn("_own", F.sum(value).over(W.partitionBy(key, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    sums = dealt.groupBy(key, "_range").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(key, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return _joined(own, before, [key, "_range"]).select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def reached(steps: DataFrame, key: str) -> DataFrame:
    """(key, at): the places reached from each key's smallest one; steps (key, at, next), next larger than at or null at the end.

    After k rounds the first 2**k places are known and each place has a pointer
    2**k steps ahead: following it from all known places doubles them.
    """
    known = settle(steps.groupBy(key).agg(F.min("at").alias("at")))
    jumps = settle(steps.where("next is not null").select(key, "at", "next"))
    while not jumps.isEmpty():
        ahead = _joined(known, jumps, [key, "at"]).select(key, F.col("next").alias("at"))
        known = settle(known.union(ahead))
        far = jumps.select(key, F.col("at").alias("next"), F.col("next").alias("_far"))
        jumps = settle(_joined(jumps, far, [key, "next"]).select(key, "at", F.col("_far").alias("next")))
    return known


def next_end(ends: DataFrame, probes: DataFrame, key: str, span: int) -> DataFrame:
    """(key, at, next): for each probe (key, at, least) the smallest end (key, end) that is `least` or more, or null.

    Ends and probes are sorted in stretches of `span`; where a stretch has no
    end behind a probe, the first end of a later stretch is the next.
    """
    rows = ends.select(key, F.col("end").alias("x"), "end", F.lit(None).cast("long").alias("at")).unionByName(
        probes.select(key, F.col("least").alias("x"), F.lit(None).cast("long").alias("end"), "at")
    )
    rows = rows.withColumn("_s", F.floor(F.col("x") / span))
    back = lambda *by: W.partitionBy(key, *by)
    near = rows.withColumn("near", F.last("end", ignorenulls=True).over(back("_s").orderBy(F.desc("x"), F.asc_nulls_first("at")).rowsBetween(W.unboundedPreceding, 0)))
    first = rows.groupBy(key, "_s").agg(F.min("end").alias("first"))
    later = first.select(key, "_s", F.last("first", ignorenulls=True).over(back().orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)).alias("far"))
    asked = near.where("at is not null")
    return _joined(asked, later, [key, "_s"]).select(key, "at", F.coalesce("near", "far").alias("next"))


def buffered_rows(pieces: DataFrame, size: int, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, flush, content): pieces of a key, in order, joined until they hold `size` characters; the rest last.

    A null piece is empty, and empty ones add nothing; pieces of a null key are
    those of one key; (key, order) tells pieces apart.
    """
    rows = pieces.where(F.length(text) > 0).select(key, order, F.col(text).alias("text"), F.length(text).cast("long").alias("n"))
    placed = settle(running_total(rows, key, [order], "n", "end"))
    ends = placed.select(key, "end")
    places = ends.select(key, F.col("end").alias("at")).union(placed.select(key, F.lit(0).cast("long")).distinct())
    steps = next_end(ends, places.withColumn("least", F.col("at") + size), key, 16 * size)
    starts = reached(steps, key).withColumn("start", F.lit(1))
    begun = placed.withColumn("at", F.col("end") - F.col("n"))
    marked = _joined(begun, starts, [key, "at"], "left").select(key, order, "text", F.coalesce("start", F.lit(0)).cast("long").alias("start"))
    numbered = running_total(marked, key, [order], "start", "flush")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text")))), lambda x: x["text"]), "")
    return numbered.groupBy(key, (F.col("flush") - 1).alias("flush")).agg(joined.alias("content"))


def boundary_cuts(text: Column, size: int) -> Column:
    """Where a text is cut in chunks of at most `size` characters, in order, as an array; empty where it is one chunk.

    A chunk ends after the last line end in reach, else after the last '. ',
    else where it is full.  A text is one row, so this is a fold over its
    pieces between boundaries: the state is where the chunk began, and the last
    line end and the last stop so far, which are those in reach whenever the
    next boundary is not.
    """
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("at"), none.alias("b"), none.alias("line"), none.alias("stop"), F.array().cast("array<bigint>").alias("cuts"))

    def step(s: Column, piece: Column) -> Column:
        end = s["at"] + F.length(piece)
        far = lambda b: end - b > size
        by_line = F.when(far(s["b"]) & (s["line"] > s["b"]), s["line"]).otherwise(s["b"])

        def then(b1: Column) -> Column:
            # a stop that a full chunk has cut in two doesn't count
            by_stop = F.when(far(b1) & (s["stop"] > b1 + 1), s["stop"]).otherwise(b1)

            def last(b2: Column) -> Column:
                fills = F.greatest(F.ceil((end - b2) / size) - 1, F.lit(0)).cast("long")
                full = F.when(fills > 0, F.transform(F.sequence(F.lit(1).cast("long"), fills), lambda k: b2 + k * size))
                more = F.concat(F.when(b1 > s["b"], F.array(b1)).otherwise(F.array().cast("array<bigint>")), F.when(b2 > b1, F.array(b2)).otherwise(F.array().cast("array<bigint>")), F.coalesce(full, F.array().cast("array<bigint>")))
                return F.struct(
                    end.alias("at"), (b2 + fills * size).alias("b"), F.when(piece.endswith("\n"), end).otherwise(s["line"]).alias("line"),
                    F.when(piece.endswith(". "), end).otherwise(s["stop"]).alias("stop"), F.when(b2 + fills * size > s["b"], F.concat(s["cuts"], more)).otherwise(s["cuts"]).alias("cuts"),
                )

            return once(by_stop, last)

        return once(by_line, then)

    return F.aggregate(F.split(text, r"(?<=\n)|(?<=\. )", -1), start, step, lambda s: s["cuts"])


def boundary_chunks(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, content): the chunks of boundary_cuts, which join to the text; an empty or null text has none.

    Nothing is shuffled.  Chunks are taken from stretches of a few chunks, as
    finding a place in a text takes time in proportion to what is before it.
    """
    span = 16 * size
    own = docs.where(F.length(text) > 0).select(key, F.length(text).cast("long").alias("n"), boundary_cuts(F.col(text), size).alias("cuts"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{span}}}"), F.lit(0)).alias("s"))
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), "cuts").alias("lo"), F.concat("cuts", F.array("n")).alias("hi"))

    def content(b: Column) -> Column:
        i = F.floor(b["lo"] / span).cast("int")
        both = F.concat(F.get("s", i), F.coalesce(F.get("s", i + 1), F.lit("")))
        return F.substring(both, (b["lo"] % span + 1).cast("int"), (b["hi"] - b["lo"]).cast("int"))

    return own.select(key, F.posexplode(F.transform(bounds, content)).alias("chunk", "content")).withColumn("chunk", F.col("chunk").cast("long"))
