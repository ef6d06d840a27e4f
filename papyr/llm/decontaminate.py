"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask selects some positions of SPAN consecutive tokens and ignores the
others, so a seed survives substitutions at ignored positions.  Seeds of the
benchmark and of every position of every document are joined by hash; each hit
is then verified on the tokens: of REACH aligned tokens around it at least
MATCHES must be equal.  Both sides of a hit are compared at one offset, so
tokens may be substituted, not inserted.  Tokens are told by 64-bit hashes.  An
item shorter than SPAN tokens has one seed, all of its tokens, and is found
where all of them stand unchanged; there the tokens themselves are compared.

Defined results: null texts, texts and items without tokens hit nothing; a null
doc_id or item_id is a value of its own and stays null; repeated rows, of
documents or of items, count once; rows of one doc_id are one document; a text
shorter than SPAN tokens can only hold short items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import NULL_ID, id_of, read

#: Selected positions (1) of 13 tokens; weight 4, chosen by simulation so that what agrees is found (see the README).
MASKS = ("1000010010010", "1001010000001", "1100100010000", "1011000000100")
SPAN = 13
#: Tokens compared to each side of a hit's span.
MARGIN = 4
MATCHES = 13
#: Positions of a piece.
PIECE = 32
#: Largest number of seeds whose table is broadcast; under 300 bytes each.
BROADCAST_SEEDS = 400_000


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """64-bit hashes of the words."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _pieces(df: DataFrame, key: str, span: int = SPAN, margin: int = MARGIN, units: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, s, skip, m, w): m positions each, w their tokens with the margins; s is the first position and w[skip] its token.

    Rows that follow carry w, a bounded array, and not the tokens of a whole
    text: the work stays in proportion to the text however long it is.  The
    tokens are generated from an array of one so that no filter on them is
    pushed below and splits each text again.
    """
    tok = df.select(key, F.explode(F.array(units(F.col("text")))).alias("tok"))
    n = F.size("tok")
    skip = lambda s: F.least(s, F.lit(margin))
    cut = F.transform(
        F.sequence(F.lit(0), n - span, F.lit(PIECE)),
        lambda s: F.struct(
            s.alias("s"), skip(s).alias("skip"), F.least(F.lit(PIECE), n - span + 1 - s).alias("m"),
            F.slice("tok", s - skip(s) + 1, skip(s) + PIECE + span - 1 + margin).alias("w"),
        ),
    )
    return tok.select(key, F.inline(F.when(n >= span, cut)))


def _seeds(pieces: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """A row for each position and mask of the pieces: the mask's number, the seed, its position `at` and its place `j` in w."""
    at = pieces.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    at = at.select("*", (F.col("skip") + F.col("k")).alias("j"))
    seeds = F.array(
        *(
            F.xxhash64(F.lit(m), *(F.get("w", F.col("j") + k) for k, bit in enumerate(mask) if bit == "1"))
            for m, mask in enumerate(masks)
        )
    )
    return at.select("*", F.posexplode(seeds).alias("mask", "seed")).withColumn("at", F.col("s") + F.col("k"))


def _short_hits(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, item_id, at, mask, matched) of items of `lengths` words, each fewer than SPAN, that stand in documents as a whole.

    One pass over the documents for all lengths: at each place a seed for each length that fits.
    """
    least, most = min(lengths), max(lengths)
    at = _pieces(docs, "doc_id", least, most - least, words).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    # the words from a place on are compared once a hash of them has met
    own = F.array(*(F.when(F.col("skip") + F.col("k") + n <= F.size("w"), F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("w", F.col("skip") + F.col("k") + 1, n)).alias("seed"))) for n in lengths))
    own = at.select("doc_id", "w", (F.col("skip") + F.col("k")).alias("j"), (F.col("s") + F.col("k")).alias("at"), F.inline(F.array_compact(own)))
    test = items.select("item_id", words(F.col("text")).alias("item")).where(F.size("item").between(1, SPAN - 1)).distinct()
    test = test.select("item_id", "item", F.size("item").alias("n"), F.xxhash64("item").alias("seed"))
    # an item of bounded size gives one row, so the table is about as large as the benchmark; it decides how the join is made
    bounded = test.count() <= BROADCAST_SEEDS
    hits = own.join(F.broadcast(test) if bounded else test.hint("merge"), ["n", "seed"]).where(F.slice("w", F.col("j") + 1, F.col("n")) == F.col("item"))
    return hits.select("doc_id", "item_id", "at", F.lit(0).alias("mask"), F.col("n").alias("matched"))


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_hits, n_matched, first_token) of documents that hold most of a passage of an item."""
    docs = docs.select(id_of().alias("doc_id"), "text")
    items = items.select(id_of("item_id").alias("item_id"), "text")
    own = _seeds(_pieces(docs, "doc_id"))
    test = _seeds(_pieces(items, "item_id"))
    # places of an item with equal tokens around them agree with the same places of documents and are one row,
    # so a repetitive item has few rows however long it is
    around = F.array(*(F.get("w", F.col("j") + k) for k in range(-MARGIN, SPAN + MARGIN)))
    test = test.select("seed", "item_id", "mask", around.alias("item")).distinct()
    # the number of seeds, of bounded size each, decides how the join is made
    bounded = test.count() <= BROADCAST_SEEDS
    hits = own.select("doc_id", "at", "j", "w", "seed").join(F.broadcast(test) if bounded else test.hint("merge"), "seed")
    # only hits are compared, so a loop over the offsets is cheaper than 21 terms of generated code
    same = F.size(
        F.filter(
            F.sequence(F.lit(-MARGIN), F.lit(SPAN + MARGIN - 1)),
            lambda k: F.coalesce(F.get("w", F.col("j") + k) == F.get("item", k + MARGIN), F.lit(False)),
        )
    )
    hits = hits.select("doc_id", "item_id", "at", "mask", same.alias("matched")).where(F.col("matched") >= MATCHES)
    # at most SPAN - 1 lengths; most benchmarks have none of them
    n = F.size(words(F.col("text")))
    lengths = sorted(row["n"] for row in items.select(n.alias("n")).where((n > 0) & (n < SPAN)).distinct().collect())
    if lengths:
        hits = hits.union(_short_hits(docs, items, lengths))
    shown = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return (
        hits.groupBy("doc_id", "item_id")
        .agg(F.count_distinct("at", "mask").alias("n_hits"), F.max("matched").cast("long").alias("n_matched"), F.min("at").cast("long").alias("first_token"))
        .select(shown("doc_id").alias("doc_id"), shown("item_id").alias("item_id"), "n_hits", "n_matched", "first_token")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_hits (places and masks of the document whose seeds agree), n_matched (most equal tokens of a hit), first_token of each document and item that share a passage.

    Nothing shared gives no row; an empty table on either side gives none.
    """
    return contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark passage."""
    found = contaminated_pairs(docs, items).select(id_of().alias("_papyr_hit")).distinct()
    return docs.join(found, id_of() == F.col("_papyr_hit"), "left_anti")


def _sql() -> str:
    def seeds(t: str, at: str) -> str:
        return ", ".join(
            f"concat_ws(' ', {m}, " + ", ".join(f"{t}[{at} + {k}]" for k, bit in enumerate(mask) if bit == "1") + ")"
            for m, mask in enumerate(MASKS)
        )

    same = " + ".join(
        f"coalesce(pos + {k} >= 1 AND item_pos + {k} >= 1 AND tok[pos + {k}] = item[item_pos + {k}], false)::INT"
        for k in range(-MARGIN, SPAN + MARGIN)
    )
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS tok FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS item FROM benchmark),
p AS (SELECT doc_id, tok, pos, unnest([{seeds("tok", "pos")}]) AS seed
      FROM d, unnest(generate_series(1, len(tok) - {SPAN - 1})) AS g(pos)),
q AS (SELECT item_id, item, pos AS item_pos, unnest([{seeds("item", "pos")}]) AS seed
      FROM b, unnest(generate_series(1, len(item) - {SPAN - 1})) AS g(pos)),
h AS (SELECT doc_id, item_id, pos, item_pos, seed[1] AS mask, {same} AS matched FROM p JOIN q USING (seed)),
s AS (SELECT d.doc_id, item_id, pos, 1 AS item_pos, '0' AS mask, len(item) AS matched
      FROM b, d, unnest(generate_series(1, len(tok) - len(item) + 1)) AS g(pos)
      WHERE len(item) BETWEEN 1 AND {SPAN - 1} AND tok[pos:pos + len(item) - 1] = item)
SELECT doc_id, item_id, count(DISTINCT (pos, mask))::BIGINT AS n_hits, max(matched)::BIGINT AS n_matched, (min(pos) - 1)::BIGINT AS first_token
FROM (SELECT * FROM h WHERE matched >= {MATCHES} UNION ALL SELECT * FROM s) GROUP BY doc_id, item_id
"""


SQL = _sql()
