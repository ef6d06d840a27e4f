"""Ranked lexical search over a bit-sliced impact index.

The impact of a term in a document is a whole number of SLICES bits that grows
with the term's occurrences and falls with the document's length.  Documents
are gathered in blocks; a block holds, for each of its terms, the documents
that have it and one bitmap for each bit of their impacts.

A search adds bitmaps: the impacts of a term times its weight, a sum of shifted
slices, then the terms of an item, each sum by bitwise carry arithmetic on the
documents of a block together.  The slices of the scores are then descended
from the most significant one: documents that have the bit stay candidates
while at least k do, otherwise they are among the best and the others stay.

Blocks are made where documents are read and searched where they lie, so
nothing but counts and the best k of each task is shuffled.  Items are met in
bounded query blocks, each of which is sent to all tasks.

Defined results: a null text has no terms; an item without terms, or whose
terms no document holds, has no rows; a null doc_id sorts first and stays null;
each row of the documents is a document of its own, also where rows repeat;
rows of one item_id are one item with all terms of its distinct texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyr.llm.common import NULL_ID, Tables, id_of, read, share, slices
from papyr.llm.textunits import TERM_BYTES, token_array

#: Impacts are at most 1,000,000.
SLICES = 20
#: Documents of a block at most, in whole words of 64, and its bytes of text unless one text has more.
BLOCK, BLOCK_BYTES = 1024, 4_000_000
#: Rows (item, term) of a query block, sent to all tasks.
QUERY_ROWS = 100_000
#: Terms added before slices of further terms are spread out.
ROUNDS = 32
#: Up to so many different query terms an index made for one search holds these alone.
VOCABULARY = 200_000
#: Parts in which the best of all tasks are ranked first.
SALTS = 64

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNTED = "doc_ids array<long>, lengths array<long>, terms array<string>, sizes array<int>, places binary, counts binary"
INDEX = "doc_ids array<long>, terms array<string>, sizes array<int>, places binary, slices binary"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): the terms of each item and how often it holds them."""
    texts = items.select(id_of("item_id").alias("item_id"), "text").distinct()
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM_PATTERN), F.lit(0))
    return texts.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


def counted_blocks(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Blocks of documents with the occurrences of each term; lengths count all terms also where a vocabulary is given."""
    only = None if vocabulary is None else pa.array(sorted(v.encode() for v in vocabulary), pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in slices(batches, "text", BLOCK_BYTES):
            for start in range(0, big.num_rows, BLOCK):
                batch = big.slice(start, BLOCK)
                ids = batch.column("doc_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                words, n = token_array(batch.column("text").take(pa.array(order)), TERM_BYTES, True)
                doc = np.repeat(np.arange(len(n)), n)
                if only is None:
                    coded = words.dictionary_encode()
                    names, code = coded.dictionary, coded.indices.to_numpy()
                else:
                    code = pc.fill_null(pc.index_in(words, only), -1).to_numpy(zero_copy_only=False)
                    names, doc, code = only, doc[code >= 0], code[code >= 0]
                cell, count = np.unique(code.astype(np.int64) * BLOCK + doc, return_counts=True)
                present, size = np.unique(cell // BLOCK, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[order]], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
                        pa.array([names.take(pa.array(present)).cast(pa.string())], pa.list_(pa.string())), pa.array([size], pa.list_(pa.int32())),
                        pa.array([(cell % BLOCK).astype("<u2").tobytes()], pa.binary()), pa.array([count.astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=["doc_ids", "lengths", "terms", "sizes", "places", "counts"],
                )

    return docs.select(id_of().alias("doc_id"), "text").mapInArrow(run, COUNTED)


def corpus_size(blocks: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    own = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    row = blocks.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("n"), F.sum(own).alias("l")).first()
    return row["n"] or 0, row["l"] or 0


def impacts(counts: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of terms with `counts` occurrences in documents of `length` terms, of n documents with `total` terms."""
    m = np.array([25 + 75 * int(x) * n // max(1, total) for x in length], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def sliced(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """The index: blocks with the impact bits of all occurrences, slice by slice, the terms of a slice one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                places, counts = (np.frombuffer(row.column(c)[0].as_py(), t).astype(np.int64) for c, t in (("places", "<u2"), ("counts", "<u4")))
                value = impacts(counts, row.column("lengths")[0].values.to_numpy()[places], n, total)
                bits = np.packbits((value >> np.arange(SLICES)[:, None] & 1).astype(bool), axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("doc_ids", "terms", "sizes", "places")), pa.array([bits.tobytes()], pa.binary())], names=["doc_ids", "terms", "sizes", "places", "slices"])

    return blocks.mapInArrow(run, INDEX)


def build_index(docs: DataFrame, tables: Tables, vocabulary: list[str] | None = None) -> tuple[DataFrame, int]:
    """(index of every document, number of documents with a term), written in the shared folder; `vocabulary` limits its terms."""
    blocks, path = tables.write(counted_blocks(docs, vocabulary))
    n, total = corpus_size(blocks)
    index = tables.settle(sliced(blocks, n, total))
    tables.drop(path)
    return index, n


def weighted_terms(index: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(item_id, term, n, w): item terms that some document holds, with their weights."""
    wanted = terms.select("term").distinct()
    sizes = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.sizes").alias("size"))
    df = sizes.groupBy("term").agg(F.sum("size").alias("df")).join(wanted, "term")
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long")
    return terms.join(df.select("term", weight.alias("w")), "term").where("w > 0")


def add(total: np.ndarray, addend: np.ndarray, shift: int, rows: int) -> None:
    """total[:, :rows] += addend << shift, both as slices (bit, row, word of 64 documents)."""
    carry = None
    for b in range(shift, len(total)):
        a = total[b, :rows]
        if b - shift < len(addend):
            x = addend[b - shift]
            half = a ^ x
            both = a & x
            if carry is not None:
                both |= half & carry
                half ^= carry
            total[b, :rows], carry = half, both
        else:
            if carry is None or not carry.any():
                return
            total[b, :rows], carry = a ^ carry, a & carry


def times(slices_: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Slices (bit, row, word) of every row's numbers times the row's factor: shifted slices added by carry arithmetic."""
    out = np.zeros((len(slices_) + int(factor.max(initial=0)).bit_length(), *slices_.shape[1:]), np.uint64)
    for j in range(int(factor.max(initial=0)).bit_length()):
        has = -(factor >> j & 1).astype(np.int64).view(np.uint64)
        add(out, slices_ & has[None, :, None], j, slices_.shape[1])
    return out


def best_bits(score: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps (row, word) of each row's k largest numbers above zero with all that equal the k-th; most significant slice first."""
    tied = np.bitwise_or.reduce(score, axis=0)
    sure = np.zeros_like(tied)
    settled = np.zeros((tied.shape[0], 1), bool)
    for bits in score[::-1]:
        has = tied & bits
        n = np.bitwise_count(sure | has).sum(axis=1, keepdims=True)
        few = n < k
        sure = np.where(few & ~settled, sure | has, sure)
        tied = np.where(settled, tied, np.where(few, tied & ~bits, has))
        settled |= n == k
    return sure | tied


class Queries:
    """A query block: for each item its terms with weight and number, the items with most terms first."""

    def __init__(self, rows: pa.Table):
        item, term = rows.column("item_id").to_numpy(), rows.column("term").combine_chunks().dictionary_encode()
        if isinstance(term, pa.ChunkedArray):
            term = term.combine_chunks()
        self.terms, code = term.dictionary, term.indices.to_numpy()
        n, w = rows.column("n").to_numpy(), rows.column("w").to_numpy()
        self.weight = np.zeros(len(self.terms), np.int64)
        self.weight[code] = w
        self.items, item = np.unique(item, return_inverse=True)
        self.item, self.code, self.n = item, code, n
        most = np.zeros(len(self.items), object)
        np.add.at(most, item, (n * w).astype(object) << SLICES)
        self.bits = int(max(most, default=0)).bit_length()

    def scores(self, row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(items, slices (bit, item, word)) of the items that share a term with the block; only their rows are made."""
        docs = len(row.column("doc_ids")[0])
        words = -(-docs // 64)
        sizes, places = row.column("sizes")[0].values.to_numpy(), np.frombuffer(row.column("places")[0].as_py(), "<u2").astype(np.int64)
        head = np.concatenate(([0], np.cumsum(sizes)))
        raw = np.frombuffer(row.column("slices")[0].as_py(), np.uint8).reshape(SLICES, -1)
        at = pc.fill_null(pc.index_in(self.terms, row.column("terms")[0].values), -1).to_numpy(zero_copy_only=False)
        # one step for each set bit of the number of times an item holds a term
        steps = [(s, np.flatnonzero((at[self.code] >= 0) & (self.n >> s & 1 == 1))) for s in range(int(self.n.max(initial=0)).bit_length())]
        seen = np.unique(self.item[np.concatenate([own for _, own in steps])]) if steps else np.empty(0, np.int64)
        score = np.zeros((self.bits, len(seen), words), np.uint64)
        for shift, own in steps:
            own = own[np.argsort(self.item[own], kind="stable")]
            item = np.searchsorted(seen, self.item[own])
            nth = np.arange(len(own)) - np.searchsorted(item, item)
            for low in range(0, int(nth.max(initial=-1)) + 1, ROUNDS):
                part = (nth >= low) & (nth < low + ROUNDS)
                codes, local = np.unique(self.code[own[part]], return_inverse=True)
                product = times(self._spread(at[codes], sizes, head, places, raw, words), self.weight[codes])
                round_, who = nth[part], item[part]
                for r in range(low, int(round_.max()) + 1):
                    now = round_ == r
                    rows = who[now]
                    grown = score[:, rows]
                    add(grown, product[:, local[now]], shift, len(rows))
                    score[:, rows] = grown
        return seen, score

    @staticmethod
    def _spread(at, sizes, head, places, raw, words) -> np.ndarray:
        """Slices (bit, term, word) over all documents of the block of the terms at places `at` of its list."""
        n = sizes[at].astype(np.int64)
        term = np.repeat(np.arange(len(at)), n)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head[at], n)
        out = np.empty((SLICES, len(at), words), np.uint64)
        cell = term * (words * 64) + places[posting]
        byte, bit = posting >> 3, (posting & 7).astype(np.uint8)
        flat = np.zeros(len(at) * words * 64, np.uint8)
        for s in range(SLICES):
            flat[cell] = raw[s, byte] >> bit & 1
            out[s] = np.packbits(flat, bitorder="little").view("<u8").reshape(len(at), words)
        return out

    def best(self, row: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, doc_id, score) of the best k documents of the block for each item, with all that equal the k-th."""
        seen, score = self.scores(row)
        found = np.unpackbits(best_bits(score, k).view(np.uint8), axis=1, bitorder="little") if len(seen) else np.zeros((0, 0), np.uint8)
        item, doc = np.nonzero(found)
        value = np.zeros(len(item), np.int64)
        for b in range(len(score)):
            value |= (score[b, item, doc >> 6] >> (doc & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
        return seen[item], row.column("doc_ids")[0].values.to_numpy()[doc], value


def top(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best rows of each item: highest score, then smallest doc_id."""
    order = np.lexsort((doc, -score, item))
    place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    return order[place < k]


def search(index: DataFrame, n_docs: int, terms: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item of `terms` (item_id, term, n)."""
    spark = index.sparkSession
    weighted = weighted_terms(index, terms, n_docs).cache()
    try:
        parts = max(1, -(-weighted.count() // QUERY_ROWS))
        blocks = [Queries(weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).select("item_id", "term", "n", "w").toArrow()) for p in range(parts)]
    finally:
        weighted.unpersist()
    found = None
    for queries in blocks:
        shared = share(spark, queries)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared()
            held, rows = [], 0
            merged = lambda: [tuple(c[i] for c in cols) for cols in [tuple(map(np.concatenate, zip(*held, strict=True)))] for i in [top(*cols, k)]]
            for batch in batches:
                for i in range(batch.num_rows):
                    held.append(q.best(batch.slice(i, 1), k))
                    rows += len(held[-1][0])
                    if rows > 500_000:
                        held = merged()
                        rows = len(held[0][0])
            if rows:
                item, doc, score = merged()[0]
                yield pa.RecordBatch.from_arrays([pa.array(q.items[item]), pa.array(doc), pa.array(score)], names=["item_id", "doc_id", "score"])

        part = index.mapInArrow(run, "item_id long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    # the best of each task first in parts, so that an item with very many tasks isn't ranked by one
    order = (F.desc("score"), F.asc("doc_id"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    shown = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return ranked.select(shown("item_id"), "rank", shown("doc_id"), "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item, over an index of all documents made for the terms of the items."""
    tables = Tables(docs.sparkSession)
    terms = item_terms(items)
    wanted = terms.select("term").distinct()
    vocabulary = [r["term"] for r in wanted.collect()] if wanted.count() <= VOCABULARY else None
    index, n = build_index(docs, tables, vocabulary)
    return search(index, n, terms, k)


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 10 best of all documents for each benchmark item.

    An item that no document shares a term with has no rows; an empty table on
    either side gives none.
    """
    return search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM_PATTERN}') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms)) AS l FROM d),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
i AS (SELECT item_id, term, count(*) AS c
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM_PATTERN}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM i) GROUP BY term),
f AS (SELECT item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * n) // l))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN t USING (term) JOIN d USING (r), s GROUP BY ALL)
SELECT item_id::BIGINT AS item_id, (row_number() OVER o)::INT AS rank, doc_id, score FROM f WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""
