"""Repeated windows of a corpus: the parse, fetch and settling steps that the
byte-level and the word-level substring operators share.

1. Each task parses its documents into phrases (textunits.parse).  A row stands
   for a phrase with what follows it up to a window's length: an entry of the
   parse's suffix order, cut at the depth that can matter.  Of equal rows of a
   batch only the first goes on, so a hot phrase sends one row per batch.
2. Rows are dealt by trigger.  Of equal ones all but the first in corpus order
   are repeated as a whole: their longest match with an earlier text is all of
   them.  First ones whose trigger also ends other phrases have to be compared
   window by window; the units they cover are fetched from their documents and
   compared in shards of whole triggers (the caller's suffix arrays or FM-index).
3. A trigger of very many different phrases would be one large shard.  Such
   triggers are found in a sample of the documents and by their number of rows;
   their windows are dealt by two 64-bit hashes instead, and the first document
   of each window is found by an aggregation with map-side combine.  The sample
   decides only how rows are dealt, never what is found.
4. Ranges are gathered per document and handed to the caller with the text.

Equal phrases are told by 128 bits of hashes, words by 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyr.llm import textunits as tu
from papyr.llm.common import NULL_ID, Tables, id_of, slices, width

#: Bytes of text that a task parses at once; bounds its arrays.
BATCH_BYTES = 1_000_000
#: Different phrases of one trigger above which their windows are dealt by hash.
GROUP = 1_000
#: Rows of the sample from which a trigger counts as frequent, and the most of them that are told to the tasks.
FREQUENT, MOST_FREQUENT = 16, 10_000
#: The sample holds every SPARSE-th document, but that many documents where there are.
SPARSE, SAMPLE = 64, 4096


@dataclass(frozen=True)
class Method:
    """What the two operators do differently."""

    #: texts -> (hashes of units, document of each unit, index of each document's first unit)
    units: Callable
    #: text -> array of its units: bytes, or hashes of words
    sequence: Callable
    #: units -> their hashes
    values: Callable
    window: int
    trigger: int
    modulus: int
    #: only windows in documents of smaller id count
    across: bool
    #: mapInArrow function over (key, id, start, off, data) of whole keys -> (id, start, n) of repeated windows
    shard: Callable


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    return tu.BYTE_VALUES[data], np.repeat(np.arange(len(texts), dtype=np.int32), lens), np.cumsum(lens) - lens


def byte_sequence(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(x) + 1 for x in texts], np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts, ends = tu.words_of(data)
    begin = np.cumsum(lens) - lens
    doc_of = (np.searchsorted(begin, starts, side="right") - 1).astype(np.int32)
    return tu.word_hashes(data, starts, ends), doc_of, np.searchsorted(doc_of, np.arange(len(texts)))


def word_sequence(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return tu.word_hashes(data, *tu.words_of(data))


def numbered(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text binary): id orders documents as doc_id does, nulls first.

    id is doc_id itself unless rows of one doc_id have different texts.  Those
    are different documents, ordered by a hash of the text; then all documents
    are numbered anew.
    """
    plain = docs.select(id_of().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    h = F.xxhash64("text")
    if plain.select("id", h.alias("h")).groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        return plain
    own = plain.select("id", h.alias("h")).distinct().orderBy("id", "h")
    places = own.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("id long, h long, place long")
    return plain.withColumn("h", h).join(places, ["id", "h"]).select(F.col("place").alias("id"), "doc_id", "text")


def _phrases(m: Method, batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(phrases with doc and start, sorted; whether each is the first of its kind in the batch)."""
    ids = batch.column("id").to_numpy()
    u, doc_of, first_unit = m.units([x or b"" for x in batch.column("text").to_pylist()])
    r = tu.parse(u, doc_of, m.window, m.trigger, m.modulus)
    d = doc_of[r["first"]]
    start, doc = r["first"] - first_unit[d], ids[d]
    order = np.lexsort((start, doc, r["ctx"], r["trig"]))
    p = {"trig": r["trig"], "ctx": r["ctx"], "doc": doc, "start": start, "n": r["n"], "off": r["off"]}
    p = {k: v[order] for k, v in p.items()}
    head = np.ones(len(order), bool)
    head[1:] = (p["trig"][1:] != p["trig"][:-1]) | (p["ctx"][1:] != p["ctx"][:-1])
    at = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else order  # the first occurrence of the same phrase here
    same = (p["doc"] == p["doc"][at]) & (m.across | (p["start"] == p["start"][at]))
    return p, same


def frequent_triggers(plain: DataFrame, m: Method) -> np.ndarray:
    """Sorted triggers that end many different phrases of a sample."""
    every = max(1, min(SPARSE, plain.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            p, first = _phrases(m, batch)
            trig, n = np.unique(p["trig"][first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(trig[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["trig", "n"])

    sample = plain.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", "text")
    counts = sample.mapInArrow(run, "trig long, n long").groupBy("trig").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "trig").limit(MOST_FREQUENT).toArrow().column("trig").to_numpy()
    return np.sort(top.view(np.uint64))


def occurrences(m: Method, frequent) -> Callable:
    """mapInArrow function over (id, text): rows (known, often, deal, ctx, id, start, n, off).

    known: the windows start..start+n-1 are repeated for certain.  often: the
    trigger is frequent, and its rows are dealt by the whole phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in slices(batches, "text", BATCH_BYTES):
            p, first = _phrases(m, batch)
            if not len(first):
                continue
            # repeated windows that follow on from each other become one row
            o = np.flatnonzero(~first)
            o = o[np.lexsort((p["start"][o], p["doc"][o]))]
            kd, ks, kn = p["doc"][o], p["start"][o], p["n"][o]
            if len(o):
                cut = np.flatnonzero(np.concatenate(([True], (kd[1:] != kd[:-1]) | (ks[1:] != ks[:-1] + kn[:-1]))))
                kn = np.add.reduceat(kn, cut)
                kd, ks = kd[cut], ks[cut]
            k = len(kd)
            spread = tu.fold(kd.astype(np.uint64), ks.astype(np.uint64))  # deals them out evenly
            trig, ctx = p["trig"][first], p["ctx"][first]
            often = np.isin(trig, hot) if len(hot) else np.zeros(len(trig), bool)
            deal = np.where(often, tu.fold(trig, ctx), trig)
            none = np.zeros(k, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((~none, np.zeros(len(trig), bool)))),
                    pa.array(np.concatenate((none, often))),
                    pa.array(np.concatenate((spread, deal)).view(np.int64)),
                    pa.array(np.concatenate((np.zeros(k, np.uint64), ctx)).view(np.int64)),
                    pa.array(np.concatenate((kd, p["doc"][first]))),
                    *(pa.array(np.concatenate((a, b)).astype(np.int32)) for a, b in ((ks, p["start"][first]), (kn, p["n"][first]), (np.zeros(k, np.int64), p["off"][first]))),
                ],
                names=["known", "often", "deal", "ctx", "id", "start", "n", "off"],
            )

    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, doc_id, text binary) -> (id, doc_id, z): texts compressed before they are dealt out."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, "text", 4_000_000):
        z = [None if x is None else press.compress(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc_id"), pa.array(z, pa.binary())], names=["id", "doc_id", "z"])


def unpack(z: bytes | None) -> bytes:
    import zstandard

    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def _asked(batches: Iterator[pa.RecordBatch], m: Method) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(id, sequence of units, asks as rows of key, start, n, off) of every document that is asked for phrases."""
    for batch in slices(batches, "z", 400_000):
        for i, z, asks in zip(*(batch.column(x).to_pylist() for x in ("id", "z", "asks")), strict=True):
            yield i, m.sequence(unpack(z)), np.array([[a["deal"], a["start"], a["n"], a["off"]] for a in asks], np.int64)


def _pieces(m: Method) -> Callable:
    """mapInArrow function: the units that each phrase asked for covers with its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for i, seq, asks in _asked(batches, m):
            for key, s, n, off in asks.tolist():
                data = seq[s : s + n + m.window - 1].tobytes()
                size += len(data)
                rows.append((key, i, s, off, data))
            if size > 2_000_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, i, s, off, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, i, s, off)), pa.array(data, pa.binary())], names=["key", "id", "start", "off", "data"])


def _windows(m: Method) -> Callable:
    """mapInArrow function: each window asked for as (h1, h2, id, starts), once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, seq, asks in _asked(batches, m):
            starts = np.unique(np.concatenate([np.arange(s, s + n) for _, s, n, _ in asks.tolist()]))
            values = m.values(seq)
            h1, h2 = (tu.span_hashes(v, m.window)[0][starts] for v in (values, tu.mix(values)))
            o = np.lexsort((starts, h2, h1))
            a, b, s = h1[o], h2[o], starts[o]
            head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            # all places of a window in the first document that has it, or the first place alone
            last = np.concatenate((head[1:], [len(s)])) if m.across else head + 1
            for at in range(0, len(head), 100_000):
                h, e = head[at : at + 100_000], last[at : at + 100_000]
                lens = e - h
                ends = np.concatenate(([0], np.cumsum(lens)))
                places = s[np.repeat(h - ends[:-1], lens) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(a[h].view(np.int64)), pa.array(b[h].view(np.int64)), pa.array(np.full(len(h), i)), lists], names=["h1", "h2", "id", "starts"])

    return run


def repeated_ranges(spark: SparkSession, docs: DataFrame, m: Method) -> DataFrame:
    """(id, doc_id, z, spans): every document's packed text and its repeated windows.

    spans are structs (start, n, first): windows that are repeated, but for
    those of spans with `first`; null where nothing repeats.
    """
    tables = Tables(spark)
    plain = numbered(docs)
    parsed = plain.select("id", "text")
    frequent = spark.sparkContext.broadcast(frequent_triggers(parsed, m))
    found = parsed.mapInArrow(occurrences(m, frequent), "known boolean, often boolean, deal long, ctx long, id long, start int, n int, off int")
    same = W.partitionBy("deal", "ctx")
    by_deal = W.partitionBy("deal")
    rows = (
        found.repartition(F.col("deal"))
        .withColumn("place", F.rank().over(same.orderBy("id") if m.across else same.orderBy("id", "start")))
        .withColumn("lo", F.min("ctx").over(by_deal))
        .withColumn("hi", F.max("ctx").over(by_deal))
        .withColumn("size", F.count("*").over(by_deal))
    )
    sure = F.col("known") | (F.col("place") > 1)
    kind = F.when(sure, "sure").when(F.col("often") | (F.col("size") > GROUP), "often").when(F.col("lo") != F.col("hi"), "some")
    rows = tables.settle(rows.withColumn("kind", kind).where("kind is not null").select("kind", F.when(~sure, F.col("deal")).alias("deal"), "id", "start", "n", "off"))
    texts = plain.mapInArrow(packed, "id long, doc_id long, z binary")
    one = texts.select("id", "z")

    def asks(kind: str) -> DataFrame:
        own = rows.where(F.col("kind") == kind).select("id", F.struct("deal", "start", "n", "off").alias("ask"))
        return one.join(own.groupBy("id").agg(F.collect_list("ask").alias("asks")), "id")

    pieces = asks("some").mapInArrow(_pieces(m), "key long, id long, start long, off long, data binary")
    compared = pieces.repartition(width(spark), "key").sortWithinPartitions("key").mapInArrow(m.shard, "id long, start int, n int")
    spans = rows.where("kind = 'sure'").select("id", "start", "n").union(compared).withColumn("first", F.lit(False))
    often = rows.where("kind = 'often'")
    if not often.isEmpty():
        windows = asks("often").mapInArrow(_windows(m), "h1 long, h2 long, id long, starts array<int>")
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "starts")).alias("w")).select("w.id", F.explode("w.starts").alias("start"))
        spans = spans.union(often.select("id", "start", "n", F.lit(False))).union(first.select("id", "start", F.lit(1), F.lit(True)))
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "n", "first")).alias("spans"))
    return texts.join(spans, "id", "left")


def covered(spans: list[dict] | None, window: int, total: int) -> np.ndarray:
    """Boolean mask of the units of a document of `total` units that its repeated windows cover."""
    if not spans:
        return np.zeros(total, bool)
    s, n, first = (np.array([x[k] for x in spans], np.int64) for k in ("start", "n", "first"))
    plus = first == 0
    many = np.bincount(np.clip(s[plus], 0, total), minlength=total + 1) - np.bincount(np.clip(s[plus] + n[plus], 0, total), minlength=total + 1)
    again = np.cumsum(many[:total]) > 0
    again[s[~plus]] = False
    # a unit is covered if one of the `window` windows that end with it or begin at it is repeated
    seen = np.cumsum(again)
    seen[window:] -= seen[:-window].copy()
    return seen > 0


def merge_windows(ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """(id, start, n) of maximal runs of the windows given."""
    o = np.lexsort((starts, ids))
    ids, starts = ids[o], starts[o]
    cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + 1)))) if len(ids) else np.empty(0, np.int64)
    last = np.concatenate((cut[1:], [len(ids)])).astype(np.int64) - 1 if len(ids) else cut
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[cut]), pa.array(starts[cut].astype(np.int32)), pa.array((starts[last] - starts[cut] + 1).astype(np.int32))],
        names=["id", "start", "n"],
    )


__all__ = ["NULL_ID", "Method", "byte_sequence", "byte_units", "covered", "merge_windows", "repeated_ranges", "unpack", "word_sequence", "word_units"]
