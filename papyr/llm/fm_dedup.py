"""Substring dedup of word sequences by FM-indexes.

Windows of WINDOW words that also start in a document of smaller id are
removed.  Documents are parsed into phrases with word-level triggers
(substring_dedup_base), so that equal windows meet in one shard whatever the
number of documents.  Each shard keeps a compressed FM-index of its distinct
phrases (Burrows-Wheeler transform in a wavelet matrix of packed bits) and
streams the phrases of its documents through backward search.  For each place
where a window can end this gives the matching statistic: the length of the
longest sequence ending there that also stands in a document of smaller id.
Intervals of WINDOW words or more are reported.

A phrase that equals an earlier document's as a whole matches all along; its
statistics are known while phrases are dealt, and one copy of it is indexed.
Phrases whose trigger ends no other phrase match nothing else.

Defined results: a null text has no words; repeated rows of one doc_id are one
document; a null doc_id sorts first; rows of one doc_id with different texts are
different documents, ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyr.llm import substring_dedup_base as base
from papyr.llm.common import read, runs_by_key, slices

WINDOW = 13
#: Length of a trigger in words, and the divisor of its hash.
TRIGGER, MODULUS = 6, 8
#: Phrases that a shard indexes at once.
SHARD_ROWS = 6_000


class WaveletMatrix:
    """Rank of any symbol in a sequence, from packed bits and counts per 64 of them."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.base = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs in the first at[i] places."""
        return self._down(symbol, at) - self.base[symbol]


class FMIndex:
    """Of a collection of sequences; symbols are 1.., and 0 ends each sequence."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, n_symbols: int, longest: int):
        ends = text == 0
        n = len(text)
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum())).astype(np.int64)  # every end differs
        depth = 1
        while depth <= longest:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - depth] = rank[depth:]
            rank = np.unique((rank << np.int64(32)) | (nxt + 1), return_inverse=True)[1]
            depth *= 2
        order = np.argsort(rank)
        self.smallest = self._table(owner[order])
        counts = np.bincount(text, minlength=n_symbols)
        self.before = np.cumsum(counts) - counts
        self.bwt = WaveletMatrix(text[order - 1], n_symbols)
        self.n = n

    @staticmethod
    def _table(owner: np.ndarray) -> list[np.ndarray]:
        """Smallest owners of 1, 2, 4 ... suffixes in order."""
        table, size = [owner], 1
        while 2 * size <= len(owner):
            table.append(np.minimum(table[-1][:-size], table[-1][size:]))
            size *= 2
        return table

    def smallest_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the suffixes lo..hi-1; no interval is empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            x = level == k
            out[x] = np.minimum(self.smallest[k][lo[x]], self.smallest[k][hi[x] - (1 << int(k))])
        return out

    def matching(self, text: np.ndarray, ends: np.ndarray, room: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Matching statistics: how long the longest text[e-k:e] is, k at most room, that stands in a sequence of an owner smaller than its own.

        Backward search from every end at once; a search stops when its interval
        is empty or holds no smaller owner, as longer ones hold fewer suffixes.
        """
        length = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(room > 0)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        k = 0
        while len(live):
            k += 1
            c = text[ends[live] - k]
            lo, hi = self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)
            ok = np.flatnonzero(hi > lo)
            ok = ok[self.smallest_owner(lo[ok], hi[ok]) < owner[live[ok]]]
            live, lo, hi = live[ok], lo[ok], hi[ok]
            length[live] = k
            more = room[live] > k
            live, lo, hi = live[more], lo[more], hi[more]
        return length


def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows (id, start, n) of the phrases of whole triggers."""
    for t in runs_by_key(batches, "key", SHARD_ROWS):
        pieces = t.column("data").to_pylist()
        lens = np.array([len(x) // 8 for x in pieces], np.int64)
        words, symbols = np.unique(np.frombuffer(b"".join(pieces), np.uint64), return_inverse=True)
        begin = np.cumsum(lens + 1) - lens - 1
        text = np.zeros(int(lens.sum()) + len(pieces), np.int64)
        piece = np.repeat(np.arange(len(pieces)), lens)
        place = np.arange(len(symbols)) + piece
        text[place] = symbols + 1
        ids = t.column("id").to_numpy()
        index = FMIndex(text, np.repeat(ids, lens + 1), len(words) + 1, int(lens.max()))
        room = place + 1 - begin[piece]
        full = room >= WINDOW  # a window can end here
        end, piece, room = place[full] + 1, piece[full], room[full]
        length = index.matching(text, end, room, ids[piece])
        hit = length >= WINDOW
        # the windows inside a match, from its start on; nearly all matches end one after the other
        n = length[hit] - WINDOW + 1
        start = (t.column("start").to_numpy()[piece] + room - WINDOW)[hit]
        back = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        who, at = np.repeat(ids[piece][hit], n), np.repeat(start, n) - back
        if len(at):
            new = np.unique(np.stack((who, at), 1), axis=0)
            who, at = new[:, 0], new[:, 1]
        yield base.merge_windows(who, at)


METHOD = base.Method(base.word_units, base.word_sequence, np.asarray, WINDOW, TRIGGER, MODULUS, True, shard)


def remove_repeats(spark: SparkSession, docs: DataFrame, digest: bool = False) -> DataFrame:
    """Words outside windows that start in a smaller document, joined by a space.

    Gives doc_id, n_words, n_removed and, by `digest`, kept_sha256 or `kept`.
    """
    kind = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "z", 500_000):
            rows = []
            for i, z, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "spans")), strict=True):
                words = base.unpack(z).split()
                total, gone = len(words), 0
                if spans:
                    out = base.covered(spans, WINDOW, total)
                    gone = int(out.sum())
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                rows.append((i, total, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", kind],
            )

    return base.repeated_ranges(spark, docs, METHOD).mapInArrow(run, f"doc_id long, n_words long, n_removed long, {kind} string")


def op8_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A null text has no words and the digest of nothing; repeated rows give equal
    rows; an empty table gives none.
    """
    return remove_repeats(spark, read(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 12], ' ')) AS k
      FROM d, unnest(generate_series(1, len(w) - 12)) AS g(i) WHERE len(w) >= 13),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM x),
s AS (SELECT DISTINCT doc_id, i + o AS j FROM m, unnest(generate_series(0, 12)) AS g(o) WHERE first < doc_id),
v AS (SELECT doc_id, w[j] AS word, j FROM d, unnest(generate_series(1, len(w))) AS g(j)),
k AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM v ANTI JOIN s USING (doc_id, j) GROUP BY v.doc_id),
n AS (SELECT doc_id, count(*) AS gone FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
