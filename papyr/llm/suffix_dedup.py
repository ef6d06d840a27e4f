"""Suffix-array dedup of byte strings by prefix-free parsing.

Rolling-hash triggers cut every document into phrases that end with a trigger,
so that equal strings of WINDOW bytes are cut alike wherever they stand.  The
dictionary keeps one copy of each distinct phrase, the parse is the sequence of
phrases of every document.  A window begins in some suffix of a phrase, which
holds the phrase's trigger and is a prefix of no other such suffix, and goes on
in the phrases that follow.  So corpus order, down to WINDOW bytes, is the order
of (rank of the phrase suffix in the suffix array of the dictionary, rank of what
follows in the suffix array of the parse); neighbours in it whose common prefix
has WINDOW bytes are equal windows, and all but the first in the corpus go.

The order is made in shards of whole triggers (substring_dedup_base), since
equal windows have one trigger.  Parse suffixes that are equal down to the depth
that matters are one entry of the parse's array, settled while rows are dealt.
Order beyond WINDOW bytes cannot change a result and is not computed.

Defined results: a null text is empty; a text shorter than WINDOW has nothing
removed; rows repeated under one doc_id are one document and get equal rows; a
null doc_id sorts before all others; rows of one doc_id with different texts are
different documents, ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyr.llm import substring_dedup_base as base
from papyr.llm import textunits as tu
from papyr.llm.common import read, runs_by_key, slices

WINDOW = 100
#: Length of a trigger in bytes, and the divisor of its hash.
TRIGGER, MODULUS = 32, 64
#: Phrases whose order a shard makes at once.
SHARD_ROWS = 6_000


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Rank of symbols[i:ends[i]], cut at `depth` symbols or more, among all such strings; equal strings have one rank.

    Prefix doubling: ranks of 2n symbols come from sorting pairs of ranks of n;
    a string that ends first comes first.
    """
    n = len(symbols)
    room = ends - np.arange(n)
    rank = symbols.astype(np.int64)
    size = 1
    if symbols.dtype == np.uint8:  # seven bytes fit a number, with the string's length behind them
        rank = np.zeros(n, np.int64)
        for k in range(min(7, n)):
            rank[: n - k] |= np.where(room[: n - k] > k, symbols[k:], 0).astype(np.int64) << np.int64(8 * (6 - k) + 4)
        rank = np.unique(rank | np.minimum(room, 7), return_inverse=True)[1]
        size = 7
    while size < min(depth, n):
        follow = np.zeros(n, np.int64)
        follow[: n - size] = np.where(room[: n - size] > size, rank[size:] + 1, 0)
        rank = np.unique((rank << np.int64(32)) | follow, return_inverse=True)[1]
        size *= 2
    return rank


def phrases_behind(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, end) of the phrases that follow on: data[begin:end] of each row is cut behind every trigger that begins inside begin-TRIGGER+1..end-TRIGGER."""
    hashes = tu.span_hashes(tu.BYTE_VALUES[data], TRIGGER)[0]
    at = np.flatnonzero(tu.is_trigger(hashes, MODULUS)) + TRIGGER
    row = np.searchsorted(end, at, side="left")  # rows lie one after the other
    ok = row < len(end)
    at, row = at[ok], row[ok]
    ok = (at > begin[row]) & (at < end[row])
    full = np.flatnonzero(end > begin)
    row, at = np.concatenate((row[ok], full)), np.concatenate((at[ok], end[full]))
    o = np.lexsort((at, row))
    return row[o], at[o]


def equal_windows(data: np.ndarray, begin: np.ndarray, length: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, group) of every window of the rows data[begin:begin+length], in which a trigger stands at `off`.

    Windows of one group are equal, those of different groups are not.
    """
    end, join = begin + length, begin + off + TRIGGER
    # the parse: a first phrase for each row, cut at the row's first window, then those that follow up to the row's end
    row, stop = phrases_behind(data, join, end)
    start = np.where(np.concatenate(([True], row[1:] != row[:-1])), join[row], np.concatenate(([0], stop[:-1]))) if len(row) else stop
    ps, pe = np.concatenate((begin, start)), np.concatenate((join, stop))
    # the dictionary: distinct phrases one after the other, and its suffix array
    text = data.tobytes()
    ids: dict[bytes, int] = {}
    phrase = np.fromiter((ids.setdefault(text[a:b], len(ids)) for a, b in zip(ps.tolist(), pe.tolist(), strict=True)), np.int64, len(ps))
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    place = np.cumsum(lens) - lens
    rank = suffix_ranks(np.frombuffer(b"".join(ids), np.uint8), np.repeat(place + lens, lens), WINDOW)
    # the suffix array of the parse: what follows each row's first phrase, as ranks of phrases
    m = len(begin)
    count = np.bincount(row, minlength=m)
    first = np.cumsum(count) - count
    follow = suffix_ranks(rank[place[phrase[m:]]], np.repeat(first + count, count), int(count.max(initial=1)))
    own = np.full(m, -1, np.int64)
    own[count > 0] = follow[first[count > 0]]
    order = np.argsort(own, kind="stable")
    # common prefixes of neighbours in that order, in bytes
    reach = max(1, int((end - join).max(initial=0)))
    k = join[:, None] + np.arange(reach)[None, :]
    after = np.where(k < end[:, None], data[np.minimum(k, len(data) - 1)].astype(np.int16), -1)[order]
    differ = np.concatenate((np.ones((1, reach), bool), after[1:] != after[:-1]))
    common = np.where(differ.any(1), differ.argmax(1), reach)
    # for each number of bytes needed behind the trigger, the run of parse suffixes that share them
    runs = np.empty((m, reach + 1), np.int64)
    runs[order] = np.cumsum(common[:, None] < np.arange(reach + 1)[None, :], axis=0)
    n = length - WINDOW + 1
    r = np.repeat(np.arange(m), n)
    j = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
    need = WINDOW - (off[r] + TRIGGER - j)
    group = np.unique((rank[place[phrase[r]] + j] << np.int64(32)) | runs[r, need], return_inverse=True)[1]
    return r, j, group


def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows (id, start, n) of the phrases of whole triggers."""
    for t in runs_by_key(batches, "key", SHARD_ROWS):
        pieces = t.column("data").to_pylist()
        length = np.array([len(x) for x in pieces], np.int64)
        ids, starts, off = (t.column(c).to_numpy() for c in ("id", "start", "off"))
        row, j, group = equal_windows(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length, length, off)
        i, s = ids[row], starts[row] + j
        o = np.lexsort((s, i, group))
        g, i, s = group[o], i[o], s[o]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        first = np.repeat(head, np.diff(np.concatenate((head, [len(g)]))))
        again = (i != i[first]) | (s != s[first])
        yield base.merge_windows(i[again], s[again])


METHOD = base.Method(base.byte_units, base.byte_sequence, tu.byte_values, WINDOW, TRIGGER, MODULUS, False, shard)


def _cut(text: bytes, spans: list | None) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes kept)."""
    gone = base.covered(spans, WINDOW, len(text))
    edges = np.diff(np.concatenate(([False], gone)).astype(np.int8))
    return int(gone.sum()), int((edges == 1).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(spark: SparkSession, docs: DataFrame, digest: bool = False) -> DataFrame:
    """Texts without the bytes of strings of WINDOW bytes that start earlier in the corpus.

    Gives doc_id, n_bytes, n_removed, n_spans and, by `digest`, kept_sha256 or
    the kept bytes as `kept` (they may cut a UTF-8 sequence, so not a string).
    """
    kind = "kept_sha256 string" if digest else "kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "z", 500_000):
            rows = []
            for i, z, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "spans")), strict=True):
                text = base.unpack(z)
                gone, runs, kept = _cut(text, spans)
                rows.append((i, len(text), gone, runs, hashlib.sha256(kept).hexdigest() if digest else kept))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", kind.split()[0]],
            )

    return base.repeated_ranges(spark, docs, METHOD).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null text has 0 bytes and the digest of nothing; repeated rows give equal
    rows; an empty table gives none.
    """
    return remove_repeats(spark, read(spark, sf_dir, "documents"), digest=True)


#: DuckDB: texts as hexadecimal digits, two to a byte.
SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k
      FROM d, unnest(generate_series(0, len(h) // 2 - 100)) AS g(i) WHERE len(h) >= 200),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
s AS (SELECT doc_id, i FROM r WHERE n > 1),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
c AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prev FROM c),
p AS (SELECT k.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last,
             string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN p.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""
