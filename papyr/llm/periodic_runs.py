"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q, of length
max(6, 4q) or more, that neither neighbour extends.  A run of period q and
length l holds every one of its k-grams twice where l >= 2q + k - 1, and each
of its words lies in one of them.  The least overlap l - q of a run with
itself is 5, and with k = 5 that bound holds for all periods; so words outside
the k-grams that a document repeats can't join runs.  They cut the document
into segments, mostly short ones.

Main-Lorentz halves each segment again and again and looks for the runs that
cross a middle: for every period the words around the middle are compared with
those a period further on, to the right and to the left.  All middles of a
level of all segments of a batch, and all their periods, are worked through
together.  Lengths of equal words come from names of words' powers of two:
names are equal where the words are, so no hash is trusted.

A document is one row and is worked on in one task, in memory of about 4 log n
bytes for each of its n words that lie in repeated k-grams.

Defined results: a null or empty text has no words; a null doc_id stays null
and leaves its text as it is; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyr.llm.common import read, slices
from papyr.llm.textunits import WORD_BYTES, token_array

#: Fewest words and fewest periods of a run.
LEAST, TIMES = 6, 4
#: Words that a run repeats of itself at least: the k of the k-grams.
K = 5
BATCH_BYTES = 4_000_000

OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def renamed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Small whole numbers for pairs (a, b) of such numbers, equal where both are."""
    if not len(a):
        return a
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int32)


def powers(words: np.ndarray, most: int) -> list[np.ndarray]:
    """names[j][i]: a number for words[i : i + 2**j], for each j up to 2**j <= most."""
    names = [words.astype(np.int32)]
    while 1 << len(names) <= most:
        half = 1 << (len(names) - 1)
        last = names[-1]
        names.append(renamed(last[:-half], last[half:]))
    return names


def survivors(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a k-gram that their document holds twice."""
    n = len(words) - K + 1
    out = np.zeros(len(words), bool)
    if n <= 0:
        return out
    two = renamed(words[:-1], words[1:])
    four = renamed(two[:-2], two[2:])
    gram = renamed(renamed(four[:n], words[K - 1 :]), doc[:n])
    twice = (np.bincount(gram)[gram] > 1) & (doc[:n] == doc[K - 1 :])
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + K] -= 1
    return np.cumsum(edge[:-1]) > 0


def forward(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many words from a on equal those from b on, a < b, before b reaches stop."""
    n = np.zeros(len(a), np.int64)
    for j in range(len(names) - 1, -1, -1):
        fits = np.flatnonzero(b + n + (1 << j) <= stop)
        x = fits[names[j][a[fits] + n[fits]] == names[j][b[fits] + n[fits]]]
        n[x] += 1 << j
    return n


def backward(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many words before a equal those before b, a < b, until a reaches stop."""
    n = np.zeros(len(a), np.int64)
    for j in range(len(names) - 1, -1, -1):
        size = 1 << j
        fits = np.flatnonzero(a - n - size >= stop)
        x = fits[names[j][a[fits] - n[fits] - size] == names[j][b[fits] - n[fits] - size]]
        n[x] += size
    return n


def main_lorentz(words: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs of the segments words[head:end].

    At each level the runs found are those that cross the middle of a part and
    lie in it; a stretch that reaches the part's edge inside its segment may go
    on, and is then found whole where that edge was a middle.
    """
    large = ends - heads >= LEAST
    lo, hi = heads[large], ends[large]
    found = [np.empty((0, 3), np.int64)]
    if not len(lo):
        return found[0]
    names = powers(words, int((hi - lo).max()))
    while len(lo):
        mid = (lo + hi) // 2
        # a run of period p holds the middle and p words more to its right, or its left
        periods = (hi - lo) // TIMES
        part = np.repeat(np.arange(len(lo)), periods)
        p = np.arange(len(part)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        for right in (True, False):
            a = mid[part] - (0 if right else p)
            b = a + p
            fits = np.flatnonzero((b < hi[part]) & (a >= lo[part]))
            near = fits[words[a[fits]] == words[b[fits]]]
            a, b, own, q = a[near], b[near], part[near], p[near]
            end = b + forward(names, a, b, hi[own])
            start = a - backward(names, a, b, lo[own])
            ok = end - start >= np.maximum(LEAST, TIMES * q)
            found.append(np.stack((start[ok], end[ok], q[ok]), axis=1))
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        keep = hi - lo >= LEAST
        lo, hi = lo[keep], hi[keep]
    rows = np.concatenate(found)
    # maximal within the words of the document: those beside a segment can't extend a run
    head, end = heads[np.searchsorted(heads, rows[:, 0], "right") - 1], ends[np.searchsorted(ends, rows[:, 1])]
    s, e, q = rows.T
    longer = (s > head) & (words[np.maximum(s - 1, 0)] == words[np.maximum(s - 1, 0) + q])
    longer |= (e < end) & (words[np.minimum(e, len(words) - 1)] == words[np.minimum(e, len(words) - 1) - q])
    rows = rows[~longer]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # multiples of the smallest period give the same stretch
    first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.empty(0, bool)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), places in the batch, of all runs of the documents; words are numbers, doc their documents in order."""
    alive = survivors(words, doc)
    at = np.flatnonzero(alive)
    if not len(at):
        return np.empty((0, 3), np.int64)
    # what survives, packed; a segment ends where places jump or the document changes
    new = np.concatenate(([True], (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])))
    heads = np.flatnonzero(new)
    ends = np.concatenate((heads[1:], [len(at)]))
    rows = main_lorentz(words[at], heads, ends)
    rows[:, 1] = at[rows[:, 1] - 1] + 1
    rows[:, 0] = at[rows[:, 0]]
    return rows


def seeded(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Places of the words that a document has after its tail is made periodic, if its number asks for that."""
    n = len(words)
    place = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[a:] = a + (place[a:] - a) % p
    return place


def digest(rows: np.ndarray, words: list[bytes]) -> tuple:
    """The result columns of a document from its runs, places in the document."""
    s, e, q = rows.T
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, s + q, 1)
    np.add.at(edge, e, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    best = (None,) * 4
    if len(rows):
        # ratios of numbers under 2**26 differ as doubles where they differ
        i = np.lexsort((q, s, -((e - s) / q)))[0]
        best = int(s[i]), int(e[i] - s[i]), int(q[i]), int(1000 * (e[i] - s[i]) // q[i])
    listed = "".join(f"{a},{b - a},{c}\n" for a, b, c in rows.tolist())
    kept = words if not dropped.any() else [w for w, d in zip(words, dropped.tolist(), strict=True) if not d]
    return (len(rows), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), int(dropped.sum()))


def detect(docs: DataFrame, place=seeded) -> DataFrame:
    """A row for each document with its runs; `place` gives, of a document's words and doc_id, the places of the words to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id").to_pylist()
            tokens, n = token_array(batch.column("text"), WORD_BYTES, False)
            coded = tokens.dictionary_encode()
            code, listed = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            ends = np.cumsum(n)
            code = np.concatenate([np.empty(0, code.dtype), *(code[e - k : e][place(code[e - k : e], i)] for e, k, i in zip(ends, n, ids, strict=True))])
            rows = runs_of(code, np.repeat(np.arange(len(n)), n))
            cut = np.searchsorted(rows[:, 0], np.concatenate((ends - n, ends[-1:])))
            names = [listed[c] for c in code.tolist()]
            out = [digest(rows[cut[i] : cut[i + 1]] - np.array([e - k, e - k, 0]), names[e - k : e]) for i, (e, k) in enumerate(zip(ends, n, strict=True))]
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, OUT)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its runs, after the tail of about one in ten is made periodic.

    Empty and null texts have no runs, four nulls and the digests of nothing;
    an empty table gives no rows.
    """
    return detect(read(spark, sf_dir, "documents"))
