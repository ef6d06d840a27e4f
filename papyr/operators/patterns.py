"""Many fixed patterns in texts at once: a table of patterns met by windows of the texts that a filter lets through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters by which a pattern is looked for; what a longer one has beyond them is compared afterwards.
GRAM = 32
#: Patterns up to which their table is broadcast; a pattern of over LONGEST characters is refused.
BROADCAST, LONGEST = 200_000, 4096
#: Bits of the filter: for each pattern, and at most; bits that a window must find set.
BITS, MOST_BITS, PROBES = 32, 2**26, 4
#: Bytes of texts worked on together, and places of them.
SLICE, BLOCK = 1_000_000, 2**16

_BASE, _ODD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _powers(base: int, n: int) -> np.ndarray:
    own = np.full(n, base, np.uint64)
    own[0] = 1
    return np.cumprod(own, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(29))


class _Hashes:
    """Hashes of all windows of a block of code points, from one running sum."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, BLOCK + GRAM), _powers(pow(_BASE, -1, 2**64), BLOCK + GRAM)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        own = _mixed(codes.astype(np.uint64) + np.uint64(_BASE)) * self.up[: len(codes)]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)))

    def windows(self, sums: np.ndarray, size: int, places: int) -> np.ndarray:
        return _mixed((sums[size : size + places] - sums[:places]) * self.down[:places])


def _layout(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First bit and number of bits for the patterns of each size; all fit MOST_BITS and one word a size."""
    total, at, out = sum(counts.values()), 0, {}
    for size, n in sorted(counts.items()):
        bits = 64 * (min(BITS * n, MOST_BITS * n // total) // 64 + 1)
        out[size] = (at, bits)
        at += bits
    return out


def _bit(h: np.ndarray, probe: int, first: int, bits: int) -> np.ndarray:
    h = h if probe == 0 else _mixed(h + np.uint64(probe))
    return np.uint64(first) + (((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(layout: dict[int, tuple[int, int]]):
    """mapInArrow function: (slot, word) of the filter's bits for patterns' first characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK // GRAM):
                grams = batch.column("_gram").slice(at, BLOCK // GRAM).to_pylist()
                sizes = np.fromiter(map(len, grams), np.int64, len(grams))
                starts = np.cumsum(sizes) - sizes
                sums, found = hashes.sums(_codes("".join(grams))), []
                for size, (first, bits) in layout.items():
                    h = hashes.windows(sums, size, max(0, len(sums) - size))[starts[sizes == size]]
                    found += [_bit(h, k, first, bits) for k in range(PROBES)]
                bit = np.unique(np.concatenate(found))
                slot, head = np.unique(bit >> np.uint64(6), return_index=True)
                word = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), head)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(word.view(np.int64))], names=["slot", "word"])

    return run


def _passed(texts: list[str], layout: dict[int, tuple[int, int]], words: np.ndarray, hashes: _Hashes) -> Iterator[tuple[int, np.ndarray]]:
    """(size, places in the joined texts) of windows within one text that the filter lets through."""
    codes = _codes("".join(texts))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + GRAM - 1]
        sums = hashes.sums(part)
        for size, (first, bits) in layout.items():
            places = min(BLOCK, len(part) - size + 1)
            if places <= 0:
                continue
            h, live = hashes.windows(sums, size, places), None
            for k in range(PROBES):
                bit = _bit(h, k, first, bits)
                keep = np.flatnonzero((words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                h, live = h[keep], keep if live is None else live[keep]
            live += at
            yield size, live[live + size <= ends[np.searchsorted(ends, live, "right")]]


def _scan(key: str, layout: dict[int, tuple[int, int]], most: dict[int, int], filled, once: bool):
    """mapInArrow function: (key, at, _gram, _window) of the windows that may begin a pattern.

    _window is null where patterns of that size end with it.  once: only one of
    a text's equal windows, where patterns of that size end with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashes = filled.value, _Hashes()
        for batch in batches:
            for part in _by_bytes(batch):
                texts = [x or "" for x in part.column("_text").to_pylist()]
                joined, sizes = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
                starts = np.cumsum(sizes) - sizes
                rows, ats, grams, windows = [], [], [], []
                for size, places in _passed(texts, layout, words, hashes):
                    row = np.searchsorted(starts + sizes, places, "right")
                    own = [joined[p : p + size] for p in places.tolist()]
                    rows += row.tolist()
                    ats += (places - starts[row]).tolist()
                    grams += own
                    # what stands behind goes no further than the text
                    windows += [None] * len(own) if most[size] == size else [texts[r][a : a + most[size]] for r, a in zip(row.tolist(), (places - starts[row]).tolist(), strict=True)]
                if once:
                    seen = {(r, g, None if w is None else a): i for i, (r, a, g, w) in enumerate(zip(rows, ats, grams, windows, strict=True))}
                    rows, ats, grams, windows = ([x[i] for i in seen.values()] for x in (rows, ats, grams, windows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(rows, pa.int64())), pa.array(ats, pa.int64()), pa.array(grams, pa.string()), pa.array(windows, pa.string())],
                    names=[key, "at", "_gram", "_window"],
                )

    return run


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows by about SLICE bytes of text, or one row."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")) - at)
        yield batch.slice(at, n)
        at += n


def _candidates(texts: DataFrame, key: str, text: str, known: DataFrame, once: bool) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """The windows of `texts` that may begin one of the `known` (_gram, _n), and by size of the first characters their number and their longest's length."""
    spark = texts.sparkSession
    rows = known.groupBy(F.length("_gram").alias("size")).agg(F.count("*").alias("n"), F.max("_n").alias("most")).collect()
    counts, most = {r["size"]: r["n"] for r in rows}, {r["size"]: r["most"] for r in rows}
    if any(m > LONGEST for m in most.values()):
        raise ValueError(f"a pattern of {max(most.values())} characters; the most is {LONGEST}")
    layout = _layout(counts) if counts else {}
    words = np.zeros(sum(bits for _, bits in layout.values()) // 64, np.uint64)
    if layout:
        filter_ = known.select("_gram").mapInArrow(_words(layout), "slot int, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
        words[filter_.column("slot").to_numpy()] = filter_.column("word").to_numpy().view(np.uint64)
    filled = spark.sparkContext.broadcast(words)
    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(F.col(key), F.col(text).alias("_text")).mapInArrow(
        _scan(key, layout, most, filled, once), f"`{key}` {kind}, at long, _gram string, _window string"
    )
    return found, counts, most


def _known(patterns: DataFrame) -> DataFrame:
    return patterns.where(F.length("pattern") > 0).select("*", F.length("pattern").alias("_n"), F.substring("pattern", 1, GRAM).alias("_gram"))


def pattern_hits(texts: DataFrame, patterns: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pattern_id, at): where each of many patterns (pattern_id, pattern) stands in each text (key, text), from 0, overlaps too.

    Every place of a text asks a filter of bounded size once for each length of
    patterns (all over GRAM count as one), by a hash of that many characters
    from there; only what it lets through is met with the patterns, by the
    characters themselves.  So what is moved grows with the hits and not with
    the texts.  Null and empty patterns and null texts give nothing; equal
    patterns each give their rows.
    """
    known = _known(patterns)
    found, counts, _ = _candidates(texts, key, text, known, once=False)
    few = sum(counts.values()) <= BROADCAST
    hits = found.join(F.broadcast(known) if few else known.hint("merge"), "_gram")
    return hits.where((F.col("_n") <= GRAM) | F.col("_window").startswith(F.col("pattern"))).select(key, "pattern_id", "at")


def pattern_counts(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n): in how many rows of `texts` each different pattern of `patterns` (pattern) stands; those in none are left out.

    Equal windows of a text are told in the task that reads it and counted
    before the shuffle, so copies of texts and of patterns make no pairs.
    """
    known = _known(patterns.select("pattern").distinct())
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    found, _, most = _candidates(rows, "_row", "_text", known, once=True)
    by_gram = found.where("_window is null").groupBy("_gram").agg(F.count("*").alias("n"))
    out = known.where(F.col("_n") <= GRAM).join(by_gram, "_gram").select("pattern", "n") if most.get(GRAM, GRAM) == GRAM else None
    if out is None:
        # patterns of GRAM characters and longer ones have the same windows
        long = found.where("_window is not null").join(known.where(F.length("_gram") == GRAM), "_gram").where(F.col("_window").startswith(F.col("pattern")))
        counted = long.select("_row", "pattern").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
        out = known.where(F.col("_n") < GRAM).join(by_gram, "_gram").select("pattern", "n").union(counted)
    return out
