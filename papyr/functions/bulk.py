"""text.clean for many texts at once: the same steps by numpy on the code points of a batch.

A search for each pattern asks every character of every text some ten times; on
arrays a step is a few operations over all of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyr.functions import charclass as cc

#: Characters that are taken at once; a longer text is taken alone.
AT_ONCE = 1 << 17
#: Stands behind each text.
END = 0x110000
NOISE, KOREAN, ALLOWED, SPACE, SHORT, WORD, BARE, SIGN, MARK, STOP = (1 << i for i in range(10))
#: Classes of ASCII_NOISE and how long a run of each is deleted, in order.
RUNS = [(1 << 10 + i, p.rpartition("{")[0], int(p.rpartition("{")[2][:-2])) for i, p in enumerate(cc.ASCII_NOISE)]


def _table() -> np.ndarray:
    """The classes of each code point as bits."""
    bits = np.zeros(END + 1, np.uint32)
    for bit, cls in ((NOISE, cc.NOISE), (KOREAN, cc.KOREAN), (ALLOWED, cc.ALLOWED)):
        for first, last in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", cls):
            bits[int(first, 16) : int(last or first, 16) + 1] |= bit
    for bit, chars in ((ALLOWED, "\n\r\t"), (SPACE, cc.SPACES), (BARE, ".,:/-"), (SIGN, "#$%&*+=-<>?!@'\"()[]{}.,;:"), (MARK, "※→←↔⇒")):
        bits[[ord(c) for c in chars]] |= bit
    for c in map(chr, range(128)):
        bits[ord(c)] |= sum(bit for bit, cls, _ in RUNS if re.match(cls, c)) | (SHORT if c.isalnum() else 0)
    # letters and numbers are asked for behind the step that leaves allowed characters alone
    own = np.flatnonzero(bits & ALLOWED)
    bits[own[[unicodedata.category(chr(c))[0] in "LN" for c in own]]] |= WORD | BARE
    bits[END] = STOP
    return bits


def _runs(mask: np.ndarray, n: int) -> np.ndarray | None:
    """The places of runs of n or more, or None."""
    at, have = mask, 1
    while have < n:
        step = min(have, n - have)
        at, have = at[:-step] & at[step:], have + step
    if not at.any():
        return None
    out, have = np.concatenate((at, np.zeros(n - 1, bool)))[: len(mask)], 1
    while have < n:
        step = min(have, n - have)
        out[step:] |= out[:-step].copy()
        have += step
    return out


def _meaningful(codes: np.ndarray, bits: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """text.meaningful of the tokens between each two edges."""
    start, n = edges[::2], edges[1::2] - edges[::2]
    some, every = (f.reduceat(bits, edges)[::2] for f in (np.bitwise_or, np.bitwise_and))
    korean = (some & KOREAN) != 0
    bare = ((every & BARE) != 0) & ((some & WORD) != 0) & (n <= 10)
    keep = np.where(korean, n <= 10, bare | (((every & SHORT) != 0) & (n <= 4)) | (((every & SIGN) != 0) & (n <= 2)) | (((every & MARK) != 0) & (n == 1)))
    asked = np.flatnonzero(korean & (n > 10))
    if len(asked):
        share = np.add.reduceat((bits & KOREAN) != 0, np.column_stack((start[asked], start[asked] + n[asked])).ravel(), dtype=np.int64)[::2] / n[asked]
        keep[asked] = share >= 0.1
    asked = np.flatnonzero(keep & ~korean & (n > 4))
    if len(asked):
        place = np.arange(10)
        token = np.where(place < n[asked, None], codes[np.minimum(start[asked, None] + place, len(codes) - 1)], END)
        token.sort(axis=1)
        kinds = 1 + (token[:, 1:] != token[:, :-1]).sum(axis=1) - (n[asked] < 10)
        keep[asked[1 - kinds / n[asked] > 0.5]] = False
    return keep


def cleaned(texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """text.clean of each and text.korean_ratio of that; the steps are those of text, in their order."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32).copy()
    codes[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1] = END
    bits = table[codes]

    def drop(places: np.ndarray | None) -> None:
        nonlocal codes, bits
        if places is not None and places.any():
            codes, bits = codes[~places], bits[~places]

    drop((bits & NOISE) != 0)
    same = _runs((codes[1:] == codes[:-1]) & (codes[1:] != END), 3)
    if same is not None:
        drop(np.append(same, False) | np.insert(same, 0, False))
    for bit, _, least in RUNS:
        drop(_runs((bits & bit) != 0, least))
    drop(_runs((bits & (KOREAN | STOP)) == 0, 11))
    other = (bits & (ALLOWED | STOP)) == 0
    drop(other & ((bits & SPACE) == 0))  # other white space parts tokens like a space

    ink = (bits & (SPACE | STOP)) == 0
    edges = np.flatnonzero(np.diff(ink, prepend=False))
    if not len(edges):
        return [""] * len(texts), np.zeros(len(texts))
    keep = _meaningful(codes, bits, edges)
    first, last = edges[::2][keep], edges[1::2][keep]
    step = np.zeros(len(codes), np.int8)
    step[first], step[last] = 1, -1
    left = np.cumsum(step, dtype=np.int8).astype(bool)
    text = np.searchsorted(np.flatnonzero(bits & STOP), first)
    between = last[:-1][text[1:] == text[:-1]]
    codes[between], left[between] = 32, True
    drop(~left & ((bits & STOP) == 0))

    stops = np.flatnonzero(bits & STOP)
    begin = np.append(0, stops[:-1] + 1)
    korean, blanks = (np.add.reduceat((bits & bit) != 0, begin, dtype=np.int64) for bit in (KOREAN, SPACE))
    n = stops - begin
    ratio = korean / np.maximum(n - blanks, 1)
    passed = (n >= 10) & (ratio >= 0.05)
    codes[stops] = 10  # no text holds a line end any more
    return [x if ok else "" for x, ok in zip(codes.tobytes().decode("utf-32-le").split("\n"), passed.tolist())], np.where(passed, ratio, 0.0)


def _portions(texts: Iterable[str]) -> Iterator[list[str]]:
    portion, n = [], 0
    for x in texts:
        if portion and n + len(x) > AT_ONCE:
            yield portion
            portion, n = [], 0
        portion.append(x)
        n += len(x) + 1
    if portion:
        yield portion


def _of_batches(batches: Iterator[pa.Array]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and ratios of each batch."""
    table = _table()
    for batch in batches:
        # equal texts of a batch are cleaned once, and few are Python's strings at a time
        known = batch.dictionary_encode()
        texts = (x for i in range(0, len(known.dictionary), 100) for x in known.dictionary.slice(i, 100).to_pylist())
        out, ratios = [pa.array([], batch.type)], [np.zeros(0)]
        for portion in _portions(texts):
            own, ratio = cleaned(portion, table)
            out.append(pa.array(own, batch.type))
            ratios.append(ratio)
        yield pa.concat_arrays(out).take(known.indices), pa.array(np.concatenate(ratios)).take(known.indices)


def _cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return (texts for texts, _ in _of_batches(batches))


def _rated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return (pa.StructArray.from_arrays(both, ["text", "ratio"]) for both in _of_batches(batches))


def _sent(f: Callable, c: Column, kind: str) -> Column:
    return F.arrow_udf(f, kind)(F.make_valid_utf8(F.coalesce(c, F.lit(""))))


def clean(c: Column) -> Column:
    """text.clean, sent to Python by Arrow batches."""
    return _sent(_cleaned, c, "string")


def rated(c: Column) -> Column:
    """(text, ratio): text.clean and text.korean_ratio of that."""
    return _sent(_rated, c, "text string, ratio double")
