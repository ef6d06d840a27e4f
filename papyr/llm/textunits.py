"""Vectorised hashing and prefix-free parsing of byte and word sequences.

A batch of documents is laid out as one flat array of 64-bit unit values (one
per byte or per word).  Every function here is a pure numpy function of that
array, so a value depends only on the units it covers and never on the batch,
the partition or the executor in which it was computed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit values."""
    x = x + _M1
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of an ordered pair of hashes."""
    x = a * _M2 + ((b << U(23)) | (b >> U(41))) * _M1
    x ^= x >> U(29)
    x *= _M3
    x ^= x >> U(32)
    return x


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return BYTE_VALUES[data]


_POSITION = mix(np.arange(1 << 12, dtype=np.uint64) + U(1 << 20)) | U(1)


def span_hashes(units: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length k the hash of units[i:i+k] for every i that has k units.

    Rolling hashes are evaluated by doubling: the hash of 2n units is the fold
    of two neighbouring hashes of n units, so all lengths share their powers.
    """
    out: list[np.ndarray | None] = [None] * len(lengths)
    done = [0] * len(lengths)
    power, size = units, 1
    while True:
        for j, k in enumerate(lengths):
            if k & size:
                n = len(units) - (done[j] + size) + 1
                if n <= 0:
                    out[j], done[j] = units[:0], done[j] + size
                else:
                    part = power[done[j] : done[j] + n]
                    out[j] = part.copy() if out[j] is None else fold(out[j][:n], part)
                    done[j] += size
        size *= 2
        if size > max(lengths):
            return out
        power = fold(power[:-size // 2], power[size // 2 :]) if len(power) > size // 2 else power[:0]


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of values[i:i+width], for every full window i."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int32)
    best, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        size += step
    return at[:n]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes outside 0x20, 0x09-0x0D."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of every word data[start:end]; words are not empty and in order."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    keep = np.repeat(np.arange(len(starts)), length)
    flat = np.arange(len(keep)) - np.repeat(np.cumsum(length) - length, length)
    value = BYTE_VALUES[data[starts[keep] + flat]] * _POSITION[flat & 4095]
    if len(flat) and flat.max() >= 4096:
        value = fold(value, (flat >> 12).astype(np.uint64))
    sums = np.add.reduceat(value, np.cumsum(length) - length)
    return mix(sums + length.astype(np.uint64) * _M3)


def parse(units: np.ndarray, doc_of: np.ndarray, window: int, trigger: int, modulus: int) -> dict[str, np.ndarray]:
    """Prefix-free parse of a flat batch into phrases that end with a trigger.

    A trigger is a span of `trigger` units whose rolling hash is divisible by
    `modulus`, a power of two.  A window of `window` units belongs to the first trigger inside
    it, or to its leftmost smallest rolling hash where it holds none.  That
    depends on the window's units alone, so equal windows belong to equal
    triggers at equal offsets, anywhere in the corpus.  Windows of one trigger
    are consecutive and form a row: trig and ctx (64-bit hashes of the trigger
    and of the union of the windows, that is the phrase and what follows it up
    to a window's length), first and n (flat index of the first window, number
    of windows), off (from the first window to the trigger).  No window crosses
    a document.
    """
    n = len(units) - window + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return {"trig": z.view(np.uint64), "ctx": z.view(np.uint64), "first": z, "n": z, "off": z}
    short, whole = span_hashes(units, trigger, window)
    value = mix(short)
    value[(value & U(modulus - 1)) == 0] = 0
    own = leftmost_minimum(value, window - trigger + 1)[:n]
    inside = doc_of[:n] == doc_of[window - 1 :]
    key = np.where(inside, own, -1)
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc_of[1:n] != doc_of[: n - 1]))))
    size = np.diff(np.concatenate((cut, [n])))
    ok = key[cut] >= 0
    first, size = cut[ok], size[ok]
    ctx = fold(fold(whole[first], whole[first + size - 1]), size.astype(np.uint64))
    return {"trig": short[own[first]], "ctx": ctx, "first": first, "n": size, "off": own[first] - first}


def is_trigger(hashes: np.ndarray, modulus: int) -> np.ndarray:
    """Which rolling hashes of spans, as span_hashes gives them, are triggers."""
    return (mix(hashes) & U(modulus - 1)) == 0


#: Bytes of words as most operators take them, `[^\x20\x09-\x0D]+`, and of terms: letters and digits of ASCII and all other characters.
WORD_BYTES = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
TERM_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def token_array(texts: pa.Array, kept: np.ndarray, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of `kept` bytes of all texts, one after another, and how many each text has; a null text has none.

    lower: A-Z become a-z.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = at[0] if len(at) else 0
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[base : at[-1]] if raw is not None and len(at) else np.empty(0, np.uint8)
    at = at - base
    inside = np.concatenate((kept[data], [False]))
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    before[at[:-1]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    held = data[inside[:-1]]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(_LOWER[held] if lower else held))]
    )
    return words, np.diff(np.searchsorted(starts, at))
