"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A leaf of the tree holds the rank of the pair that starts at its symbol; the
root holds the smallest (rank, position), so it yields the leftmost merge of
lowest rank.  A merge changes three leaves, each in logarithmic time, until no
pair can be merged.  Words repeat, so results are kept by word in a bounded
table of each worker; the words of a batch that it lacks are merged together,
with a tree as the row of a matrix for each word.

The vocabulary is read from a tokenizer file by the driver and broadcast; its
size is that of the file.  With it go the letters, numbers and capitals of the
tokenizers library's own Unicode tables, which are of another version than
Python's.  Supported: BPE models with NFC, whitespace and
lower-case normalisers, a removing or isolating split by a pattern, byte-level
symbols, an end-of-word suffix and added special tokens.

Defined results: a null text is empty and has no tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyr.llm.common import process_state, read, slices

_NONE = 1 << 62
#: Where read_spec puts the library's tables.
_TABLES = "_library_tables"
#: Bytes of the words, and of their ids, that a worker keeps, and what each costs beside.
CACHE_BYTES, CACHE_ROW = 48_000_000, 200
#: Leaves of the largest tree that is a row of a matrix, and leaves of such a matrix.
ROW_LEAVES, MATRIX_LEAVES = 64, 1 << 17
#: Bytes of text whose words are looked up together.
GROUP = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """All merges of a word, lowest rank first and leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = ranks.get((symbols[i], symbols[i + 1]))
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    symbols = list(symbols)
    while tree[1] != _NONE:
        i = tree[1] % n
        j = right[i]
        symbols[i] += symbols[j]
        symbols[j] = ""
        nxt = right[j]
        right[i] = nxt
        if j < n - 1:
            put(j, _NONE)
        if nxt < n:
            left[nxt] = i
            r = ranks.get((symbols[i], symbols[nxt]))
            put(i, _NONE if r is None else r * n + i)
        else:
            put(i, _NONE)
        p = left[i]
        if p >= 0:
            r = ranks.get((symbols[p], symbols[i]))
            put(p, _NONE if r is None else r * n + p)
    return [s for s in symbols if s]


class Pairs:
    """Symbols by number, and the rank and product of each pair of them that merges."""

    def __init__(self, ranks: dict[tuple[str, str], int], first: list[str], last: list[str]):
        """first, last: the symbols of each byte inside a word and at its end."""
        number: dict[str, int] = {}
        of = lambda s: number.setdefault(s, len(number))
        self.first, self.last = (np.array([of(s) for s in x]) for x in (first, last))
        rows = [(of(a), of(b), of(a + b), r) for (a, b), r in ranks.items()]
        self.names, self.none = list(number), len(number)
        a, b, product, rank = np.array(rows, np.int64).reshape(-1, 4).T
        key = a * (self.none + 1) + b
        order = np.argsort(key)
        # the last key is that of no pair, so a search always finds a place
        self.key, self.rank = np.append(key[order], np.iinfo(np.int64).max), np.append(rank[order], 0)
        self.product = np.zeros(rank.max(initial=0) + 1, np.int64)
        self.product[rank] = product

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """rank * m + at of the pairs (a, b), _NONE where they don't merge."""
        key = a * (self.none + 1) + b
        k = np.searchsorted(self.key, key)
        return np.where(self.key[k] == key, self.rank[k] * m + at, _NONE)


def merge_rows(symbols: np.ndarray, pairs: Pairs) -> np.ndarray:
    """merge() for many words at once: a row each, pairs.none before, behind and, in the result, where a symbol was merged.

    The row's width less one is a power of two and the number of leaves of its
    tree; a row has fewer symbols than that.
    """
    n, size = symbols.shape[0], symbols.shape[1] - 1
    sym = symbols.copy()
    tree = np.full((n, 2 * size), _NONE)
    place = np.arange(1, size)
    tree[:, size + 1 :] = pairs.leaves(sym[:, 1:size], sym[:, 2 : size + 1], place, size)
    level = size
    while level > 1:
        half = level >> 1
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    left, right = (np.tile(np.arange(size + 1) + d, (n, 1)) for d in (-1, 1))
    live = np.arange(n)
    while True:
        top = tree[live, 1]
        going = top != _NONE
        if not going.all():
            live, top = live[going], top[going]
        if not len(live):
            return sym
        i = top % size
        new = pairs.product[top // size]
        j = right[live, i]
        nxt, p = right[live, j], left[live, i]
        sym[live, i], sym[live, j] = new, pairs.none
        right[live, i], left[live, nxt] = nxt, i
        leaves = np.concatenate((
            np.full(len(live), _NONE), pairs.leaves(new, sym[live, nxt], i, size), np.where(p > 0, pairs.leaves(sym[live, p], new, p, size), _NONE),
        ))
        row = np.concatenate((live, live, live))
        k = np.concatenate((j, i, p)) + size
        tree[row, k] = leaves
        k >>= 1
        while k[0]:
            tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])
            k >>= 1


class Words(dict):
    """Ids by word, computed when first asked for.

    Holds two generations of at most `most` bytes each: when the young one is
    full the old one goes, so frequent words stay and memory is bounded.  A word
    that alone takes more than a tenth of that is not kept.
    """

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old, self.size = compute, most, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        return self.keep(word, self.compute(word) if found is None else found)

    def many(self, words: Iterable[str], compute) -> dict[str, bytes]:
        """Ids of different words; those that are not held are computed together, from a list."""
        out, new = {}, []
        held, old = self.get, self.old.get
        for w in words:
            found = held(w)
            if found is None:
                found = old(w)
                if found is None:
                    new.append(w)
                    continue
                self.keep(w, found)
                held, old = self.get, self.old.get
            out[w] = found
        for w, found in zip(new, compute(new), strict=True):
            out[w] = self.keep(w, found)
        return out

    def keep(self, word: str, found: bytes) -> bytes:
        size = len(word) + len(found) + CACHE_ROW
        if 10 * size > self.most:
            return found
        if self.size + size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += size
        self[word] = found
        return found


def library_tables() -> dict[str, list]:
    """Letters and numbers that Python's patterns know and the tokenizers library does not, as ranges, and capitals that only the library lowers.

    All are code points that are unassigned in one of the Unicode versions.
    """
    import regex
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: dict[str, list] = {}
    for kind in ("L", "N"):
        ours = regex.findall(rf"\p{{{kind}}}", every)
        theirs = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True).pre_tokenize_str("".join(ours))
        odd = sorted(map(ord, {*ours} - {c for c, _ in theirs}))
        heads = [c for i, c in enumerate(odd) if not i or odd[i - 1] != c - 1]
        ends = [c for i, c in enumerate(odd) if i + 1 == len(odd) or odd[i + 1] != c + 1]
        out[kind] = list(zip(heads, ends, strict=True))
        if kind == "L":
            low = normalizers.Lowercase().normalize_str
            out["lower"] = [(ord(c), ord(low(c))) for c in ours if unicodedata.category(c) == "Cn" and low(c) != c]
    return out


class Codec:
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        steps = spec.get("normalizer") or {}
        kinds = [s["type"] for s in (steps.get("normalizers") or ([steps] if steps else []))]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        split = next(p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split")
        # white space is the Unicode property, which leaves out the separators U+001C to U+001F
        white = r"\t-\r\x20\x85\xa0  -     　"
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{white}")
        self.words = regex.compile(pattern).findall
        # texts with code points whose class differs take the same pattern with the library's classes, which is slower
        tables = spec.get(_TABLES) or {"L": [], "N": [], "lower": []}
        every = [*tables["L"], *tables["N"], *((a, a) for a, _ in tables["lower"])]
        ranges = lambda rows: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in rows)
        least = min((a for a, _ in every), default=0x10FFFF)
        self.high = re.compile(f"[\\U{least:08x}-\\U0010ffff]").search
        self.odd = regex.compile(f"[{ranges(every)}]").search if every else lambda _: None
        own = pattern
        for k in ("L", "N"):
            if tables[k]:
                own = own.replace(rf"[\p{{{k}}}]", rf"[\p{{{k}}}--[{ranges(tables[k])}]]").replace(rf"[^{white}\p{{L}}\p{{N}}]", rf"(?:[^{white}\p{{L}}\p{{N}}]|[{ranges([*tables['L'], *tables['N']])}])")
        self.odd_words = regex.compile(own, regex.V1).findall
        self.capitals = dict(tables["lower"])
        top = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * top
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.cache = Words(self.encode_word, CACHE_BYTES // 2)
        self.pairs = Pairs(self.ranks, self.symbols, [s + self.suffix for s in self.symbols])
        self.ids = np.array([*(self.vocab.get(s, -1) for s in self.pairs.names), -1])

    def encode_word(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.suffix
        ids = [i for s in merge(symbols, self.ranks) if (i := self.vocab.get(s)) is not None]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """encode_word of each, for short words by matrices of trees."""
        out = [b""] * len(words)
        data = [w.encode() for w in words]
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(data):
            groups.setdefault(1 << len(b).bit_length(), []).append(i)
        for size, group in groups.items():
            if size > ROW_LEAVES:
                for i in group:
                    out[i] = self.encode_word(words[i])
                continue
            step = max(1, MATRIX_LEAVES // size)
            for part in (group[k : k + step] for k in range(0, len(group), step)):
                n = np.array([len(data[i]) for i in part])
                row = np.repeat(np.arange(len(part)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
                byte = np.frombuffer(b"".join([data[i] for i in part]), np.uint8)
                symbols = np.full((len(part), size + 1), self.pairs.none)
                symbols[row, at] = np.where(at == n[row], self.pairs.last[byte], self.pairs.first[byte])
                ids = self.ids[merge_rows(symbols, self.pairs)]
                ends = (4 * np.cumsum((ids >= 0).sum(axis=1))).tolist()
                flat = ids[ids >= 0].astype("<u4").tobytes()
                for i, a, b in zip(part, [0, *ends], ends):  # noqa: B905
                    out[i] = flat[a:b]
        return out

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # one character at a time: a final sigma is lowered like any other
            text = text.lower() if "Σ" not in text else "".join("σ" if c == "Σ" else c.lower() for c in text)
        return text

    def _plain(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        text, words = self.normal(text), self.words
        if self.high(text) and self.odd(text):
            text, words = text.translate(self.capitals) if self.lower else text, self.odd_words
        return words(text)

    def _parts(self, text: str) -> list[list[str] | bytes]:
        """Its lists of words and, between them, the ids of special tokens."""
        if self.split_special is None or not self.split_special.search(text):
            return [self._plain(text)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return [*out, self._plain(text[at:])]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; the words of some texts at a time are looked up together."""
        held, size = [], 0
        for text in texts:
            held.append(self._parts(text))
            size += len(text)
            if size >= GROUP:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[list[str] | bytes]]) -> list[bytes]:
        distinct = set().union(*(x for parts in held for x in parts if isinstance(x, list)))
        ids = self.cache.many(distinct, self.encode_words).__getitem__
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(ids, x)) for x in parts]) for parts in held]

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def read_spec(path: str) -> str:
    """The tokenizer file with the library's tables beside it."""
    with open(path, encoding="utf-8") as f:
        return json.dumps(json.load(f) | {_TABLES: library_tables()}, ensure_ascii=False)


def codec(spec) -> Codec:
    """The worker's codec of a broadcast tokenizer file."""
    state = process_state()
    key = ("bpe", hashlib.sha256(spec.value.encode()).hexdigest())
    if key not in state:
        state[key] = Codec(spec.value)
    return state[key]


def encode(docs: DataFrame, spec) -> DataFrame:
    """(doc_id, ids array<int>) of every row; spec is a broadcast of read_spec(path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec)
        for batch in slices(batches, "text", 1_000_000):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode_all(x or "" for x in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, spec) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec)
        for batch in batches:
            text = [c.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, spec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, then decodes the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec)
        for batch in slices(batches, "text", 2_000_000):
            n, a, b = [], [], []
            for ids in c.encode_all(x or "" for x in batch.column("text").to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def public_spec(spark: SparkSession, name: str = "word_bpe_49k.json"):
    import public_tokenizers

    return spark.sparkContext.broadcast(read_spec(public_tokenizers.path(name)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    A null or empty text has no tokens and the digests of nothing; a null doc_id
    stays null; repeated rows give repeated results; an empty table gives none.
    """
    return digests(read(spark, sf_dir, "documents"), public_spec(spark))
