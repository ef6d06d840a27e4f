"""Periodic runs of words against a plain search of all stretches."""

import hashlib
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from papyr.llm import periodic_runs as m


def plain(words):
    """All runs (start, end, period) by trying each period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and (i, j + q) not in out:
                out[i, j + q] = q
            i = max(j, i) + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def found(lists):
    words = np.array([w for x in lists for w in x], np.int32)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return [tuple(r) for r in m.runs_of(words, doc).tolist()]


def expected(lists):
    out, base = [], 0
    for x in lists:
        out += [(s + base, e + base, q) for s, e, q in plain(x)]
        base += len(x)
    return out


PIECE = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)).map(lambda x: x[0] * x[1])
DOC = st.lists(PIECE, max_size=6).map(lambda x: [w for p in x for w in p])


@settings(max_examples=400, deadline=None)
@given(st.lists(DOC, max_size=4))
def test_runs_equal_plain_search(lists):
    assert found(lists) == expected(lists)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=90), st.integers(1, 20), st.integers(0, 90))
def test_runs_of_long_periods(block, times, rest):
    words = block * times + block[:rest]
    assert found([words]) == expected([words])


def test_equal_stretches_of_neighbouring_documents_stay_apart():
    assert found([[1] * 5, [1] * 5, [1] * 6]) == [(10, 16, 1)]


def row_of(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\t-\r]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain(words)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-__import__("fractions").Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def check(got, rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted((row_of(*r) for r in rows), key=key)


def test_query_equals_plain_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [d for d in docs if len(d[1] or "") < 12_000]
    schema = "doc_id long, text string"
    check(m.detect(spark.createDataFrame(docs, schema)).collect(), docs)
    assert m.op12_periodic_runs(spark, SF).count() == 200


def test_edge_rows(spark):
    rows = [(None, "a " * 9), (1, None), (2, ""), (2, ""), (3, " \t\n"), (4, "é " * 7 + "x"), (5, "a b " * 300), (6, "　a　 " * 8), (10, "w"), (11, "A a " * 5), (-7, "u v w " * 4)]
    rows += [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(100, 400)]
    got = m.detect(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_runs")).collect()
    check(got, rows)
    assert any(r.n_runs for r in got if r.doc_id and r.doc_id >= 100)
    assert m.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("words", [["a"] * 200_000, ["a", "b", "c"] * 70_000, [f"w{i}" for i in range(200_000)]])
def test_long_texts(words):
    code = np.unique(words, return_inverse=True)[1].astype(np.int32)
    got = m.runs_of(code, np.zeros(len(code), np.int64)).tolist()
    q = len(set(words))
    assert got == ([[0, len(words), q]] if q < 9 else [])
