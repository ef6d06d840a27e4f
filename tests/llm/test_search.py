"""Ranked search against a plain count of all terms."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from papyr.llm import impact_index as m

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, q in asked.items():
        found = []
        for doc_id, c in counts:
            length = sum(c.values())
            score = 0
            for t, times in q.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * length * n // total)))
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, r + 1, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(found)[:k])]
    return out


def searched(spark, docs, items, **kind):
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as terms")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as rank")
    return [tuple(r) for r in m.search_documents(a, b, **kind).select("item_id", "rank", "doc_id", "score").collect()]


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


DOCS = [
    (1, "Apple apple pear. ÉA"), (2, "apple"), (3, None), (4, ""), (5, "pear plum-plum"), (None, "apple pear"), (7, "APPLE"), (7, "APPLE"),
    (-8, "apple " * 500 + "fig"), (9, "éa Éa"), (10, "-- \t"), (11, "日本 apple_日本"), (12, "apple"), (13, "apple"), (14, "apple"), (15, "apple"), (16, "fig"),
]
ITEMS = [(1, "apple apple fig"), (2, "none such"), (3, None), (4, "日本 plum"), (4, "日本 plum"), (4, "pear"), (None, "ÉA pear"), (6, ""), (7, "fig " * 70 + "plum")]


def test_search_equals_plain_count(spark):
    got = searched(spark, DOCS, ITEMS)
    same(got, plain(DOCS, ITEMS))
    assert sorted(r[1] for r in got if r[0] == 1) == list(range(1, 11))


def test_many_blocks_and_query_blocks(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + DOCS
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + ITEMS
    want = plain(rows, items)
    same(searched(spark, rows, items), want)
    monkeypatch.setattr(m, "VOCABULARY", 0)  # an index of all terms
    monkeypatch.setattr(m, "QUERY_ROWS", 500)
    monkeypatch.setattr(m, "ROUNDS", 3)
    monkeypatch.setattr(m, "BLOCK", 64)
    same(searched(spark, rows, items), want)


def test_empty_tables(spark):
    assert searched(spark, [], ITEMS) == [] and searched(spark, DOCS, []) == []


def test_query_equals_its_sql(spark, duck, same):
    got, want = m.op11_impact_search(spark, SF).toPandas(), duck.sql(m.SQL).df()
    same(got, want)


def test_long_text(spark):
    docs = [(1, "x y " * 400_000), (2, "x z"), (3, " ".join(f"t{i}" for i in range(200_000)))]
    items = [(1, "x t77 y"), (2, " ".join(f"t{i}" for i in range(5000)))]
    same(searched(spark, docs, items), plain(docs, items))


def as_slices(numbers, bits):
    return np.stack([np.packbits((numbers >> b & 1).astype(bool), axis=1, bitorder="little").view("<u8") for b in range(bits)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=64, max_size=64), min_size=1, max_size=3), st.integers(1, 70))
def test_best_by_slices(rows, k):
    numbers = np.array(rows)
    got = np.unpackbits(m.best_bits(as_slices(numbers, 4), k).view(np.uint8), axis=1, bitorder="little")
    for row, bits in zip(rows, got, strict=True):
        limit = sorted(row, reverse=True)[min(k, 64) - 1]
        assert [bool(b) for b in bits] == [x > 0 and x >= limit for x in row]


@pytest.mark.parametrize("factor", [0, 1, 5, 1023])
def test_products_by_carries(factor):
    numbers = np.random.default_rng(1).integers(0, 1 << 20, (3, 128))
    factors = np.array([factor, 7, 0])
    out = m.times(as_slices(numbers, 20), factors)
    assert (out == as_slices(numbers * factors[:, None], len(out))).all()
