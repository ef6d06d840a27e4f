"""Hand-made vectors of text, paragraph and validation functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyr.functions import text as t
from papyr.functions import validate as v
from papyr.operators import logs, structure

PARAGRAPHS = [
    ("제1장 총칙", True, 1, "heading", "legal", "short"),
    ("제 2 절 범위", True, 2, "heading", "legal", "short"),
    ("1. 목적", True, 2, "heading", "general", "short"),
    ("가. 대상", True, 3, "heading", "general", "short"),
    ("<Ⅰ> 개요", True, 1, "heading", "general", "short"),
    ("ⅱ. 세부", True, 2, "heading", "general", "short"),
    ("  1. 들여쓰기", True, 2, "heading", "general", "short"),
    ("Chapter 3", True, 2, "heading", "academic", "short"),
    ("1) 항목", False, None, "numbered_list", None, "short"),
    ("- item", False, None, "list_item", None, "short"),
    ("-item", False, None, "normal", None, "short"),
    ("NOTICE 12", False, None, "title", None, "short"),
    ("문의 a.b@c.kr 02-123-4567 ₩1,000 2025-01-15 https://x.y", False, None, "normal", None, "date,email,url,phone,currency,short"),
]


def test_paragraphs(spark):
    c = F.col("text")
    rows = spark.createDataFrame([(p[0],) for p in PARAGRAPHS], "text string").select(
        "text", t.is_heading(c), t.heading_level(c), t.paragraph_type(c), t.heading_kind(c), F.array_join(t.tags(c), ",")
    )
    for got, want in zip(rows.collect(), PARAGRAPHS, strict=True):
        assert got[1] == want[1], want
        if want[1]:
            assert (got[2], got[4]) == (want[2], want[4]), want
        assert (got[3], got[5]) == (want[3], want[5]), want


def test_statistics_of_an_empty_text(spark):
    got = spark.createDataFrame([("",)], "text string").select(*(c.alias(k) for k, c in t.text_statistics(F.col("text")).items())).first()
    assert (got.char_count, got.word_count, got.line_count, got.sentence_count, got.korean_ratio) == (0, 0, 1, 0, 0.0)


def test_parents(spark):
    levels = {0: 1, 3: 2, 5: 3, 7: 2, 9: 1, 11: 3}
    heads = spark.createDataFrame([(1, i, x) for i, x in levels.items()], "doc_id long, idx long, level int")
    got = {r.idx: (r.parent, r.depth) for r in structure.with_parents(heads).collect()}
    assert got == {0: (None, 0), 3: (0, 1), 5: (3, 2), 7: (0, 1), 9: (None, 0), 11: (9, 1)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=12))
def test_parents_as_a_stack(spark, levels):
    want, stack = {}, []
    for i, x in enumerate(levels):
        while stack and stack[-1][1] >= x:
            stack.pop()
        want[i] = (stack[-1][0] if stack else None, len(stack))
        stack.append((i, x))
    heads = spark.createDataFrame([(1, i, x) for i, x in enumerate(levels)], "doc_id long, idx long, level int")
    assert {r.idx: (r.parent, r.depth) for r in structure.with_parents(heads).collect()} == want


ALPHABET = st.text(st.sampled_from(list("가나다ㄱab cdABCDEFGH123.,-!#()\n\t\x0b   ·※→Жƀ䀀贀①")), max_size=60)
NOISE = re.compile("[䀀-俿耀-耿蠀-蠿褀-褿Ѐ-ӿĀ-ɏࡀ-࡟ऀ-ॿ-\x00-\x1f\x7f-\x9f￰-￿贀-贿谀-谿捀-捿勀-勿]")


@settings(max_examples=15, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=20))
def test_deletions_as_in_python(spark, texts):
    c = F.col("text")
    got = spark.createDataFrame([(x,) for x in texts], "text string").select(t.strip_noise(c), t.drop_foreign_runs(c), t.squeeze(c), t.words(c)).collect()
    for x, r in zip(texts, got, strict=True):
        assert r[0] == NOISE.sub("", x)
        assert r[1] == re.sub("[^가-힣㄰-㆏]{11,}", "", x)
        assert r[2] == " ".join(x.split())
        assert r[3] == len(x.split())


@pytest.mark.parametrize(("text", "want"), [("AAAA가나", "가나"), ("###가", "가"), ("a.b", "a.b"), ("(((((", "")])
def test_ascii_noise(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(t.strip_ascii_noise(F.col("text"))).first()[0] == want


def test_validation(spark):
    rows = [("x.hwp", "D0CF11E0A1B11AE1", "ole"), ("x.hwpx", "504B0304", "zip"), ("x.pdf", "255044462D312E34", "pdf"), ("x.hwp", "496E76616C6964", "unknown")]
    got = spark.createDataFrame(rows, "name string, head string, want string").select(v.magic_of(F.unhex("head")), "want").collect()
    assert all(a == b for a, b in got)
    size = spark.createDataFrame([(11 * 1024 * 1024,)], "n long").select(F.col("n") > v.UPLOAD_LIMIT).first()[0]
    assert size


@pytest.mark.parametrize(
    ("kind", "size", "base", "want"),
    [("json", 1024, 3600, 5400), ("text", 1024, 3600, 2880), ("markdown", 1024, 3600, 3600), ("json", 2 << 20, 3600, 8100), ("text", 20 << 20, 3600, 5760), ("json", 20 << 20, 3600, 10800), ("json", 1, 86400, 86400)],
)
def test_ttl(spark, kind, size, base, want):
    assert spark.createDataFrame([(kind, size)], "k string, n long").select(logs.cache_ttl(F.col("k"), F.col("n"), base)).first()[0] == want


def test_sliding_log():
    assert [a for a, _, _ in logs.sliding_log(iter([0, 1, 2, 60, 61, 62]), 2, 60)] == [True, True, False, True, True, False]
    bucket = logs.LeakyBucket(1, 1)
    assert [bucket.accepts(x) for x in (0, 0, 0, 1, 5)] == [True, True, False, True, True]
