"""The cleaner on arrays against the one by patterns, and what is asked of it."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from papyr.functions import bulk
from papyr.functions import charclass as cc
from papyr.functions import text as t
from papyr.operators import structure as s
from papyr.plans import registry


def _ranges(cls):
    return [(int(a, 16), int(b or a, 16)) for a, b in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", cls)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    edges = {c + d for x in (cc.WS, cc.NOISE, cc.ALLOWED, cc.KOREAN) for r in _ranges(x) for c in r for d in (-1, 0, 1)}
    marks = [chr(c) for c in sorted(edges) if c >= 0 and not 0xD800 <= c < 0xE000] + list("\t\n가힣aZ~ ") + ["\U0001f600"]
    words = ["한국어", "문서 ", "입니다.", "가가가가", "\x00", "12.5", "※ ", " → ", "#!?", "(((", "..", "x-y/z ", " 50%", "é", "aab ", " 1212ab", "가나다라마바사", "日本"]
    pools = (lambda: rng.choice(marks if rng.random() < 0.5 else " 가a1."), lambda: rng.choice(words), lambda: rng.choice("가 a1.(#A나"), lambda: rng.choice("가 ") + rng.choice("ab1A#.") * rng.randrange(18))
    made = ["".join(one() for _ in range(rng.randrange(60))) for one in pools for _ in range(1500)]
    # each allowed character as a token, twice as one and beside others
    allowed = [chr(c) for a, b in _ranges(cc.ALLOWED) if a < 0xA000 or a > 0xD7A3 for c in range(a, b + 1)]
    return ["", " ", *marks, *made, *(f"가나다라마 {c} 바사아자 {c}{c} 차카타파하 {c}.a" for c in allowed), "가" * 300_000 + " a", "가 나다" * 100_000, "x" * 300_000]


def test_bulk_is_the_cleaner(spark, texts):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i long, x string").repartition(8)
    plain = frame.select("i", "x", t.clean(F.col("x")).alias("a")).withColumn("share", t.korean_ratio(F.col("a")))
    rows = plain.select("i", "a", "share", bulk.clean(F.col("x")).alias("b"), bulk.rated(F.col("x")).alias("c")).collect()
    assert [r.i for r in rows if (r.a, r.a, r.share) != (r.b, r.c.text, r.c.ratio)] == [] and sum(r.a != "" for r in rows) > 3000


def test_broken_bytes(spark):
    frame = spark.range(1).select(F.unhex(F.lit("ff" + "가나다라마바사아자차카".encode().hex() + "e0")).cast("string").alias("x"))
    assert frame.select(bulk.clean(F.col("x")).alias("y")).first().y == "가나다라마바사아자차카"


def test_equal_texts_are_cleaned_once(monkeypatch):
    seen = []
    monkeypatch.setattr(bulk, "cleaned", lambda texts, _: (seen.extend(texts) or [x.upper() for x in texts], np.zeros(len(texts))))
    out = list(bulk._cleaned(iter([pa.array(["a", "b", "a", "a"]), pa.array([], pa.string())])))
    assert [x.to_pylist() for x in out] == [["A", "B", "A", "A"], []] and seen == ["a", "b"]


def test_portions_are_bounded():
    texts = ["x" * n for n in (bulk.AT_ONCE - 2, 1, 5, 3 * bulk.AT_ONCE, 0, 7)]
    portions = list(bulk._portions(texts))
    assert [x for p in portions for x in p] == texts and all(len(p) == 1 or sum(map(len, p)) <= bulk.AT_ONCE for p in portions)


def test_only_texts_asked_for_are_cleaned(spark):
    """A short body and a preview that the body's text needs not give way to were cleaned too."""

    @F.udf("string")
    def clean(x):
        if x is not None and "unasked" in x:
            raise ValueError(x[:20])
        return x

    korean, latin = "한국어 " * 200, "latin " * 200
    rows = [
        (1, korean, "unasked " * 100), (2, "unasked", korean), (3, "unasked", "unasked " * 20), (4, latin, korean), (5, latin, "unasked"),
        (6, None, korean), (7, korean, None), (8, None, None), (9, latin, latin),
    ]
    out = s.accepted(spark.createDataFrame(rows, "i int, body string, preview string"), "body", "preview", lambda c: s.rated(clean(c))).collect()
    assert {r.i: r.method for r in out} == {1: "body", 2: "preview", 3: None, 4: "preview", 5: "body", 6: "preview", 7: "body", 8: None, 9: "body"}


def test_strategy_texts_are_cleaned_in_bulk(spark):
    plan = registry.QUERIES["strategy_accepted"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and r"{3,}" not in plan


def test_sections_are_cleaned_in_bulk_and_moved_once(spark):
    """Parts were cleaned by patterns and moved twice, for the grouping and for the texts made of it."""
    plan = registry.QUERIES["section_clean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and r"{3,}" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 1


def test_sections_of_a_frequent_document(spark, tmp_path):
    """Half of all orders are one customer's, whose text is longer than what is taken at once."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, 7).otherwise(F.col("o_custkey")).cast("long")).write.parquet(str(tmp_path / "orders.parquet"))
    from papyr.plans.documents import BODIES
    from papyr.plans.inputs import made

    got = {r.doc_id: r.result for r in registry.QUERIES["section_clean"](spark, str(tmp_path)).collect()}
    parts = made(spark, str(tmp_path), BODIES).where("doc_id = 7").select("idx", t.clean(F.col("body")).alias("part")).where("part <> ''").orderBy("idx").collect()
    whole = "\n\n".join(r.part for r in parts)
    assert got[7] == spark.createDataFrame([(whole,)], "x string").select(t.clean(F.col("x")).alias("y")).first().y and len(whole) > 50_000
