"""Steps of the cleaners against their plain definitions, at characters at every edge of the classes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papyr.functions import charclass as cc
from papyr.functions import text as t

SF = "/root/testdata/sf0.001"


def _class(x: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), x)


def _plain_ratio(x: str) -> float:
    ink = sum(not c.isspace() for c in x)
    return len(re.findall(f"[{_class(cc.KOREAN)}]", x)) / ink if ink else 0.0


def _smart(x: str) -> str:
    kept = f"[^{_class(cc.SERVED)}\n\r\t]"
    return re.sub(kept, "", "".join(" " if c.isspace() and re.match(kept, c) else c for c in x))


def _allowed(x: str) -> str:
    kept = f"[^{_class(cc.ALLOWED)}\n\r\t]"
    return re.sub(kept, "", "".join(" " if c.isspace() and re.match(kept, c) else c for c in x))


def _token(x: str) -> bool:
    n, korean = len(x), len(re.findall(f"[{_class(cc.KOREAN)}]", x))
    if n == 0 or re.fullmatch("[A-Za-z0-9]{1,4}", x):
        return n > 0
    if korean:
        return n <= 10 or korean / n >= 0.1
    return None  # other tokens are as before


STEPS = {
    "strip": (t.strip, str.strip),
    "squeeze": (t.squeeze, lambda x: " ".join(x.split())),
    "strip_noise": (t.strip_noise, lambda x: re.sub(f"[{_class(cc.NOISE)}]", "", x)),
    "smart_filter": (t.smart_filter, _smart),
    "keep_allowed": (t.keep_allowed, _allowed),
    "korean_ratio": (t.korean_ratio, _plain_ratio),
}


@pytest.fixture(scope="module")
def texts(spark):
    edges = {int(h, 16) + d for x in (cc.WS, cc.NOISE, cc.ALLOWED, cc.SERVED, cc.KOREAN) for h in re.findall(r"\\x\{([0-9A-Fa-f]+)\}", x) for d in (-1, 0, 1)}
    marks = [chr(c) for c in sorted(edges) if 0 <= c and not 0xD800 <= c < 0xE000] + list(" \t\n가힣aZ~ ") + ["\U0001f600"]
    rng = random.Random(7)
    out = ["", " ", "  ", *marks] + ["".join(rng.choice(marks if rng.random() < 0.5 else " 가a") for _ in range(rng.randrange(40))) for _ in range(400)]
    return spark.createDataFrame([(x,) for x in out], "text string").coalesce(1)


@pytest.mark.parametrize("step", STEPS)
def test_step(step, texts):
    own, plain = STEPS[step]
    for r in texts.select("text", own(F.col("text")).alias("x")).collect():
        assert r.x == pytest.approx(plain(r.text)) if step == "korean_ratio" else r.x == plain(r.text), repr(r.text)


def test_tokens_with_korean(spark):
    tokens = ["", "가", "a가", "abcdefghi가", "abcdefghij가", "가" + "a" * 9, "가" + "a" * 10, "ab12", "ab123", "\U0001f600" * 9 + "가", "\U0001f600" * 10 + "가", "x" * 9 + "ㄱ"]
    for r in spark.createDataFrame([(x,) for x in tokens], "x string").select("x", t.meaningful(F.col("x")).alias("ok")).collect():
        if _token(r.x) is not None:
            assert r.ok == _token(r.x), r.x


def test_rows_made_of_one_row_group_are_dealt(spark, tmp_path):
    """A file of one row group was one task, whatever was made of it."""
    from papyr.plans.inputs import dealt

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = dealt(spark.read.parquet(str(tmp_path / "t")), "id")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 3 * spark.sparkContext.defaultParallelism * 3 // 4 and max(sizes) < 300


@pytest.mark.parametrize("query", ["strategy_accepted", "strategy_accepted_loosely", "section_clean"])
def test_bodies_are_dealt_and_cleaned_once(spark, query):
    from conftest import SF

    from papyr.plans import registry

    plan = registry.QUERIES[query](spark, SF)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "REPARTITION_BY_NUM" in plan and "Filter NOT" not in plan


def test_composed_holds_few_rows(spark):
    """Composition by rows, not by Arrow batches of 10,000 texts; Latin-1 texts, nulls and decomposed ones come out right."""
    from unicodedata import normalize

    texts = [None, "", "plain", "caf\xe9", "é", "한 x", "à̕ יִ Å", "\U0001d15e"]
    df = spark.createDataFrame([(x,) for x in texts], "text string").select("text", t.composed(F.col("text")).alias("x"))
    assert all(r.x == (r.text if r.text is None else normalize("NFC", r.text)) for r in df.collect())
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()


def test_documents_of_one_row_group_are_worked_on_by_all_tasks(spark):
    import __spark_entry__ as e

    for name in ("smart_filter", "garbage_gate", "doc_statistics", "improved_clean"):
        sizes = e.queries()[name](spark, SF).rdd.glom().map(len).collect()
        assert sum(sizes) == 200 and max(sizes) <= 50, (name, sizes)
