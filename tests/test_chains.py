"""Cuts by pointer doubling and folds by islands, against plain loops."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from papyr.operators import chains, logs


def cut_plainly(x, size):
    out = []
    while len(x) > size:
        m = regex.match(rf"(?s).{{0,{size - 1}}}\n", x) or regex.match(rf"(?s).{{0,{size - 2}}}\. ", x) or regex.match(f"(?s).{{{size}}}", x)
        out.append(m[0])
        x = x[len(m[0]) :]
    return [*out, x] if x else out


@pytest.mark.parametrize("size", [3, 5, 8, 20])
def test_chunks_equal_a_plain_loop(spark, size):
    rng = random.Random(size)
    texts = ["", None, "a", "\n", ". ", "x" * 50, "ab. " * 20, "x" * 19 + ". y" * 9, "日本。\n" * 9, "\n" * 30, "x" * 200 + "\nend"]
    texts += ["".join(rng.choice("aa" + kind) for _ in range(rng.randint(1, 80))) for kind in ("b\n. ", ". ", "\n", "bcdef.", "....   ", "é. \n") for _ in range(60)]
    got = {}
    for r in chains.boundary_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size).collect():
        got.setdefault(r.doc_id, {})[r.chunk] = r.content
    for i, x in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == cut_plainly(x or "", size), repr(x)


def test_chunks_of_a_long_text(spark):
    text = "word. " * 40_000 + "x" * 100_000 + "\n" + "line\n" * 20_000
    got = chains.boundary_chunks(spark.createDataFrame([(None, text)], "doc_id long, text string"), 500).orderBy("chunk").collect()
    assert [r.content for r in got] == cut_plainly(text, 500)


def test_buffers_equal_a_plain_loop(spark):
    rng = random.Random(7)
    rows = [(k, i, None if rng.random() < 0.1 else "xyz"[i % 3] * rng.choice((0, 1, 2, 5, 30, 200))) for k in (None, 1, 2, 3) for i in range(120 if k != 3 else 2000)]
    rows += [(9, 1, ""), (9, 2, None)]
    want = {}
    for k in (None, 1, 2, 3):
        held, n = "", 0
        for _, _, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            held += x or ""
            if len(held) >= 40:
                want[k, n] = held
                held, n = "", n + 1
        if held:
            want[k, n] = held
    rng.shuffle(rows)
    got = chains.buffered_rows(spark.createDataFrame(rows, "k long, o long, text string"), 40, "k", "o").collect()
    assert {(r.k, r.flush): r.content for r in got} == want
    assert len(got) == len(want)


def test_no_chunks_and_no_buffers(spark):
    none = spark.createDataFrame([], "doc_id long, o long, text string")
    assert chains.boundary_chunks(none, 5).count() == 0 and chains.buffered_rows(none, 5, "doc_id", "o").count() == 0


def test_running_totals_of_a_key_with_most_rows(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 5).alias("k"), "id", F.lit(2).alias("n")).repartition(5)
    out = chains.running_total(rows, "k", ["id"], "n", "sum")
    seen = {}
    for r in out.orderBy("id").collect():
        seen[r.k] = seen.get(r.k, 0) + 2
        assert r["sum"] == seen[r.k]


def log_plainly(times, limit, window):
    log, out = [], []
    for t in times:
        log = [x for x in log if x > t - window]
        out.append((len(log) < limit, len(log)))
        if len(log) < limit:
            log.append(t)
    return out


def test_folds_by_islands_equal_whole_folds(spark):
    """One client makes half of the requests; its islands lie in several tasks and give what one fold over all gives."""
    rng = random.Random(3)
    rows, t = [], {}
    for i in range(3000):
        c = "hot" if i % 2 else rng.choice(["a", "b", None])
        t[c] = t.get(c, 0.0) + rng.choice((0.0, 0.5, 1.0, 3.0, 10.0, 10.0, 25.0))
        rows.append((i, c, t[c]))
    frame = spark.createDataFrame(rows, "event_id long, client string, t double").repartition(3)
    want, dry = {}, {}
    for c in t:
        own = [r for r in rows if r[1] == c]
        want |= dict(zip([r[0] for r in own], log_plainly([r[2] for r in own], 2, 10.0), strict=True))
        bucket = logs.LeakyBucket(0.5, 1)
        dry |= {r[0]: bucket.accepts(r[2]) for r in own}
    assert {r.event_id: (r.accepted, r.active) for r in logs.rate_limited(frame, 2, 10.0).collect()} == want
    assert {r.event_id: (not r.rejected, r.active) for r in logs.gated(frame, 2, 10.0).collect()} == want
    assert {r.event_id: r.accepted for r in logs.leaky(frame, 0.5, 1).collect()} == dry
    parts = logs.rate_limited(frame, 2, 10.0).where("client = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert logs.islands(frame, 10.0).where("client = 'hot'").select("_island").distinct().count() > 100
