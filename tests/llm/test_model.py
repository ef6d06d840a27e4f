"""Language-model scores: plain counts, normalisation, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from papyr.llm import log_bilinear as m

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.lower() for w in WORD.findall((text or "").encode())] + ["end"]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    count = Counter(t for i, x in rows if not is_held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    out = []
    for i, x in rows:
        own = tokens(x)
        base = math.fsum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
        out.append((i, is_held(i), len(own), sum(count[t] > 0 for t in own), n, base))
    return out


def check(got, rows):
    key = lambda r: tuple((x is not None, x) for x in r[:5])
    a, b = sorted((tuple(r)[:6] for r in got), key=key), sorted(plain(rows), key=key)
    assert [r[:5] for r in a] == [r[:5] for r in b]
    a, b = (sorted(x, key=lambda r: (*key(r), r[5])) for x in (a, b))
    assert np.allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-12, atol=1e-9)


@pytest.fixture
def small():
    """Tiny bounds, so that a small corpus has words of every kind."""
    old = {k: getattr(m, k) for k in ("HEAD", "INPUTS", "SINGLE", "OUTPUTS", "START", "CLASSES")}
    m.HEAD, m.INPUTS, m.SINGLE, m.CLASSES = 300, 100, 20, 8
    m.OUTPUTS, m.START = 28, 108
    yield
    for k, v in old.items():
        setattr(m, k, v)


ROWS = [
    (None, "a b"), (1, None), (2, ""), (2, ""), (3, " \t"), (4, "The the THE é É"), (5, "x" * 90 + " " + "x" * 90), (6, "x" * 91), (7, "\x00 b\xa0c　d"),
    *((i, f"word{i % 9} and tail{i} " * (i % 5 + 1)) for i in range(10, 120)), (200, "unseen " * 4), (-5, "a"),
]


def test_counts_equal_plain_counts(spark, small):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as row")
    got = m.score_documents(df).collect()
    check(got, ROWS)
    assert all(r.score <= 0 for r in got)
    assert m.score_documents(df.where("false")).count() == 0
    one = m.score_documents(df.where("doc_id = 200 or doc_id is null")).collect()
    assert len(one) == 2


def test_without_training_documents(spark, small):
    held = [(i, f"a b{i}") for i in range(60) if is_held(i)]
    got = m.score_documents(spark.createDataFrame(held, "doc_id long, text string")).collect()
    check(got, held)
    assert {(r.train_tokens, r.n_known, r.base_score) for r in got} == {(0, 0, 0.0)}


def test_scores_equal_plain_scores(spark, small):
    """Each document's score from the parameters, a token at a time."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ROWS
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", m.held_out())
    tables = m.Tables(spark)
    counts = tables.settle(m.word_counts(docs.where("not held_out")))
    v = m.vocabulary(counts)
    assert len(v.words) == 300
    table = tables.settle(m.encoded(docs, v))
    model = m.trained(table, v)
    words, place, out, bias = (x.astype(float) for x in model.parts)
    count = Counter(m.END if t == "end" else t for i, x in rows if not is_held(i) for t in tokens(x))
    rank = {w: i for i, w in enumerate(v.words.to_pylist())}
    kind = lambda w: int(m.word_classes(pa.array([w], pa.large_binary()))[0])
    single = {w for w, i in rank.items() if i < m.SINGLE}
    total, types = Counter(), Counter()
    for w, c in count.items():
        if w not in single and w != m.END:
            total[kind(w)] += c
            types[kind(w)] += 1
    want = {}
    for i, x in rows:
        own = [m.END if t == "end" else t for t in tokens(x)]
        code = [rank[w] if rank.get(w, 10**9) < m.INPUTS else m.INPUTS + kind(w) for w in own]
        score = 0.0
        for j, w in enumerate(own):
            before = [code[j - k] if j >= k else m.START for k in range(1, m.CONTEXT + 1)]
            s = sum(words[b] * place[k] for k, b in enumerate(before)) @ out.T + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            assert abs(p.sum() - 1) < 1e-9
            score += math.log10(p[rank[w] if w in single else m.SINGLE + kind(w)])
            if w not in single:
                score += math.log10((count[w] + 1) / (total[kind(w)] + types[kind(w)] + 1))
        want.setdefault(i, []).append(score)
    scored = m.model_scores(table, v, model).join(m.tail_sums(table, counts, v), "row", "left")
    got = {}
    for r in scored.collect():
        got.setdefault(r.doc_id, []).append(r.model + r.within + (r.tail_within or 0))
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert np.allclose(sorted(got[i]), sorted(x), rtol=1e-4, atol=1e-3)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    sf = SF.replace("0.001", "0.01")
    got = m.op13_log_bilinear(spark, sf).where("held_out").toPandas()
    assert len(got) > 50
    assert got.score.sum() > 0.98 * got.base_score.sum()
