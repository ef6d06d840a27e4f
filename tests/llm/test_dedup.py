"""Deduplication operators against brute force, with planted and odd rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyr.llm import embed_dedup, fm_dedup, simhash, suffix_dedup
from papyr.llm import substring_dedup_base as base
from papyr.llm import textunits as tu
from papyr.llm.common import Tables, join_hot
from papyr.llm.components import connected_components, forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, z string, fp long, trig string"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(40)
    texts = [prose(rng.randint(0, 120)) for _ in range(25)]
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(8)]
    texts += [texts[0], texts[0], texts[3].upper(), None, "", " \t\n", "aaaa " * 100, "a" * 400, passage + passage, prose(3000), "x\x1cy z"]
    near = texts[26].split()
    for i in range(6):
        changed = list(near)
        changed[i * 7] = "zzz"
        texts.append(" ".join(changed))
    rows = [(i * 3, x, None, "s", 0, 7, "c", 1, "t") for i, x in enumerate(texts)]
    return [*rows, (None, passage + " tail", None, None, None, None, None, None, None), rows[4], rows[-1]]


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], r[1])
    return sorted(out.items(), key=lambda x: (x[0] is not None, x[0]))


def brute_windows(units, window, across):
    """{id: set of removed positions}; units: [(id, sequence)] in corpus order."""
    first, gone = {}, {i: set() for i, _ in units}
    for i, seq in units:
        for s in range(len(seq) - window + 1):
            k = tuple(seq[s : s + window])
            if k not in first:
                first[k] = i
            elif not across or first[k] != i:
                gone[i].update(range(s, s + window))
    return gone


@pytest.mark.parametrize("group", [base.GROUP, 2])
def test_suffix_dedup(spark, group, monkeypatch):
    monkeypatch.setattr(base, "GROUP", group)
    rows = corpus()
    docs = by_id(rows)
    gone = brute_windows([(i, (t or "").encode()) for i, t in docs], 100, False)
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (dict(docs)[r.doc_id] or "").encode()
        cut = gone[r.doc_id]
        runs = sum(1 for k in cut if k - 1 not in cut)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), len(cut), runs), r.doc_id
        assert bytes(r.kept) == bytes(b for k, b in enumerate(text) if k not in cut)


@pytest.mark.parametrize("group", [base.GROUP, 2])
def test_fm_dedup(spark, group, monkeypatch):
    monkeypatch.setattr(base, "GROUP", group)
    rows = corpus()
    docs = by_id(rows)
    words = {i: (t or "").encode().split() for i, t in docs}
    gone = brute_windows(list(words.items()), 13, True)
    got = fm_dedup.remove_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(5), digest=True).collect()
    assert len(got) == len(rows)
    for r in got:
        kept = b" ".join(w for k, w in enumerate(words[r.doc_id]) if k not in gone[r.doc_id])
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words[r.doc_id]), len(gone[r.doc_id]), hashlib.sha256(kept).hexdigest()), r.doc_id


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=12), min_size=1, max_size=8))
def test_matching_statistics(seqs):
    text = np.concatenate([np.array([*s, 0]) for s in seqs]).astype(np.int64)
    owner = np.repeat(np.arange(len(seqs)), [len(s) + 1 for s in seqs])
    index = fm_dedup.FMIndex(text, owner, 4, max(map(len, seqs)))
    ends, room = zip(*[(sum(len(x) + 1 for x in seqs[:i]) + k, k) for i, s in enumerate(seqs) for k in range(1, len(s) + 1)], strict=True)
    got = index.matching(text, np.array(ends), np.array(room), owner[np.array(ends) - 1])
    joined = ["," + ",".join(map(str, s)) + "," for s in seqs]
    for (i, k), n in zip([(i, k) for i, s in enumerate(seqs) for k in range(1, len(s) + 1)], got.tolist(), strict=True):
        stands = lambda m: any("," + ",".join(map(str, seqs[i][k - m : k])) + "," in x for x in joined[:i])  # noqa: B023, E731
        assert n == max([m for m in range(1, k + 1) if stands(m)], default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=6), st.integers(1, 20))
def test_suffix_ranks(texts, depth):
    data, lens = b"".join(texts), [len(x) for x in texts]
    ends = np.repeat(np.cumsum(lens), lens)
    rank = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), ends, depth)
    same = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8).astype(np.int64), ends, 64)
    for i in range(len(data)):
        for j in range(i):
            x, y = data[i : ends[i]], data[j : ends[j]]
            assert (same[i] < same[j], same[i] == same[j]) == (x < y, x == y)
            assert rank[i] != rank[j] or x[:depth] == y[:depth]
            assert x[:depth] >= y[:depth] or rank[i] < rank[j]


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_dictionary_and_parse_give_corpus_order(data):
    """Rows around one trigger, with context from a small alphabet, against all pairs of windows."""
    w, t = suffix_dedup.WINDOW, suffix_dedup.TRIGGER
    part = lambda n: b"".join(data.draw(st.lists(st.sampled_from([b"a", b"bcd", b"x" * 9, bytes(range(40, 90))]), min_size=n, max_size=n)))[:n]
    trig = bytes(range(100, 100 + t))
    rows = []
    for _ in range(data.draw(st.integers(1, 6))):
        off = data.draw(st.integers(0, w - t))
        n = data.draw(st.integers(1, off + 1))
        rows.append((part(off) + trig + part(w))[: n + w - 1])
        rows[-1] = (rows[-1], off)
    length = np.array([len(x) for x, _ in rows], np.int64)
    flat = b"".join(x for x, _ in rows)
    begin = np.cumsum(length) - length
    r, j, g = suffix_dedup.equal_windows(np.frombuffer(flat, np.uint8), begin, length, np.array([o for _, o in rows]))
    seen = {}
    for a, b, k in zip(r.tolist(), j.tolist(), g.tolist(), strict=True):
        assert seen.setdefault(k, rows[a][0][b : b + w]) == rows[a][0][b : b + w]
    assert len(set(seen.values())) == len(seen)
    assert len(r) == sum(len(x) - w + 1 for x, _ in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_leftmost_minimum(values, width):
    got = tu.leftmost_minimum(np.array(values, np.uint64), width)
    assert list(got) == [i + values[i : i + width].index(min(values[i : i + width])) for i in range(len(values) - width + 1)]


def test_word_hash_depends_on_the_word_alone():
    long = "é" * 5000
    texts = [f"ab cd {long} ab", f"\t{long}  cd\x0b"]
    (a, b) = (tu.word_hashes(d, *tu.words_of(d)) for d in (np.frombuffer(x.encode(), np.uint8) for x in texts))
    assert a[0] == a[3] and a[2] == b[0] and a[1] == b[1] and len({*a[:3]}) == 3


def reference_fingerprint(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) for i in range(64)]
    return sum(1 << i for i, n in enumerate(bits) if 2 * n > len(shingles))


def test_simhash(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    fps = {i: reference_fingerprint(t) for i, t in by_id(rows)}
    ids = list(fps)
    a, b = zip(*[(i, j) for i in range(len(ids)) for j in range(len(ids)) if i != j and (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 2], strict=True)
    comp = dict(zip(*forest(np.array(a), np.array(b)), strict=True))
    for r in got:
        assert int(r.fingerprint, 16) == fps[r.doc_id]
        k = ids.index(r.doc_id)
        assert r.component_id == ids[comp.get(k, k)]


@pytest.mark.parametrize("large", [simhash.LARGE, 60])
def test_crowded_cells(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(1)
    base_fp = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.concatenate([[base_fp ^ np.uint64(1 << i) ^ np.uint64(1 << j)] for i in range(8) for j in range(i, 30)]))
    fps = np.concatenate((fps, rng.integers(0, 2**63, 200, dtype=np.uint64)))
    classes = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in connected_components(simhash.links(classes), Tables(spark)).collect()}
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    keep = x != y
    assert got == {**dict(zip(*(v.tolist() for v in forest(x[keep], y[keep])), strict=True)), **{r: r for r in set(forest(x[keep], y[keep])[1].tolist())}}


def test_similar_documents(spark):
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    near = []
    for t in texts[:10]:
        w = t.split()
        w[50] = "x"
        near.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts + near)] + [(99, None), (100, "")]
    kept = simhash.keep_representatives(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [*range(30), 99]


def test_similar_documents_by_similarity(spark):
    """Pairs of known Jaccard similarity: those of 0.85 or more are found, those of 0.65 or less are not."""
    rng = random.Random(8)
    rows, wanted = [], {}
    for k in range(240):
        a = [f"{k}-{rng.random()}" for _ in range(rng.choice((40, 300, 1500)))]
        b = list(a)
        for at in rng.sample(range(len(b)), max(1, round(len(b) * rng.uniform(0.004, 0.09)))):
            b[at] = "y" + str(rng.random())
        x, y = (set(simhash.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in (a, b))
        wanted[k] = len(x & y) / len(x | y)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    kept = {r.doc_id for r in simhash.keep_representatives(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in wanted)
    assert sum(j >= 0.85 for j in wanted.values()) > 20 and sum(j <= 0.65 for j in wanted.values()) > 50
    assert not [k for k, j in wanted.items() if j >= 0.85 and 2 * k + 1 in kept]
    assert not [k for k, j in wanted.items() if j <= 0.65 and 2 * k + 1 not in kept]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 32))
    x[100:160] = x[:60] + 0.1 * rng.normal(size=(60, 32))
    x[200:240] = x[0] + 0.05 * rng.normal(size=(40, 32))
    rows = [(i * 2, [float(c) for c in v], 1, "k") for i, v in enumerate(x)]
    rows += [(1, None, 1, "k"), (3, [0.0] * 32, 1, "k"), (5, [float("nan")] * 32, 1, "k"), (7, [None] * 32, 1, "k"), (9, [], 1, "k"), (None, rows[0][1], 1, "k"), rows[5], (11, [1e200] * 32, 1, "k")]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")).collect()}
    assert len(got) == len({r[0] for r in rows})
    ids = [None, *[r[0] for r in rows[:300]]]
    y = np.concatenate((x[:1], x))
    y /= np.linalg.norm(y, axis=1)[:, None]
    a, b = np.nonzero(y @ y.T >= 0.9)
    a, b = a[a != b], b[a != b]
    want = np.bincount(a, minlength=len(y))
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= n for i, n in zip(ids, want, strict=True))
    assert found >= 0.9 * want.sum()
    for i in (1, 3, 5, 7, 9):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_vectors_of_several_lengths_and_equal_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.normal(size=48)]) for i in range(40)]
    rows += [(100, [1.0, 0.5]), (101, [1.0, 0.5]), (102, [2.0, 1.0]), (103, [-1.0, 0.5]), (200, [0.5] * 300), (201, [0.25] * 300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v in rows}
    for i, v in rows:
        links = [j for j, w in rows if j != i and len(v) == len(w) and unit[i] @ unit[j] >= 0.9 - 1e-12]
        assert got[i].n_links == len(links), i
    assert got[102].component_id == 100 and got[201].component_id == 200 and got[319].component_id == min(i for i, v in rows if len(v) == 48 and unit[i] @ unit[0] >= 0.9)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BUCKET", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=32) + 0.02 * rng.normal(size=(150, 32))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.n_links == 149 and r.component_id == 0 for r in got)


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected_components(links, Tables(spark)).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_a_hub_of_the_largest_node(spark):
    links = spark.createDataFrame([(9000, i) for i in range(3000)] + [(i, 20000 + i) for i in range(0, 3000, 7)], "a long, b long").repartition(9)
    got = {r.node: r.component for r in connected_components(links, Tables(spark)).collect()}
    assert len(got) == 3001 + len(range(0, 3000, 7)) and set(got.values()) == {0}


def test_join_hot(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 9)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_hot(rows, table, "k", "n", 57, most=5, least=1).orderBy("k", "v").collect()
    assert [(r.k, r.v, r.n) for r in got] == [(1, i, 50) for i in range(50)] + [(k, 0, 1) for k in range(2, 9)]


def test_texts_of_one_doc_id(spark):
    """Rows of one doc_id with different texts are documents of their own."""
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, passage + " one"), (1, "two " + passage), (2, passage), (2, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = fm_dedup.remove_repeats(spark, frame).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 40), (2, 40), (2, 40)]
    got = suffix_dedup.remove_repeats(spark, frame).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in got) == [(1, False), (1, True), (2, True), (2, True)]


def test_very_long_texts(spark):
    """Over a megabyte in one row, and its middle once more."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200_000)]
    text, part = " ".join(words), " ".join(words[50_000:90_000])
    frame = spark.createDataFrame([(1, text), (2, part), (3, "z " * 700_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark, frame).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, len(part), 1)
    assert (got[3].n_removed, got[3].n_bytes) == (1_400_000 - 2, 1_400_000)
    got = {r.doc_id: r for r in fm_dedup.remove_repeats(spark, frame, digest=True).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 40_000, 0)
    got = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(spark, frame).collect()}
    assert got == {1: reference_fingerprint(text), 2: reference_fingerprint(part), 3: reference_fingerprint("z " * 700_000)}


def test_a_frequent_trigger(spark, monkeypatch):
    """Phrases of a trigger that the sample finds are dealt by their windows."""
    monkeypatch.setattr(base, "FREQUENT", 2)
    rng = random.Random(1)
    line = " ".join(f"common{i}" for i in range(15))
    rows = [(i, " ".join([str(rng.random()) for _ in range(9)] + [line] + [str(rng.random()) for _ in range(9)])) for i in range(60)]
    for op, units, window, across in ((suffix_dedup, lambda t: t.encode(), 100, False), (fm_dedup, lambda t: t.split(), 13, True)):
        gone = brute_windows([(i, units(t)) for i, t in rows], window, across)
        got = op.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
        assert {r.doc_id: r.n_removed for r in got} == {i: len(x) for i, x in gone.items()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeats(spark, docs).count() == 0
    assert fm_dedup.remove_repeats(spark, docs).count() == 0
    assert simhash.near_duplicates(spark, docs).count() == 0
    assert simhash.keep_representatives(spark, docs).count() == 0
    assert embed_dedup.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_similarity_is_that_of_the_sets(spark):
    """Repeats of a shingle neither part texts of one set nor join texts of different sets."""
    rng = random.Random(5)
    words = lambda n: [str(rng.random()) for _ in range(n)]
    rows, alike, unlike = [], [], []
    for k in range(10):
        own, line = words(200), words(8)
        rows += [(4 * k, " ".join(own + line * 2)), (4 * k + 1, " ".join(own + line * 30))]
        alike.append(4 * k + 1)
        rows += [(4 * k + 2, "| " * 300 + " ".join(words(40))), (4 * k + 3, "| " * 300 + " ".join(words(40)))]
        unlike += [4 * k + 2, 4 * k + 3]
    kept = {r.doc_id for r in simhash.keep_representatives(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not kept & set(alike)
    assert kept >= set(unlike)


def test_jaccard_at_the_limit():
    sets = lambda n, m: (np.arange(n, dtype=np.int64), np.arange(m, dtype=np.int64))
    assert simhash.jaccard_at_least(*sets(4, 5)) and simhash.jaccard_at_least(*sets(5, 4)) and simhash.jaccard_at_least(*sets(0, 0))
    assert not simhash.jaccard_at_least(*sets(3, 4)) and not simhash.jaccard_at_least(*sets(0, 1))
    assert not simhash.jaccard_at_least(np.array([1, 9]), np.array([2, 9]))


def test_texts_go_to_python_by_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, real = spark.conf.get(name), simhash.shingle_sets
    monkeypatch.setattr(simhash, "shingle_sets", lambda *x: seen.append(int(spark.conf.get(name))) or real(*x))
    docs = spark.createDataFrame([(i, f"some words of a text that has ten copies {i % 2}") for i in range(20)], "doc_id long, text string")
    assert simhash.keep_representatives(spark, docs).count() == 2
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before
