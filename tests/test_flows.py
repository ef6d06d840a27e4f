"""Streams that are cut off and go on, pattern tables, cascades, sinks and retention."""

import glob
import json
import os
import random

from conftest import SF
from pyspark.sql import functions as F

from papyr.functions import text as t
from papyr.operators import cascade, patterns, retention, structure
from papyr.streaming import expiry, sink


def reads_plainly(rows, ttl):
    last, out = {}, {}
    for i, k, s in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = k in last and s - last[k] <= ttl
        last[k] = s
    return out


def test_expiring_reads_after_a_restart(spark, tmp_path):
    """Reads in files of a day each, one a batch; the stream stops half way, is started anew and gives what a batch gives, and its state shrinks."""
    rng = random.Random(5)
    rows = sorted(((i, rng.randrange(12) if i < 300 else rng.randrange(2), rng.randrange(4_000_000) if i < 300 else 4_000_000 + rng.randrange(4_000_000)) for i in range(420)), key=lambda r: r[2])
    # the first hundred keys' reads end in the first half
    size, src, at = 42, tmp_path / "in", str(tmp_path / "run")
    for k in range(10):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], "event_id long, key long, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
        part.coalesce(1).write.parquet(f"{src}/{k}")
        os.utime(glob.glob(f"{src}/{k}/part-*")[0], (1_700_000_000 + k, 1_700_000_000 + k))
    ttl = 100_000

    def run(files):
        reads = spark.readStream.schema("event_id long, key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/{files}")
        with expiry.rocksdb(spark):
            q = expiry.expiring_reads(reads, ttl).writeStream.option("checkpointLocation", f"{at}/state").outputMode("append")
            q = q.foreachBatch(sink.once_per_batch(f"{at}/out")).trigger(availableNow=True).start()
            q.awaitTermination()
            return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]

    first = run("[0-4]")
    second = run("[0-9]")
    out = sink.written(spark, f"{at}/out", spark.createDataFrame([], expiry.READS).schema).collect()
    hits = {r.event_id: r.hit for r in out if r.event_id is not None}
    assert hits == reads_plainly(rows, ttl) and len([r for r in out if r.event_id is not None]) == len(rows)
    ends = [(r.key, r.us) for r in out if r.event_id is None]
    assert len(ends) == len(set(ends)) > 100
    # two keys are left at the end
    assert max(first) > second[-1]


def test_a_replayed_batch_gives_no_second_copy(spark, tmp_path):
    at, write = str(tmp_path / "out"), None
    write = sink.once_per_batch(at)
    a, b = spark.range(5), spark.range(5, 9)
    write(a, 0), write(b, 1), write(b, 1), write(a, 0)
    assert sorted(r.id for r in sink.written(spark, at, a.schema).collect()) == list(range(9))


def test_patterns_equal_a_plain_search(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abé\n") for _ in range(rng.choice((0, 3, 63, 64, 65, 300, 1000))))) for i in range(30)] + [(99, None)]
    known = [(k, "".join(rng.choice("abé\n") for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 3, 3, 12])] + [(50, texts[5][1][:200] or "x"), (51, ""), (52, None), (53, max(texts[:30], key=lambda x: len(x[1]))[1][100:260])]
    want = {(i, k, at) for i, x in texts for k, p in known if p for at in range(len(x or "")) if x.startswith(p, at)}
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(known, "pattern_id long, pattern string")
    for most in (patterns.BROADCAST, 0):
        monkeypatch.setattr(patterns, "BROADCAST", most)
        got = [tuple(r) for r in patterns.pattern_hits(a, b, "doc_id").collect()]
        assert set(got) == want and len(got) == len(want)
    assert patterns.pattern_hits(a, b.where("pattern_id = 51"), "doc_id").count() == 0


def test_ten_thousand_patterns_in_one_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known = spark.range(10_000).select(F.col("id").alias("pattern_id"), F.concat(F.lit("no such "), "id").alias("pattern"))
    known = known.union(docs.select(F.col("doc_id") + 20_000, F.substring("text", 5, 30)))
    hits = patterns.pattern_hits(docs, known, "doc_id").where("pattern_id < 10000 or doc_id = pattern_id - 20000").select("pattern_id").distinct()
    assert hits.count() == docs.where(F.length(F.substring("text", 5, 30)) > 0).count()


def test_only_windows_that_may_begin_a_pattern_are_moved(spark):
    docs = spark.range(50).select("id", F.repeat(F.concat(F.lit("some words of text "), F.col("id").cast("string")), 40).alias("text"))
    known = spark.range(3_000).select(F.col("id").alias("pattern_id"), F.concat(F.lit("text no such "), "id").alias("pattern"))
    found, *_ = patterns._candidates(docs, "id", "text", patterns._known(known), once=False)
    assert found.count() < docs.agg(F.sum(F.length("text"))).first()[0] / 100
    assert patterns.pattern_counts(docs, known).count() == 0


def test_pattern_counts_equal_a_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(patterns, "MOST_BITS", 64)  # lets nearly all through
    texts = ["".join(rng.choice("ab😀\n") for _ in range(rng.choice((0, 1, 40, 700)))) for _ in range(20)] + ["ab" * 70_000 + "a😀b", None]
    texts += texts[:9]
    long = max(texts[:20], key=len)
    known = ["a", "ab", "a😀b", "", None, "ab", "b" * 31, long[3:34], long[3:35], long[3:36], long[5:190], long[5:189] + "x"]
    docs = spark.createDataFrame([(0, x) for x in texts], "doc_id long, text string")
    for some in (known, known[:9]):
        want = {p: n for p in some if p and (n := sum(p in (x or "") for x in texts))}
        got = patterns.pattern_counts(docs, spark.createDataFrame([(x,) for x in some], "pattern string")).collect()
        assert {r["pattern"]: r["n"] for r in got} == want and len(got) == len(want)


def test_later_strategies_see_what_is_left(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(70)] + [(99, None)], "id long, text string")
    known = cascade.Registry()
    known.register(2, cascade.Strategy("any", lambda r: r["text"], lambda x: F.length(x) > 0))
    known.register(1, cascade.Strategy("long", lambda r: F.upper(r["text"]), lambda x: F.length(x) > 4, lambda r: r["id"] < 60))
    stages = []
    out = {r.id: (r.method, r.result) for r in cascade.first_accepted(rows, known, stages).collect()}
    assert [s.count() for s in stages] == [71, 71 - sum(i % 7 > 4 for i in range(60))]
    for i in range(70):
        n = i % 7
        assert out[i] == (("long", "X" * n) if n > 4 and i < 60 else ("any", "x" * n) if n else (None, None))
    assert out[99] == (None, None) and len(out) == 71


def test_days_that_do_not_change_keep_their_files(spark, tmp_path):
    at = str(tmp_path / "t")
    retention.write_by_day(spark.range(60).withColumn("d", F.col("id") % 4), f"file://{at}", F.concat(F.lit("d"), "d"))
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{at}/day=*/part-*")}
    assert retention.delete_rows(spark, f"file://{at}", (F.col("d") == 1) | ((F.col("d") == 2) & (F.col("id") < 10)), F.col("day").isin("d1", "d2", "d3")) == 15 + 2
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{at}/day=*/part-*")}
    same = {f for f in after if before.get(f) == after[f]}
    assert {os.path.basename(os.path.dirname(f)) for f in same} == {"day=d0", "day=d3"} and not glob.glob(f"{at}/day=d1")
    assert sorted(r.id for r in spark.read.parquet(f"file://{at}").collect()) == [i for i in range(60) if i % 4 != 1 and not (i % 4 == 2 and i < 10)]
    assert retention.delete_rows(spark, f"file://{at}", F.lit(False), F.lit(True)) == 0


def tree_plainly(sections):
    out, stack = [], []
    for text, level, index in sections:
        node = {"text": text, "level": level, "index": index, "children": []}
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        (stack[-1]["children"] if stack else out).append(node)
        stack.append(node)
    return out


def test_trees_equal_a_stack(spark):
    rng = random.Random(8)
    rows = [(d, i, f'h"{i}\\', rng.randint(1, 6)) for d in range(40) for i in range(rng.randint(1, 30))] + [(50, 1, None, 3)]
    heads = spark.createDataFrame(rows, "doc_id long, idx long, text string, level int")
    got = {r.doc_id: json.loads(r.tree) for r in structure.heading_trees(heads).collect()}
    for d in {r[0] for r in rows} - {50}:
        assert got[d] == tree_plainly([(x, n, i) for k, i, x, n in rows if k == d])
    assert got[50] == [{"level": 3, "index": 1, "children": []}]


def test_stray_marks(spark):
    lines = {"<a><b>": ["a", "b"], "> <a> > <b<c> >": ["", "a", "a", "c", "c"], "a > b": None, "<": None, "<a": None, "x<a>y": ["a"], "<><": [""], "><": [""], "a><b": [""]}
    frame = spark.createDataFrame([(k,) for k in lines], "x string").select("x", structure.table_rows(F.col("x")).alias("rows"))
    for r in frame.collect():
        assert r.rows == ([lines[r.x]] if lines[r.x] is not None else []), r.x


def test_rows_by_header(spark):
    text = "<a><b><a>\n<1><2><3><4>\n<5>\n<6><7>"
    named = spark.createDataFrame([(text,)], "x string").select(structure.rows_by_header(structure.table_rows(F.col("x"))).alias("y")).first().y
    assert named == [{"a": "3", "b": "2"}, {"a": "5"}, {"a": "6", "b": "7"}]
    assert spark.createDataFrame([("<a>",)], "x string").select(structure.rows_by_header(structure.table_rows(F.col("x"))).alias("y")).first().y == []


def test_a_value_is_computed_once(spark):
    plan = spark.createDataFrame([("a",)], "x string").select(t.gate(F.reverse("x")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(x#") == 1


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """300 MB in ranges: every byte once, in several tasks; too large, missing and empty files are rows of their own."""
    from papyr.sources import ranged

    ranged.register(spark)
    block = bytes(range(256)) * 4096
    with open(tmp_path / "big.bin", "wb") as f:
        for k in range(300):
            f.write(k.to_bytes(4, "little") + block[4:])
    (tmp_path / "none.bin").write_bytes(b"")
    read = lambda path, **o: spark.read.format("ranged").options(**o).load(path)
    rows = read(f"{tmp_path}/*.bin", size=32 << 20)
    assert rows.rdd.getNumPartitions() == 11
    own = rows.withColumn("head", F.hex(F.substring("content", 1, 4))).withColumn("n", F.octet_length("content")).select("path", "start", "head", "n", "file_size", "error").collect()
    big = sorted((r for r in own if r.path.endswith("big.bin")), key=lambda r: r.start)
    assert [r.head for r in big] == [(32 * i).to_bytes(4, "little").hex().upper() for i in range(10)]
    assert sum(r.n for r in big) == 300 << 20 and not any(r.error for r in own)
    assert [(r.start, r.n, r.file_size) for r in own if r.path.endswith("none.bin")] == [(0, 0, 0)]
    capped = read(f"file://{tmp_path}/big.bin", most=1 << 20).first()
    assert capped.content is None and capped.error.startswith("314572800 bytes") and capped.file_size == 300 << 20
    assert read(f"{tmp_path}/gone.bin").first().error == "not found"


def test_a_bucketed_cache_is_not_moved(spark):
    from papyr.operators.caches import ResultCache

    cache = ResultCache(spark, 4)
    cache.store(spark.createDataFrame([(f"k{i % 50}", f"r{i % 50}") for i in range(100)] + [(None, "x")], "key string, result string"))
    assert cache.table.count() == 50
    inputs = spark.createDataFrame([(i, f"k{i}") for i in range(90)] + [(99, None)], "id long, key string")
    out = cache.lookup(inputs)
    assert {r.id: r.result for r in out.collect()} == {i: f"r{i}" if i < 50 else None for i in [*range(90), 99]}
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    # what lies between the join and the cache's scan on the scan's own side
    branch, at = [], scan
    for i in range(scan, join, -1):
        if depth(lines[i]) < depth(lines[at]) or i == scan:
            branch.append(lines[i])
            at = i
    assert not any("Exchange" in x for x in branch), "\n".join(lines)
    cache.drop()
