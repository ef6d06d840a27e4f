"""Queries without SQL, and whole-document operators, against plain Python versions."""

import random

import pytest
import regex
from conftest import SF
from pyspark.sql import functions as F

from papyr.functions import charclass as cc
from papyr.functions import text as t
from papyr.operators import documents as d
from papyr.operators import structure as s
from papyr.plans import registry


def py(pattern):
    """A pattern in the writing of Python."""
    return regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


def inside(cls):
    return regex.compile(f"[{py(cls)}]").match


NOISE, ALLOWED, KOREAN = inside(cc.NOISE), inside(cc.ALLOWED + cc.ALLOWED_SPACES), inside(cc.KOREAN)


def korean_share(x):
    rest = [c for c in x if not c.isspace()]
    return sum(bool(KOREAN(c)) for c in rest) / len(rest) if rest else 0


#: Tokens and whether they are kept, by what the rule says of their kind.
TOKENS = {
    True: ["한국어", "가", "가나다라마바사아자차카타", "a가", "가12345678", "12", "1234567890", "①", "²³", "x", "ab", "Abc1", "日本", "é", "a.b", "x-y/z", "1,000", "12:30", "abcdefghij", "#", "!?", "()", "※", "→", "⇒"],
    False: ["", "가bcdefghijk", "abcdefghijk", "12345678901", "aaaaa", "abababab", "11111", "a_b", "50%", "###", "(((", "...!", "●", "—", "x=1", "→→"],
}


def test_tokens_by_the_rule(spark):
    rows = [(w, keep) for keep, words in TOKENS.items() for w in words]
    frame = spark.createDataFrame(rows, "w string, keep boolean")
    assert [r.w for r in frame.where(t.meaningful(F.col("w")) != F.col("keep")).collect()] == []


def keep_tokens(spark, texts):
    """The tokens of each text that are kept; the rule itself has a test of its own above."""
    words = sorted({w for x in texts for w in x.split()})
    kept = {r.w for r in spark.createDataFrame([(w,) for w in words], "w string").where(t.meaningful(F.col("w"))).collect()}
    return [" ".join(w for w in x.split() if w in kept) for x in texts]


def ascii_noise(x):
    x = regex.sub(r"(.)\1{3,}", "", x)
    for p in cc.ASCII_NOISE:
        x = regex.sub(p, "", x)
    return x


def clean(spark, texts):
    out = []
    for x in texts:
        x = ascii_noise("".join(c for c in x if not NOISE(c)))
        x = regex.sub(f"[^{py(cc.KOREAN)}]{{11,}}", "", x)
        out.append("".join(c if ALLOWED(c) else " " if c.isspace() else "" for c in x))
    return [x.strip() if len(x) >= 10 and korean_share(x) >= 0.05 else "" for x in keep_tokens(spark, out)]


def garbled_ok(x):
    bad = sum(bool(NOISE(c)) and c not in "\n\r\t" for c in x)
    korean, latin = sum(bool(KOREAN(c)) for c in x), sum(c.isascii() and c.isalpha() for c in x)
    return len(x) >= 10 and sum(bool(ALLOWED(c)) for c in x) / len(x) > 0.5 and bad / len(x) < 0.1 and (korean > 10 or latin > 20)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["한국어", "문서 ", "입니다.", " ", "\t", "\n", "aaaa", "AbC", "ABCDEFGHI", "abcdefghijk", "12.5", "①", "→", "※", "㐀", "Ж", "ā", "　", "\u2028", "####", "!?", "(((", "..", "x-y/z", "50%", "ㄱㄴ", "é", "\x0b", "\x00", "힣", "●", "::", "가나다라마바사", "日本"]
    return ["", "x", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500))]


@pytest.mark.parametrize(
    ("column", "plain"),
    [(t.clean, clean), (t.strip_ascii_noise, lambda _, xs: [ascii_noise(x) for x in xs]), (t.garbled_ok, lambda _, xs: [garbled_ok(x) for x in xs]), (t.keep_tokens, keep_tokens),
     (lambda c: t.clean(t.clean(c)), lambda spark, xs: clean(spark, clean(spark, xs)))],
)
def test_cleaning(spark, texts, column, plain):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string")
    got = {r.i: r.y for r in frame.select("i", column(F.col("x")).alias("y")).collect()}
    want = plain(spark, texts)
    assert {texts[i] for i, y in got.items() if y != want[i]} == set()


def test_sentences_and_blank_runs(spark):
    rows = ["", " . ", "a. b! c?", "  x  ", "no end", "a...b", ". .a", " " * 200_000 + "a" + "\n" * 200_000 + ". b"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i long, x string")
    got = {r.i: (r.n, r.a) for r in frame.select("i", t.text_statistics(F.col("x"))["sentence_count"].alias("n"), t.text_statistics(F.col("x"))["avg_sentence_length"].alias("a")).collect()}
    for i, x in enumerate(rows):
        parts = [p for p in regex.split("[.!?]+", x) if p.strip()]
        assert got[i] == (len(parts), round(sum(len(p.split()) for p in parts) / max(len(parts), 1), 6))


def test_boundary_chunks(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in registry.QUERIES["boundary_chunks"](spark, SF).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for i, x in docs.items():
        want = []
        while len(x) > 500:
            m = regex.match(r"(?s).{0,499}\n", x) or regex.match(r"(?s).{0,498}\. ", x) or regex.match("(?s).{500}", x)
            want.append(m[0])
            x = x[len(m[0]) :]
        assert got.get(i, []) == [*want, x] if x else want


def test_leaky_bucket(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).collect()
    want, water = {}, {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.t, r.event_id)):
        level, last = water.get(r.user_id, (0.0, r.t))
        level = max(0.0, level - (r.t - last) * (1 / 21600))
        want[r.event_id] = level <= 1
        water[r.user_id] = (level + want[r.event_id], r.t)
    assert {r.event_id: r.accepted for r in registry.QUERIES["leaky_bucket"](spark, SF).collect()} == want


def test_accepted_strategy(spark):
    rows = registry.QUERIES["strategy_accepted"](spark, SF).collect()
    from papyr.plans.documents import BODIES
    from papyr.plans.inputs import made

    seen = set()
    source = {(r.doc_id, r.idx): r for r in made(spark, SF, BODIES).collect()}
    every = sorted({x for r in source.values() for x in (r.body, r.preview)})
    cleaned = dict(zip(every, clean(spark, every), strict=True))
    for r in rows:
        x = source[r.doc_id, r.idx]
        own, other = cleaned[x.body], cleaned[x.preview]
        method, text = None, None
        if len(x.body) > 500 and korean_share(own) < 0.1 and len(x.preview) > 100 and len(other) > 50 and korean_share(other) > korean_share(own):
            method, text = "preview", other
        elif len(x.body) > 500 and len(own) >= 100:
            method, text = "body", own
        elif len(x.preview) > 500 and len(other) >= 100:
            method, text = "preview", other
        assert (r.method, r.n) == (method, None if text is None else len(text))
        seen.add(method)
    assert len(rows) == len(source) and seen == {None, "body", "preview"}


def test_sections_are_cleaned_twice(spark):
    from papyr.plans.documents import BODIES
    from papyr.plans.inputs import made

    parts = {}
    rows = made(spark, SF, BODIES).orderBy("doc_id", "idx").collect()
    for r, x in zip(rows, clean(spark, [r.body for r in rows]), strict=True):
        if x:
            parts.setdefault(r.doc_id, []).append(x)
    got = {r.doc_id: r.result for r in registry.QUERIES["section_clean"](spark, SF).collect()}
    assert got == dict(zip(parts, clean(spark, ["\n\n".join(v) for v in parts.values()]), strict=True))


def test_a_parsed_document(spark):
    """Three paragraphs, one with Korean, a table of three rows, and the whole text behind them."""
    body = ["This is the first paragraph.", "This is the second paragraph with Korean text: 안녕하세요", "This is the third paragraph."]
    paras = spark.createDataFrame([(1, i, x) for i, x in enumerate(body)], "doc_id long, i int, text string")
    tables = spark.createDataFrame([(1, 0, None, [["Header 1", "Header 2"], ["Cell 1", "Cell 2"], ["Cell 3", "Cell 4"]])], "doc_id long, tbl int, position int, rows array<array<string>>")
    meta = spark.createDataFrame([(1, "Test Document", "Test Author")], "doc_id long, title string, author string")
    whole = spark.createDataFrame([(1, "\n\n".join(body))], "doc_id long, text string")
    r = d.structured(paras, tables, meta, whole).first()
    x = r.statistics
    assert [p["word_count"] for p in r.paragraphs] == [5, 9, 5] and r.tables[0]["summary"] == "Table with 3 rows and 2 columns"
    assert (x.char_count, x.char_count_no_spaces, x.word_count, x.line_count, x.sentence_count, x.avg_sentence_length) == (281, 221, 53, 17, 4, 13.25)
    assert (x.paragraph_count, x.table_count, x.korean_ratio, x.english_ratio) == (3, 1, round(10 / 281, 6), round(196 / 281, 6))
    assert (r.metadata.title, r.metadata.created_date, r.metadata.creator, r.metadata.language) == ("Test Document", "", "HWP", "ko")
    md = d.to_markdown(paras, tables, meta).first().markdown
    assert md.startswith("---\ntitle: Test Document\nauthor: Test Author\ncreator: HWP\nlanguage: ko\n---\n\n") and "| Header 1 | Header 2 |\n|---|---|\n| Cell 1 | Cell 2 |" in md
    assert not d.to_markdown(paras, tables, None).first().markdown.startswith("---")


def test_a_table_keeps_all_its_rows(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array(i.cast("string"))).alias("x"))
    assert rows.select(s.markdown_table(F.col("x")).alias("m")).first().m.count("\n") == 6
    assert rows.select(s.padded_table(F.col("x")).alias("m")).first().m == "\n".join(["| 0   |", "| --- |", *(f"| {i}   |" for i in range(1, 6))])


def test_buffer_of_a_null_key(spark):
    from papyr.operators.chains import buffered_rows

    frame = spark.createDataFrame([(None, 1, "ab"), (None, 2, "cd"), (1, 1, "x")], "k long, o long, text string")
    got = sorted((r.k is not None, r.flush, r.content) for r in buffered_rows(frame, 3, "k", "o").collect())
    assert got == [(False, 0, "abcd"), (True, 0, "x")]
