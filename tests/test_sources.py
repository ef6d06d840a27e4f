"""Container readers on files made here."""

import struct
import zlib

import pytest

from papyr.sources import cfb, hwp, hwpx


def test_compound_file_round_trip():
    streams = {"FileHeader": b"x" * 40, "BodyText/Section0": b"a" * 5000, "BodyText/Section1": b"", "PrvText": "가나다".encode("utf-16-le") * 50}
    f = cfb.CompoundFile(cfb.build(streams))
    assert {k: f.read(k) for k in f.streams} == streams


@pytest.mark.parametrize("data", [b"", b"abc", cfb.MAGIC, cfb.MAGIC + b"\xff" * 600, cfb.build({"a": b"1"})[:700]])
def test_broken_compound_files(data):
    with pytest.raises((ValueError, struct.error, IndexError)):
        cfb.CompoundFile(data)


def test_records():
    long = "가" * 5000
    data = hwp.record(0x42, "첫째".encode("utf-16-le"), 3) + hwp.record(0x43, b"zz") + hwp.record(0x42, long.encode("utf-16-le"))
    got = list(hwp.records(data))
    assert [(r.tag, r.level) for r in got] == [(0x42, 3), (0x43, 0), (0x42, 0)]
    assert hwp.plain_text(got[2].payload) == long
    assert list(hwp.records(data[:-1]))[-1].tag == 0x43  # the last one overruns


def test_controls():
    units = [0x41, 2, *[0x61] * 6, 0x42, 24, *[0x61] * 7, 0x43, 0, 0x44]
    assert hwp.controlled_text(struct.pack(f"<{len(units)}H", *units)) == "ABC"
    assert hwp.plain_text("a\tb\rc\nd".encode("utf-16-le")) == "a bc\nd"


def test_inflate():
    body = b"some text" * 100
    packer = zlib.compressobj(wbits=-15)
    assert hwp.inflate(packer.compress(body) + packer.flush()) == body
    assert hwp.inflate(zlib.compress(body)) == body
    assert hwp.inflate(b"\xff\xfe plain") == b"\xff\xfe plain"


def test_scan_gives_errors_as_rows(spark):
    files = spark.createDataFrame([("good", cfb.build({"FileHeader": b"\0" * 40, "BodyText/Section0": hwp.record(0x42, "가나".encode("utf-16-le"))})), ("bad", b"oops"), ("none", None)], "path string, content binary")
    got = {r.path: (r.text, r.error is not None) for r in hwp.scan(files).collect()}
    assert got == {"good": ("가나", False), "bad": (None, True), "none": (None, True)}


def test_hwpx(spark):
    table = f'<s xmlns:hp="{hwpx.NS_2011}"><hp:p><hp:run><hp:charPr bold="1"/><hp:t>굵은 </hp:t></hp:run><hp:run><hp:t>글</hp:t></hp:run></hp:p><hp:tbl><hp:tr><hp:tc colSpan="2"><hp:subList><hp:p><hp:run><hp:t>칸</hp:t></hp:run></hp:p></hp:subList></hp:tc></hp:tr></hp:tbl></s>'
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("Contents/section0.xml", table)
        z.writestr("Contents/section1.xml", "<broken")
    d = hwpx.read(b.getvalue())
    assert d["paragraphs"] == [{"text": "굵은 글", "emphasis": True, "para_style": None, "style": None}]
    assert d["tables"] == [{"rows": [[{"text": "칸", "colSpan": 2, "rowSpan": 1}]], "row_count": 1, "col_count": 1}]
    files = spark.createDataFrame([("a", hwpx.write([["x", "y"], ["z"]])), ("b", b"no zip")], "path string, content binary")
    got = {r.path: (r.text, r.error is not None) for r in hwpx.scan(files).collect()}
    assert got == {"a": ("x\ny\nz", False), "b": (None, True)}


def _xml(body):
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Contents/section0.xml", f'<s xmlns:hp="{hwpx.NS_2011}">{body}</s>')
    return b.getvalue()


def test_nested_runs_and_texts():
    run = lambda x, shape="": f"<hp:run>{shape}{x}</hp:run>"
    deep = _xml(f"<hp:p><hp:ctrl>{run('<hp:box><hp:t>in</hp:t></hp:box>')}</hp:ctrl>{run('<hp:t> out</hp:t>')}{run('', '<hp:charPr bold=\"1\"/>')}</hp:p>")
    # a run inside another element and a text inside a run count; an empty emphasised run does not
    assert [(p["text"], p["emphasis"]) for p in hwpx.read(deep)["paragraphs"]] == [("in out", False)]


def test_tables_of_odd_shapes():
    cell = lambda x, at="", own="": f"<hp:tc{own}>{at}<hp:subList><hp:p><hp:run><hp:t>{x}</hp:t></hp:run></hp:p></hp:subList></hp:tc>"
    body = (
        f'<hp:tbl><hp:tr/><hp:tr>{cell("a", "<hp:cellAddr rowSpan=\"3\"/>", " colSpan=\"2\"")}{cell("b", "<hp:cellAddr colSpan=\"\"/>")}</hp:tr></hp:tbl>'
        f'<hp:tbl><hp:tr/></hp:tbl><hp:tbl><hp:tr>{cell("c", own=" colSpan=\"x\"")}</hp:tr></hp:tbl>'
    )
    d = hwpx.read(_xml(body))
    assert d["tables"] == [{"rows": [[{"text": "a", "colSpan": 2, "rowSpan": 3}, {"text": "b", "colSpan": 1, "rowSpan": 1}]], "row_count": 1, "col_count": 2}]
    assert d["paragraphs"] == []


def test_damaged_and_large_zips_are_error_rows(spark, monkeypatch):
    whole = bytearray(hwpx.write([["text " * 2000]]))
    at = whole.index(b"Contents/section0.xml") + 60
    whole[at : at + 12] = b"\xff" * 12
    monkeypatch.setattr(hwpx, "MAX_ENTRY", 1000)
    for data in (bytes(whole), hwpx.write([["x" * 5000]])):
        try:
            hwpx.read(data)
            raise AssertionError("read")
        except (ValueError, zlib.error, EOFError, OSError) as e:
            assert str(e)
    monkeypatch.undo()
    got = {r.path: r.error for r in hwpx.scan(spark.createDataFrame([("a", bytes(whole)), ("b", hwpx.write([["y"]]))], "path string, content binary")).collect()}
    assert got["a"] and got["b"] is None


def test_a_section_over_the_limit_is_refused():
    with pytest.raises(ValueError):
        hwp.inflate(zlib.compress(b"x" * 5000), most=1000)
    with pytest.raises(ValueError):
        hwp.inflate(b"\xff plain" * 1000, most=1000)


def test_other_texts_of_compound_files():
    assert hwp.broken_text("a\tb\rc\x01d".encode("utf-16-le")) == "a\tb\ncd"
    data = cfb.build({"FileHeader": b"\0" * 40, "PrvText": ("첫째 " * 40 + "\n\n \n\n둘째").encode("utf-16-le")})
    assert hwp.preview_paragraphs(data) == [("첫째 " * 40).strip(), "둘째"]


def test_summaries(spark):
    import datetime

    made = hwp.summary_stream({2: "제목", 3: "", 4: "a" * 300, 13: datetime.datetime(2024, 2, 29, 1, 2, 3)})
    assert hwp.summary(made) == {"title": "제목", "subject": "", "author": "a" * 300, "modified_date": "2024-02-29T01:02:03"}
    files = [("a", cfb.build({hwp.SUMMARY: made})), ("b", cfb.build({"x": b"1"})), ("c", cfb.build({hwp.SUMMARY: b"oops" * 20})), ("d", cfb.build({hwp.SUMMARY: made[:60]})), ("e", None)]
    got = {r.path: (r.title, r.error is None) for r in hwp.scan_summaries(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a": ("제목", True), "b": (None, True), "c": (None, False), "d": (None, False), "e": (None, False)}
