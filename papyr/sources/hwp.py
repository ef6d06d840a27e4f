"""Word processor files in compound containers: sections, records, paragraph texts.

Tags and control characters are parameters: no sample files exist to confirm
them against.  A file that cannot be read gives an error column, never a failed
job.
"""

from __future__ import annotations

import datetime
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyr.sources.cfb import CompoundFile

# Tags of the records that hold text, control characters and their widths.
PARA_TEXT = 0x42
TEXT_TAGS = {
    0x42: "HWPTAG_PARA_TEXT", 0x43: "HWPTAG_PARA_HEADER", 0x44: "HWPTAG_PARA_CHAR_SHAPE", 0x47: "HWPTAG_CTRL_HEADER",
    0x4D: "HWPTAG_TABLE", 0x57: "HWPTAG_CTRL_DATA", 0x58: "HWPTAG_EQEDIT", 0x5C: "HWPTAG_MEMO_LIST",
}
WIDE_CONTROLS = frozenset([*range(1, 19), 21, 22, 23])
WIDE_BYTES = 12
FIELD_CONTROL, FIELD_BYTES = 24, 14
MAX_FILE = 10 * 1024 * 1024
MAX_SECTION = 50 * 1024 * 1024


def inflate(data: bytes, most: int = MAX_SECTION) -> bytes:
    """Raw deflate, else zlib, else the bytes as they are; more than `most` bytes are refused."""
    for bits in (-15, 15):
        try:
            unpacker = zlib.decompressobj(bits)
            out = unpacker.decompress(data, most + 1)
        except zlib.error:
            continue
        if out or unpacker.eof:
            return _bounded(out, most)
    return _bounded(data, most)


def _bounded(data: bytes, most: int = MAX_SECTION) -> bytes:
    if len(data) > most:
        raise ValueError(f"section of over {most} bytes")
    return data


@dataclass(frozen=True)
class Record:
    tag: int
    level: int
    payload: bytes


def records(data: bytes) -> Iterator[Record]:
    """Records of a section until its end or a size that overruns it."""
    at, end = 0, len(data)
    while at + 4 <= end:
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > end:
                return
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if at + size > end:
            return
        yield Record(head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size])
        at += size


def record(tag: int, payload: bytes, level: int = 0) -> bytes:
    """The bytes of one record."""
    n = len(payload)
    head = tag | level << 10 | min(n, 0xFFF) << 20
    return struct.pack("<I", head) + (struct.pack("<I", n) if n >= 0xFFF else b"") + payload


def plain_text(payload: bytes) -> str:
    """Every code unit as text: line feeds stay, tabs become spaces, other controls go."""
    text = payload[: len(payload) & ~1].decode("utf-16-le", "ignore")
    return "".join(c for c in text.replace("\t", " ") if c >= " " or c == "\n").strip()


def broken_text(payload: bytes) -> str:
    """Every code unit as text: tabs and line feeds stay, carriage returns become line feeds, other controls go."""
    text = payload[: len(payload) & ~1].decode("utf-16-le", "ignore")
    return "".join(c for c in text.replace("\r", "\n") if c >= " " or c in "\n\t")


def preview_paragraphs(data: bytes) -> list[str]:
    """Paragraphs of the stored preview, between empty lines; stripped, empty ones left out."""
    return [x for p in preview_text(data).split("\n\n") if (x := p.strip())]


def controlled_text(payload: bytes, wide: frozenset[int] = WIDE_CONTROLS) -> str:
    """Text that skips what follows inline controls; a zero ends it."""
    out, at = bytearray(), 0
    while at + 2 <= len(payload):
        (unit,) = struct.unpack_from("<H", payload, at)
        at += 2
        if unit == 0:
            break
        if unit in wide:
            at += WIDE_BYTES
        elif unit == FIELD_CONTROL:
            at += FIELD_BYTES
        elif unit >= 32:
            out += struct.pack("<H", unit)
    return out.decode("utf-16-le", "ignore")


def sections(data: bytes, ole_limit: int = MAX_FILE) -> list[tuple[str, bytes]]:
    """(name, inflated bytes) of the body's sections in the order of their numbers."""
    if len(data) > ole_limit:
        raise ValueError("file too large")
    f = CompoundFile(data)
    header = f.read("FileHeader") if "FileHeader" in f.streams else b""
    packed = not header or len(header) < 37 or bool(header[36] & 1)
    names = [p for p in f.streams if p.count("/") == 1 and p.startswith("BodyText/")]
    number = lambda p: (int("".join(filter(str.isdigit, p.rpartition("/")[2])) or 0), p)
    return [(p, inflate(raw) if packed else _bounded(raw)) for p in sorted(names, key=number) if (raw := f.read(p)) is not None]


SUMMARY = "\x05HwpSummaryInformation"
# Numbers of summary properties and their names.
PROPERTIES = {2: "title", 3: "subject", 4: "author", 5: "keywords", 12: "created_date", 13: "modified_date"}
_TEXT, _WIDE, _TIME = 30, 31, 64
_EPOCH = datetime.datetime(1601, 1, 1)


def summary(data: bytes) -> dict[str, str]:
    """Properties of a summary stream by name: texts, and times as yyyy-mm-ddThh:mm:ss; those of other types are left out."""
    if len(data) < 48 or data[:2] != b"\xfe\xff":
        raise ValueError("no property set")
    (base,) = struct.unpack_from("<I", data, 44)
    _, count = struct.unpack_from("<II", data, base)
    out = {}
    if base + 8 + 8 * count > len(data):
        raise ValueError("property set cut off")
    for k in range(count):
        number, offset = struct.unpack_from("<II", data, base + 8 + 8 * k)
        kind, n = struct.unpack_from("<II", data, base + offset)
        at = base + offset + 8
        if number not in PROPERTIES:
            continue
        if kind == _WIDE:
            out[PROPERTIES[number]] = data[at : at + 2 * n].decode("utf-16-le", "ignore").split("\0")[0]
        elif kind == _TEXT:
            out[PROPERTIES[number]] = data[at : at + n].decode("utf-8", "ignore").split("\0")[0]
        elif kind == _TIME:
            (ticks,) = struct.unpack_from("<Q", data, at - 4)
            if ticks:
                out[PROPERTIES[number]] = (_EPOCH + datetime.timedelta(microseconds=ticks // 10)).isoformat(timespec="seconds")
    return out


def summary_stream(properties: dict[int, str | datetime.datetime]) -> bytes:
    """The bytes of a summary stream with the properties by number."""
    values = []
    for v in properties.values():
        if isinstance(v, datetime.datetime):
            values.append(struct.pack("<IQ", _TIME, int((v - _EPOCH).total_seconds()) * 10_000_000))
        else:
            raw = (v + "\0").encode("utf-16-le")
            values.append(struct.pack("<II", _WIDE, len(raw) // 2) + raw + b"\0" * (-len(raw) % 4))
    at, index = 8 + 8 * len(values), b""
    for number, v in zip(properties, values, strict=True):
        index += struct.pack("<II", number, at)
        at += len(v)
    body = struct.pack("<II", at, len(values)) + index + b"".join(values)
    return b"\xfe\xff\0\0" + b"\0" * 20 + struct.pack("<I", 1) + b"\0" * 16 + struct.pack("<I", 48) + body


def scan_summaries(files: DataFrame) -> DataFrame:
    """(path, the properties by name, error) of (path, content); a file without a summary has none, an unreadable one gives `error`."""
    names = [*PROPERTIES.values()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    c = CompoundFile(content or b"")
                    found = summary(c.read(SUMMARY)) if SUMMARY in c.streams else {}
                    out.append((path, *(found.get(n) for n in names), None))
                except (ValueError, struct.error, IndexError, KeyError, OverflowError) as e:
                    out.append((path, *(None for _ in names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, ", ".join(f"{n} string" for n in ["path", *names, "error"]))


#: Encodings tried on bytes of unknown encoding, in order.
ENCODINGS = ("utf-16-le", "utf-8", "cp949", "euc-kr")


def any_text(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """Lines of mostly printable characters by the first encoding that yields any, else the ASCII in it."""
    data = data.replace(b"\0\0", b"\n") if b"\0\0" in data else data
    for e in encodings:
        lines = [x.strip() for x in data.decode(e, "ignore").split("\n")]
        good = [x for x in lines if x and sum(c.isprintable() for c in x) > len(x) / 2]
        if good:
            return "\n".join(good)
    return "".join(chr(b) for b in data if 32 <= b <= 126)


def preview_text(data: bytes, least: int = 100) -> str:
    """The stored preview by the first encoding that gives more than `least` characters."""
    f = CompoundFile(data)
    if "PrvText" not in f.streams:
        return ""
    raw = f.read("PrvText")
    return next((x for e in ENCODINGS if len(x := raw.decode(e, "ignore")) > least), "")


SCHEMA = "path string, section string, idx int, tag int, tag_type string, level int, text string, error string"


def scan(files: DataFrame, tags: tuple[int, ...] = (PARA_TEXT,), controls: bool = True) -> DataFrame:
    """Paragraphs of (path, content): one row per text record, or one row with `error` per unreadable file.

    `files` is what spark.read.format("binaryFile") gives; filter its length
    and path before, so that rejected contents are never read.
    """
    read = controlled_text if controls else plain_text

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            n = 0
            for name, body in sections(content or b""):
                for r in records(body):
                    if r.tag in tags and (text := read(r.payload)).strip():
                        yield path, name, n, r.tag, TEXT_TAGS.get(r.tag), r.level, text, None
                        n += 1
        except (ValueError, struct.error, IndexError, KeyError) as e:
            yield path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            out = [r for p, c in zip(f["path"], f["content"], strict=True) for r in rows(p, c)]
            yield pd.DataFrame(out, columns=names).astype({"idx": "Int32", "tag": "Int32", "level": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def scan_previews(files: DataFrame) -> DataFrame:
    """(path, i, text, error): the paragraphs of the stored previews of (path, content); an unreadable file gives a row with `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    out += [(path, i, x, None) for i, x in enumerate(preview_paragraphs(content or b""))]
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "i", "text", "error"]).astype({"i": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, i int, text string, error string")


def docinfo(fields: F.Column) -> dict[str, F.Column]:
    """Heuristics on stored text fields: title, author and date."""
    clean = F.filter(fields, lambda x: x != "")
    first = lambda p: F.get(F.filter(clean, p), F.lit(0))
    author = F.substring_index(first(lambda x: x.contains("@")), "@", 1)
    return {
        "title": first(lambda x: F.length(x) < 100),
        "author": F.when(F.length(author) < 50, author),
        "date": first(lambda x: x.startswith("20") & (F.length(x) == 8)),
    }
