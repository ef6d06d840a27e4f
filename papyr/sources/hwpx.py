"""Word processor files in zip containers: paragraphs with emphasis, tables, metadata; and their writer."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

# Namespaces of the two versions.
NS_2011 = "http://www.hancom.co.kr/hwpml/2011/paragraph"
NS_2016 = "http://www.hancom.co.kr/hwpml/2016/paragraph"
MIMETYPE = "application/hwp+zip"
_WHITE = re.compile(r"\s+")
_HIDDEN = re.compile("[​‌‍﻿]")


def tidy(text: str) -> str:
    return _WHITE.sub(" ", _HIDDEN.sub("", text)).strip()


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


#: Bytes that one entry of a file may have unpacked.
MAX_ENTRY = 100 * 1024 * 1024


def _outer(root: ET.Element) -> dict[int, list[ET.Element]]:
    """For each element, by identity, its ancestors' last paragraph and nested list, as [paragraph or none, list or none]."""
    out: dict[int, list] = {}
    stack: list[tuple[ET.Element, ET.Element | None, ET.Element | None]] = [(root, None, None)]
    while stack:
        e, p, inner = stack.pop()
        out[id(e)] = [p, inner]
        kind = _local(e)
        stack += [(x, e if kind == "p" else p, e if kind == "subList" else inner) for x in e]
    return out


def _paragraphs(root: ET.Element, outer: dict[int, list]) -> Iterator[ET.Element]:
    """Paragraphs outside nested lists, those of the older namespace first."""
    for ns in (NS_2011, NS_2016):
        yield from (p for p in root.iter(f"{{{ns}}}p") if outer[id(p)][1] is None)


def _runs(p: ET.Element, outer: dict[int, list]) -> Iterator[tuple[str, bool]]:
    """(text, emphasised) of the runs of a paragraph, however deep, but for those of paragraphs inside it; empty ones are left out."""
    for run in p.iter():
        if _local(run) == "run" and outer[id(run)][0] is p:
            text = "".join(x.text or "" for x in run.iter() if _local(x) == "t")
            if text:
                yield text, any(x.get(k) == "1" for x in run.iter() if _local(x) == "charPr" for k in ("bold", "italic"))


def _span(tc: ET.Element, address: ET.Element | None, key: str) -> int:
    own = int(address.get(key) or 1) if address is not None else 1
    return own if own != 1 else int(tc.get(key) or 1)


def _table(e: ET.Element) -> dict[str, Any] | None:
    """Rows of cells as nested elements are met, inner tables' rows included; null for a table without cells or with a span that is no number."""
    rows = []
    try:
        for tr in (x for x in e.iter() if _local(x) == "tr"):
            row = []
            for tc in (x for x in tr.iter() if _local(x) == "tc"):
                address = next((x for x in tc.iter() if _local(x) == "cellAddr"), None)
                text = tidy(" ".join(x.text for x in tc.iter() if _local(x) == "t" and x.text))
                row.append({"text": text, "colSpan": _span(tc, address, "colSpan"), "rowSpan": _span(tc, address, "rowSpan")})
            if row:
                rows.append(row)
    except ValueError:
        return None
    return {"rows": rows, "row_count": len(rows), "col_count": max(map(len, rows))} if rows else None


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    """An entry's bytes; a larger one than MAX_ENTRY is refused, whatever size it declares."""
    with z.open(name) as f:
        data = f.read(MAX_ENTRY + 1)
    if len(data) > MAX_ENTRY:
        raise ValueError(f"{name} of over {MAX_ENTRY} bytes")
    return data


def read(data: bytes) -> dict[str, Any]:
    """Paragraphs, tables, text, Markdown, sections and metadata of one file; sections that are no XML are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        version = _entry(z, "version.xml").decode("utf-8", "ignore") if "version.xml" in names else ""
        m = re.search(r'version="([^"]*)"', version)
        out: dict[str, Any] = {
            "metadata": {"version": m[1] if m else "", "has_header": "Contents/header.xml" in names},
            "paragraphs": [], "tables": [], "sections": [],
        }
        for name in sorted(n for n in names if re.fullmatch(r"Contents/section.*\.xml", n)):
            try:
                root = ET.fromstring(_entry(z, name))
            except ET.ParseError:
                continue
            outer, paragraphs = _outer(root), []
            for p in _paragraphs(root, outer):
                runs = list(_runs(p, outer))
                text = tidy("".join(r for r, _ in runs))
                if text:
                    paragraphs.append({"text": text, "emphasis": any(e for _, e in runs), "para_style": p.get("paraPrIDRef"), "style": p.get("styleIDRef")})
            tables = [t for x in root.iter() if _local(x) == "tbl" and (t := _table(x))]
            out["sections"].append({"section_id": name, "text_length": sum(len(p["text"]) for p in paragraphs), "paragraph_count": len(paragraphs), "table_count": len(tables)})
            out["paragraphs"] += paragraphs
            out["tables"] += tables
    out["text"] = "\n".join(p["text"] for p in out["paragraphs"])
    return out


def write(sections: list[list[str | tuple[str, bool] | list[list[str]]]], version: str = "5.0") -> bytes:
    """A file with one paragraph for each text, emphasised where it comes as (text, True), and one table for each list of rows; the media type is stored first."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MIMETYPE, zipfile.ZIP_STORED)
        z.writestr("version.xml", f'<?xml version="1.0" encoding="UTF-8"?><version version="{version}"/>'.replace('version="1.0" ', "", 1))
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="Contents/content.hpf"/></rootfiles></container>')
        z.writestr("Contents/header.xml", "<head/>")
        for i, texts in enumerate(sections):
            root = ET.Element("section")
            for k, text in enumerate(texts):
                if isinstance(text, list):
                    table = ET.SubElement(root, f"{{{NS_2011}}}tbl")
                    for row in text:
                        tr = ET.SubElement(table, f"{{{NS_2011}}}tr")
                        for cell in row:
                            inner = ET.SubElement(ET.SubElement(tr, f"{{{NS_2011}}}tc"), f"{{{NS_2011}}}subList")
                            ET.SubElement(ET.SubElement(ET.SubElement(inner, f"{{{NS_2011}}}p"), f"{{{NS_2011}}}run"), f"{{{NS_2011}}}t").text = cell
                    continue
                text, strong = text if isinstance(text, tuple) else (text, False)
                p = ET.SubElement(root, f"{{{NS_2011}}}p", {"id": str(k), "paraPrIDRef": "0", "styleIDRef": "0"})
                run = ET.SubElement(p, f"{{{NS_2011}}}run")
                if strong:
                    ET.SubElement(run, f"{{{NS_2011}}}charPr", {"bold": "1"})
                ET.SubElement(run, f"{{{NS_2011}}}t").text = text
            z.writestr(f"Contents/section{i}.xml", ET.tostring(root, encoding="UTF-8", xml_declaration=True))
        z.writestr("Contents/content.hpf", "<package/>")
    return buffer.getvalue()


SCHEMA = (
    "path string, version string, paragraphs array<struct<text string, emphasis boolean, para_style string, style string>>, "
    "tables array<struct<rows array<array<struct<text string, colSpan int, rowSpan int>>>, row_count int, col_count int>>, "
    "sections array<struct<section_id string, text_length int, paragraph_count int, table_count int>>, text string, error string"
)


def scan(files: DataFrame) -> DataFrame:
    """Parsed content of (path, content); an unreadable file gives a row with `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    d = read(bytes(content or b""))
                    out.append((path, d["metadata"]["version"], d["paragraphs"], d["tables"], d["sections"], d["text"], None))
                except (zipfile.BadZipFile, zlib.error, EOFError, KeyError, ValueError, RuntimeError, NotImplementedError) as e:
                    out.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "version", "paragraphs", "tables", "sections", "text", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
