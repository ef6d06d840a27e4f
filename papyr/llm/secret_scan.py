"""Secret scans with linking of multipart credentials.

Strong patterns (assign, access, hex) are found in every whole text.  Weak
candidates are texts that are only suspicious beside their counterparts: a
40-character key without a label ("secret") and the address of a service
("endpoint").  Parts are joined by interval within scopes: the scope of a part
reaches SCOPE code points to both sides of it but not over an empty line.  A
weak secret is reported if an access identifier lies in its scope, an endpoint
if an access identifier or any secret does.

Defined results: a null text is empty and has no spans; spans may overlap
across kinds, never within one; offsets count code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyr.llm.common import read, slices

KINDS = ("assign", "access", "hex", "secret", "endpoint")
SCOPE = 400

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_WEAK = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_URL = re.compile(rb"https?://[A-Za-z0-9.-]+(?::[0-9]+)?")
_HOST, _CLOUD = re.compile(rb"[A-Za-z0-9.-]+"), b".amazonaws.com"


def strong_spans(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """Byte spans of the strong kinds: leftmost, not overlapping within a kind."""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16],
        # a run of [0-9a-f] is taken whole, so runs of 32 or more are those of the pattern with a minimum
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def endpoints(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of addresses: URLs up to the port, and hosts of a cloud by their last labels.

    Each run of host characters is looked at once; what it holds up to its last
    cloud name, behind any empty label, is the host.
    """
    urls = [m.span() for m in _URL.finditer(text)]
    hosts = []
    if _CLOUD in text:
        at = 0
        for m in _HOST.finditer(text):
            while at < len(urls) and urls[at][1] <= m.start():
                at += 1
            end = m[0].rfind(_CLOUD)
            if end < 0 or (at < len(urls) and urls[at][0] < m.end()):
                continue
            labels = m[0][:end]
            start = labels.rfind(b"..") + 2 if b".." in labels else 0
            start = end - len(labels[start:].lstrip(b".-"))
            if start < end:
                hosts.append((m.start() + start, m.start() + end + len(_CLOUD)))
    return sorted(urls + hosts)


def in_scope(text: bytes, part: tuple[int, int], others: list[tuple[int, int]], scope: int) -> bool:
    """Whether a span of `others` (sorted, disjoint, another one than `part`) touches the part's scope."""
    lo = max(text.rfind(b"\n\n", max(0, part[0] - scope), part[0]) + 2, part[0] - scope) if b"\n\n" in text[max(0, part[0] - scope) : part[0]] else part[0] - scope
    cut = text.find(b"\n\n", part[1], part[1] + scope)
    hi = cut if cut >= 0 else part[1] + scope
    k = bisect.bisect_right(others, (hi,)) - 1
    while k >= 0 and others[k][1] > lo:
        if others[k] != part and others[k][0] < hi:
            return True
        k -= 1
    return False


def linked_spans(text: bytes, found: dict[str, list[tuple[int, int]]], scope: int = SCOPE) -> dict[str, list[tuple[int, int]]]:
    """The weak spans whose complementary parts co-occur.

    Spans of different kinds may overlap, so each kind is searched by itself.
    """
    access = found["access"]
    secrets: list[tuple[int, int]] = []
    if access:
        taken = set(access)
        secrets = [s for s in (m.span() for m in _WEAK.finditer(text)) if s not in taken and in_scope(text, s, access, scope)]
    kinds = [x for x in (access, secrets, found["assign"], found["hex"]) if x]
    ends = [s for s in endpoints(text) if any(in_scope(text, s, x, scope) for x in kinds)] if kinds else []
    return {"secret": secrets, "endpoint": ends}


def scan(text: str, scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of KINDS."""
    data = text.encode("utf-8", "surrogatepass")
    found = strong_spans(data)
    if not any(found.values()):
        return []
    found |= linked_spans(data, found, scope)
    spans = sorted((s, KINDS.index(k), e) for k, v in found.items() for s, e in v)
    if len(data) == len(text):
        return [(KINDS[k], s, e) for s, k, e in spans]
    points, at, seen = {}, 0, 0
    for offset in sorted({x for s, _, e in spans for x in (s, e)}):
        seen += len(data[at:offset].decode("utf-8", "surrogatepass"))
        points[offset], at = seen, offset
    return [(KINDS[k], points[s], points[e]) for s, k, e in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by [SECRET]."""
    out, at, end = [], 0, -1
    for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[at:s], "[SECRET]"]
        end = max(end, e)
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the strong kinds, base_sha256 and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = scan(text or "")
                base = [x for x in spans if x[0] in KINDS[:3]]
                n = [sum(x[0] == k for x in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in `text` are replaced, a null text stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            text = [None if x is None else redact(x, scan(x)) for x in batch.column("text").to_pylist()]
            at = names.index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text.

    A null or empty text has no spans; a null doc_id stays null; repeated rows
    give repeated results; an empty table gives none.
    """
    return find_secrets(read(spark, sf_dir, "documents"))
