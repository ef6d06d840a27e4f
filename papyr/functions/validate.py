"""Validation of uploaded files as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes, limits in bytes, media types and patterns of the service.
EXTENSIONS = (".hwp", ".hwpx", ".pdf")
UPLOAD_LIMIT = 10 * 1024 * 1024
LIMITS = {".hwp": 50 * 1024 * 1024, ".hwpx": 100 * 1024 * 1024, ".pdf": 100 * 1024 * 1024}
MEDIA = {
    ".hwp": ("application/x-hwp", "application/haansofthwp", "application/vnd.hancom.hwp"),
    ".hwpx": ("application/vnd.hancom.hwpx", "application/zip"),
    ".pdf": ("application/pdf",),
}
DANGEROUS = (
    "<script", "javascript:", "vbscript:", "onload=", "onerror=", "onclick=", "<iframe", "<object", "<embed", "cmd.exe", "powershell",
    "/bin/sh", "/bin/bash",
)
SUSPICIOUS = ("EICAR", "X5O!P%@AP", "malware", "virus")
MALICIOUS = ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "5d41402abc4b2a76b9719d911017c592")
SCANNED = 1024 * 1024
MAGIC = {".hwp": "D0CF11E0A1B11AE1", ".hwpx": "504B0304", ".pdf": "255044462D"}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def parser_of(name: Column) -> Column:
    e = extension(name)
    return F.when(e == ".hwpx", "hwpx").when(e == ".pdf", "pdf").otherwise("hwp")


def limit_of(ext: Column) -> Column:
    out = F.lit(None).cast("long")
    for e, n in LIMITS.items():
        out = F.when(ext == e, F.lit(n)).otherwise(out)
    return out


def media_ok(ext: Column, media: Column) -> Column:
    out = F.lit(False)
    for e, kinds in MEDIA.items():
        out = out | ((ext == e) & media.isin(*kinds))
    return out


def found(content: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(content.contains(p), p) for p in patterns)))


def magic_of(content: Column) -> Column:
    """Container by the first bytes of binary content; unknown if none fits."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith(MAGIC[".hwp"]), "ole").when(head.startswith(MAGIC[".hwpx"]), "zip").when(head.startswith(MAGIC[".pdf"]), "pdf")
        .when(head.startswith("485750"), "hwp").otherwise("unknown")
    )


def scan_verdict(content: Column) -> Column:
    """clean, infected or suspicious; a suspicious pattern outweighs a known hash."""
    hit = F.size(found(F.substring(content, 1, SCANNED), SUSPICIOUS)) > 0
    return F.when(hit, "suspicious").when(F.sha2(content, 256).isin(*MALICIOUS), "infected").otherwise("clean")


def validation(name: Column, content: Column, media: Column) -> Column:
    """The first failing check in order, or ok."""
    ext, n = extension(name), F.octet_length(content)
    return (
        F.when(~ext.isin(*EXTENSIONS), "extension").when(n == 0, "empty").when(n > limit_of(ext), "size").when(~media_ok(ext, media), "media")
        .when(scan_verdict(content) != "clean", "virus").otherwise("ok")
    )


# Entries of which a zip container must have one.
MEMBERS = ("version.xml", "Contents/content.hpf")


def structure_ok(ext: Column, head: Column, members: Column) -> Column:
    """Whether the first bytes, in hexadecimal digits, and the names in a zip fit the suffix; other suffixes fit."""
    inside = F.coalesce(F.arrays_overlap(members, F.array(*map(F.lit, MEMBERS))), F.lit(False))
    return (
        F.when(ext == ".hwp", head.startswith(MAGIC[".hwp"])).when(ext == ".hwpx", head.startswith(MAGIC[".hwpx"]) & inside)
        .when(ext == ".pdf", head.startswith(MAGIC[".pdf"])).otherwise(True)
    )


def scan_report(content: Column) -> Column:
    """Struct (status, threats); a threat has a type, a name and a severity.  Missing content is an error."""
    status, digest = scan_verdict(content), F.sha2(content, 256)
    threat = lambda kind, name, severity: F.struct(F.lit(kind).alias("type"), name.alias("name"), F.lit(severity).alias("severity"))
    hashes = F.array_compact(F.array(F.when(digest.isin(*MALICIOUS), threat("hash", digest, "high"))))
    patterns = F.transform(found(F.substring(content, 1, SCANNED), SUSPICIOUS), lambda p: threat("pattern", p, "medium"))
    return F.struct(F.when(content.isNull(), "error").otherwise(status).alias("status"), F.coalesce(F.concat(hashes, patterns), F.expr("array()")).alias("threats"))


def full_verdict(name: Column, content: Column, media: Column, head: Column, members: Column) -> Column:
    """Struct (error, valid, warnings, hash, size): the first failing check in order; what only warns does not fail a file."""
    ext, n, scan = extension(name), F.octet_length(content), scan_verdict(content)
    early = (
        F.when(~ext.isin(*EXTENSIONS), "extension").when(n > limit_of(ext), "size").when(n == 0, "empty").when(~media_ok(ext, media), "media")
        .when(~structure_ok(ext, head, members), "structure")
    )
    error = F.coalesce(early, F.when(scan == "infected", "virus"))
    warnings = F.array_compact(F.array(F.when(F.size(found(content, DANGEROUS)) > 0, "threat"), F.when(scan == "suspicious", "suspicious")))
    return F.struct(
        error.alias("error"), error.isNull().alias("valid"), F.when(early.isNull(), warnings).otherwise(F.expr("array()").cast("array<string>")).alias("warnings"),
        F.when(error.isNull(), F.sha2(content, 256)).alias("hash"), F.when(error.isNull(), n.cast("long")).alias("size"),
    )


#: Status of an error by its kind.
STATUS = {"validation": 400, "authentication": 401, "authorization": 403, "size": 413, "rate_limit": 429, "parsing": 500, "timeout": 504}


def error_envelope(kind: Column, message: Column, path: Column, details: Column | None = None) -> Column:
    """Struct (status, error, message, details, path), or null where there is no error."""
    status = F.lit(500)
    for k, v in STATUS.items():
        status = F.when(kind == k, v).otherwise(status)
    details = F.lit(None).cast("string") if details is None else details
    return F.when(kind.isNotNull(), F.struct(status.alias("status"), kind.alias("error"), message.alias("message"), details.alias("details"), path.alias("path")))


def simple_verdict(filename: Column, content: Column) -> Column:
    """missing, extension, size or ok: null content is a file that is not there; the largest size of any kind is allowed to all."""
    ext = extension(filename)
    return (
        F.when(content.isNull(), "missing").when(~ext.isin(*EXTENSIONS), "extension")
        .when(F.octet_length(content) > max(LIMITS.values()), "size").otherwise("ok")
    )
