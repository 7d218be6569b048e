"""File names, formats and media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media type by extension.
MIME_TYPES = {
    "txt": "text/plain",
    "html": "text/html",
    "htm": "text/html",
    "css": "text/css",
    "js": "text/javascript",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "csv": "text/csv",
    "json": "application/json",
    "jsonl": "application/json",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "webp": "image/webp",
}
UNKNOWN = "application/octet-stream"
#: The reader for an extension; any other is read as text.
FORMATS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf", "docx": "docx", "doc": "doc", "xlsx": "xlsx", "xls": "xls", "html": "html", "htm": "html", "json": "json", "csv": "csv"}


def extension(filename: Column | str) -> Column:
    """What follows the last dot, lower-cased; a name without a dot is its own extension."""
    name = F.col(filename) if isinstance(filename, str) else filename
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def mime_type(filename: Column | str) -> Column:
    """The media type of a file name; without an extension or with an unknown one, octet-stream."""
    name = F.col(filename) if isinstance(filename, str) else filename
    return F.when(name.contains("."), _lookup(extension(name), MIME_TYPES, UNKNOWN)).otherwise(UNKNOWN)


def format_of(filename: Column | str) -> Column:
    return _lookup(extension(filename), FORMATS, "text")


def extension_of_mime() -> dict[str, str]:
    """The first extension of every media type."""
    out: dict[str, str] = {}
    for name, mime in MIME_TYPES.items():
        out.setdefault(mime, name)
    return out


def sniff(content: Column | str) -> Column:
    """A media type from the first bytes; null for fewer than four."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(content, 1, 4))
    start = F.make_valid_utf8(F.substring(content, 1, 1000).cast("string"))
    first = F.ltrim(F.substring(start, 1, 10))
    opening = F.lower(F.substring(start, 1, 100))
    return F.when(F.length(content) >= 4, (
        F.when(head == "25504446", MIME_TYPES["pdf"])
        .when(head == "504B0304", F.when(start.contains("word/"), MIME_TYPES["docx"]).when(start.contains("xl/"), MIME_TYPES["xlsx"]).otherwise("application/zip"))
        .when(head == "D0CF11E0", MIME_TYPES["doc"])
        .when(opening.contains("<!doctype html") | opening.contains("<html"), MIME_TYPES["html"])
        .when(first.startswith("{") | first.startswith("["), MIME_TYPES["json"])
        .otherwise("text/plain")
    ))
