"""File validation as columns: every error of a file, not only the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.mime import MIME_TYPES, extension, sniff

MAX_SIZE = 100 * 1024 * 1024
#: The extensions that are let in unless others are given.
ALLOWED = ("pdf", "docx", "doc", "xlsx", "xls", "csv", "json", "html", "htm", "md", "markdown", "txt")


def errors_of(filename: Column, content: Column, max_size: int = MAX_SIZE, allowed: tuple[str, ...] = ALLOWED, strict_mime: bool = False) -> Column:
    ext, size = extension(filename), F.length(content)
    errors = [
        F.when(size > max_size, F.format_string(f"FILE_TOO_LARGE: %d bytes, at most {max_size}", size)),
        F.when(~ext.isin(*allowed), F.concat(F.lit("UNSUPPORTED_FORMAT: ."), ext)),
    ]
    if strict_mime:
        known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
        declared, found = F.try_element_at(known, ext), sniff(content)
        errors.append(F.when(found.isNotNull() & (found != F.coalesce(declared, F.lit(""))), F.concat(F.lit("MIME_MISMATCH: "), found)))
    return F.array_compact(F.array(*errors))


def validate_files(files: DataFrame, filename: str = "filename", content: str = "content", **options) -> DataFrame:
    """Adds size, extension, mime_type (null if unknown), errors and valid."""
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    out = files.withColumns({"size": F.length(content).cast("bigint"), "extension": extension(filename)})
    out = out.withColumns({"mime_type": F.try_element_at(known, F.col("extension")), "errors": errors_of(F.col(filename), F.col(content), **options)})
    return out.withColumn("valid", F.size("errors") == 0)


def require_valid(files: DataFrame, **options) -> DataFrame:
    """The files, or an error of the job that names the first bad one met."""
    checked = validate_files(files, **options)
    message = F.concat(F.lit("DOCUMENT_VALIDATION_ERROR: "), F.array_join("errors", "; "))
    return checked.filter(F.coalesce(F.assert_true(F.col("valid"), message).cast("string"), F.lit("")) == "")


#: Bytes that a fetched page may have.
MAX_PAGE = 10 * 1024 * 1024


def fetchable(url: Column, body: Column, most: int = MAX_PAGE) -> Column:
    """Whether a page came over HTTP from a valid address and is not too long."""
    return url.rlike(r"(?i)\Ahttps?://[^/\s]+") & (F.octet_length(body) <= most)
