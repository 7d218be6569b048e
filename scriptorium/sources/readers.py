"""Readers: paths in, document tables out. Files are read by Spark, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.mime import format_of
from scriptorium.functions.portions import per_text
from scriptorium.operators.splitting import trim
from scriptorium.schema import CONTENT, METADATA, merged, metadata
from scriptorium.session import work_folder
from scriptorium.sources import parsing
from scriptorium.sources.parsing import Parsed, Providers

EXCLUDED = r"/(node_modules|\.git)/"


def binary_files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True, exclude: str = EXCLUDED, ignore_corrupt: bool = False) -> DataFrame:
    """(path, content, length, modificationTime) of the files under ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).filter(~F.col("path").rlike(exclude))


def from_buffers(files: DataFrame, filename: str = "filename", content: str = "content") -> DataFrame:
    """The same shape from a table of file names and bytes."""
    return files.select(F.col(filename).alias("path"), F.col(content).alias("content"))


def _texts(files: DataFrame, encoding: str | None) -> DataFrame:
    """Adds text; without an encoding it is detected, and utf-8 where that fails."""
    name = F.coalesce(tx.detect_encoding("content"), F.lit("utf-8")) if encoding is None else F.lit(encoding)
    return files.withColumn("encoding", name).withColumn("text", tx.decode_as("content", F.col("encoding")))


def _document(files: DataFrame, content: Column, meta: Column, index: Column | None = None) -> DataFrame:
    return files.select(F.col("path").alias("doc_id"), (F.lit(0) if index is None else index).cast("bigint").alias("doc_seq"), content.alias(CONTENT), merged(metadata(source=F.col("path")), meta).alias(METADATA))


def read_text(files: DataFrame, encoding: str | None = "utf-8", kind: str = "text") -> DataFrame:
    """One document for each file."""
    held = _texts(files, encoding)
    return _document(held, F.col("text"), metadata(format=kind, encoding=F.col("encoding")))


def read_markdown(files: DataFrame, encoding: str | None = "utf-8") -> DataFrame:
    return read_text(files, encoding, "markdown")


_PARSED = pa.list_(pa.struct([("content", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))]))


def _parsed(files: DataFrame, column: str, parse: Callable[[object], Parsed], skip_errors: bool = False) -> DataFrame:
    """The documents that ``parse`` makes of each file; only its column goes to Python. A file it fails on is an error, or left out."""

    def documents(value) -> list[dict]:
        try:
            return [{"content": c, "meta": list(m.items())} for c, m in parse(value)] if value is not None else []
        except Exception:
            if not skip_errors:
                raise
            return []

    def run(values: pa.Array) -> list[pa.Array]:
        return [pa.array([documents(v) for v in values.to_pylist()], _PARSED)]

    found = per_text("found array<struct<content:string,meta:map<string,string>>>", lambda: run)(column)["found"]
    cut = files.select("path", F.posexplode(found).alias("k", "d"))
    return _document(cut, F.col("d.content"), F.col("d.meta"), F.col("k"))


def read_csv(files: DataFrame, split_rows: bool = True, use_markdown: bool = True, separator: str = ",", source_column: str | None = None, metadata_columns: tuple[str, ...] = (), encoding: str | None = "utf-8", skip_errors: bool = False) -> DataFrame:
    """Rows as documents, or a Markdown table for each file, or its plain text."""
    held = _texts(files, encoding)
    if split_rows:
        return _parsed(held, "text", lambda t: parsing.csv_rows(t, separator, source_column, metadata_columns), skip_errors)
    return _parsed(held, "text", lambda t: parsing.csv_table(t, separator), skip_errors) if use_markdown else read_text(files, encoding, "csv")


def read_json(files: DataFrame, path: str | None = None, content_key: str | None = None, metadata_keys: tuple[str, ...] = (), pretty: bool = True, encoding: str | None = "utf-8", skip_errors: bool = False) -> DataFrame:
    return _parsed(_texts(files, encoding), "text", lambda t: parsing.json_documents(t, path, content_key, metadata_keys, pretty), skip_errors)


def read_html(files: DataFrame, mode: str = "markdown", tags: tuple[str, ...] = parsing.HTML_TAGS, encoding: str | None = "utf-8") -> DataFrame:
    """Pages as ``markdown``, as plain ``text``, or one document for each of their ``elements``."""
    held = _texts(files, encoding)
    if mode == "text":
        return _document(held, tx.strip_html("text"), metadata(format="html", originalFormat="html"))
    if mode == "elements":
        return html_elements(held.select("path", "text"), "path", "text", tags)
    return _parsed(held, "text", _page)


def _page(html: str) -> Parsed:
    return [(parsing.html_to_markdown(html), {"format": "markdown", "originalFormat": "html", "convertedBy": "html-parser"})]


_ELEMENTS = pa.list_(pa.struct([("tag", pa.string()), ("position", pa.int32()), ("inner", pa.string())]))


def html_elements(pages: DataFrame, key: str, html: str, tags: tuple[str, ...] = parsing.HTML_TAGS) -> DataFrame:
    """Non-empty elements of pages, tag by tag in the order given, with their position in the page without scripts."""

    def found(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([parsing.elements(t, tags) if t is not None else [] for t in texts.to_pylist()], _ELEMENTS)]

    elements = per_text("found array<struct<tag:string,position:int,inner:string>>", lambda: found)
    page = pages.select(F.col(key).alias("path"), elements(tx.drop_scripts(html))["found"].alias("found"))
    each = page.select("path", F.posexplode("found").alias("k", "e"))
    each = each.withColumn("text", tx.strip_tags("e.inner")).filter("text <> ''")
    return _document(each, F.col("text"), metadata(format="html", element=F.col("e.tag"), position=F.col("e.position")), F.col("k"))


def read_docx(files: DataFrame, skip_errors: bool = False) -> DataFrame:
    return _parsed(files, "content", parsing.docx_text, skip_errors)


def read_xlsx(files: DataFrame, skip_errors: bool = False, **options) -> DataFrame:
    return _parsed(files, "content", lambda c: parsing.xlsx_documents(c, **options), skip_errors)


def read_with(files: DataFrame, provider: Callable[[bytes], Parsed] | None, kind: str, skip_errors: bool = False) -> DataFrame:
    """Documents of a caller's converter."""
    if provider is None:
        raise ValueError(f"reading {kind} files needs a provider")
    return _parsed(files, "content", provider, skip_errors)


def read_pdf(files: DataFrame, providers: Providers, detect_scanned: bool = True, skip_errors: bool = False) -> DataFrame:
    """PDFs by the caller's text extractor; those whose text looks scanned by its OCR, if there is one."""
    return read_with(files, _pdf_parser(providers, detect_scanned), "PDF", skip_errors)


def _pdf_parser(providers: Providers, detect_scanned: bool) -> Callable[[bytes], Parsed] | None:
    plain, ocr, looks = providers.pdf, providers.scanned, _looks_scanned
    if not (detect_scanned and providers.ocr):
        return plain
    return lambda c: ocr(c) if plain is None or looks(found := plain(c)) else found


def _looks_scanned(found: Parsed) -> bool:
    """The rules of functions.text.looks_scanned for one parsed file."""
    text = trim("".join(c for c, _ in found))
    pages = max(1, int(next((m["totalPages"] for _, m in found if "totalPages" in m), len(found) or 1)))
    if not text:
        return True
    cjk = lambda c: "一" <= c <= "龥"
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    special = sum(not (word(c) or c.isspace() or cjk(c) or "　" <= c <= "〿" or "＀" <= c <= "￯") for c in text) / len(text)
    readable = sum(c.isascii() and c.isalnum() or cjk(c) for c in text) / len(text)
    average = len(text) / pages
    return average < 100 or special > 0.3 or readable < 0.5 or average < 200 and special > 0.2


def _parse_files(files: DataFrame, providers: Providers, skip: set[str], reader_options: dict[str, dict] | None, skip_errors: bool) -> DataFrame:
    """(path, found, error): what one scan makes of every file; with ``skip_errors`` a file that fails has a null found and tells why."""
    given = {"csv": {}, "json": {}, "html": {}, "xlsx": {}, "text": {}} | (reader_options or {})
    own_csv = dict(given["csv"])
    encoding = given["text"].get("encoding", "utf-8")
    csv_parser = parsing.csv_rows if own_csv.pop("split_rows", True) else lambda t, separator=",", **_: parsing.csv_table(t, separator)
    texts: dict[str, Callable[[str], Parsed]] = {"csv": lambda t: csv_parser(t, **own_csv), "json": lambda t: parsing.json_documents(t, **given["json"]), "html": _page}
    binaries: dict[str, Callable[[bytes], Parsed]] = {"docx": parsing.docx_text, "xlsx": lambda c: parsing.xlsx_documents(c, **given["xlsx"])}
    if providers.pdf or providers.ocr:
        binaries["pdf"] = _pdf_parser(providers, True)
    binaries |= {kind: provider for kind in ("doc", "xls") if (provider := getattr(providers, kind))}
    texts, binaries = ({k: p for k, p in held.items() if k not in skip} for held in (texts, binaries))
    plain = [k for k in ("text", "markdown") if k not in skip]

    def documents(kind: str, text: str | None, content: bytes | None) -> tuple[list[dict] | None, str | None]:
        try:
            found = texts[kind](text) if kind in texts else binaries[kind](content) if kind in binaries else []
            return [{"content": c, "meta": m} for c, m in found], None
        except Exception as e:  # whatever is in the file, or in the caller's converter
            if not skip_errors:
                raise
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf("found array<struct<content:string,meta:map<string,string>>>, error string")
    def parse(kinds: pd.Series, held: pd.Series, raw: pd.Series) -> pd.DataFrame:
        made = [documents(*x) for x in zip(kinds, held, raw, strict=True)]
        return pd.DataFrame({"found": pd.Series([f for f, _ in made], dtype=object), "error": pd.Series([e for _, e in made], dtype=object)})

    kind = format_of("path")
    typed = files.withColumn("format", kind).filter(~F.col("format").isin(*skip) if skip else F.lit(True))
    readable = F.col("format").isin(*plain, *texts, *binaries)
    wanted = _texts(typed, encoding)
    kind = F.col("format")
    made = parse(kind, F.when(kind.isin(*texts), F.col("text")), F.when(kind.isin(*binaries), F.col("content")))
    whole = F.array(F.struct(F.col("text").alias("content"), metadata(format=kind, encoding=F.col("encoding")).alias("meta")))
    missing = F.when(~readable, F.concat(F.lit("no reader for "), kind))
    return wanted.withColumn("made", F.when(readable & ~kind.isin(*plain), made)).select("path", F.when(kind.isin(*plain), whole).otherwise(F.col("made.found")).alias("found"), F.coalesce(F.col("made.error"), missing).alias("error"))


def _documents(parsed: DataFrame) -> DataFrame:
    cut = parsed.select("path", F.posexplode("found").alias("k", "d"))
    return _document(cut, F.col("d.content"), F.col("d.meta"), F.col("k"))


def read_files(files: DataFrame, providers: Providers = Providers(), overrides: dict[str, Callable[[DataFrame], DataFrame]] | None = None, skip_errors: bool = False, reader_options: dict[str, dict] | None = None) -> DataFrame:
    """Every file by the reader of its extension; unknown ones as text. Formats without a provider are left out.

    ``reader_options`` has the options of csv (separator, source_column, metadata_columns, split_rows), json (path, content_key,
    metadata_keys, pretty), xlsx and text (encoding). All files go through one scan, as a branch for each format would open every file once
    more. Readers given in ``overrides`` take tables, so each of them scans for its own.
    """
    overrides = overrides or {}
    parts = [_documents(_parse_files(files, providers, set(overrides), reader_options, skip_errors))]
    parts += [reader(files.filter(format_of("path") == kind)) for kind, reader in overrides.items()]
    return reduce(DataFrame.unionByName, parts)


def read_or_refuse(files: DataFrame, providers: Providers = Providers(), reader_options: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, refused): the documents of the files that can be read, and (path, error) of those that can't, from one pass over the files.

    Refused are files that fail to parse and those whose format has no reader. What the pass finds is written once, to
    the folder that executors share.
    """
    spark = files.sparkSession
    place = work_folder(spark, "read")
    _parse_files(files, providers, set(), reader_options, True).write.parquet(place)
    parsed = spark.read.parquet(place)
    return _documents(parsed.filter("error is null")), parsed.filter("error is not null").select("path", "error")


def read_directory(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, exclude: str = EXCLUDED, ignore_errors: bool = False, **options) -> DataFrame:
    """The files under a folder; with ``ignore_errors`` those that can't be read or parsed are left out."""
    return read_files(binary_files(spark, path, glob, recursive, exclude, ignore_errors), skip_errors=ignore_errors, **options)


def table_rows(df: DataFrame, key: str, columns: list[str], metadata_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of any table as documents, ``column: value`` by line, without a Python step."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns if c not in metadata_columns]
    meta = metadata(format="csv", **{c: F.col(c) for c in metadata_columns})
    return df.select(F.col(key).alias("doc_id"), F.concat_ws("\n", *lines).alias(CONTENT), meta.alias(METADATA))


def table_markdown(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A small table as one Markdown table: (page_content, rows, columns). All rows meet in one text, as they must."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate(columns)]
    cells = df.select(F.col(order).alias("o"), *texts)
    widths = [F.greatest(F.lit(len(c)), F.max(F.length(f"c{k}"))).alias(f"w{k}") for k, c in enumerate(columns)]
    rows = F.array_sort(F.collect_list(F.struct("o", *[f"c{k}" for k in range(len(columns))])))
    one = cells.agg(*widths, rows.alias("rows"))
    pad = lambda text, k: F.rpad(text, F.col(f"w{k}"), F.lit(" "))
    line = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    head = line([pad(F.lit(c), k) for k, c in enumerate(columns)])
    rule = line([F.repeat(F.lit("-"), F.col(f"w{k}")) for k in range(len(columns))])
    body = F.transform("rows", lambda r: line([pad(r[f"c{k}"], k) for k in range(len(columns))]))
    return one.select(F.array_join(F.concat(F.array(head, rule), body), "\n").alias(CONTENT), F.size("rows").cast("bigint").alias("rows"), F.lit(len(columns)).cast("bigint").alias("columns"))
