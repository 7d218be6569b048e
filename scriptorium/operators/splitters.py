"""Splitters of document tables: one document in, its chunks out, each with its parent's columns.

Rules that need a parser or a running state work on portions of about 1 MB of text, so all
other columns stay in the JVM and a Python worker holds the chunks of one portion at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.portions import per_text
from scriptorium.operators.splitting import CharacterRules, HtmlRules, JsonRules, MarkdownRules, RecursiveRules, token_windows  # noqa: F401: the number of windows is taken from here
from scriptorium.schema import CONTENT, METADATA, merged, metadata, unused

#: Separators of chunk size control: headings first.
SIZE_SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", " ", "")


def _text_chunks(split: Callable[[str], list[str]]) -> Callable[[str], Column]:
    def chunks(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([split(t) if t is not None else [] for t in texts.to_pylist()], pa.list_(pa.string()))]

    return lambda column: per_text("chunks array<string>", lambda: chunks)(column)["chunks"]


def _explode_chunks(docs: DataFrame, chunks) -> DataFrame:
    held, k, text = (unused(n, docs) for n in ("chunks", "chunk_k", "chunk_text"))
    other = [F.col(f"`{c}`") for c in docs.columns if c not in (CONTENT, METADATA, "chunk_index")]
    # Of an inner posexplode Spark would filter by the size of its array, making it twice.
    cut = docs.withColumn(held, chunks).select(*other, METADATA, F.posexplode_outer(held).alias(k, text)).filter(F.col(k).isNotNull())
    index = F.col(k).cast("bigint")
    return cut.select(*other, index.alias("chunk_index"), F.col(text).alias(CONTENT), merged(F.col(METADATA), metadata(chunkIndex=index)).alias(METADATA))


def split_characters(docs: DataFrame, rules: CharacterRules | None = None) -> DataFrame:
    """Chunks cut at one separator and merged up to a size."""
    return _explode_chunks(docs, _text_chunks((rules or CharacterRules()).split)(CONTENT))


def split_recursively(docs: DataFrame, rules: RecursiveRules | None = None) -> DataFrame:
    """Chunks cut at the strongest separators that keep them under a size."""
    return _explode_chunks(docs, _text_chunks((rules or RecursiveRules()).split)(CONTENT))


def split_language(docs: DataFrame, language: str, **options) -> DataFrame:
    return split_recursively(docs, RecursiveRules.from_language(language, **options))


def split_windows(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` code points with ``overlap``, untrimmed; token_windows() tells their number.

    A pattern, so that no text leaves the JVM: each match looks ahead for a window and goes on by
    a stride, or to the end if the window reaches it. Possessive counts neither go back nor recurse,
    so that the time is linear in the text; substrings would be sought from a text's start each.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    windows = f"(?s)(?=(.{{1,{size}}}+))(?:.{{{size - overlap}}}(?=.{{{overlap + 1}}})|.++)"
    return _explode_chunks(docs, F.regexp_extract_all(CONTENT, F.lit(windows), F.lit(1)))


_SCOPED = pa.list_(pa.struct([("text", pa.string()), ("scope", pa.map_(pa.string(), pa.string()))]))


def _scoped_chunks(split: Callable[[str], list[tuple[str, dict[str, str]]]]) -> Callable[[str], Column]:
    def chunks(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([[{"text": c, "scope": list(scope.items())} for c, scope in split(t)] if t is not None else [] for t in texts.to_pylist()], _SCOPED)]

    return lambda column: per_text("chunks array<struct<text:string,scope:map<string,string>>>", lambda: chunks)(column)["chunks"]


def _explode_scoped(docs: DataFrame, chunks) -> DataFrame:
    held, k, chunk = (unused(n, docs) for n in ("chunks", "chunk_k", "chunk"))
    other = [F.col(f"`{c}`") for c in docs.columns if c not in (CONTENT, METADATA, "chunk_index")]
    cut = docs.withColumn(held, chunks).select(*other, METADATA, F.posexplode(held).alias(k, chunk))
    return cut.select(*other, F.col(k).cast("bigint").alias("chunk_index"), F.col(chunk)["text"].alias(CONTENT), merged(F.col(METADATA), F.col(chunk)["scope"]).alias(METADATA))


def split_markdown(docs: DataFrame, rules: MarkdownRules | None = None) -> DataFrame:
    """Chunks by Markdown headings, which become metadata."""
    return _explode_scoped(docs, _scoped_chunks((rules or MarkdownRules()).split)(CONTENT))


def split_markdown_sections(docs: DataFrame) -> DataFrame:
    """The processor form: headings of three levels stay in the chunks."""
    return split_markdown(docs, MarkdownRules(strip_headings=False))


def split_html(docs: DataFrame, rules: HtmlRules | None = None) -> DataFrame:
    """Chunks by HTML headings, which become metadata."""
    return _explode_scoped(docs, _scoped_chunks((rules or HtmlRules()).split)(CONTENT))


def split_json(docs: DataFrame, rules: JsonRules | None = None) -> DataFrame:
    """Objects of about one size; chunkIndex and totalChunks become metadata. Invalid JSON is an error."""
    every = unused("all_chunks", docs)
    cut = docs.withColumn(every, _text_chunks((rules or JsonRules()).split)(CONTENT))
    cut = cut.withColumn(METADATA, merged(F.col(METADATA), metadata(totalChunks=F.size(every))))
    return _explode_chunks(cut.select(*[F.col(f"`{c}`") for c in docs.columns], every), F.col(every)).drop(every)


def control_chunk_size(docs: DataFrame, most: int = 1000, overlap: int = 200, force_overlap: bool = True) -> DataFrame:
    """Split documents at headings, paragraphs, lines and words; without ``force_overlap`` only those over ``most``."""
    rules = RecursiveRules(size=most, overlap=overlap, separators=SIZE_SEPARATORS)
    if force_overlap:
        return split_recursively(docs, rules)
    fits = F.length(CONTENT) <= most
    whole = docs.filter(fits).withColumn("chunk_index", F.lit(0).cast("bigint"))
    return whole.unionByName(split_recursively(docs.filter(~fits), rules))
