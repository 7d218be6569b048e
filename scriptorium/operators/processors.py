"""Processors of document tables: functions from DataFrame to DataFrame, chained with transform()."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.schema import CONTENT, METADATA, merged, metadata

Processor = Callable[[DataFrame], DataFrame]


def pipeline(*steps: Processor) -> Processor:
    """Processors in order, as one."""
    return lambda docs: reduce(DataFrame.transform, steps, docs)


def clean_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn(CONTENT, tx.clean(CONTENT))


def enrich(docs: DataFrame, with_time: bool = False) -> DataFrame:
    """Adds word_count, char_count, line_count, and processed_at if wanted."""
    out = docs.withColumns({"word_count": tx.word_count(CONTENT), "char_count": tx.char_count(CONTENT), "line_count": tx.line_count(CONTENT)})
    return out.withColumn("processed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")) if with_time else out


def merge_pages(pages: DataFrame, key: str, page: str, content: str, size: int = 10, overlap: int = 2, separator: str = "\n\n", sort_by_page: bool = True, order: str | None = None) -> DataFrame:
    """Overlapping windows of consecutive pages, each as one document.

    ``pages`` has a document key, a page number (null counts as 0) and the content; ``order``
    breaks ties, and is the order itself without ``sort_by_page``. Gives (key, window_index,
    page_content, page_from, page_to, page_count): windows start every size - overlap pages
    until one reaches the end. A page is sent to each window it belongs to; no join is made.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window size")
    tie = F.col(order) if order else F.col(content)
    place = Window.partitionBy(key).orderBy(*([F.coalesce(F.col(page).cast("bigint"), F.lit(0)), tie] if sort_by_page else [tie]))
    stride = size - overlap
    r = (F.row_number().over(place) - 1).alias("r")
    rows = pages.select(key, F.col(page).alias("page"), F.col(content).alias("content"), r, F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    last = F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / stride)).cast("int")
    first = F.when(F.col("r") < size, 0).otherwise(F.floor((F.col("r") - size) / stride) + 1).cast("int")
    until = F.least(F.floor(F.col("r") / stride).cast("int"), last)
    member = rows.withColumn("first", first).withColumn("until", until).filter("first <= until")
    member = member.select(key, "page", "content", "r", F.explode(F.sequence("first", "until")).alias("window_index"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), separator)
    return member.groupBy(key, "window_index").agg(joined.alias(CONTENT), F.min("page").cast("bigint").alias("page_from"), F.max("page").cast("bigint").alias("page_to"), F.count(F.lit(1)).alias("page_count")).withColumn("window_index", F.col("window_index").cast("bigint"))


def stamp_source(docs: DataFrame, filename: str) -> DataFrame:
    """The file's name as ``source``, over any that a reader has set."""
    return docs.withColumn(METADATA, merged(F.col(METADATA), metadata(source=F.col(filename))))


def embed(docs: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 32, column: str = "embedding", skip_on_error: bool = False) -> DataFrame:
    """Adds the vectors that ``provider`` gives for batches of texts; failed batches stay without if ``skip_on_error``."""

    @F.pandas_udf("array<float>")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out: list = []
            for k in range(0, len(texts), batch):
                part = ["" if t is None else t for t in texts.iloc[k : k + batch]]
                try:
                    out += provider(part)
                except Exception:
                    if not skip_on_error:
                        raise
                    out += [None] * len(part)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(column, vectors(CONTENT))


def cosine(a: str, b: str):
    """Cosine similarity of two vector columns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))
