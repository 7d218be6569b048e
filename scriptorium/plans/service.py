"""From files to processed documents: validation, cache, reading, processors, provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.control import DocumentLoadError, Options
from scriptorium.operators.processors import Processor, pipeline
from scriptorium.operators.splitters import split_recursively
from scriptorium.operators.validation import errors_of
from scriptorium.schema import METADATA, merged, metadata
from scriptorium.sources.parsing import Providers
from scriptorium.sources.readers import from_buffers, read_files


@dataclass
class Result:
    documents: DataFrame
    #: (path, errors) of the files that were refused.
    refused: DataFrame


def process_buffers(files: DataFrame, *steps: Processor, options: Options = Options(), providers: Providers = Providers()) -> Result:
    """Documents of a table of (filename, content), through processors, with their file name as source.

    Files that fail validation are returned apart; without continue_on_error they are an error.
    """
    held = from_buffers(files).withColumn("errors", errors_of(F.col("path"), F.col("content"), options.max_file_size, strict_mime=options.strict_mime))
    refused = held.filter(F.size("errors") > 0).select("path", "errors")
    if not options.continue_on_error and (bad := refused.first()):
        raise DocumentLoadError(f"{bad.path}: {'; '.join(bad.errors)}")
    docs = read_files(held.filter(F.size("errors") == 0).drop("errors"), providers)
    docs = pipeline(*steps)(docs).withColumn(METADATA, merged(F.col(METADATA), metadata(source=F.col("doc_id"))))
    return Result(docs, refused)


def load_and_split(docs: DataFrame, split: Processor = split_recursively) -> DataFrame:
    """Documents of any reader, cut into chunks; by default recursively, in chunks of 1,000 with an overlap of 200."""
    return split(docs)


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose name and content hash have no row in the cache table (key, ..., cached_at)."""
    keyed = files.withColumn("key", tx.cache_key("filename", "content"))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti").drop("key")


def fresh(cache: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """Rows of a cache table that have not expired."""
    return cache.filter(F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
