"""File streams, sliding metrics and rate limits with keyed state."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from scriptorium.operators.processors import Processor

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length, content)."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def process_stream(files: DataFrame, read: Callable[[DataFrame], DataFrame], process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Read and process every micro-batch of files as a table of its own and append it to ``out``.

    A batch is written under its number, so one that is replayed after a failure replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        process(read(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Nodes of a logical plan that make one row of several, or let rows meet.
_MEETING = re.compile(r"^[\s:|+-]*(Aggregate|Distinct|Deduplicate\w*|Window\w*|Join|LateralJoin|Intersect|Except|GlobalLimit|LocalLimit|Tail|Offset|Sample|Pivot|\w*Groups\w*|TransformWithState\w*|MapGroups\w*|WindowInPandas)\b", re.MULTILINE)


def meets_rows(step: Processor, docs: DataFrame) -> str | None:
    """What in a step makes one document of several, or lets documents meet, so that it can't run on one document at a time; None if nothing does.

    A step may say so itself by an attribute ``merges``; else the analysed plan of what it makes
    of an empty table like ``docs`` is searched.
    """
    if getattr(step, "merges", False):
        return "declared"
    empty = docs.sparkSession.createDataFrame([], docs.schema)
    found = _MEETING.search(step(empty)._jdf.queryExecution().analyzed().toString())
    return found[1] if found else None


def process_each(docs: DataFrame, *steps: Processor) -> DataFrame:
    """A stream (or table) of documents through steps that look at one document at a time; others are refused.

    So the result doesn't depend on which documents come in one micro-batch. Steps may
    split a document or leave it out.
    """
    for step in steps:
        if why := meets_rows(step, docs):
            raise ValueError(f"{getattr(step, '__name__', step)} merges documents ({why}); use process_stream, which gives it whole batches")
        docs = step(docs)
    return docs


def sliding_metrics(operations: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Counts, failures, durations and throughput by operation over sliding windows of their end; works on tables too."""
    timed = operations.withWatermark("ended", late) if operations.isStreaming else operations
    by = timed.groupBy(F.window("ended", window, slide).alias("window"), "operation")
    rolled = by.agg(F.count(F.lit(1)).alias("count"), F.sum((~F.col("success")).cast("bigint")).alias("failure_count"), F.avg("duration").alias("avg_duration"), F.max("duration").alias("max_duration"))
    seconds = F.unix_micros("window.end") - F.unix_micros("window.start")
    return rolled.select("operation", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "count", "failure_count", "avg_duration", "max_duration", (F.col("count") * 1e6 / seconds).alias("throughput"))


def limit_stream(calls: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """A sliding-window limit over a stream of (key, at_ms): (key, at_ms, allowed, remaining).

    A key's state are the times of its allowed calls, ``limit`` at most; it is dropped when
    nothing has come for a window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = []
        for now in sorted(t for batch in batches for t in batch["at_ms"].tolist()):
            held = [t for t in held if t > now - window_ms]
            allowed = len(held) < limit
            if allowed:
                held.append(now)
            rows.append((key[0], now, allowed, limit - len(held) if allowed else 0))
        state.update((held,))
        state.setTimeoutDuration(max(1, window_ms))
        yield pd.DataFrame(rows, columns=["key", "at_ms", "allowed", "remaining"])

    schema = "key string, at_ms long, allowed boolean, remaining long"
    return calls.select("key", "at_ms").groupBy("key").applyInPandasWithState(step, schema, "held array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
