"""Text files read in blocks by many tasks, where what a block means depends on the state it begins in.

A block is one of Spark's splits of a text file. A first pass tells of every block what it makes
of either of two states, and a number for either; composed from block to block, that gives
the state, and the sum of the numbers, that each block begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks (or files) whose few numbers may be sent to all tasks; with more of them there is a shuffle.
BROADCAST_ROWS = 300_000
OUT, IN = 0, 1
#: The state after a block and a number, by the state before it.
SUMMARY = "path string, block long, ends_out int, ends_in int, value_out long, value_in long"


def split_texts(spark: SparkSession, path: str | list[str], separator: str, name: str) -> DataFrame:
    """(path, block, ``name``): what stands between separators, in the order of the files within each task."""
    return spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias(name))


class Blocks:
    """Runs of rows of one block, from batches that follow one another."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[tuple, list[str]]]:
        """(all columns but the last of the block's rows, a part of its texts); parts of a block come in order."""
        for batch in self.batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            texts = batch.column(batch.num_columns - 1).to_pylist()
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    yield keys[start], texts[start:k]
                    start = k


def summary_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in SUMMARY.split(", ")])


def block_starts(summaries: DataFrame) -> DataFrame:
    """(path, block, state, before): the state a block begins in and the sum of the numbers of the blocks before it.

    A block keeps the state, turns it over, or fixes it. So the state is the last fixed one, turned
    as often as blocks since then turn it: running sums over one row a block.
    """
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    fixed = F.col("ends_out") == F.col("ends_in")
    turns = summaries.withColumn("turn", F.when(~fixed & (F.col("ends_out") == IN), 1).otherwise(0)).withColumn("turns", F.coalesce(F.sum("turn").over(before), F.lit(0)))
    last = F.last(F.when(fixed, F.struct(F.col("ends_out").alias("to"), F.col("turns").alias("at"))), ignorenulls=True).over(before)
    states = turns.withColumn("last", last).withColumn("state", F.when(F.col("last").isNull(), F.col("turns") % 2).otherwise((F.col("last.to") + F.col("turns") - F.col("last.at")) % 2).cast("int"))
    value = F.when(F.col("state") == OUT, F.col("value_out")).otherwise(F.col("value_in"))
    return states.withColumn("before", F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long")).select("path", "block", "state", "before")


def entered(texts: DataFrame, summaries: DataFrame, place: str) -> DataFrame:
    """``texts`` with the state and sum that their block begins with, still in order; ``place`` is a folder for the numbers."""
    spark = texts.sparkSession
    summaries.write.parquet(f"{place}/summaries")
    block_starts(spark.read.parquet(f"{place}/summaries")).write.parquet(f"{place}/starts")
    starts = spark.read.parquet(f"{place}/starts")
    if starts.count() <= BROADCAST_ROWS:  # texts then stay where they are
        return texts.join(F.broadcast(starts), ["path", "block"])
    return texts.withColumn("n", F.monotonically_increasing_id()).join(starts, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "n")


def joined_parts(parts: DataFrame) -> DataFrame:
    """(path, number, text) from (path, number, block, seq, part), put together in order."""
    held = F.array_sort(F.collect_list(F.struct("block", "seq", "part")))
    return parts.groupBy("path", "number").agg(F.array_join(F.transform(held, lambda x: x["part"]), "").alias("text"))
