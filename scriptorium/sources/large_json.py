"""JSON files that hold one large array, each read by many tasks.

A file is cut at its commas. Of every block a first pass tells whether it ends inside a string
and by how much it deepens the nesting, by whether it begins inside one; composed from block
to block, that gives the place where each block begins. A second pass cuts items at the commas
between elements; those that lie across blocks come out as parts and are put together by number. No
task holds a file, only one item at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.schema import CONTENT, METADATA, merged, metadata
from scriptorium.session import work_folder
from scriptorium.sources import blocks, parsing
from scriptorium.sources.blocks import IN, OUT, Blocks

_ESCAPE = re.compile(r"\\.", re.DOTALL)


def effect(piece: str, state: int) -> tuple[int, int]:
    """(state, depth): whether a piece that begins outside (or inside) a string ends inside one, and by how much it deepens the nesting.

    No escape reaches over a comma, so none reaches over an end of a piece.
    """
    if "\\" in piece:
        piece = _ESCAPE.sub("", piece)
    if '"' in piece:
        parts = piece.split('"')
        piece, after = "".join(parts[state::2]), (state + len(parts) - 1) % 2
    elif state == IN:
        return IN, 0
    else:
        after = OUT
    return after, piece.count("[") + piece.count("{") - piece.count("]") - piece.count("}")


def _summaries(pieces: DataFrame) -> DataFrame:
    """blocks.SUMMARY with the change of depth as its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, states, depths = None, [OUT, IN], [0, 0]
        for at, part in Blocks(batches):
            if at != key:
                if key is not None:
                    done.append((*key, *states, *depths))
                key, states, depths = at, [OUT, IN], [0, 0]
            for piece in part:
                for k in (0, 1):
                    states[k], deeper = effect(piece, states[k])
                    depths[k] += deeper
        if key is not None:
            done.append((*key, *states, *depths))
        if done:
            yield blocks.summary_batch(done)

    return pieces.mapInArrow(run, blocks.SUMMARY)


_CUT = "path string, block long, local long, seq int, item string, part string"
_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())


def _cut(entered: DataFrame) -> DataFrame:
    """Whole items and parts of items, numbered by the commas between elements in the block before them, and a row for each block with all its commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[str] = []
        key, state, depth, local, seq, broken = None, OUT, 0, 0, 0, False

        def end_item():
            nonlocal broken, seq
            text = ",".join(held)
            rows.append((*key[:2], local, seq if broken else None, None if broken else text, text if broken else None))
            seq, broken = seq + broken, False
            held.clear()

        def end_block():
            if held and state == OUT and depth == 0:  # the array is closed
                end_item()
            elif held:
                rows.append((*key[:2], local, seq, None, ",".join(held) + ","))
                held.clear()
            rows.append((*key[:2], local, None, None, None))

        for at, part in Blocks(batches):
            if at != key:
                if key is not None:
                    end_block()
                key, state, depth, local, seq = at, at[2], at[3], 0, 0
                broken = not (state == OUT and depth in (0, 1)) or depth == 0 and at[1] > 0
            for piece in part:
                held.append(piece)
                state, deeper = effect(piece, state)
                depth += deeper
                if state == OUT and depth == 1:  # the comma behind it stands between elements
                    end_item()
                    local += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[f.split()[0] for f in _CUT.split(", ")])
                rows.clear()
        if key is not None:
            end_block()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[f.split()[0] for f in _CUT.split(", ")])

    return entered.mapInArrow(run, _CUT)


def items_of(pieces: DataFrame) -> DataFrame:
    """read_items() of (path, block, piece); each block's pieces stand in order within one task."""
    spark = pieces.sparkSession
    place = work_folder(spark, "json")
    entered = blocks.entered(pieces, _summaries(pieces), place)
    _cut(entered.select("path", "block", "state", "before", "piece")).write.parquet(f"{place}/cut")
    cut = spark.read.parquet(f"{place}/cut")
    by_block = W.partitionBy("path").orderBy("block")
    counts = cut.filter("item is null and part is null").select("path", "block", F.coalesce(F.sum("local").over(by_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("local").over(W.partitionBy("path")).alias("last"))
    counts.write.parquet(f"{place}/offsets")
    counts = spark.read.parquet(f"{place}/offsets")
    numbered = cut.filter("item is not null or part is not null").join(F.broadcast(counts) if counts.count() <= blocks.BROADCAST_ROWS else counts, ["path", "block"])
    numbered = numbered.select("path", "block", "seq", "item", "part", "last", (F.col("local") + F.col("offset")).alias("number"))
    parts = blocks.joined_parts(numbered.filter("part is not null")).join(counts.select("path", "last").distinct(), "path")
    every = numbered.filter("item is not null").select("path", "number", "last", F.col("item").alias("text")).unionByName(parts.select("path", "number", "last", "text"))
    first, last = F.col("number") == 0, F.col("number") == F.col("last")
    opened = F.when(first & ~F.col("text").rlike(r"^[﻿\s]*\["), F.raise_error(F.concat(F.lit("Not an array: "), "path"))).when(first, F.regexp_replace("text", r"^[﻿\s]*\[", "")).otherwise(F.col("text"))
    closed = F.when(last, F.regexp_replace(opened, r"\]\s*$", "")).otherwise(opened)
    return every.select("path", "number", F.regexp_replace(closed, r"^\s+|\s+$", "").alias("item")).filter("item <> ''")


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, number, item): the elements, as JSON texts numbered from 0, of files in UTF-8 that hold an array each.

    A file takes as many tasks as it has splits (``spark.sql.files.maxPartitionBytes``); one
    element has to fit into a task. An empty array has no elements; a file that holds something
    other than an array is an error.
    """
    return items_of(blocks.split_texts(spark, path, ",", "piece"))


def read_json(spark: SparkSession, path: str | list[str], content_key: str | None = None, metadata_keys: tuple[str, ...] = (), pretty: bool = True) -> DataFrame:
    """Elements as documents, as readers.read_json() makes them of the array of a whole file."""

    @F.pandas_udf("struct<content:string,meta:map<string,string>>")
    def document(texts: pd.Series) -> pd.DataFrame:
        made = [parsing.json_documents(f"[{t}]", "[]", content_key, metadata_keys, pretty)[0] for t in texts]
        return pd.DataFrame({"content": [c for c, _ in made], "meta": [m for _, m in made]})

    made = read_items(spark, path).withColumn("d", document("item"))
    meta = merged(metadata(source=F.col("path")), F.col("d.meta"), metadata(index=F.col("number")))
    return made.select(F.col("path").alias("doc_id"), F.col("number").alias("doc_seq"), F.col("d.content").alias(CONTENT), meta.alias(METADATA))
