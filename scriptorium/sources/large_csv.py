"""CSV files of any size, each read by many tasks.

Where a task begins to read, it can't know whether it stands inside quotes. So a first pass
tells of every block of a file what it makes of either state (outside and inside quotes) and
how many records begin in it; those are composed from block to block, which gives the state
and the record number each block begins with; a second pass parses. Records that
lie across blocks come out as parts and are put together by their number. Blocks are
Spark's own splits of a text file, so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.schema import CONTENT, METADATA, merged, metadata
from scriptorium.session import work_folder
from scriptorium.sources import blocks
from scriptorium.sources.blocks import IN, OUT, Blocks


def end_state(line: str, state: int, separator: str = ",") -> int:
    """Whether a line that begins outside (or inside) quotes ends inside them, by the rules of csv.reader."""
    at = 0
    while True:
        if state == OUT:
            if line.startswith('"', at):
                at += 1
            else:  # a quote within a bare field is plain text
                at = line.find(separator, at) + 1
                if not at:
                    return OUT
                continue
        while True:
            at = line.find('"', at) + 1
            if not at:
                return IN
            if not line.startswith('"', at):
                break
            at += 1
        state = OUT
        at = line.find(separator, at) + 1  # what stands between the quote and the separator belongs to the field
        if not at:
            return OUT


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _summaries(lines: DataFrame, separator: str) -> DataFrame:
    """blocks.SUMMARY: the state after a block and the records that begin in it, by the state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, states, starts = None, [OUT, IN], [0, 0]
        for at, part in Blocks(batches):
            if at != key:
                if key is not None:
                    done.append((*key, *states, *starts))
                key, states, starts = at, [OUT, IN], [0, 0]
            for line in part:
                if '"' not in line:  # leaves either state as it is
                    if not _blank(line):
                        starts[0] += states[0] == OUT
                        starts[1] += states[1] == OUT
                    continue
                after = {s: end_state(line, s, separator) for s in set(states)}
                for k in (0, 1):
                    starts[k] += states[k] == OUT
                    states[k] = after[states[k]]
        if key is not None:
            done.append((*key, *states, *starts))
        if done:
            yield blocks.summary_batch(done)

    return lines.mapInArrow(run, blocks.SUMMARY)


def _parse(lines: list[str], separator: str) -> list[list[str]]:
    return [r for r in csv.reader((x + "\n" for x in lines), delimiter=separator) if r]


def _parsed(lines: DataFrame, separator: str) -> DataFrame:
    """(path, number, fields) of whole records and (path, number, block, seq, part) of parts of records, from (path, block, state, before, line)."""
    csv.field_size_limit(1 << 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 62)
        rows: list[tuple] = []
        held: list[str] = []  # lines of the record that is open
        whole: list[str] = []  # lines of records that lie within the block
        key, state, first, number, seq, broken = None, OUT, 0, 0, 0, False

        def flush_whole():
            nonlocal first
            for r in _parse(whole, separator):
                rows.append((key[0], first, key[1], None, r, None))
                first += 1
            whole.clear()

        def end_block():
            nonlocal seq
            flush_whole()
            if held:
                rows.append((key[0], number - 1, key[1], seq, None, "\n".join(held) + "\n"))
                held.clear()

        for at, part in Blocks(batches):
            if at != key:
                if key is not None:
                    end_block()
                key, state, number, seq = at, at[2], at[3], 0
                first, broken = number, state == IN
            for line in part:
                if state == OUT:
                    if _blank(line):
                        continue
                    number += 1
                held.append(line)
                state = end_state(line, state, separator) if '"' in line else state
                if state == OUT:
                    if broken:  # began in an earlier block
                        rows.append((key[0], number - 1, key[1], seq, None, "\n".join(held) + "\n"))
                        broken, seq = False, seq + 1
                    else:
                        whole.extend(held)
                    held = []
            if len(whole) > 10_000 or sum(map(len, whole)) > 4_000_000:
                flush_whole()
            if rows:
                yield _batch(rows)
                rows = []
        if key is not None:
            end_block()
        if rows:
            yield _batch(rows)

    return lines.mapInArrow(run, "path string, number long, block long, seq int, fields array<string>, part string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "number", "block", "seq", "fields", "part"])


def read_records(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """(path, number, fields): the records of CSV files in UTF-8, numbered from 0 in each file; lines without anything aren't records.

    Quotes may hold separators, line ends and doubled quotes. A file takes as many tasks as it
    has splits (``spark.sql.files.maxPartitionBytes``); one record has to fit into a task. A field whose
    quote is never closed runs to the end of the file, and ends in a line end.
    """
    if len(separator) != 1 or separator in '"\n\r':
        raise ValueError("the separator is one character, not a quote or a line end")
    return records_of(blocks.split_texts(spark, path, "\n", "line"), separator)


def records_of(lines: DataFrame, separator: str = ",") -> DataFrame:
    """read_records() of (path, block, line); each block's lines stand in order within one task."""
    spark = lines.sparkSession
    place = work_folder(spark, "csv")
    entered = blocks.entered(lines, _summaries(lines, separator), place)
    _parsed(entered.select("path", "block", "state", "before", "line"), separator).write.parquet(f"{place}/parsed")
    parsed = spark.read.parquet(f"{place}/parsed")
    parts = blocks.joined_parts(parsed.filter("part is not null"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 62)
        for batch in batches:
            found = [_parse(t.removesuffix("\n").split("\n"), separator)[0] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["path", "number", "fields"])

    return parsed.filter("fields is not null").select("path", "number", "fields").unionByName(parts.mapInArrow(joined, "path string, number long, fields array<string>"))


def read_csv(spark: SparkSession, path: str | list[str], separator: str = ",", source_column: str | None = None, metadata_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV files as documents, as readers.read_csv() makes them of whole files.

    A row as wide as its file's header is a document, ``header: value`` by line without the source and
    metadata columns; other rows only take a number. Of columns of one name the last one counts.
    """
    records = read_records(spark, path, separator)
    place = work_folder(spark, "csv-rows")
    records.write.parquet(place)
    records = spark.read.parquet(place)
    # The place of each column, by the last column of its name.
    last = F.transform("fields", lambda h: F.size("fields") - F.array_position(F.reverse("fields"), h).cast("int"))
    heads = records.filter("number = 0").select("path", F.col("fields").alias("header"), last.alias("at"))
    rows = records.filter("number > 0").join(F.broadcast(heads) if heads.count() <= blocks.BROADCAST_ROWS // 10 else heads, "path").filter(F.size("fields") == F.size("header"))
    hidden = F.array(*map(F.lit, [*metadata_columns, *([source_column] if source_column else [])])).cast("array<string>")
    shown = F.filter(F.arrays_zip("header", "at"), lambda c: ~F.array_contains(hidden, c["header"]))
    content = F.array_join(F.transform(shown, lambda c: F.concat(c["header"], F.lit(": "), F.get("fields", c["at"]))), "\n")

    def value(name: str):
        k = F.array_position("header", name).cast("int")
        return F.when(k > 0, F.get("fields", F.get("at", k - 1)))

    source = {"source": F.nullif(value(source_column), F.lit(""))} if source_column else {}
    meta = merged(metadata(source=F.col("path")), metadata(**{m: value(m) for m in metadata_columns}), metadata(**source), metadata(row=F.col("number"), format="csv"))
    return rows.select(F.col("path").alias("doc_id"), (F.col("number") - 1).alias("doc_seq"), content.alias(CONTENT), meta.alias(METADATA))
