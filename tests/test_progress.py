"""Progress tables and the stream that takes one document at a time."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.processors import clean_text, enrich, merge_pages
from scriptorium.operators.splitters import split_recursively
from scriptorium.sources.readers import read_files
from scriptorium.streaming import progress, streams


@pytest.fixture
def folder(tmp_path):
    for name, raw in {"a.txt": b"one", "b.txt": b"two  words", "c.csv": b"k\n1\n2\n3\n", "d.md": b"# d", "e.html": b"<p>hi</p>"}.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    return tmp_path


def counts(df):
    return {r["format"]: (r.documents, r.characters) for r in df.collect()}


def test_batch_progress_equals_the_written_rows(spark, folder):
    from scriptorium.sources.readers import binary_files

    docs = read_files(binary_files(spark, str(folder / "in")))
    rows = progress.write_observed(docs, str(folder / "out"), "first load", str(folder / "progress"))
    written = spark.read.parquet(str(folder / "out"))
    want = written.groupBy(F.col("metadata")["format"].alias("format")).agg(F.count("*").alias("documents"), F.sum(F.length("page_content")).alias("characters"))
    table = spark.read.parquet(str(folder / "progress"))
    assert counts(table) == counts(want) == {r.format: (r.documents, r.characters) for r in rows} and len(rows) == 3
    assert table.filter("label = 'first load' and at is not null").count() == 3


def test_stream_progress_equals_the_written_rows(spark, folder):
    seen = []
    listener = progress.ProgressListener(seen.extend)
    spark.streams.addListener(listener)
    try:
        docs = read_files(streams.file_stream(spark, str(folder / "in"), files_per_batch=2))
        progress.load_with_progress(docs, str(folder / "out"), str(folder / "checkpoint"), "stream load").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    progress.append_progress(spark, seen, str(folder / "progress"))
    table = spark.read.parquet(str(folder / "progress"))
    got = table.groupBy("format").agg(F.sum("documents").alias("documents"), F.sum("characters").alias("characters"))
    want = spark.read.parquet(str(folder / "out")).groupBy(F.col("metadata")["format"].alias("format")).agg(F.count("*").alias("documents"), F.sum(F.length("page_content")).alias("characters"))
    assert counts(got) == counts(want) and table.select("batch").distinct().count() == 3 and table.filter("label <> 'stream load'").isEmpty()


def merged(docs):
    return merge_pages(docs.withColumn("page", F.lit(1)), "doc_id", "page", "page_content", 2, 1)


def test_steps_that_merge_are_refused(spark, folder):
    docs = read_files(streams.file_stream(spark, str(folder / "in")))
    for step in (merged, lambda d: d.dropDuplicates(["doc_id"]), lambda d: d.groupBy("doc_id").count(), lambda d: d.join(d.select("doc_id"), "doc_id"), lambda d: d.limit(3), lambda d: d.select("doc_id").distinct()):
        with pytest.raises(ValueError, match="merges documents"):
            streams.process_each(docs, clean_text, step)
    declared = lambda d: d
    declared.merges = True
    assert streams.meets_rows(declared, docs) == "declared"
    out = streams.process_each(docs, clean_text, enrich, split_recursively, lambda d: d.filter("word_count > 0"))
    out.writeStream.option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start(str(folder / "out")).awaitTermination()
    assert sorted(r.page_content for r in spark.read.parquet(str(folder / "out")).collect()) == sorted(["one", "two words", "k: 1", "k: 2", "k: 3", "# d", "hi"])
