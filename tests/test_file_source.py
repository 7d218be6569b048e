"""The file source: what is listed, opened, packed and streamed."""

import os
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import file_source
from scriptorium.sources.readers import read_files

NAMES = {"a.txt": b"alpha", "b.md": b"# b", "sub/c.csv": b"x,y\n1,2\n", "sub/d e.TXT": b"delta" * 100, "sub/deep/no": b"", ".git/x.txt": b"no", "node_modules/y.txt": b"no", "_hidden.txt": b"no", "big.bin": b"z" * 5000}


@pytest.fixture
def folder(tmp_path):
    for k, (name, raw) in enumerate(NAMES.items()):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    return str(tmp_path / "in")


def names(df):
    return sorted(r.path.rsplit("/in/", 1)[1] for r in df.collect())


def test_rows(spark, folder):
    rows = {r.path.rsplit("/in/", 1)[1]: r for r in file_source.files(spark, folder).collect()}
    assert sorted(rows) == ["a.txt", "b.md", "big.bin", "sub/c.csv", "sub/d e.TXT", "sub/deep/no"]
    assert all(bytes(r.content) == NAMES[n] and r.length == len(NAMES[n]) and r.error is None for n, r in rows.items())
    assert (rows["sub/d e.TXT"].extension, rows["sub/deep/no"].extension) == ("txt", "")
    assert names(file_source.files(spark, folder, recursive="false")) == ["a.txt", "b.md", "big.bin"] and names(file_source.files(spark, folder, glob="*.md")) == ["b.md"]
    listed = file_source.files(spark, folder, content="false").collect()
    assert len(listed) == 6 and all(r.content is None for r in listed)


CUTS = [
    ({"extensions": "txt"}, "extension = 'txt'", 2),
    ({"minLength": 101, "maxLength": 4999}, "length between 101 and 4999", 1),
    ({"extensions": ".MD, csv", "pathGlob": "*/in/b*"}, "extension in ('md', 'csv') and path like '%/in/b%'", 1),
    ({"modifiedAfter": "2020-09-13T12:26:42", "modifiedBefore": "2020-09-13T12:26:45+00:00"}, "modificationTime > timestamp '2020-09-13 12:26:42' and modificationTime < timestamp '2020-09-13 12:26:45'", 2),
    ({"maxLength": 0}, "length = 0", 1),
    ({}, "true", 6),
]


@pytest.mark.parametrize("options,where,count", CUTS)
def test_files_outside_the_options_are_never_opened(spark, folder, monkeypatch, options, where, count):
    held = file_source.files(spark, folder, content="false").filter(where)
    assert names(file_source.files(spark, folder, **options)) == names(held) and held.count() == count
    seen = []
    monkeypatch.setattr(file_source, "open_file", lambda path, real=file_source.open_file: seen.append(path) or real(path))
    reader = file_source.FileReader({"path": folder} | {k.lower(): str(v) for k, v in options.items()})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == count == len(seen)


def test_one_table_filtered_in_two_ways(spark, folder):
    """What one scan leaves out, the next one of the same DataFrame still has."""
    held = file_source.files(spark, folder)
    assert [held.filter("extension = 'txt'").count(), held.count(), held.filter("extension = 'md'").unionByName(held.filter("extension = 'csv'")).count()] == [2, 6, 2]


def test_any_condition_on_a_listing(spark, folder):
    listed = file_source.files(spark, folder, content="false")
    rows = file_source.open_files(listed.filter("length(extension) = 0 or length % 5 = 0"), task_bytes=1_000_500).collect()
    assert sorted((r.path.rsplit("/in/", 1)[1], bytes(r.content)) for r in rows) == sorted((n, NAMES[n]) for n in ("a.txt", "big.bin", "sub/d e.TXT", "sub/deep/no"))
    assert file_source.open_files(listed.filter("false")).count() == 0


def test_packing_by_bytes():
    at = datetime.now(timezone.utc)
    entries = [file_source.Entry(f"file:/{k}", at, size) for k, size in enumerate([900, 10, 10, 10, 500, 400, 0, 70])]
    packed = file_source.pack(entries, 1000, 0)
    assert sorted(e.path for p in packed for e in p.entries) == sorted(e.path for e in entries)
    assert len(packed) == 2 and all(sum(e.length for e in p.entries) <= 1000 for p in packed)
    assert len(file_source.pack(entries, 100, 0)) == 8 and file_source.pack([], 100, 0) == []


def test_unreadable_files_are_rows_or_errors(spark, folder, monkeypatch):
    entries = [*file_source.list_files(folder), file_source.Entry("file:/gone.txt", datetime.now(timezone.utc), 3)]
    rows = [r for b in file_source.read_packed(entries, True, True) for r in b.to_pylist()]
    assert [r["error"] is None for r in rows] == [True] * 6 + [False] and rows[-1]["content"] is None
    with pytest.raises(OSError):
        list(file_source.read_packed(entries, True, False))


def test_readers_take_it(spark, folder):
    docs = read_files(file_source.files(spark, folder).filter("extension in ('md', 'csv', 'txt')"))
    assert sorted(r.page_content for r in docs.collect()) == sorted(["alpha", "# b", "x: 1\ny: 2", "delta" * 100])


def test_stream_goes_on_from_its_offset(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(**options):
        found = file_source.file_stream(spark, folder, **options).filter("extension = 'txt'").select("path", F.length("content").alias("n"))
        found.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    assert run() == ["a.txt", "d e.TXT"]
    for name in ("late1.txt", "late2.txt", "late.bin"):
        path = f"{folder}/{name}"
        with open(path, "wb") as f:
            f.write(b"late")
        os.utime(path, (time.time() - 60, time.time() - 60))
    assert run() == ["a.txt", "d e.TXT", "late1.txt", "late2.txt"]
    assert run() == ["a.txt", "d e.TXT", "late1.txt", "late2.txt"]
