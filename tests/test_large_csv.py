"""CSV files read in blocks, held against the parser of whole files at every place a block may end."""

import csv
import io
import random

import pytest

from scriptorium.sources import blocks, large_csv, parsing
from scriptorium.sources.readers import binary_files, read_csv

TEXT = 'id,name,"no\nte",id\n1,"a ""quoted"", word",x,9\n\n2,"two\n\nlines, ""and\n"" more",ab"c,"8"\n3,too,few\n4,"",,\n5,"open "" x" tail,"y\r\n z",7\r\n\r\n6,é😀,"ü\n\n\n\nß",5\n7,last,"row without end\n",4'


def whole(text, separator=","):
    header, rows = parsing.read_csv(text, separator)
    return [header, *rows] if header else []


def in_blocks(spark, path, size, separator=","):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = large_csv.read_records(spark, path, separator).collect()
        count = blocks.split_texts(spark, path, "\n", "line").select("block").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.number for r in rows) == list(range(len(rows)))
    return [r.fields for r in sorted(rows, key=lambda r: r.number)], count


def state_of(text, separator=","):
    """Whether more lines are needed, by the parser itself: a record that is open takes in a mark put behind it."""
    found = list(csv.reader(io.StringIO(text + "\nMARK"), delimiter=separator))
    return large_csv.IN if found[-1] != ["MARK"] else large_csv.OUT


def test_end_state_is_that_of_the_parser():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choices('a",; \r', [4, 5, 3, 1, 1, 0], k=rng.randrange(12)))
        for separator in ",;":
            assert large_csv.end_state(line, large_csv.OUT, separator) == state_of(line, separator), line
            # Inside quotes: behind a line that opens them.
            assert large_csv.end_state(line, large_csv.IN, separator) == state_of('"\n' + line, separator), line


def cut_lines(text, cuts):
    """(block, line) of a text whose blocks begin at ``cuts``; a line belongs to the block that holds its first byte."""
    at, out = 0, []
    for line in text.removesuffix("\n").split("\n"):
        out.append((max([0, *(c for c in cuts if c <= at)]), line))
        at += len(line.encode()) + 1
    return out


def test_every_cut_gives_the_whole_files_records(spark):
    """One cut at every byte, blocks of every size, and random texts with random cuts, as so many files of one job."""
    rng = random.Random(2)
    cases = {}
    for k in range(1, len(TEXT.encode())):
        cases[f"at{k}"] = (TEXT, [k])
        cases[f"by{k}"] = (TEXT, list(range(0, len(TEXT.encode()), k)))
    for k in range(300):
        text = "h,i\n" + "".join(rng.choice(["a", ",", "\n", '"x\ny"', '"p""q\n\n"', ',"",', '"\n"', "\n\n", "b"]) for _ in range(40))
        cases[f"random{k}"] = (text, sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randrange(1, 12)))))
    rows = [(name, block, line) for name, (text, cuts) in cases.items() for block, line in cut_lines(text, cuts)]
    lines = spark.createDataFrame(rows, "path string, block long, line string").coalesce(1)
    found = {}
    for r in large_csv.records_of(lines).collect():
        found.setdefault(r.path, {})[r.number] = r.fields
    for name, (text, _) in cases.items():
        want = whole(text.removesuffix("\n") + "\n")  # a field that is never closed ends in a line end
        assert found.get(name, {}) == dict(enumerate(want)), name


@pytest.mark.parametrize("size", [17, 60, 1000])
def test_real_splits(spark, tmp_path, size):
    (tmp_path / "one.csv").write_bytes(TEXT.encode())
    rows, count = in_blocks(spark, str(tmp_path / "one.csv"), size)
    assert rows == whole(TEXT) and count > 1


def test_shuffled_blocks_and_separators(spark, tmp_path, monkeypatch):
    text = TEXT.replace(",", ";")
    (tmp_path / "two.csv").write_bytes(text.encode())
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", -1)
    assert in_blocks(spark, str(tmp_path / "two.csv"), 40, ";")[0] == whole(text, ";")
    with pytest.raises(ValueError):
        large_csv.read_records(spark, str(tmp_path / "two.csv"), '"')


def test_documents_equal_those_of_whole_files(spark, tmp_path):
    texts = {"a.csv": TEXT, "b.csv": "k,v\n1,2\n3,4\n", "only.csv": "just,a,header\n", "empty.csv": "", "blank.csv": "\n\n\r\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for options in ({}, {"source_column": "name", "metadata_columns": ("id", "v", "absent")}):
        made = large_csv.read_csv(spark, str(tmp_path), **options).collect()
        want = read_csv(binary_files(spark, str(tmp_path)), **options).drop("doc_seq").collect()
        own = lambda rows: sorted((r.doc_id.rsplit("/", 1)[1], r.page_content, sorted((k, v) for k, v in r.metadata.items() if k != "source" or "/" not in v)) for r in rows)
        assert own(made) == own(want)
