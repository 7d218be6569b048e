"""The result cache: hits, misses, write-back, life span, and what is opened."""

from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import result_cache
from scriptorium.plans.result_cache import ResultCache
from scriptorium.sources.readers import read_files

NOW = datetime(2024, 5, 10, 12, 0, tzinfo=timezone.utc)


@pytest.fixture
def cache(spark, tmp_path):
    return ResultCache(spark, str(tmp_path / "cache"), timedelta(hours=30))


def files(spark, **texts):
    return spark.createDataFrame([(f"{k}.txt" if "_" not in k else k.replace("_", "."), v.encode()) for k, v in texts.items()], "path string, content binary")


def rows(df):
    return sorted((r.doc_id, r.page_content, r.cached) for r in df.collect())


def test_hits_misses_and_write_back(spark, cache):
    opened = []

    def read(missed):
        opened.append(sorted(r.path for r in missed.collect()))
        return read_files(missed)

    assert rows(cache.process(files(spark, a="one", b="two", c_csv=""), read, NOW)) == [("a.txt", "one", False), ("b.txt", "two", False)]
    # Changed, renamed and new files are read; those without documents are remembered too.
    out = cache.process(files(spark, a="one", b="other", d="two", c_csv=""), read, NOW + timedelta(hours=1))
    assert rows(out) == [("a.txt", "one", True), ("b.txt", "other", False), ("d.txt", "two", False)]
    assert rows(cache.process(files(spark, a="one", b="other"), read, NOW + timedelta(hours=29))) == [("a.txt", "one", True), ("b.txt", "other", True)]
    assert rows(cache.process(files(spark, a="one", b="other"), read, NOW + timedelta(hours=30, minutes=30))) == [("a.txt", "one", False), ("b.txt", "other", True)]
    assert opened == [["a.txt", "b.txt", "c.csv"], ["b.txt", "d.txt"], [], ["a.txt"]]
    assert out.filter("cached").first().metadata["format"] == "text"


def test_only_the_parts_of_a_batch_and_live_days_are_opened(spark, cache):
    many = files(spark, **{f"f{k}": f"text {k}" for k in range(200)})
    cache.process(many, read_files, NOW)
    own = cache.keyed(many.filter("path = 'f7.txt'")).select(result_cache.part_of("key").alias("part")).first().part
    for path in Path(cache.folder).rglob("*.parquet"):
        if f"part={own}" not in str(path):
            path.write_bytes(b"broken")  # would fail if it were opened
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    broken = Path(cache.folder) / "day=2024-05-01" / f"part={own}"
    broken.mkdir(parents=True)
    (broken / "old.parquet").write_bytes(b"broken")
    assert rows(cache.process(many.filter("path = 'f7.txt'"), read_files, NOW)) == [("f7.txt", "text 7", True)]
    with pytest.raises(Exception):
        cache.held(cache.keyed(many), NOW).count()


@pytest.mark.parametrize("most", [result_cache.BROADCAST_ROWS, -1])
def test_last_result_counts_and_old_days_go(spark, cache, monkeypatch, most):
    monkeypatch.setattr(result_cache, "BROADCAST_ROWS", most)
    one = files(spark, a="one")
    keys = cache.keyed(one).select("path", "key")
    docs = read_files(one)
    for hours, text in ((0, "first"), (2, "second"), (1, "between")):
        cache.store(keys, docs.withColumn("page_content", F.lit(text)), NOW + timedelta(hours=hours))
    assert rows(cache.process(one, read_files, NOW + timedelta(hours=3))) == [("a.txt", "second", True)]
    assert cache.drop_expired(NOW + timedelta(days=1)) == [] and cache.drop_expired(NOW + timedelta(days=3)) == ["day=2024-05-10"]
    assert rows(cache.process(one, read_files, NOW + timedelta(days=3))) == [("a.txt", "one", False)]
    assert cache.held(keys.limit(0), NOW).count() == 0
