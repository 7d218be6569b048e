"""Results by content: files whose documents are already in a table aren't read again.

The table has a folder for each day and each of 256 parts of the key, so a batch looks only
into the days that haven't expired and the parts that its own keys fall into; inside a
part, Parquet's Bloom filters on the key let a reader pass over files. What was read
is written back under the key of its file's name and content. Old days go as whole folders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.schema import CONTENT, METADATA
from scriptorium.session import work_folder

ROWS = f"key string, doc_id string, doc_seq long, {CONTENT} string, {METADATA} map<string,string>, cached_at timestamp, day string, part string"
_COLUMNS = ["doc_id", "doc_seq", CONTENT, METADATA]
#: Keys that may be sent to all tasks; a batch of more meets the cache in a shuffled join.
BROADCAST_ROWS = 100_000


def _utc(now: datetime | None) -> datetime:
    return now or datetime.now(timezone.utc)


def part_of(key: str) -> Column:
    """Which of 256 parts a key falls into."""
    return F.substring(F.sha2(F.col(key), 256), 1, 2)


class ResultCache:
    """Documents of files in a folder that all executors share, kept for ``ttl``.

    Keys hold the path and a hash of the content, so a file that is changed or renamed is read anew. A file without
    documents is remembered too. Of results stored twice the last one counts.
    """

    def __init__(self, spark: SparkSession, folder: str, ttl: timedelta = timedelta(hours=1)):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl

    def _table(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(ROWS).parquet(self.folder)

    def keyed(self, files: DataFrame) -> DataFrame:
        return files.withColumn("key", tx.cache_key("path", "content"))

    def held(self, keys: DataFrame, now: datetime | None = None) -> DataFrame:
        """The rows of the cache for ``keys`` (key) that haven't expired; only the days and parts that may have them are read."""
        cache = self._table()
        if cache is None:
            return self.spark.createDataFrame([], ROWS)
        now = _utc(now)
        oldest = now - self.ttl
        wanted = keys.select("key").distinct()
        parts = [r.part for r in wanted.select(part_of("key").alias("part")).distinct().collect()]  # 256 at most
        live = cache.filter(F.col("day").between(oldest.date().isoformat(), now.date().isoformat()) & F.col("part").isin(*parts) if parts else F.lit(False))
        live = live.filter(F.col("cached_at") > F.lit(oldest))
        few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        found = live.join(F.broadcast(wanted) if few else wanted, "key", "left_semi")
        last = found.groupBy("key").agg(F.max("cached_at").alias("cached_at"))
        return found.join(last, ["key", "cached_at"]).select(*[f.split()[0] for f in ROWS.split(", ")])

    def store(self, keys: DataFrame, documents: DataFrame, now: datetime | None = None) -> None:
        """Remember the documents (doc_id: the file's path) of files (path, key)."""
        at = _utc(now)
        rows = keys.select("key", F.col("path").alias("doc_id")).join(documents.select(*_COLUMNS), "doc_id", "left")
        made = rows.select("key", *_COLUMNS, F.lit(at).alias("cached_at"), F.lit(at.date().isoformat()).alias("day"), part_of("key").alias("part"))
        made.repartition("part").write.mode("append").partitionBy("day", "part").option("parquet.bloom.filter.enabled#key", "true").parquet(self.folder)

    def process(self, files: DataFrame, read: Callable[[DataFrame], DataFrame], now: datetime | None = None) -> DataFrame:
        """The documents of ``files`` (path, content), with ``cached``: those that are held, and those of the rest, which are read and written back."""
        place = work_folder(self.spark, "cache")
        keyed = self.keyed(files)
        keyed.select("path", "key").write.parquet(f"{place}/keys")
        keys = self.spark.read.parquet(f"{place}/keys")
        self.held(keys, now).write.parquet(f"{place}/held")
        held = self.spark.read.schema(ROWS).parquet(f"{place}/held")
        missed = keys.join(held.select("key").distinct(), "key", "left_anti")
        missed.write.parquet(f"{place}/missed")
        missed = self.spark.read.parquet(f"{place}/missed")
        read(files.join(missed.select("path"), "path", "left_semi")).select(*_COLUMNS).write.parquet(f"{place}/read")
        made = self.spark.read.parquet(f"{place}/read")
        self.store(missed, made, now)
        known = held.filter(f"{CONTENT} is not null").select(*_COLUMNS, F.lit(True).alias("cached"))
        return known.unionByName(made.select(*_COLUMNS, F.lit(False).alias("cached")))

    def drop_expired(self, now: datetime | None = None) -> list[str]:
        """Remove the days that hold nothing but expired results; their names."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        oldest = f"day={(_utc(now) - self.ttl).date().isoformat()}"
        days = [s.getPath() for s in store.listStatus(path) if s.getPath().getName().startswith("day=")] if store.exists(path) else []
        gone = [p for p in days if p.getName() < oldest]
        for p in gone:
            store.delete(p, True)
        return sorted(p.getName() for p in gone)
