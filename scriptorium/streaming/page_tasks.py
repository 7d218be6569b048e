"""Page tasks that resume, stop and survive: a keyed state over append-only logs.

A store is a folder that all executors share, with three logs: ``commands`` (what callers ask for),
``steps`` (which pages to work on next, and each task's state after every step) and
``attempts`` (what came of a page). One streaming query reads commands and attempts, keeps a
task's position and the outcome of its pages as state, and hands out a bounded number
of pages a task at a time; the attempts that it writes are its own next input. So a cancel
command takes effect before the next portion, and pages of one task run on many executors.
Steps and attempts are written under the number of their micro-batch: a batch that is replayed
after a failure replaces what it wrote, and each page is worked on once.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators import tasks
from scriptorium.operators.tasks import CANCELLED, COMPLETED, FAILED, PENDING, PROCESSING, RESULT, SUCCESS

DELETED = "deleted"
COMMAND = "task_id long, kind string, total long, only array<long>, skip array<long>, at timestamp"
STEP = "task_id long, page long, attempt int, total long, completed long, failed long, status string, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a task is remembered after it was last touched, and pages handed out to a task at a time.
DAYS, PORTION = 7, 1000
#: Pages whose outcomes are one value of the state.
BLOCK = 1000
#: Batches without input would follow one another without end; what has expired goes with the next input.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def status_of(total: int, completed: int, failed: int, cancelled: bool) -> str:
    """The rule of tasks.progress() for one task."""
    if cancelled:
        return CANCELLED
    if total > 0 and completed + failed >= total:
        return FAILED if not completed else COMPLETED
    return PROCESSING if completed + failed else PENDING


class _Steps(StatefulProcessor):
    """Commands and attempts of a task in, pages to work on and the task's state out."""

    def __init__(self, portion: int, days: int):
        self.portion, self.days = portion, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.days * 86_400_000
        # next: how many pages of the run's list have been looked at; waiting: pages handed out whose attempts haven't come back.
        self.task = handle.getValueState("task", "total long, cancelled boolean, next long, waiting long, completed long, failed long, only array<long>, skip array<long>, listed boolean", ttl)
        # The pages of a block in one value, as each access is a call to the JVM: for a page its attempts times four, 2 if one failed, 1 if one succeeded.
        self.pages = handle.getMapState("pages", "block long", "pages binary", ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [r.asDict() for r in rows]
        names = ("total", "cancelled", "next", "waiting", "completed", "failed", "only", "skip", "listed")
        found = self.task.get()
        held = dict(zip(names, found, strict=True)) if found is not None else None
        deleted = False
        self.blocks, self.changed = {}, set()
        for e in (e for e in events if e["kind"] == "attempt"):
            if held:
                self._record(held, int(e["page"]), e["status"] == SUCCESS)
        for e in sorted((e for e in events if e["kind"] != "attempt"), key=lambda e: e["at"]):
            held, deleted = self._command(held, deleted, e)
        now = datetime.now(timezone.utc)
        if held is None:
            self.task.clear()
            self._forget()
            if deleted:
                yield _STEP_ROW(key[0], None, None, 0, 0, 0, DELETED, now)
            return
        out = [] if held["waiting"] else list(islice(self._left(held), self.portion))
        held["waiting"] += len(out)
        self.task.update(tuple(held[n] for n in names))
        for block in self.changed:
            self.pages.updateValue((block,), (self.blocks[block].tobytes(),))
        status = status_of(held["total"], held["completed"], held["failed"], held["cancelled"])
        status = PROCESSING if status == PENDING and held["waiting"] else status
        last = (held["total"], held["completed"], held["failed"], status, now)
        yield _STEP_ROW(key[0], None, None, *last)
        for page, attempt in out:
            yield _STEP_ROW(key[0], page, attempt, *last)

    def _page(self, page: int) -> tuple[array, int]:
        """The block that holds a page, read once for the rows at hand, and the page's place in it."""
        block, place = divmod(page, BLOCK)
        if block not in self.blocks:
            found = self.pages.getValue((block,))
            self.blocks[block] = array("Q", bytes(found[0]) if found else b"")
        return self.blocks[block], place

    def _forget(self) -> None:
        self.pages.clear()
        self.blocks, self.changed = {}, set()

    def _record(self, held: dict, page: int, succeeded: bool) -> None:
        pages, place = self._page(page)
        pages.extend([0] * (place + 1 - len(pages)))
        old, new = pages[place], 1 if succeeded else 2
        held["waiting"] = max(0, held["waiting"] - 1)
        held["completed"] += succeeded and not old & 1
        held["failed"] += not succeeded and not old & 2
        pages[place] = (old | new) + 4
        self.changed.add(page // BLOCK)

    def _command(self, held: dict | None, deleted: bool, e: dict) -> tuple[dict | None, bool]:
        if e["kind"] == "delete":
            return None, True
        over = held and status_of(held["total"], held["completed"], held["failed"], False) == COMPLETED
        if e["kind"] == "cancel":
            return (held | {"cancelled": True} if held and not over else held), deleted
        if held is None:
            if deleted:
                self._forget()
            held = {"total": int(e["total"]), "cancelled": False, "waiting": 0, "completed": 0, "failed": 0}
        if over:
            return held, deleted
        listed = e["only"] is not None
        only = sorted({int(p) for p in e["only"] if 1 <= p <= held["total"]}) if listed else []
        skip = [] if e["skip"] is None else sorted({int(p) for p in e["skip"]})
        return held | {"cancelled": False, "next": 0, "only": only, "skip": skip, "listed": listed}, False

    def _left(self, held: dict) -> Iterator[tuple[int, int]]:
        """(page, attempt) of the run's next pages that haven't succeeded and aren't skipped; moves the run's position."""
        size, skip, seen = len(held["only"]) if held["listed"] else held["total"], set(held["skip"]), held["completed"] + held["failed"]
        while held["next"] < size and not held["cancelled"]:
            page = int(held["only"][held["next"]]) if held["listed"] else held["next"] + 1
            held["next"] += 1
            pages, place = self._page(page) if seen else ((), 0)
            old = pages[place] if place < len(pages) else 0
            if page not in skip and not old & 1:
                yield page, old // 4 + 1

    def close(self) -> None:
        pass


_STEP_ROW = Row(*[f.split()[0] for f in STEP.split(", ")])


class PageTasks:
    """A store of page tasks under ``folder``, which all executors must share.

    A task is started with its number of pages, which stays as first given; a second start
    resumes it: pages that failed come again, those that succeeded don't, and a task that is
    completed does nothing. A document that isn't taken apart is a task of one page.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in (("commands", COMMAND), ("attempts", RESULT), ("steps", STEP)):
            if not self._exists(name):
                spark.createDataFrame([], schema).write.mode("append").parquet(self._batch(name, -1))

    def _batch(self, name: str, number: int) -> str:
        return f"{self.folder}/{name}/batch={number}"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(f"{self.folder}/{name}")
        return files.exists(path)

    def _remove(self, name: str, number: int) -> None:
        path, files = self._path(self._batch(name, number))
        files.delete(path, True)

    def _log(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    # Commands

    def _command(self, rows: DataFrame, kind: str) -> None:
        have = {c.lower() for c in rows.columns}
        column = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
        made = rows.select(F.col("task_id").cast("long").alias("task_id"), F.lit(kind).alias("kind"), column("total", "long"), column("only", "array<long>"), column("skip", "array<long>"), F.current_timestamp().alias("at"))
        made.write.mode("append").parquet(self._batch("commands", 0))

    def start(self, rows: DataFrame) -> None:
        """Start or resume tasks: (task_id, total), and ``only`` and ``skip`` as arrays of pages, if wanted."""
        self._command(rows, "start")

    def cancel(self, rows: DataFrame) -> None:
        """Stop tasks before their next portion of pages; one that is completed stays so."""
        self._command(rows, "cancel")

    def delete(self, rows: DataFrame) -> None:
        """Forget tasks and what came of their pages."""
        self._command(rows, "delete")

    def delete_old(self, days: int = DAYS) -> None:
        """Delete tasks that ended more than ``days`` ago."""
        ended = self.progress().select("task_id", F.when(F.col("status").isin(COMPLETED, FAILED, CANCELLED), F.col("at")).alias("end_time"))
        self.delete(ended.filter("end_time is not null").join(tasks.without_old(ended, F.current_timestamp(), days), "task_id", "left_anti"))

    # Work

    def run(self, process: Callable[[DataFrame], DataFrame], portion: int = PORTION, days: int = DAYS, on_batch: Callable[[DataFrame, int], None] | None = None, every: str = "5 seconds") -> StreamingQuery:
        """Work on what is asked for until the query is stopped; restarted, it goes on where it was.

        A micro-batch starts ``every`` so often.

        ``process`` makes rows of (task_id, page, status, text, error, duration_ms, at) from (task_id, page,
        attempt), one for each; see tasks.process_pages(). ``on_batch`` is called with each portion's attempts once they are written;
        what it returns is ignored, and after a failure it may be called again for the same batch.
        """
        spark = self.spark
        stream = lambda name, schema: spark.readStream.schema(f"{schema}, batch long").option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        commands = stream("commands", COMMAND).select("task_id", "kind", "total", "only", "skip", F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("status"), "at")
        none = F.lit(None)
        attempts = stream("attempts", RESULT).select("task_id", F.lit("attempt").alias("kind"), none.cast("long").alias("total"), none.cast("array<long>").alias("only"), none.cast("array<long>").alias("skip"), "page", "status", "at")
        steps = commands.unionByName(attempts).groupBy("task_id").transformWithState(_Steps(portion, days), STEP, "append", "ProcessingTime")

        def each(batch: DataFrame, number: int) -> None:
            here = batch.sparkSession
            batch.write.mode("overwrite").parquet(self._batch("steps", number))
            written = here.read.schema(STEP).parquet(self._batch("steps", number))
            todo = written.filter("page is not null")
            if todo.isEmpty():
                if written.isEmpty():  # a batch that only looked for what has expired
                    self._remove("steps", number)
                return
            # By page, so that the pages of one large task are spread over the cluster.
            process(todo.select("task_id", "page", "attempt").repartition("task_id", "page")).select(*_RESULT_NAMES).write.mode("overwrite").parquet(self._batch("attempts", number))
            if on_batch:
                on_batch(here.read.schema(RESULT).parquet(self._batch("attempts", number)), number)

        writer = steps.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint")
        with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKS, NO_DATA: "false"}):  # which the query copies as it starts
            return writer.trigger(processingTime=every).start()

    def run_until_idle(self, process: Callable[[DataFrame], DataFrame], **options) -> None:
        """Work until no command and no page is left."""
        query = self.run(process, every="0 seconds", **options)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    # What came of it

    def progress(self) -> DataFrame:
        """(task_id, total, completed, failed, percentage, status, at) after each task's last step."""
        last = self._log("steps", STEP).filter("page is null").groupBy("task_id").agg(F.max_by(F.struct("total", "completed", "failed", "status", "at"), "batch").alias("x")).select("task_id", "x.*")
        share = F.when(F.col("total") > 0, F.floor((F.col("completed") + F.col("failed")) * 100 / F.col("total"))).otherwise(0).cast("long")
        return last.filter(F.col("status") != DELETED).select("task_id", "total", "completed", "failed", share.alias("percentage"), "status", "at")

    def attempts(self) -> DataFrame:
        """All attempts at the pages of tasks that aren't deleted: RESULT and the number of the batch."""
        gone = self._log("steps", STEP).filter(F.col("status") == DELETED).groupBy("task_id").agg(F.max("batch").alias("gone"))
        kept = self._log("attempts", RESULT).filter("batch >= 0").join(gone, "task_id", "left").filter("gone is null or batch >= gone")
        return kept.drop("gone")

    def results(self) -> DataFrame:
        """The last attempt at every page."""
        row = F.struct(*_RESULT_NAMES)
        return self.attempts().groupBy("task_id", "page").agg(F.max_by(row, "batch").alias("x")).select("x.*")

    def full_text(self) -> DataFrame:
        """(task_id, text) of the pages that succeeded, in order."""
        return tasks.full_text(self.attempts())


_RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]
