"""Progress of reading: what was written, by format, as a table that batches and streams append to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from scriptorium.schema import CONTENT, METADATA

FORMATS = ("text", "markdown", "csv", "json", "html", "docx", "xlsx", "doc", "xls", "pdf", "other")
PROGRESS = "label string, batch long, format string, documents long, characters long, at timestamp"
#: The name under which a stream's counts are observed.
OBSERVED = "documents_by_format"


def _measures() -> list[Column]:
    """Counts and characters of each format; counted by the tasks that write, without another pass."""
    kind = F.coalesce(F.col(METADATA)["format"], F.lit("other"))
    kind = F.when(kind.isin(*FORMATS), kind).otherwise("other")
    size = F.length(CONTENT).cast("long")
    return [x for f in FORMATS for x in (F.count(F.when(kind == f, 1)).alias(f"documents_{f}"), F.coalesce(F.sum(F.when(kind == f, size)), F.lit(0)).alias(f"characters_{f}"))]


def _rows(counts: dict, label: str, batch: int) -> list[tuple]:
    return [(label, batch, f, int(counts[f"documents_{f}"]), int(counts[f"characters_{f}"])) for f in FORMATS if counts.get(f"documents_{f}")]


def append_progress(spark: SparkSession, rows: list[tuple], path: str) -> None:
    schema = PROGRESS.rsplit(", ", 1)[0]
    spark.createDataFrame(rows, schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def write_observed(docs: DataFrame, out: str, label: str, progress: str, mode: str = "append") -> list[Row]:
    """Write documents, and append to the table ``progress`` how many of each format were written; those rows are returned too."""
    seen = Observation(OBSERVED)
    docs.observe(seen, *_measures()).write.mode(mode).parquet(out)
    rows = _rows(seen.get, label, 0)
    append_progress(docs.sparkSession, rows, progress)
    return [Row(label=r[0], batch=r[1], format=r[2], documents=r[3], characters=r[4]) for r in rows]


def observed(docs: DataFrame) -> DataFrame:
    """A stream of documents whose counts ProgressListener receives."""
    return docs.observe(OBSERVED, *_measures())


class ProgressListener(StreamingQueryListener):
    """Calls ``on_progress`` with the rows (label, batch, format, documents, characters) of each micro-batch that had any.

    The label is the query's name, or its id. An event may come twice after a failure; the batch number tells.
    Register with ``spark.streams.addListener``.
    """

    def __init__(self, on_progress: Callable[[list[tuple]], None]):
        self.on_progress = on_progress

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if OBSERVED in p.observedMetrics and (rows := _rows(p.observedMetrics[OBSERVED].asDict(), p.name or str(p.id), p.batchId)):
            self.on_progress(rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def load_with_progress(docs: DataFrame, out: str, checkpoint: str, label: str) -> StreamingQuery:
    """Append a stream of documents to ``out``, counted for ProgressListener."""
    return observed(docs).writeStream.queryName(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
