"""Resumable page tasks: what is left to do, what was done, and what can be forgotten.

Pages are rows of (task_id, page, status, text, error, duration_ms, at), appended as they
are processed; tasks are (task_id, total, ...). Everything else is derived by queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, PROCESSING, COMPLETED, FAILED, CANCELLED = "pending", "processing", "completed", "failed", "cancelled"
SUCCESS, PAGE_FAILED, SKIPPED = "success", "failed", "skipped"


def pages_to_process(tasks: DataFrame, done: DataFrame, skip: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(task_id, page): pages 1 to total, or those of ``only`` within it, without those done or skipped.

    ``done`` has the pages processed with success, so failed pages come again.
    """
    if only is None:
        pages = tasks.filter("total >= 1").select("task_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total").cast("bigint"))).alias("page"))
    else:
        wanted = only.select("task_id", F.col("page").cast("bigint").alias("page")).distinct()
        pages = tasks.join(wanted, "task_id").filter("page between 1 and total").select("task_id", "page")
    for gone in (done, skip):
        if gone is not None:
            pages = pages.join(gone.select("task_id", F.col("page").cast("bigint").alias("page")), ["task_id", "page"], "left_anti")
    return pages


RESULT = "task_id long, page long, status string, text string, error string, duration_ms long, at timestamp"


def process_pages(pages: DataFrame, work: Callable[[int, int], str]) -> DataFrame:
    """Run ``work(task_id, page)`` for every page; a failure is a row, not the end of the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for task, page in zip(batch["task_id"].tolist(), batch["page"].tolist(), strict=True):
                began = pd.Timestamp.now("UTC").tz_localize(None)
                try:
                    text, status, error = work(task, page), SUCCESS, None
                except Exception as e:  # the caller's code may fail in any way
                    text, status, error = None, PAGE_FAILED, str(e)
                took = pd.Timestamp.now("UTC").tz_localize(None) - began
                rows.append((task, page, status, text, error, int(took.total_seconds() * 1000), began))
            yield pd.DataFrame(rows, columns=["task_id", "page", "status", "text", "error", "duration_ms", "at"])

    return pages.select(F.col("task_id").cast("long"), F.col("page").cast("long")).mapInPandas(run, RESULT)


def progress(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """(task_id, total, completed, failed, percentage, status) by task.

    Pages count once in each set; a page that failed and then succeeded is in both. A task
    is over once both sets together reach its total, and failed if no page succeeded. If
    ``tasks`` has a boolean column ``cancelled``, it tells which were stopped.
    """
    sets = pages.groupBy("task_id").agg(F.count_distinct(F.when(F.col("status") == SUCCESS, F.col("page"))).alias("completed"), F.count_distinct(F.when(F.col("status") == PAGE_FAILED, F.col("page"))).alias("failed"))
    stopped = F.col("cancelled") if "cancelled" in tasks.columns else F.lit(False)
    joined = tasks.select("task_id", F.col("total").cast("bigint").alias("total"), F.coalesce(stopped, F.lit(False)).alias("stopped")).join(sets, "task_id", "left").na.fill(0, ["completed", "failed"])
    seen = F.col("completed") + F.col("failed")
    status = F.when(F.col("stopped"), CANCELLED).when((F.col("total") > 0) & (seen >= F.col("total")), F.when((F.col("failed") > 0) & (F.col("completed") == 0), FAILED).otherwise(COMPLETED)).when(seen > 0, PROCESSING).otherwise(PENDING)
    share = F.when(F.col("total") > 0, F.floor(seen * 100 / F.col("total"))).otherwise(0).cast("bigint")
    return joined.select("task_id", "total", "completed", "failed", share.alias("percentage"), status.alias("status"))


def full_text(pages: DataFrame) -> DataFrame:
    """(task_id, text): texts of successful pages in order, between blank lines; the last result of a page counts."""
    last = pages.filter(F.col("status") == SUCCESS).groupBy("task_id", "page").agg(F.max_by("text", "at").alias("text")).filter("text <> ''")
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    return last.groupBy("task_id").agg(F.array_join(rows["text"], "\n\n").alias("text"))


def without_old(tasks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Tasks that have not ended, or not longer than ``days`` ago."""
    return tasks.filter(F.col("end_time").isNull() | (F.col("end_time") >= now - F.make_dt_interval(days=F.lit(days))))


def without_tasks(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages of tasks that aren't deleted."""
    return pages.join(gone.select("task_id"), "task_id", "left_anti")
