"""A Spark session with the settings that the library's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Time stamps are in UTC, and the later of two equal metadata keys wins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """The active session, or a new one, with SETTINGS and ``more`` (dots as double underscores)."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    spark = builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``, which driver and executors share; only a local session may go without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/scriptorium/{name}-{uuid.uuid4().hex}"
