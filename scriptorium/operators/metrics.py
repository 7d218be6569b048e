"""Operation metrics over a table of (operation, started, ended, duration, success, error)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import work_folder

PERCENTILES = (50, 95, 99)


#: Buckets of a value's magnitude, for each time that it grows e-fold; parts that a bucket of too many rows is cut into; rows that are ranked in one task at most.
_BUCKETS, _PARTS, CELL_ROWS = 200, 1024, 1_000_000


def magnitude(value: Column) -> Column:
    """The bucket of a value, half a percent wide; NaN has its own, above all others."""
    size = F.floor(F.log(1 + F.abs(value)) * _BUCKETS).cast("double") * F.signum(value)
    return F.when(F.isnan(value), value).otherwise(size)


def _ranks(percents: tuple[int, ...]) -> Column:
    """An array of (p, rank) of the nearest ranks among ``total`` values."""
    return F.array(*[F.struct(F.lit(p).alias("p"), F.expr(f"greatest(1, (total * {p} + 99) div 100)").alias("rank")) for p in percents])


def exact_percentiles(rows: DataFrame, key: str, value: str, percents: tuple[int, ...] = PERCENTILES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Nearest-rank percentiles of each key as columns p50 and so on; null values don't count.

    A first pass counts values in buckets of their magnitude and finds the bucket of each
    rank. While such a bucket holds more than ``cell_rows`` rows and more than one value, another pass counts
    it in equal parts between its least and largest value, and goes on with the part of the rank. What is left is ranked
    by its distinct values. Counts are combined before they are sent, so no task gets more than ``cell_rows`` values of a key, however
    narrowly they lie; most tables need no pass between the first and the last.
    """
    spark = rows.sparkSession
    place = work_folder(spark, "percentiles")
    held = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null").withColumn("b", magnitude(F.col("v")))
    span = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    upto = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = held.groupBy("k", "b").agg(*span).withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    wanted = counts.withColumn("r", F.explode(_ranks(percents))).filter("r.rank <= upto and r.rank > upto - n")
    wanted = wanted.select("k", "b", "lo", "hi", "n", F.col("r.p").alias("p"), (F.col("r.rank") - F.col("upto") + F.col("n")).alias("rank"))
    cell = ["k", "b", "lo", "hi"]

    def inside(cells: DataFrame) -> DataFrame:
        """The rows of some cells; a cell's bucket is found by equality, the cell within it by comparison."""
        named = cells.select(*[F.col(c).alias(f"c_{c}") for c in cell]).distinct()
        found = held.join(named, F.col("k").eqNullSafe(F.col("c_k")) & (F.col("b") == F.col("c_b")) & F.col("v").between(F.col("c_lo"), F.col("c_hi")))
        return found.select("v", *[F.col(f"c_{c}").alias(c) for c in cell])

    for number in itertools.count():
        wanted.write.parquet(f"{place}/{number}")
        wanted = spark.read.parquet(f"{place}/{number}")
        large = (F.col("n") > cell_rows) & (F.col("lo") < F.col("hi"))
        if wanted.filter(large).isEmpty():
            break
        part = F.least(F.lit(_PARTS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * _PARTS)).alias("part")
        parts = inside(wanted.filter(large)).groupBy(*cell, part).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("from"), F.max("v").alias("to"))
        parts = parts.withColumn("upto", F.sum("m").over(Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
        finer = _same_cell(parts, wanted.filter(large), "p", "rank").filter("rank <= upto and rank > upto - m")
        finer = finer.select("k", "b", F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("m").alias("n"), "p", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
        wanted = wanted.filter(~large).unionByName(finer)

    one = F.col("lo") == F.col("hi")
    values = inside(wanted.filter(~one)).groupBy(*cell, "v").agg(F.count(F.lit(1)).alias("m"))
    values = values.withColumn("upto", F.sum("m").over(Window.partitionBy(*cell).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    values = _same_cell(values, wanted.filter(~one), "p", "rank").filter("rank <= upto and rank > upto - m").select("k", "p", "v")
    every = wanted.filter(one).select("k", "p", F.col("lo").alias("v")).unionByName(values)
    return every.groupBy(F.col("k").alias(key)).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def _same_cell(left: DataFrame, cells: DataFrame, *more: str) -> DataFrame:
    right = cells.select(*[F.col(c).alias(f"w_{c}") for c in ("k", "b", "lo", "hi")], *more)
    on = F.col("k").eqNullSafe(F.col("w_k"))
    for c in ("b", "lo", "hi"):
        on = on & (F.col(c) == F.col(f"w_{c}"))
    return left.join(right, on).drop(*[f"w_{c}" for c in ("k", "b", "lo", "hi")])


def histograms(operations: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(operation, window_start, bucket, count, failure_count, total, least, most): a roll-up table of durations by magnitude; works on streams too.

    Rows of several windows, or of several tables, merge by adding them up; see merged_percentiles().
    """
    timed = operations.withWatermark("ended", late) if operations.isStreaming else operations
    timed = timed.filter("duration is not null")
    by = timed.groupBy(F.window("ended", window).alias("window"), "operation", magnitude(F.col("duration").cast("double")).alias("bucket"))
    rolled = by.agg(F.count(F.lit(1)).alias("count"), F.sum((~F.col("success")).cast("bigint")).alias("failure_count"), F.sum("duration").alias("total"), F.min("duration").alias("least"), F.max("duration").alias("most"))
    return rolled.select("operation", F.col("window.start").alias("window_start"), "bucket", "count", "failure_count", "total", "least", "most")


def merged_percentiles(rolled: DataFrame, percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(operation, count, p50, ...) of histogram rows put together: the largest value of the bucket of each nearest rank, so at most a bucket's width above it."""
    merged = rolled.groupBy("operation", "bucket").agg(F.sum("count").alias("n"), F.max("most").alias("most"))
    upto = Window.partitionBy("operation").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("operation")))
    found = counts.withColumn("r", F.explode(_ranks(percents))).filter("r.rank <= upto and r.rank > upto - n")
    return found.groupBy("operation").agg(F.max("total").alias("count"), *[F.max(F.when(F.col("r.p") == p, F.col("most"))).alias(f"p{p}") for p in percents])


def _rollup(operations: DataFrame, *more: Column) -> DataFrame:
    failed = (~F.col("success")).cast("bigint")
    rolled = operations.groupBy("operation").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.col("success").cast("bigint")).alias("success_count"),
        F.sum(failed).alias("failure_count"),
        (F.sum(failed) / F.count(F.lit(1))).alias("error_rate"),
        F.sum("duration").alias("total_duration"),
        F.avg("duration").alias("avg_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        *more,
    )
    ranked = exact_percentiles(operations, "operation", "duration").withColumnRenamed("operation", "ranked")
    return rolled.join(ranked, F.col("operation").eqNullSafe(F.col("ranked")), "left").drop("ranked")


def aggregate_metrics(operations: DataFrame, now: Column | None = None) -> DataFrame:
    """Counts, error rate, durations, nearest-rank percentiles and throughput of finished operations, one row each.

    Throughput is operations a second between the first start and ``now`` (default: the last end).
    """
    finished = operations.filter("duration is not null")
    until = F.lit(None).cast("timestamp") if now is None else now
    seconds = (F.unix_micros(F.coalesce(until, F.max("ended"))) - F.unix_micros(F.min("started"))) / 1e6
    return _rollup(finished, F.when(seconds > 0, F.count(F.lit(1)) / seconds).otherwise(0.0).alias("throughput"))


def concurrency(operations: DataFrame) -> DataFrame:
    """Operations begun and not ended, by name."""
    return operations.groupBy("operation").agg(F.sum(F.col("ended").isNull().cast("bigint")).alias("running"))


def realtime_metrics(operations: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """The same over operations that ended in the last ``seconds``; throughput is their number over that time."""
    recent = operations.filter(F.col("ended") > now - F.make_dt_interval(secs=F.lit(seconds))).filter("duration is not null")
    return _rollup(recent, (F.count(F.lit(1)) / F.lit(float(seconds))).alias("throughput"))


def slow_operations(operations: DataFrame, threshold: float = 5000) -> DataFrame:
    """Operations over the threshold, slowest first."""
    return operations.filter(F.col("duration") > threshold).orderBy(F.desc("duration"))


def last_errors(operations: DataFrame, limit: int = 100, chronological: bool = True) -> DataFrame:
    """The last failures; by name of operation, first seen first, unless ``chronological``."""
    failures = operations.filter(~F.col("success"))
    if chronological:
        return failures.orderBy(F.desc("started"), F.desc("operation")).limit(limit)
    seen = operations.groupBy("operation").agg(F.min("started").alias("first_seen"))
    return failures.join(seen, "operation").orderBy(F.desc("first_seen"), F.desc("operation"), F.desc("started")).limit(limit).drop("first_seen")


def close_stale(operations: DataFrame, now: Column, threshold_ms: int = 300_000) -> DataFrame:
    """Operations that never ended and are older than the threshold become failures."""
    age = (F.unix_micros(now) - F.unix_micros("started")) / 1000
    stale = F.col("ended").isNull() & (age > threshold_ms)
    return operations.withColumns({
        "success": F.when(stale, False).otherwise(F.col("success")),
        "error": F.when(stale, "operation timed out or was never ended").otherwise(F.col("error")),
        "duration": F.when(stale, age).otherwise(F.col("duration")),
        "ended": F.when(stale, now).otherwise(F.col("ended")),
    })


def cache_statistics(probes: DataFrame) -> DataFrame:
    """Hit rates from rows (level, hit): one row for each level and one, ``all``, for both; a miss in the first level and a hit in the second are two probes."""
    rate = F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate")
    counts = [F.sum(F.col("hit").cast("bigint")).alias("hits"), F.sum((~F.col("hit")).cast("bigint")).alias("misses"), rate]
    return probes.rollup("level").agg(*counts).withColumn("level", F.coalesce("level", F.lit("all")))


def health(checks: DataFrame) -> DataFrame:
    """One status from rows (component, up): up, down, or degraded if they differ."""
    up = F.when(F.bool_and("up"), "up").when(~F.bool_or("up"), "down").otherwise("degraded")
    return checks.agg(F.coalesce(up, F.lit("up")).alias("status"), F.count(F.lit(1)).alias("components"))
