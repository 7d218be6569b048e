"""Percentiles of narrowly lying values, and histograms as tables and as streams."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import metrics


def nearest(values, p):
    return sorted(values)[max(1, (len(values) * p + 99) // 100) - 1]


def test_narrow_buckets_are_refined_to_the_exact_value(spark):
    rng = random.Random(6)
    values = {"narrow": [30_000 + rng.random() for _ in range(3000)], "equal": [5.0] * 2000, "two": [1.0, 1.0000000001] * 600, "wide": [rng.lognormvariate(0, 9) * rng.choice([1, -1]) for _ in range(900)], "few": [1.5, 2.5], "skewed": [7.0] * 1500 + [7.0 + k * 1e-12 for k in range(1500)]}
    rows = spark.createDataFrame([(k, float(v)) for k, held in values.items() for v in held] + [("none", None), (None, 3.0)], "k string, v double")
    want = {k: [nearest(held, p) for p in (50, 95, 99)] for k, held in values.items()} | {None: [3.0] * 3}
    for cell_rows in (10, 400, 1_000_000):
        assert {r.k: [r.p50, r.p95, r.p99] for r in metrics.exact_percentiles(rows, "k", "v", cell_rows=cell_rows).collect()} == want


def test_many_values_in_one_bucket(spark):
    """No task of the last step ranks more than a cell's rows: the cells that are left tell."""
    rows = spark.range(2_000_000, numPartitions=8).select(F.lit("k").alias("k"), (30_000 + (F.col("id") * 7919 % 2_000_000) / 1e5).alias("v"))
    out = metrics.exact_percentiles(rows, "k", "v", cell_rows=20_000).first()
    assert [out.p50, out.p95, out.p99] == [pytest.approx(30_000 + x / 1e5, abs=1e-9) for x in (999_999, 1_899_999, 1_979_999)]


@pytest.fixture
def operations(spark):
    rng = random.Random(8)
    rows = [(f"op{rng.randrange(3)}", 1_700_000_000 + rng.randrange(20_000), rng.lognormvariate(3, 2), rng.random() < 0.9) for _ in range(3000)] + [("op0", 1_700_000_000, None, True)]
    made = spark.createDataFrame(rows, "operation string, at long, duration double, success boolean")
    return made.select("operation", F.timestamp_seconds("at").alias("ended"), "duration", "success")


def test_streamed_histograms_equal_those_of_the_table(spark, operations, tmp_path):
    late = operations.unionByName(operations.limit(1).select("operation", (F.lit("2030-01-01").cast("timestamp")).alias("ended"), "duration", "success"))  # closes all windows
    late.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(late.schema).parquet(str(tmp_path / "in"))
    query = metrics.histograms(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    own = lambda df: sorted((r.operation, r.window_start, r.bucket, r["count"], r.failure_count, round(r.total, 6), r.least, r.most) for r in df.collect())
    assert own(spark.read.parquet(str(tmp_path / "out"))) == own(metrics.histograms(operations))


def test_merged_percentiles_are_within_a_bucket(operations):
    rolled = metrics.histograms(operations)
    got = {r.operation: r for r in metrics.merged_percentiles(rolled.filter("hour(window_start) % 2 = 0").unionByName(rolled.filter("hour(window_start) % 2 = 1"))).collect()}
    held = {}
    for r in operations.filter("duration is not null").collect():
        held.setdefault(r.operation, []).append(r.duration)
    for k, values in held.items():
        assert got[k]["count"] == len(values)
        for p in (50, 95, 99):
            exact = nearest(values, p)
            assert exact <= got[k][f"p{p}"] <= (1 + exact) * 1.0051 - 1 + 1e-9
