"""Streams of files, driven to their end, give what the batch plan gives."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import generators
from plinth.streaming import jobs


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"), "id")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    return jobs.file_stream(spark, f"{tmp_path}/in", rows.schema), rows


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_add_up(spark, events):
    stream, rows = events
    out = run(spark, jobs.windowed(stream, "ts", ["k"], "v", "1 hour", late="10 hours"), "w", "complete")
    assert out.agg(F.sum("n")).first()[0] == rows.count() and out.agg(F.sum("total")).first()[0] == sum(range(200))


def test_alerts_and_duplicates(spark, events):
    stream, _ = events
    assert run(spark, jobs.alerts(stream, "v", {"high": 150, "top": 190}), "a").groupBy("alert").count().orderBy("alert").collect() == [("high", 40), ("top", 9)]
    assert run(spark, jobs.deduplicated(stream, "ts", ["k"], "100 hours"), "d").count() == 3


def test_drift(spark):
    a, b = spark.range(500).select((F.col("id") / 500).alias("v")), spark.range(500).select((F.col("id") / 500 + 0.4).alias("v"))
    assert jobs.drift(b, a, "v")["drift"] and not jobs.drift(a, a, "v")["drift"]


def test_running_means(spark):
    means = jobs.RunningMeans([[0.0, 0.0], [10.0, 10.0]])
    batch = spark.createDataFrame([([1.0, 1.0],), ([1.0, 3.0],), ([9.0, 9.0],)], "x array<double>")
    means.update(batch, "x")
    assert means.centres == [[1.0, 2.0], [9.0, 9.0]]


def test_generators(spark):
    tables = generators.suite(spark, 300)
    assert all(t.count() == 300 for t in tables.values())
    with pytest.raises(ValueError, match="Unknown complexity level"):
        generators.classification(spark, 5, complexity="odd")
    with pytest.raises(ValueError, match="contamination"):
        generators.anomalies(spark, 5, 1.5)
    r = generators.collinear(spark, 2000).agg(F.corr("x0_0", "x0_1")).first()[0]
    assert r > 0.8
