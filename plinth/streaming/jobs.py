"""Structured Streaming: scoring, windows, sessions, deduplication, drift and running statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 10) -> DataFrame:
    """A stream of new Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of tumbling or sliding windows; rows later than the watermark are left out."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    g = stream.withWatermark(time, late).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows closer than the gap."""
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def alerts(stream: DataFrame, value: str, bounds: dict[str, float]) -> DataFrame:
    """Rows with the name of the highest bound that the value is over; rows under all bounds are left out."""
    level = None
    for name, bound in sorted(bounds.items(), key=lambda x: -x[1]):
        level = F.when(F.col(value) > bound, name) if level is None else level.when(F.col(value) > bound, name)
    return stream.withColumn("alert", level).where("alert IS NOT NULL")


def score(stream: DataFrame, model: PipelineModel, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Score each micro-batch with a fitted pipeline and hand it to a sink; the sink should be idempotent by batch id."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: sink(model.transform(batch), i))
    return writer.trigger(availableNow=True).start() if once else writer.start()


class RunningMeans:
    """Mini-batch k-means: centres move toward the mean of each batch's points by their share of all points so far."""

    def __init__(self, centres: list[list[float]]):
        self.centres, self.counts = [list(c) for c in centres], [0] * len(centres)

    def update(self, batch: DataFrame, vector: str) -> None:
        """One aggregation a batch: at most a row for each centre and dimension reaches the driver."""
        distance = lambda c: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        d = F.array(*[distance(c) for c in self.centres])
        near = batch.select((F.array_position(d, F.array_min(d)) - 1).alias("c"), F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("i", "x"))
        for r in near.groupBy("c", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).collect():
            c = int(r["c"])
            share = r["n"] / (self.counts[c] + r["n"])
            self.centres[c][r["i"]] += share * (r["m"] - self.centres[c][r["i"]])
            if r["i"] == len(self.centres[c]) - 1:
                self.counts[c] += r["n"]


def drift(batch: DataFrame, reference: DataFrame, value: str, level: float = 0.05) -> dict:
    """Two-sample Kolmogorov-Smirnov test of a batch against reference rows."""
    from plinth.operators.stats import ks_two_sample

    both = batch.select(value, F.lit(True).alias("_new")).unionByName(reference.select(value, F.lit(False).alias("_new")))
    found = ks_two_sample(both, value, F.col("_new"))
    return {**found, "drift": found["p"] < level}
