"""Named tables of a folder of Parquet files, and file sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables:
    """Tables of a folder by attribute: Tables(spark, dir).orders reads dir/orders.parquet lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, target: str | None = None):
    """A CSV file with a header; with `target` the pair (features, target column). Give a schema to skip inference."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if target is None:
        return df
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    return df.drop(target), df.select(target)


def write_csv(df: DataFrame, path: str, target: str | None = None) -> None:
    """Write a CSV folder with headers, the target column last."""
    columns = [c for c in df.columns if c != target] + ([target] if target in df.columns else [])
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def log_experiment(spark: SparkSession, folder: str, name: str, params: dict, metrics: dict) -> None:
    """Append one run to a folder of JSON files."""
    row = (name, json.dumps(params), json.dumps(metrics))
    df = spark.createDataFrame([row], "name string, params string, metrics string").withColumn("at", F.current_timestamp())
    df.coalesce(1).write.mode("append").json(folder)


def read_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of a folder, unreadable lines left out; parameters and metrics become param_* and metric_* columns."""
    schema = "name string, params string, metrics string, at timestamp, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(folder).where("_bad IS NULL AND name IS NOT NULL").drop("_bad")
    parsed = rows.withColumn("p", F.from_json("params", "map<string,string>")).withColumn("m", F.from_json("metrics", "map<string,double>"))
    keys = parsed.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys(c))))).alias(c) for c in "pm"]).first()
    extra = [F.col("p")[k].alias(f"param_{k}") for k in keys["p"]] + [F.col("m")[k].alias(f"metric_{k}") for k in keys["m"]]
    return parsed.select("name", "at", *extra)


def date_range(spark: SparkSession, start: str, days: int) -> DataFrame:
    """One row a day from start."""
    return spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"))


def latest_interactions(df: DataFrame, user: str, item: str, time: str, tie: str) -> DataFrame:
    """The last row of each (user, item) by time, then by the unique tie column; one aggregation, no window."""
    order = F.struct(time, tie)
    return df.groupBy(user, item).agg(F.max_by(F.struct(*df.columns), order).alias("_last")).select("_last.*")


def durable(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder of spark.checkpoint.dir, which all machines share, and read back.

    Where the setting is absent and the master is local, a temporary folder is set.
    """
    import tempfile
    import uuid

    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="plinth-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/durable/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
