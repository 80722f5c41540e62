"""Synthetic tables from a seed: each value is a function of its row number, so partitions do not matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) from a hash of the row and a seed."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), *map(F.lit, keys)), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, *keys) -> Column:
    """A standard normal number by Box and Muller."""
    u, v = uniform(seed, "u", *keys), uniform(seed, "v", *keys)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def regression(spark: SparkSession, n: int, features: int = 5, noise: float = 0.1, bias: float = 0.0, seed: int = 42) -> DataFrame:
    """x0.. normal, y linear in them with weights 1, -1/2, 1/3, ..."""
    df = spark.range(n).select("id", *[normal(seed, i).alias(f"x{i}") for i in range(features)])
    weights = [(-1) ** i / (i + 1) for i in range(features)]
    y = sum((F.col(f"x{i}") * w for i, w in enumerate(weights)), F.lit(bias))
    return df.withColumn("y", y + noise * normal(seed, "noise")).drop("id")


def classification(spark: SparkSession, n: int, features: int = 5, complexity: str = "linear", seed: int = 42) -> DataFrame:
    """Two classes split by a plane, by a circle, or by both."""
    df = spark.range(n).select("id", *[normal(seed, i).alias(f"x{i}") for i in range(features)])
    a, b = F.col("x0") + F.col("x1") > 0, F.col("x0") * F.col("x0") + F.col("x1") * F.col("x1") > 1.4
    rules = {"linear": a, "medium": b, "high": (a & b) | (~a & ~b)}
    if complexity not in rules:
        raise ValueError(f"Unknown complexity level: {complexity}")
    return df.withColumn("y", rules[complexity].cast("int")).drop("id")


def imbalanced(spark: SparkSession, n: int, ratio: float = 0.1, features: int = 5, seed: int = 42) -> DataFrame:
    """minority / majority about ratio; the minority is shifted."""
    df = spark.range(n).withColumn("y", (uniform(seed, "y") < ratio / (1 + ratio)).cast("int"))
    return df.select(*[(normal(seed, i) + 1.5 * F.col("y")).alias(f"x{i}") for i in range(features)], "y")


def blobs(spark: SparkSession, n: int, centres: int = 3, features: int = 2, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """Clusters around points on a circle; noise points have label -1."""
    df = spark.range(n).withColumn("label", F.when(uniform(seed, "noise") < noise, -1).otherwise(F.floor(uniform(seed, "c") * centres)).cast("int"))
    at = lambda i: (F.cos if i % 2 == 0 else F.sin)(2 * math.pi * F.col("label") / centres + i) * 8
    return df.select(*[F.when(F.col("label") < 0, 24 * uniform(seed, i) - 12).otherwise(at(i) + normal(seed, i)).alias(f"x{i}") for i in range(features)], "label")


def anomalies(spark: SparkSession, n: int, contamination: float = 0.1, features: int = 3, seed: int = 42) -> DataFrame:
    """label -1 for outliers, 1 for others, in mixed order."""
    if not 0 < contamination < 1:
        raise ValueError("contamination must be between 0 and 1")
    df = spark.range(n).withColumn("label", F.when(uniform(seed, "out") < contamination, -1).otherwise(1))
    return df.select(*[F.when(F.col("label") < 0, normal(seed, i) * 2 + F.signum(normal(seed, i, "s")) * 8).otherwise(normal(seed, i)).alias(f"x{i}") for i in range(features)], "label")


def seasonal(spark: SparkSession, days: int = 365, start: str = "2023-01-01", trend: float = 0.1, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """A daily series with a trend and periods of 7 and 30 days, with calendar parts."""
    i = F.col("id")
    y = 50 + trend * i + 5 * F.sin(2 * math.pi * i / 7) + 8 * F.sin(2 * math.pi * i / 30) + noise * normal(seed, "noise")
    df = spark.range(days).select(F.date_add(F.lit(start).cast("date"), i.cast("int")).alias("date"), y.alias("y"))
    return df.withColumns({"day_of_week": F.weekday("date"), "day_of_month": F.dayofmonth("date"), "month": F.month("date")})


def mixed(spark: SparkSession, n: int, numbers: int = 5, categories: int = 3, ordinals: int = 2, seed: int = 42) -> DataFrame:
    """num_*, cat_* and ord_* columns."""
    pick = lambda values, *keys: F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(seed, *keys) * len(values)) + 1).cast("int"))
    columns = [normal(seed, "n", i).alias(f"num_{i}") for i in range(numbers)] + [pick("ABCD", "c", i).alias(f"cat_{i}") for i in range(categories)]
    return spark.range(n).select(*columns, *[pick(["low", "medium", "high"], "o", i).alias(f"ord_{i}") for i in range(ordinals)])


def collinear(spark: SparkSession, n: int, groups: int = 2, size: int = 3, seed: int = 42) -> DataFrame:
    """Groups of columns that share a factor, correlation over 0.8 within, and a target of the factors."""
    columns = [(normal(seed, "f", g) + 0.3 * normal(seed, "e", g, k)).alias(f"x{g}_{k}") for g in range(groups) for k in range(size)]
    return spark.range(n).select(*columns, sum((normal(seed, "f", g) * (g + 1) for g in range(groups)), 0.1 * normal(seed, "y")).alias("y"))


def suite(spark: SparkSession, n: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """Named tables of all kinds."""
    return {
        "regression": regression(spark, n, seed=seed), "collinear": collinear(spark, n, seed=seed), "linear": classification(spark, n, seed=seed), "medium": classification(spark, n, complexity="medium", seed=seed),
        "high": classification(spark, n, complexity="high", seed=seed), "imbalanced": imbalanced(spark, n, seed=seed), "blobs": blobs(spark, n, seed=seed), "anomalies": anomalies(spark, n, seed=seed),
        "seasonal": seasonal(spark, n, seed=seed), "mixed": mixed(spark, n, seed=seed),
    }
