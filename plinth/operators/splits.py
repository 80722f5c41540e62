"""Splits, folds and resampling that are the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.operators import order
from plinth.operators.order import numbered, tile


def hash_split(df: DataFrame, keys: list[str], test: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: no shuffle, and a key keeps its side when the table grows."""
    u = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000))
    return df.where(u >= int(test * 1_000_000)), df.where(u < int(test * 1_000_000))


def stratified(df: DataFrame, label: str, order: list[str], test: float) -> DataFrame:
    """Marks with is_test the first floor(test * n) rows of each class in a given order."""
    w = Window.partitionBy(label)
    i, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return df.withColumn("is_test", i <= F.floor(F.lit(test) * n))


def should_stratify(df: DataFrame, label: str) -> bool:
    """At most 20 classes, fewer than half as many as rows, and two rows in each."""
    r = df.groupBy(label).count().agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("least"), F.sum("count").alias("n")).first()
    return r["k"] <= 20 and r["k"] < 0.5 * (r["n"] or 0) and (r["least"] or 0) >= 2


def chronological(df: DataFrame, time: str, train: float, valid: float) -> DataFrame:
    """Adds part: train, valid or test by exact quantiles of the time."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    a, b = order.quantiles(df.select(seconds.alias("s")), {"s": [train, train + valid]})["s"]
    return df.withColumn("part", F.when(seconds <= F.lit(a), "train").when(seconds <= F.lit(b), "valid").otherwise("test"))


def modulo_folds(df: DataFrame, key: str, folds: int) -> DataFrame:
    """Adds fold: the key modulo the number of folds. With a group's key, a group stays in one fold."""
    return df.withColumn("fold", F.pmod(F.col(key), F.lit(folds)).cast("long"))


def hash_folds(df: DataFrame, keys: list[str], folds: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("long"))


def expanding_folds(df: DataFrame, by: list[str], folds: int) -> DataFrame:
    """Sizes of expanding folds: fold f trains on the first f of folds+1 equal parts and tests on the next."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    part = numbered(df.select(*by), by, "_i").join(F.broadcast(n)).select(tile(F.col("_i"), F.col("_n"), folds + 1).alias("b"))
    sizes = part.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    listed = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    return sizes.select("b", "c", listed).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.sum(F.when(F.col("b") <= F.col("fold"), F.col("c")).otherwise(0)).alias("train"), F.sum(F.when(F.col("b") == F.col("fold") + 1, F.col("c")).otherwise(0)).alias("test"))


def undersample(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """The first rows of each class, as many as the rarest class has."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    i = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("_i", i).join(F.broadcast(least)).where("_i <= _least").drop("_i", "_least")


def bootstrap(df: DataFrame, keys: list[str], rounds: int, seed: int = 42) -> DataFrame:
    """A row for each round and draw: rows are drawn Poisson(1) times by a hash, so rounds need no collection."""
    u = F.pmod(F.xxhash64(*keys, "round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    edges, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 9):
        total += p
        edges.append(total)
        p /= k
    times = sum((F.when(u >= e, 1).otherwise(0) for e in edges[1:]), F.when(u >= edges[0], 1).otherwise(0))
    rows = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = rows.withColumn("_times", times).where("_times > 0")
    return drawn.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_draw")
