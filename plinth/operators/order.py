"""Global ranks and exact quantiles: values are ranged over tasks, and each range is shifted by the rows before it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plinth.sources.tables import durable


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """df in ranges of the order, with the number of the range; written, so that the ranges stay as they are."""
    return durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _shift(parts: DataFrame, size: Column) -> DataFrame:
    """(_part, _shift): the sum of size over the ranges before; one row a range."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("_part").agg(size.alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with the place of each row in a global order, from 1. No task sees more than one range."""
    parts = _ranged(df, order)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = parts.withColumn("_row", inside).join(F.broadcast(_shift(parts, F.count(F.lit(1)))), "_part")
    return placed.withColumn(out, (F.col("_shift") + F.col("_row")).cast("long")).drop("_part", "_row", "_shift")


def tile(place: Column, n: Column, tiles: int) -> Column:
    """The tile 1..tiles of a place from 1 among n rows; the first tiles take the rows left over."""
    small, over = F.floor(n / tiles), n % tiles
    late = F.when(small > 0, F.floor((place - 1 - over * (small + 1)) / F.greatest(small, F.lit(1))) + over + 1)
    return F.when(place <= over * (small + 1), F.floor((place - 1) / (small + 1)) + 1).otherwise(late).cast("long")


def quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of columns, nulls left out; null without values.

    Equal values are counted first and ranged; only the values around the wanted places reach the driver.
    """
    out = {}
    for column, ps in wanted.items():
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts = _ranged(counts, ["v"])
        n = parts.agg(F.sum("n")).first()[0] or 0
        if not n:
            out[column] = [None] * len(ps)
            continue
        places = [p * (n - 1) for p in ps]
        value = _at(parts, {f for x in places for f in (math.floor(x), math.ceil(x))})
        out[column] = [_between(value, x) for x in places]
    return out


def _at(parts: DataFrame, ranks: set[int]) -> dict[int, float]:
    """The values at the ranks, from 0, of ranged values v that occur n times each."""
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("v"))
    spans = parts.withColumn("_end", upto).join(F.broadcast(_shift(parts, F.sum("n"))), "_part").select("v", (F.col("_shift") + F.col("_end") - F.col("n")).alias("a"), (F.col("_shift") + F.col("_end")).alias("b"))
    hit = spans.withColumn("rank", F.explode(F.filter(F.array(*map(F.lit, sorted(ranks))), lambda r: (r >= F.col("a")) & (r < F.col("b"))))).collect()  # at most two for each quantile
    return {r["rank"]: r["v"] for r in hit}


def _between(value: dict[int, float], x: float) -> float:
    low, high = value[math.floor(x)], value[math.ceil(x)]
    return low + (high - low) * (x - math.floor(x))


def quantile(df: DataFrame, column: str, p: float, accuracy: int = 10_000) -> float | None:
    """One exact quantile as `quantiles` gives it, for a column of many different values.

    A sketch says between which values it lies; all others are only counted below and above. Where the counts show
    that it lies elsewhere, all values are ranged.
    """
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    bounds = v.agg(F.percentile_approx("v", [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)], accuracy).alias("q")).first()["q"]
    if bounds is None:
        return None
    side = F.when(F.col("v") < bounds[0], -1).when(F.col("v") > bounds[1], 1).otherwise(0)
    counts = durable(v.groupBy(side.alias("side"), F.when(side == 0, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    n = {r["side"]: r["n"] for r in counts.groupBy("side").agg(F.sum("n").alias("n")).collect()}
    x, below = p * (sum(n.values()) - 1), n.get(-1, 0)
    if not below <= math.floor(x) <= math.ceil(x) < below + n.get(0, 0):
        return quantiles(df, {column: [p]})[column][0]
    value = _at(_ranged(counts.where("side = 0").select("v", "n"), ["v"]), {math.floor(x) - below, math.ceil(x) - below})
    return _between({k + below: found for k, found in value.items()}, x)
